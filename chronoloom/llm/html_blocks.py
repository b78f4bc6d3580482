"""Leaf blocks of a page: runs of text between block boundaries, with the elements around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed sets of element names, as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text that do not end a block.
WITHIN = frozenset("area embed img input link meta param source track".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style title noscript template iframe noembed noframes object canvas svg math audio video textarea select option button datalist head".split())
#: An opening tag of the first kind ends an open element of the second kind.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol table dl article section div body main aside nav form td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s"'=<>/]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")
_NAMES = ("class", "id", "role", "aria-label", "itemprop")


@dataclass
class Block:
    """The text of one leaf block and where it stands."""

    text: str
    path: tuple[tuple[str, str], ...]  # elements around it, outermost first: name, and what class, id and role say
    link_chars: int = 0


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0


def blocks(page: str) -> list[Block]:
    """The visible leaf blocks in page order. Broken or cut markup never raises."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    inline: list[str] = []
    now = _Open()
    hidden = 0  # unseen elements that are open

    def flush() -> None:
        nonlocal now
        text = _SPACE.sub(" ", html.unescape("".join(now.parts))).strip()
        if text:
            out.append(Block(text, tuple(stack), now.link_chars))
        now = _Open()

    def close(k: int) -> None:
        nonlocal hidden
        flush()
        hidden -= sum(n in UNSEEN or said == "!hidden" for n, said in stack[k:])
        del stack[k:]

    def said(text: str) -> None:
        if text and not hidden:
            now.parts.append(text)
            if "a" in inline:
                now.link_chars += len(text.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in INLINE:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name)]
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            else:
                flush()
            continue
        if name == "br":
            if not hidden:
                now.parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                inline = [x for x in inline if x != "a"]
            inline.append(name)
            continue
        if name in WITHIN:
            continue
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in STOPS:
                    break
        if name in CLOSES_SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES_SAME[name]:
                    close(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        flush()
        if name in VOID or m[3].endswith("/"):
            continue
        words = _described(m[3])
        stack.append((name, words))
        hidden += name in UNSEEN or words == "!hidden"
        if name == "body":
            inline = []
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            close(len(stack) - 1)
    said(page[at:])
    flush()
    return out


def _described(attributes: str) -> str:
    """What class, id, role and label say, in lower case; !hidden for an element that is not shown."""
    if not attributes.strip():
        return ""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attributes)}
    if "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", "")) or found.get("aria-hidden") == "true":
        return "!hidden"
    return " ".join(found[k] for k in _NAMES if k in found).lower()
