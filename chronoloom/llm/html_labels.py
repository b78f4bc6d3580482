"""Labelled pages for training the extractor, laid out by rules.

Pages differ in skeleton, element names, class words, order and text; each leaf's label (1: main text, 0: the rest) is
set where the leaf is written. Texts are invented syllables, so that no language is preferred.
"""

from __future__ import annotations

import random

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo za sch ción eau thing the of and tion".split()
#: Words that class and id attributes use, by the role of their element.
ROLE_WORDS = {
    "nav": "nav navigation menu navbar main-menu breadcrumb breadcrumbs site-nav topnav pagination tabs toc".split(),
    "header": "header site-header masthead banner topbar page-header branding".split(),
    "footer": "footer contentinfo site-footer copyright colophon legal bottom page-footer".split(),
    "aside": "sidebar complementary aside widget related recommended popular trending side rail more-stories".split(),
    "ad": "ad ads advert advertisement sponsored promo sponsor banner-ad ad-slot adsbox".split(),
    "notice": "cookie cookies cookie-notice consent notice alert popup modal overlay newsletter subscribe gdpr paywall banner".split(),
    "form": "form search login signup search-form subscribe-form contact".split(),
    "comments": "comments comment comment-list discussion disqus replies reader-comments responses user-comment".split(),
    "share": "share social share-bar social-links tags meta byline-tools".split(),
    "main": "content main story-body article post entry story article-body post-content entry-content text page-content body-text".split(),
}
TAGS = {
    "nav": ["nav", "div", "ul"],
    "header": ["header", "div"],
    "footer": ["footer", "div"],
    "aside": ["aside", "div", "section"],
    "ad": ["div", "aside", "section"],
    "notice": ["div", "section", "aside", "dialog"],
    "form": ["form", "div"],
    "comments": ["section", "div", "aside", "ol"],
    "share": ["div", "ul", "aside"],
    "main": ["article", "main", "div", "section"],
}


class PageWriter:
    """Writes one page and the labels of its leaves."""

    def __init__(self, seed: int, invented: float = 0.0):
        self.r = random.Random(seed)
        self.invented = invented
        self.html: list[str] = []
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if r.random() < 0.7:
            out[0] = out[0].capitalize()
            if len(out) > 3:
                out[-1] += r.choice([".", "!", "?", "."])
        if r.random() < 0.15:
            out = [w + r.choice(["###", "***", "$$$", "%%%", "!!", "&amp;&amp;&amp;"]) for w in out]
        if r.random() < 0.05:
            out = [w.upper() for w in out]
        return " ".join(out)

    def leaf(self, tag: str, text: str, label: int, link: bool = False) -> None:
        inner = f'<a href="/{self.r.randint(0, 999)}">{text}</a>' if link else text
        if not link and self.r.random() < 0.1:
            inner = f"<b>{inner}</b>"
        self.html.append(f"<{tag}>{inner}</{tag}>" if tag else inner)
        self.labels.append(label)

    def open(self, role: str) -> str:
        r = self.r
        tag = r.choice(TAGS[role])
        word = r.choice(ROLE_WORDS[role]) if r.random() >= self.invented else "".join(r.choices(SYLLABLES[:20], k=3))
        plain = tag not in ("div", "section", "ul", "ol") and r.random() < 0.6
        if plain:
            said = ""
        elif r.random() < 0.75:
            said = f' class="{word} {r.choice(["", "wide", "box", "x1"])}"'
        else:
            said = f' id="{word}"'
        self.html.append(f"<{tag}{said}>")
        return tag

    def part(self, role: str) -> None:
        """One stretch of the page that is no main text."""
        r = self.r
        tag = self.open(role)
        if role in ("nav", "share") or (role in ("aside", "footer", "header") and r.random() < 0.5):
            listed = tag in ("ul", "ol")
            if not listed:
                self.html.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.leaf("li", self.words(1, 4), 0, link=r.random() < 0.95)
            if not listed:
                self.html.append("</ul>")
        elif role == "comments":
            if r.random() < 0.6:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.words(1, 3), 0)
            for _ in range(r.randint(1, 6)):
                inner = "li" if tag == "ol" else r.choice(["div", "article", "p", "section"])
                self.html.append(f'<{inner} class="{r.choice(ROLE_WORDS["comments"])}">')
                self.leaf(r.choice(["p", "div", "p"]) if inner != "p" else "", self.words(3, 60), 0)
                self.html.append(f"</{inner}>")
        elif role == "form":
            self.leaf(r.choice(["div", "p", "label", "h3"]) if tag == "form" else "p", self.words(1, 8), 0)
            self.html.append('<input type="text"><button>go</button>')
        elif r.random() < 0.3:  # text right in the element, as copyright lines and adverts are at times
            self.leaf("", self.words(1, 20), 0, link=r.random() < 0.2)
        else:
            if r.random() < 0.3:
                self.leaf(r.choice(["h1", "h1", "h2"] if role == "header" else ["h2", "h3", "h4"]), self.words(1, 5), 0)
            for _ in range(r.randint(1, 3)):
                bare = len(self.html[-1]) and r.random() < 0.4
                self.leaf("div" if bare else "p", self.words(2, 30), 0, link=r.random() < 0.3)
        self.html.append(f"</{tag}>")

    def body(self) -> None:
        """The main text, at times with other parts within it."""
        r = self.r
        wraps = [self.open("main") for _ in range(r.choice([0, 1, 1, 1, 1, 1, 2, 3]))]
        if r.random() < 0.85:
            within = wraps and r.random() < 0.2  # a header of the article, not of the page
            self.html.append("<header>" if within else "")
            self.leaf("h1", self.words(1, 14), 1)
            self.html.append("</header>" if within else "")
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random()
            if kind < 0.72:
                self.leaf("p", self.words(1, 90), 1)
            elif kind < 0.8:
                self.leaf(r.choice(["h2", "h3", "h4"]), self.words(1, 6), 1)
            elif kind < 0.86:
                self.html.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.leaf("li", self.words(1, 15), 1)
                self.html.append("</ul>")
            elif kind < 0.9:
                self.html.append("<blockquote>")
                self.leaf("p", self.words(3, 40), 1)
                self.html.append("</blockquote>")
            elif kind < 0.92:
                self.leaf("pre", self.words(3, 20), 1)
            elif kind < 0.93:
                role = r.choice(["ad", "notice", "share", "aside"])
                self.html.append(f'<p class="{r.choice(ROLE_WORDS[role])}">')
                self.leaf("", self.words(2, 20), 0)
                self.html.append("</p>")
            elif kind < 0.935:
                self.html.append("<figure><img src=x>")
                self.leaf("figcaption", self.words(2, 12), 1)
                self.html.append("</figure>")
            elif kind < 0.95:
                self.html.append("<table><tr>")
                for _ in range(3):
                    self.leaf("td", self.words(1, 4), 1)
                self.html.append("</tr></table>")
            else:
                self.part(r.choice(["ad", "aside", "notice", "share", "form"]))
        if r.random() < 0.15:
            self.part("comments")
        for tag in reversed(wraps):
            self.html.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.html.append("<!DOCTYPE html><html><head><title>x</title></head><body>")
        for role in r.sample(["header", "nav", "notice", "ad", "form", "aside"], r.randint(0, 5)):
            self.part(role)
        wrapped = r.random() < 0.3
        if wrapped:
            self.html.append(f'<div id="{r.choice(["page", "wrapper", "container", "app"])}">')
        self.body()
        for role in r.sample(["footer", "aside", "comments", "ad", "share", "form", "notice", "nav"], r.randint(0, 6)):
            self.part(role)
        if wrapped:
            self.html.append("</div>")
        self.html.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.html), self.labels


def labelled_pages(n: int, seed: int = 0, invented: float = 0.0) -> list[tuple[str, list[int]]]:
    """n pages, each with a label for every leaf block in page order; of class words the share `invented` has no meaning."""
    return [PageWriter(seed * 1_000_003 + k, invented).page() for k in range(n)]
