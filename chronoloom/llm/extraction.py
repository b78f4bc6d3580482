"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each leaf block has features of the elements around it (names, class words, nearest sectioning element) and of its text
(length, punctuation, share in links). The field has two states, main text and other, with weights for features and for
transitions; it is trained by maximum likelihood on labelled pages, and the best sequence of a page is found by Viterbi
decoding over the page's whole sequence of blocks. The model is small and of fixed size.

Defined results: null html counts as empty; a page without main text gives an empty string; broken or cut markup is read
as far as it goes; character references are decoded, white space within a block becomes one space, and two newlines stand
between blocks; repeated rows give equal results; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import text_or_empty
from chronoloom.llm.html_blocks import Block, blocks
from chronoloom.llm.html_labels import ROLE_WORDS, labelled_pages

N_PAGES = 700
#: Share of the training pages' elements whose class words say nothing, so that names, links and text are learned too.
INVENTED = 0.1
#: What stands between two blocks of the main text.
BETWEEN = "\n\n"
_WORD_ROLE = {w: role for role, words in ROLE_WORDS.items() for w in words}
_SPLIT = re.compile(r"[^a-z]+")
_TAG_ROLE = {"article": "main", "main": "main", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "dialog": "notice"}


@lru_cache(maxsize=20_000)
def path_features(path: tuple[tuple[str, str], ...]) -> tuple[str, ...]:
    """Features of the elements around a block."""
    own = path[-1][0] if path else ""
    out = {"bias", f"own={own}", f"parent={path[-2][0] if len(path) > 1 else ''}"}
    roles = ["none", "none"]
    for name, said in path:
        found = {_WORD_ROLE[w] for w in {*said.split(), *_SPLIT.split(said)} if w in _WORD_ROLE} if said else set()
        out |= {f"says={x}" for x in found}
        if name in _TAG_ROLE:
            out.add(f"in={name}")
        # what an element's words say goes before its name, and that it is other than main text before that it is
        role = min(found - {"main"}, default="main" if found else _TAG_ROLE.get(name))
        if role:
            roles.append(role)
    out |= {f"role={roles[-1]}", f"roles={roles[-2]}>{roles[-1]}", f"{roles[-1]}/{own}"}
    return tuple(sorted(out))


def features(b: Block, place: int, n: int) -> list[str]:
    words = b.text.count(" ") + 1
    linked = b.link_chars / max(1, len(b.text))
    links = f"linked={int(linked > 0.1) + int(linked > 0.6)}"
    return [
        *path_features(b.path),
        f"words={min(6, words.bit_length())}",
        links,
        f"{b.path[-1][0] if b.path else ''}/{links}",
        "ends" if b.text[-1] in ".!?:\"'" else "no-end",
        "first" if place == 0 else "last" if place == n - 1 else "inner",
    ]


@dataclass(frozen=True)
class Crf:
    """Weights of a two-state chain: a row of two for each feature, and a square for transitions."""

    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, page: list[Block]) -> np.ndarray:
        get, n = self.index.get, len(page)
        return np.array([self.emit[[k for f in features(b, i, n) if (k := get(f)) is not None]].sum(0) for i, b in enumerate(page)])

    def decode(self, page: list[Block]) -> list[int]:
        """The most likely states, by Viterbi."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = self.scores(page).tolist()
        s0, s1 = rows[0]
        back = []
        for e0, e1 in rows[1:]:
            from0, from1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
            back.append((from0, from1))
            s0, s1 = (s1 + m10 if from0 else s0 + m00) + e0, (s1 + m11 if from1 else s0 + m01) + e1
        states = [int(s1 > s0)]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


def train(pages: list[tuple[str, list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 3) -> Crf:
    """Maximum likelihood by stochastic gradients (Adagrad), with the gradient from forward and backward sums."""
    index: dict[str, int] = {}
    data = []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels) or not found:
            continue
        n = len(found)
        data.append(([np.array([index.setdefault(f, len(index)) for f in features(b, i, n)]) for i, b in enumerate(found)], np.array(labels)))
    emit, move = np.zeros((len(index), 2)), np.zeros((2, 2))
    emit_sum, move_sum = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            at, y = data[k]
            n = len(y)
            e = np.array([emit[a].sum(0) for a in at])
            fore, back = np.empty((n, 2)), np.zeros((n, 2))
            fore[0] = e[0]
            for i in range(1, n):
                fore[i] = e[i] + np.logaddexp(fore[i - 1, 0] + move[0], fore[i - 1, 1] + move[1])
            for i in range(n - 2, -1, -1):
                step = move + e[i + 1] + back[i + 1]
                back[i] = np.logaddexp(step[:, 0], step[:, 1])
            total = np.logaddexp(*fore[-1])
            grad = -np.exp(fore + back - total)
            grad[np.arange(n), y] += 1
            moved = np.zeros((2, 2))
            for i in range(1, n):
                moved[y[i - 1], y[i]] += 1
                moved -= np.exp(fore[i - 1][:, None] + move + e[i] + back[i] - total)
            where = np.concatenate(at)
            each = np.repeat(grad, [len(a) for a in at], axis=0)
            unique, inverse = np.unique(where, return_inverse=True)
            g = np.zeros((len(unique), 2))
            np.add.at(g, inverse, each)
            g -= decay * emit[unique]
            emit_sum[unique] += g * g
            emit[unique] += rate * g / np.sqrt(emit_sum[unique])
            move_sum += moved * moved
            move += rate * moved / np.sqrt(move_sum)
    return Crf(index, emit, move)


def main_text(page: str, crf: Crf) -> str:
    found = blocks(page)
    return BETWEEN.join(b.text for b, state in zip(found, crf.decode(found), strict=True) if state)


def extract(pages: DataFrame, crf: Crf | None = None, n_pages: int = N_PAGES) -> DataFrame:
    """page_id, url, text and n_chars of each page; the model is trained on n_pages labelled pages where none is given."""
    sent = pages.sparkSession.sparkContext.broadcast(crf or train(labelled_pages(n_pages, invented=INVENTED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts = [main_text(h.as_py(), sent.value) for h in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    return read.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
