"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from text into a whitespace marker, so a normalised text falls into chunks (markers and the
text after them) that are segmented on their own, and ids are joined back by position. The corpus's distinct chunks are
counted first; those that occur more than once, commonest first, as many as TABLE_CHUNKS, are segmented once, in tasks,
and the table is broadcast, so that joining back moves no text. A chunk that occurs once is segmented where it stands;
so are the rarest of a corpus with more chunks than the table takes, in a table of each worker that is emptied when it is
full. Neither bound changes an id. A model whose pieces do cross, or which does more to a text than mark its spaces, is
refused.

Defined results: null text counts as empty, and an empty text is the end id alone, which decodes to an empty text; rows
repeated are encoded one by one; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, text_or_empty

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks, of at most so many characters, that are segmented once for all and broadcast: 20 MB or so.
TABLE_CHUNKS, TABLE_CHARS = 300_000, 64
#: Further chunks that a worker keeps.
OWN_CHUNKS = 300_000
#: Steps a doubling in which counts are told apart to find the commonest chunks.
STEPS = 16


class ChunkEncoder:
    """Ids of whole texts, as the library's own encode gives them, with a table of the chunks seen."""

    def __init__(self, model_path: str, own_chunks: int = OWN_CHUNKS):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.own_chunks = own_chunks
        self.shared: dict[str, bytes] = {}  # a chunk without its first marker: its ids, as 32-bit integers
        self.table: dict[str, bytes] = {}  # those, and the chunks met besides
        self.mark = np.array([self.sp.piece_to_id(MARK)], np.int32).tobytes()
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this model crosses a whitespace marker")
        probe = " a  ﬁ\tÅ "
        if self.sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("this model changes more than spaces")

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks without their first marker; the library marks the front of what it gets."""
        full = [c for c in chunks if c]
        out = {c: array("i", ids).tobytes() for c, ids in zip(full, self.sp.encode(full, num_threads=1), strict=True)} if full else {}
        return out | {"": self.mark} if len(full) < len(chunks) else out

    def share(self, table: dict[str, bytes]) -> ChunkEncoder:
        """Take a table over, once."""
        if table is not self.shared:
            self.shared, self.table = table, dict(table)
        return self

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        single = MARK not in text and "  " not in text and text[0] != " " and text[-1] != " "
        # with single spaces between words, the chunks are the words
        chunks = text.split(" ") if single else [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]
        table = self.table
        new = set(chunks).difference(table)
        if new:
            if len(table) + len(new) > len(self.shared) + self.own_chunks:
                self.table = table = dict(self.shared)
                new = set(chunks).difference(table)
            table.update(self.segment(list(new)))
        return np.frombuffer(b"".join([table[c] for c in chunks]), np.int32)


@lru_cache(maxsize=2)
def chunk_encoder(model_path: str) -> ChunkEncoder:
    """One encoder a Python worker."""
    return ChunkEncoder(model_path)


def chunk_table(docs: DataFrame, model_path: str, most: int = TABLE_CHUNKS) -> dict[str, bytes]:
    """Ids of the commonest distinct chunks of a corpus that occur more than once, at most `most`.

    Words are counted by partial sums before the shuffle, so a word that every text has is no hot key. Which chunks are
    common enough is read from a histogram of counts of a fixed number of steps.
    """
    words = docs.select(F.explode(F.split(text_or_empty(), " ")).alias("w")).where((F.length("w") > 0) & (F.length("w") <= TABLE_CHARS) & ~F.contains("w", F.lit(MARK)))
    step = F.floor(F.log2("n") * STEPS).cast("int").alias("step")
    counts = materialize(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w", step), "chunk-counts")
    least, held = None, 0
    for r in counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # 64 * STEPS rows at most
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    if least is None:
        return {}

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(model_path)
        for batch in batches:
            found = enc.segment(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], names=["w", "ids"])

    common = materialize(counts.where(F.col("step") >= least).select("w").mapInArrow(segment, "w string, ids binary"), "chunk-table")
    table = common.toArrow()  # `most` rows of TABLE_CHARS characters at most
    return dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))


def piece_round_trip(docs: DataFrame, model_path: str, most: int = TABLE_CHUNKS) -> DataFrame:
    """doc_id, ids (array, with the end id) and decoded (the library's decode of those ids) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(chunk_table(docs, model_path, most))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(model_path).share(sent.value)
        end = np.array([enc.sp.eos_id()], np.int32)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([enc.encode(t.as_py()), end])
                rows.append((doc_id, ids, enc.sp.decode(ids.tolist())))
                size += len(ids)
                if size > 1_000_000:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        encode, "doc_id long, ids array<int>, decoded string"
    )


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, ids, decoded = zip(*rows, strict=True)
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])
