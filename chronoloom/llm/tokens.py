"""Byte-level BPE ids, and a fixed-width bit-packed file format for them.

Ids are those of the tokenizers library. A text made only of characters on which its splitting pattern and tiktoken's
agree (see AGREED) is encoded by tiktoken with the same vocabulary, several times faster; any other text, or one that
spells a special token, goes to the tokenizers library itself. Tests hold the two against each other.

File layout, little-endian: 8 bytes of magic, u32 bits per id, u32 ids per block; the blocks, each packed on its own to
ceil(ids * bits / 8) bytes, bit k of an id at bit position i * bits + k; an index: i64 ids of documents, u8 whether an id
is null, i64 end of each document in ids, i64 byte offset of each block and of the end; a trailer: i64 documents, ids,
blocks and index offset, and the magic again. Any id range is found by division and unpacked by numpy.

Defined results: null text counts as empty, and an empty text is the end id alone; null doc_ids come first; rows repeated
are written one by one; an empty table gives no file and an empty result; other columns play no part.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import materialize, text_or_empty, work_path

MAGIC = b"CLBITS01"
BLOCK_IDS = 65536
MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
END_ID = 0
#: Characters on which both libraries' splitting patterns are known to agree.
AGREED = re.compile(r"[^\t\n\r\x20-\x7e¡-ſΑ-Ωα-ωА-я‐-‧€ぁ-ゖ一-龥]")


@dataclass(frozen=True)
class BpeFiles:
    """A vocabulary as the tokenizers library and as tiktoken read it, with the splitting pattern; paths are valid on every machine."""

    json_path: str
    ranks_path: str
    pattern: str


class BpeEncoder:
    """Ids of whole texts, exactly as the tokenizers library gives them without added special tokens."""

    def __init__(self, files: BpeFiles):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(files.json_path)
        with open(files.ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.fast = tiktoken.Encoding("bpe", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.specials = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.vocab_size = self.slow.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str) -> list[int]:
        if AGREED.search(text) or any(s in text for s in self.specials):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=4)
def encoder(files: BpeFiles) -> BpeEncoder:
    """One encoder a Python worker."""
    return BpeEncoder(files)


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, int(vocab_size - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same layout, without handling bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_block(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return planes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class TokenFileWriter:
    """Streams documents' ids into one file; holds a block of ids and the index, never the whole."""

    def __init__(self, uri: str, bits: int, block_ids: int = BLOCK_IDS):
        self.store, self.path = fs.FileSystem.from_uri(uri)
        self.bits, self.block_ids = bits, block_ids
        self.temporary = f"{self.path}.{id(self)}-{np.random.randint(1 << 62)}.tmp"
        self.out = self.store.open_output_stream(self.temporary)
        self.out.write(MAGIC + struct.pack("<II", bits, block_ids))
        self.at, self.n_ids = 16, 0
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.offsets: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n_ids)
        if self.held >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for k in range(0, whole, self.block_ids):
            data = pack_block(ids[k : min(k + self.block_ids, whole)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.pending, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        """The file appears under its name only when whole, so that a task run twice leaves one file."""
        self._flush(True)
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + nulls.tobytes())
        self.out.write(np.array(self.ends, "<i8").tobytes() + np.array([*self.offsets, self.at], "<i8").tobytes())
        self.out.write(struct.pack("<qqqq", len(self.doc_ids), self.n_ids, len(self.offsets), self.at) + MAGIC)
        self.out.close()
        self.store.move(self.temporary, self.path)


class TokenFile:
    """Random access to a token file."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        self.f = store.open_input_file(path)
        size = self.f.size()
        head, tail = self.f.read_at(16, 0), self.f.read_at(40, size - 40)
        if head[:8] != MAGIC or tail[32:] != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        self.bits, self.block_ids = struct.unpack("<II", head[8:])
        self.n_docs, self.n_ids, self.n_blocks, at = struct.unpack("<qqqq", tail[:32])
        index = self.f.read_at(size - 40 - at, at)
        n = self.n_docs
        values, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.doc_ids = [None if z else int(v) for v, z in zip(values, nulls, strict=True)]
        self.ends = np.frombuffer(index, "<i8", n, 9 * n)
        self.offsets = np.frombuffer(index, "<i8", self.n_blocks + 1, 17 * n)
        self._block: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def block(self, k: int) -> np.ndarray:
        if self._block[0] != k:
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            data = self.f.read_at(int(self.offsets[k + 1] - self.offsets[k]), int(self.offsets[k]))
            self._block = (k, unpack_block(data, n, self.bits))
        return self._block[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, by the blocks that hold them."""
        out = []
        while start < stop:
            k, within = divmod(start, self.block_ids)
            part = self.block(k)[within : within + stop - start]
            out.append(part)
            start += len(part)
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_token_files(docs: DataFrame, files: BpeFiles, path: str, end_id: int = END_ID) -> DataFrame:
    """Write every document's ids, each with the end id, in ascending doc_id order over the files; returns the manifest.

    Manifest rows: part (files in order), file, n_docs, n_ids. Ranges of doc_id are dealt to tasks, and ties of doc_id by
    the text's length and checksum, so that an id which many rows share still spreads.
    """
    text = text_or_empty()
    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.length(text).alias("_n"), F.crc32(text.cast("binary")).alias("_c")
    )
    key = ["doc_id", "_n", "_c"]
    ordered = ordered.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, bpe = TaskContext.get().partitionId(), None, encoder(files)
        for batch in batches:
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if out is None:
                    name = f"part-{part:06d}.bits"
                    out = TokenFileWriter(f"{path}/{name}", bits_for(bpe.vocab_size))
                ids = bpe.encode(t.as_py())
                ids.append(end_id)
                out.add(doc_id, np.array(ids, np.uint32))
        if out is not None:
            out.close()
            row = {"part": part, "file": name, "n_docs": len(out.doc_ids), "n_ids": out.n_ids}
            yield pa.RecordBatch.from_pylist([row], schema=MANIFEST)

    store, where = fs.FileSystem.from_uri(path)
    store.create_dir(where, recursive=True)
    return materialize(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, little-endian unsigned 32-bit) of each document.

    The driver holds one number a file: where in the corpus the file's ids start.
    """
    held = manifest.orderBy("part").select("file", "n_ids").collect()
    starts, at = [], 0
    for r in held:
        starts.append(at)
        at += r["n_ids"]
    names = [r["file"] for r in held]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                f, rows, size = TokenFile(f"{path}/{names[k]}"), [], 0
                first = 0
                for i, doc_id in enumerate(f.doc_ids):
                    data = f.document(i).astype("<u4").tobytes()
                    rows.append((doc_id, starts[k] + first, len(data) // 4, data))
                    first += len(data) // 4
                    size += len(data)
                    if size > 4_000_000:
                        yield _token_rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _token_rows(rows)

    return spark.range(0, len(names), 1, max(1, len(names))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def _token_rows(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"],
    )


def token_round_trip(docs: DataFrame, files: BpeFiles, path: str | None = None) -> DataFrame:
    """Write the token files and read them back."""
    spark = docs.sparkSession
    where = path or work_path(spark, "tokens")
    return read_token_files(spark, where, write_token_files(docs, files, where))
