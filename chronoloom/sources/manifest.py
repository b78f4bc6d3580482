"""Manifests of file sets: a chain of SHA-256 roots over files, committed one version at a time.

A manifest row: seq, file, bytes, sha256, modified, the least and greatest key and time of its rows, prev_root, root;
root = sha256(prev_root || sha256 of the file). Versions are small JSON-lines folders `_manifest/v=N.k`; the highest whole
one counts. A writer claims its version by creating a marker file `claim-N.k` that must not exist yet, so of two writers
one fails rather than both winning. A claim whose writer has not finished within CLAIM_MS is void: the next writer claims
N.(k+1), and the late writer, which looks again after writing, fails.

Reading checks the chain, and length and time of change of the files that it is to read; only files that look changed are
hashed. `verify` hashes all.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZERO = "0" * 64
#: After this time a claim without a version counts as left by a writer that died.
CLAIM_MS = 600_000
#: Files up to which each is looked up by name; beyond, the folder is listed as a whole, by tasks.
LISTED_ONE_BY_ONE = 500
SCHEMA = "seq long, file string, bytes long, sha256 string, modified long, low string, high string, since long, until long, prev_root string, root string"


class ArchiveError(Exception):
    """Base of the errors below."""


class IntegrityError(ArchiveError):
    """A file is not the one that the manifest names."""


class IncompleteDataError(ArchiveError):
    """A file that the manifest names is missing, or there is no manifest."""


class LimitExceededError(ArchiveError):
    """A file is larger than the reader allows."""


class ConcurrentWriteError(ArchiveError):
    """Another writer committed this version first."""


@dataclass(frozen=True)
class File:
    """A data file: its digest, and the ranges of key (as JSON) and time of its rows, where they are known."""

    file: str
    bytes: int
    sha256: str
    modified: int | None = None
    low: str | None = None
    high: str | None = None
    since: int | None = None
    until: int | None = None

    def may_hold(self, keys: list | None, since: int | None, until: int | None) -> bool:
        """Whether a row of one of these keys within these times can be here."""
        if keys is not None and self.low is not None and not any(json.loads(self.low) <= k <= json.loads(self.high) for k in keys):
            return False
        return not (since is not None and self.until is not None and self.until < since or until is not None and self.since is not None and self.since > until)


    def may_hold_prefix(self, prefix: str) -> bool:
        """Whether a row whose key (a text) starts with the prefix can be here."""
        return self.low is None or json.loads(self.low)[: len(prefix)] <= prefix <= json.loads(self.high)[: len(prefix)]


@dataclass(frozen=True)
class Entry(File):
    """A file's place in the chain."""

    seq: int = 0
    prev_root: str = ZERO
    root: str = ZERO

    def holds(self, seq: int, root: str) -> bool:
        return self.seq == seq and self.prev_root == root and self.root == _next_root(root, self.sha256)


def _next_root(root: str, digest: str) -> str:
    return hashlib.sha256((root + digest).encode()).hexdigest()


def chain(files: list[File], held: list[Entry] | None = None) -> list[Entry]:
    """The entries held, and those of further files, each chained to the one before."""
    out = list(held or [])
    for f in files:
        root = out[-1].root if out else ZERO
        facts = {k: getattr(f, k) for k in File.__dataclass_fields__}
        out.append(Entry(**facts, seq=len(out), prev_root=root, root=_next_root(root, f.sha256)))
    return out


def _relative(path: str):
    base = path.rstrip("/").split("://")[-1].split(":", 1)[-1].lstrip("/") + "/"
    return F.substring_index(F.col("path"), base, -1).alias("file")


def file_facts(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """file (relative), bytes and modified (ms) of the data files below path; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(_relative(path), F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("modified"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """file (relative), bytes, sha256 and modified (ms) of the data files below path, read where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(_relative(path), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.unix_millis("modificationTime").alias("modified"))


def new_files(spark: SparkSession, path: str, folder: str, key: str | None = None, time_column: str = "ts") -> list[File]:
    """The data files of a folder below path, with digests, and ranges of key and time from one narrow scan: a row a file."""
    found = file_digests(spark, f"{path}/{folder}")
    if key is not None:
        rows = spark.read.parquet(f"{path}/{folder}").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col(key).alias("k"), F.col(time_column).alias("t"))
        text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        ranges = rows.where("k IS NOT NULL").groupBy("name").agg(text(F.min("k")).alias("low"), text(F.max("k")).alias("high"), F.min("t").alias("since"), F.max("t").alias("until"))
        # a null key lies outside every range, and is asked for by none
        found = found.withColumn("name", F.element_at(F.split("file", "/"), -1)).join(ranges, "name", "left").drop("name")
    return [File(**{**r.asDict(), "file": f"{folder}/{r['file']}"}) for r in found.orderBy("file").collect()]


class Manifest:
    """The manifest of one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._path("/".join([self.path, "_manifest", *parts]))

    def _found(self, prefix: str) -> dict[int, dict[int, object]]:
        """Version, attempt and status of the folders or files `prefix`N.k."""
        out: dict[int, dict[int, object]] = {}
        if self._fs.exists(self._at()):
            for s in self._fs.listStatus(self._at()):
                name = s.getPath().getName()
                if name.startswith(prefix):
                    number, _, attempt = name[len(prefix) :].partition(".")
                    out.setdefault(int(number), {})[int(attempt)] = s
        return out

    def _whole(self) -> dict[int, int]:
        """The last whole attempt at each version that has one."""
        found = self._found("v=")
        whole = {n: [k for k, s in tries.items() if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))] for n, tries in found.items()}
        return {n: max(tries) for n, tries in whole.items() if tries}

    def version(self) -> int:
        """The highest version that is whole, or -1."""
        return max(self._whole(), default=-1)

    def entries(self, version: int | None = None) -> list[Entry]:
        whole = self._whole()
        v = max(whole, default=-1) if version is None else version
        if v not in whole:
            return []
        rows = self.spark.read.schema(SCHEMA).json(f"{self.path}/_manifest/v={v}.{whole[v]}").orderBy("seq").collect()
        return [Entry(**r.asDict()) for r in rows]

    def commit(self, entries: list[Entry], expected: int, claim_ms: int = CLAIM_MS) -> int:
        """Write the version after `expected`; fails if another writer has it, or is at it."""
        n = expected + 1
        taken = f"version {n} of {self.path} is taken"
        self._fs.mkdirs(self._at())
        claims = self._found("claim-").get(n, {})
        last = max(claims, default=-1)
        if claims and time.time() * 1000 - claims[last].getModificationTime() < claim_ms:
            raise ConcurrentWriteError(taken)
        try:
            if not self._fs.createNewFile(self._at(f"claim-{n}.{last + 1}")):
                raise ConcurrentWriteError(taken)
        except Py4JJavaError as e:
            raise ConcurrentWriteError(taken) from e
        if self.version() >= n:
            raise ConcurrentWriteError(taken)
        out = self._fs.create(self._at(f"v={n}.{last + 1}", "entries.json"), False)
        for at in range(0, len(entries), 2000):
            out.write(bytearray("".join(json.dumps({c.split()[0]: getattr(e, c.split()[0]) for c in SCHEMA.split(", ")}) + "\n" for e in entries[at : at + 2000]).encode()))
        out.close()
        self._fs.create(self._at(f"v={n}.{last + 1}", "_SUCCESS"), False).close()  # whole from here on
        if max(self._found("claim-").get(n, {})) > last + 1:
            raise ConcurrentWriteError(f"{taken}: this writer's claim was void before it had finished")
        return n

    def checks(self, version: int | None = None) -> DataFrame:
        """file, expected, found, valid of every file of the manifest, by hashing it."""
        entries = self.entries(version)
        want = self.spark.createDataFrame([(e.file, e.sha256) for e in entries], "file string, expected string")
        if not entries:
            return want.select("file", "expected", F.col("expected").alias("found"), F.lit(True).alias("valid"))
        have = file_digests(self.spark, self.path).select("file", F.col("sha256").alias("found"))
        return want.join(have, "file", "left").withColumn("valid", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)))

    def chain_holds(self, entries: list[Entry]) -> bool:
        """Whether the entries follow from one another."""
        return all(e.holds(k, entries[k - 1].root if k else ZERO) for k, e in enumerate(entries))

    def verify(self) -> bool:
        """Whether there is a manifest, its chain holds and every file is what it was; never raises."""
        try:
            return self.version() >= 0 and self.chain_holds(self.entries()) and self.checks().where(~F.col("valid")).isEmpty()
        except Exception:
            return False

    def _suspects(self, entries: list[Entry]) -> tuple[list[str], list[str]]:
        """The files that are missing, and those that are not what the manifest says; what is listed, not read, tells most."""
        if len(entries) <= LISTED_ONE_BY_ONE:
            have = {}
            for e in entries:
                try:
                    status = self._fs.getFileStatus(self._path(f"{self.path}/{e.file}"))
                    have[e.file] = (status.getLen(), status.getModificationTime())
                except Py4JJavaError:
                    continue
        else:
            have = {r["file"]: (r["bytes"], r["modified"]) for r in file_facts(self.spark, self.path).toLocalIterator()}
        missing = [e.file for e in entries if e.file not in have]
        there = [e for e in entries if e.file in have]
        changed = [e.file for e in there if have[e.file][0] != e.bytes]
        odd = [e for e in there if have[e.file][0] == e.bytes and have[e.file][1] != e.modified]  # copied, or written over
        if odd:
            now = self.spark.read.format("binaryFile").load([f"{self.path}/{e.file}" for e in odd]).select(_relative(self.path), F.sha2("content", 256).alias("found"))
            want = self.spark.createDataFrame([(e.file, e.sha256) for e in odd], "file string, expected string")
            changed += [r["file"] for r in want.join(now, "file", "left").where("NOT expected <=> found").collect()]
        return missing, changed

    def require(self, warn_only: bool = False, limit_bytes: int | None = None, only: Callable[[Entry], bool] | None = None) -> list[str]:
        """The files to read, or an error before any row is read; with warn_only changed files are let through, missing ones never.

        only picks the entries that a query needs; no other file is looked at.
        """
        entries = self.entries()
        if not entries and self.version() < 0:
            raise IncompleteDataError(f"{self.path} has no manifest")
        if not self.chain_holds(entries) and not warn_only:
            raise IntegrityError("changed: the chain of roots")
        wanted = entries if only is None else [e for e in entries if only(e)]
        if limit_bytes is not None and any(e.bytes > limit_bytes for e in wanted):
            raise LimitExceededError(f"a file of {self.path} is over {limit_bytes} bytes")
        missing, changed = self._suspects(wanted)
        if missing:
            raise IncompleteDataError(f"missing: {missing[:20]}")
        if changed and not warn_only:
            raise IntegrityError(f"changed: {changed[:20]}")
        return [f"{self.path}/{e.file}" for e in wanted]

    def vacuum(self, older_ms: int) -> int:
        """Delete the data files that the last version does not name and that are older than older_ms."""
        named = {e.file for e in self.entries()}
        limit = time.time() * 1000 - older_ms
        stray = [r["file"] for r in file_facts(self.spark, self.path).toLocalIterator() if r["file"] not in named and r["modified"] <= limit]
        for f in stray:
            self._fs.delete(self._path(f"{self.path}/{f}"), False)
        return len(stray)
