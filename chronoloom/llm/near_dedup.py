"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles gets a signature of CHUNKS * CHUNK_SYMBOLS symbols of 16 bits, the low bits of one
MinHash each. Two sets of similarity s differ in about a share 1 - s of their symbols. Signatures are split into chunks;
by the pigeonhole principle two signatures that differ in at most 2 * CHUNKS - 1 symbols have a chunk with at most one
differing symbol, so all pairs within that distance meet if each chunk is indexed under every variant with one symbol
left out. (Differences fall at random, so pairs well over that distance nearly always meet too: a pair at similarity 0.8
is missed with a probability of about 3e-6.) Links are confirmed on the full shingle sets, never by signatures.

Groups are joined without all their pairs: documents with equal sets form a class with one representative. Each
representative is first compared with one other, the leader (smallest member) that it shares most buckets with, and links
are contracted into components. Then, and only for buckets that still span several components, blocks of representatives
that share such a bucket are compared whole, by counting shared shingles, and each comparison puts out no more than a
spanning forest of the components it has seen, so what is put out grows with the components and not with their pairs.
Links within a component add nothing; none between components is lost but by the index.

Defined results: words are runs of bytes other than space and tab to carriage return, after A-Z are lower-cased; a text
of fewer words than a shingle takes is one shingle; null, empty and blank texts have an empty set and are linked with
nothing; rows repeated belong to one class; rows of one doc_id with different texts are one document, which reaches what
any of its texts reaches; rows with a null doc_id take no part (component_id null, kept true); an empty table gives an
empty result; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free_name, materialize, text_or_empty
from chronoloom.operators.arrow_groups import runs
from chronoloom.operators.graph import connected_components

CHUNKS, CHUNK_SYMBOLS = 12, 6
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Representatives, and shingles of theirs, that one task compares with as many others at once.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000
#: Rows, 160 bytes each in memory, up to which a list of documents is broadcast rather than joined by a shuffle.
BROADCAST_IDS = 200_000

_RNG = np.random.default_rng(6)
_FACTORS = _RNG.integers(0, 1 << 32, SYMBOLS, np.uint64).astype(np.uint32) | np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, SYMBOLS, np.uint64).astype(np.uint32)
_PLACES = _RNG.integers(0, 1 << 63, (CHUNKS, CHUNK_SYMBOLS), np.uint64) | np.uint64(1)
_VARIANTS = _RNG.integers(0, 1 << 63, (CHUNKS, CHUNK_SYMBOLS), np.uint64)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, words_each: int) -> np.ndarray:
    """The distinct shingles of a text, hashed to 64 bits, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes, both know ASCII alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    k = min(words_each, len(h))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total = total * _ROLL + h[i : len(h) - k + 1 + i]
    return np.unique(mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each set; no set may be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[:-1]])]).astype(np.int64)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    work = np.empty_like(flat)
    for k in range(SYMBOLS):
        np.multiply(flat, _FACTORS[k], out=work)
        np.add(work, _OFFSETS[k], out=work)
        low = np.minimum.reduceat(work, starts)
        out[:, k] = ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """For each row of symbols, a key for every chunk and symbol left out."""
    parts = signature.reshape(-1, CHUNKS, CHUNK_SYMBOLS).astype(np.uint64) * _PLACES
    left_out = parts.sum(2, dtype=np.uint64)[:, :, None] - parts
    return mix(left_out + _VARIANTS).reshape(len(signature), SYMBOLS).view(np.int64)


def signed_documents(docs: DataFrame, words_each: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole set) and signature (binary) of each document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _spans(texts, 200_000):
                sets = [shingle_set(t.as_py(), words_each) for t in texts[a:b]]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                signs = [next(rows).tobytes() if len(s) else None for s in sets]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "signature"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, signature binary")


def _spans(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes of text."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t.as_buffer() or b"")
        if held >= most:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _keys(reps: DataFrame) -> DataFrame:
    """key and rep, for every key of every representative: the index, 72 narrow rows each."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                signs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                rep = np.repeat(part.column(0).to_numpy(), SYMBOLS)
                yield pa.RecordBatch.from_arrays([pa.array(index_keys(signs).ravel()), pa.array(rep)], names=["key", "rep"])

    return reps.select("rep", "signature").mapInArrow(keys, "key long, rep long")


def _shingle_sets(docs: DataFrame, classes: DataFrame, members: DataFrame, words_each: int) -> DataFrame:
    """rep and the whole set (binary, ascending 64-bit shingles) of every class that shares a bucket."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _spans(batch.column(1), 1_000_000):
                sets = [shingle_set(t.as_py(), words_each).tobytes() for t in batch.column(1)[a:b]]
                own = [xxhash.xxh3_128_digest(s) == k.as_py() for s, k in zip(sets, batch.column(2)[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.binary())], names=["rep", "shingles"]).filter(pa.array(own, pa.bool_()))

    wanted = materialize(classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "set_key", F.col("first_id").alias("doc_id")), "wanted")
    n = wanted.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    held = texts.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "doc_id").select("rep", "text", "set_key")
    found = materialize(held.mapInArrow(measure, "rep long, shingles binary"), "shingle-sets")
    return found if found.count() == n else materialize(found.dropDuplicates(["rep"]), "distinct-sets")  # rows repeated with their id


def _confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have the similarity."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(one), len(two)) < per_cent * max(len(one), len(two)):
                    linked.append(False)
                    continue
                both = np.sort(np.concatenate([one, two]))
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= per_cent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one, two = (sets.select(F.col("rep").alias(c), F.col("shingles").alias(f"s_{c}")) for c in ("a", "b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "s_a", "s_b").mapInArrow(confirm, "a long, b long")


def _best_leads(members: DataFrame) -> DataFrame:
    """b, a representative, and a: of the smallest members of its buckets the one that it shares most buckets with."""
    shared = members.where("rep != lead").repartition("rep").groupBy("rep", "lead").agg(F.count(F.lit(1)).alias("n"))
    return shared.groupBy(F.col("rep").alias("b")).agg(F.max(F.struct("n", (-F.col("lead")).alias("m")))["m"].alias("m")).select((-F.col("m")).alias("a"), "b")


def _one_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of one doc_id that comes with several texts."""
    key = F.xxhash64("set_key")
    ids = full.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high").select("doc_id")
    owners = full.join(materialize(ids, "ids-of-several-texts"), "doc_id", "left_semi").join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep").distinct()
    owners = materialize(owners, "classes-of-ids")
    return owners.join(owners.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a != rep").select("a", F.col("rep").alias("b"))


def _blocks(mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, component, block and only of every representative in buckets that span components.

    Representatives that share their smallest leader lie together, in as many blocks as their number and sets take, so the
    pairs of blocks that share a bucket are few. A component with many of them has blocks of its own; only names it then.
    """
    near = mixed.groupBy("rep", "component").agg(F.min("lead").alias("near")).join(classes.select("rep", "n_shingles"), "rep")
    sizes = near.groupBy("near", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    sizes = sizes.withColumn("only", F.when(F.col("n") * 2 >= BLOCK, F.col("component")).otherwise(-1))
    parts = F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("w") / BLOCK_SHINGLES)).cast("int")
    pools = sizes.groupBy("near", "only").agg(parts.alias("parts"))
    groups = materialize(sizes.select("near", "component", "only").join(pools, ["near", "only"]), "block-groups")
    block = F.xxhash64("near", "only", F.pmod(F.xxhash64("rep"), F.col("parts")))
    return near.join(groups, ["near", "component"]).select("rep", "component", block.alias("block"), "only")


def _block_pairs(mixed: DataFrame, blocks: DataFrame) -> DataFrame:
    """i and j (i <= j) of every two blocks that share a bucket and are not of one component alone.

    What is gathered for a bucket is the list of its blocks, not of its members.
    """
    held = F.collect_set(F.struct("block", "only")).alias("held")
    lists = mixed.select("key", "rep").join(blocks, "rep").groupBy("key").agg(held).select(F.sort_array("held").alias("held")).distinct()
    firsts = lists.select(F.explode("held").alias("x"), "held")
    partners = F.filter("held", lambda y: (y["block"] >= F.col("x.block")) & ((F.col("x.only") == -1) | (y["only"] != F.col("x.only"))))
    return firsts.select(F.col("x.block").alias("i"), F.explode(partners).alias("y")).select("i", F.col("y.block").alias("j")).distinct()


def _across(block_pairs: DataFrame, held: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) between components, block against block: for each pair of blocks the edges of a spanning forest.

    held has block, rep, component and shingles. For each member of the one block, the postings of its shingles in the
    other count what it shares with every member there, on whole sets. A link between components that earlier links of
    the two blocks already hold together says nothing new and is not put out.
    """
    rows = held.select("block", "component", "shingles")
    sides = [block_pairs.join(rows.withColumnRenamed("block", side), side).select("i", "j", F.lit(side == "i").alias("left"), "component", "shingles") for side in ("i", "j")]
    dealt = sides[0].union(sides[1].where("i <> j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in runs(batches, 2):
            links = list(_forest(cols[2].to_numpy(zero_copy_only=False), cols[3].to_numpy(), [np.frombuffer(x, np.uint64) for x in cols[4].to_pylist()], per_cent))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(compare, "a long, b long").distinct()


def _forest(left: np.ndarray, component: np.ndarray, sets: list[np.ndarray], per_cent: int) -> Iterator[tuple[int, int]]:
    """Pairs of components that links between the left and the other members join (between all, if all are left)."""
    names, own = np.unique(component, return_inverse=True)
    group = np.arange(len(names))  # of each component, as joined so far
    size = np.array([len(s) for s in sets])
    xs = np.flatnonzero(left)
    ys = xs if left.all() else np.flatnonzero(~left)
    if len(names) == 1 or not len(ys):
        return
    flat, owner = np.concatenate([sets[y] for y in ys]), np.repeat(np.arange(len(ys)), size[ys])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for x in xs:
        other = group[own[ys]] != group[own[x]]
        if not other.any():
            continue
        low = np.searchsorted(flat, sets[x], "left")
        n = np.searchsorted(flat, sets[x], "right") - low
        low, n = low[n > 0], n[n > 0]
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(ys))
        for y in ys[other & (100 * shared >= per_cent * (size[ys] + size[x] - shared))]:
            p, q = group[own[x]], group[own[y]]
            if p != q:
                group[group == q] = p
                yield int(min(names[own[x]], names[own[y]])), int(max(names[own[x]], names[own[y]]))


def near_groups(docs: DataFrame, words_each: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    signed = materialize(signed_documents(docs, words_each), "signed")
    full = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    equal = full.groupBy("set_key", "n_shingles", "signature").agg(F.min("doc_id").alias("first_id"))
    classes = materialize(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")

    buckets = _keys(classes).groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(_keys(classes).join(materialize(buckets, "buckets"), "key"), "members")
    sets = _shingle_sets(docs, classes, members, words_each)
    tried = materialize(_best_leads(members), "star-pairs")
    links = materialize(_confirm(tried, sets, per_cent).union(_one_id(full, classes)), "star-links")
    found = connected_components(links)

    placed = materialize(
        members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(tried.select(F.col("b").alias("rep"), F.col("a").alias("met")), "rep", "left")
        .select("key", "rep", "lead", F.coalesce("component", "rep").alias("component"), ((F.col("n") == 2) & F.col("met").eqNullSafe(F.col("lead"))).alias("done")),
        "placed",
    )
    spans = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max("done").alias("done")).where("x != y AND NOT done")
    mixed = materialize(placed.join(materialize(spans.select("key"), "mixed-keys"), "key", "left_semi"), "mixed")
    blocks = materialize(_blocks(mixed, classes), "blocks")
    block_pairs = materialize(_block_pairs(mixed, blocks), "block-pairs")
    more = materialize(_across(block_pairs, blocks.join(sets, "rep"), per_cent), "cross-links")
    if not more.isEmpty():
        found = connected_components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))

    grouped = classes.select("set_key", "rep", "first_id").join(found, F.col("rep") == F.col("node"))
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("least"))
    grouped = materialize(grouped.join(smallest, "component").select("set_key", "least"), "grouped-classes")
    by_class = materialize(classes.select("set_key", "first_id").join(grouped, "set_key", "left").select("set_key", F.coalesce("least", "first_id").alias("least")), "class-components")
    out = signed.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_copies(docs: DataFrame, words_each: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows that stay, one document of each group, with all their columns; rows of one doc_id stay or go together."""
    name = free_name(docs, "gone_id")
    marked = near_groups(docs, words_each, per_cent)
    gone = materialize(marked.where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    listed = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(listed, F.col("doc_id").cast("long") == F.col(name), "left_anti")
