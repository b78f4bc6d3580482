"""Sharding, exact and near deduplication against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from chronoloom.llm import exact_dedup, near_dedup, queries, sharding
from chronoloom.llm.common import work_path
from llm_helpers import prose
from pyspark.sql import functions as F

from helpers import same_rows


def test_shards_are_even_and_gapless(frame):
    docs = frame([(i, prose(i, random.Random(i).randint(1, 60))) for i in range(900)])
    found = sharding.shard_documents(docs, 24).collect()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    sizes = [sum(r["size"] for r in rows) for rows in by.values()]
    assert len(by) == 24 and max(sizes) - min(sizes) < 0.01 * max(sizes)
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    assert {r.doc_id: r.shard for r in found} == {r.doc_id: r.shard for r in sharding.shard_documents(docs.repartition(5), 24).collect()}


def test_op1_equals_a_plain_count(spark, sf_dir):
    """Every column of the query against zlib and a plain walk over the slots; repeated runs give the same shards."""
    import zlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    found = queries.op1_sharding(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    by = defaultdict(list)
    slots = defaultdict(set)
    for r in found:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw)) and r.text_crc32 >= 0
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 and r.map_version == 1
        by[r.shard].append(r)
        slots[r.virtual_slot].add(r.shard)
    assert all(len(s) == 1 for s in slots.values()) and len(by) == 24
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    total = sum(r["size"] for r in found)
    largest_slot = max(sum(r["size"] for r in found if r.virtual_slot == s) for s in slots)
    assert max(sum(r["size"] for r in rows) for rows in by.values()) <= total / 24 + largest_slot  # what whole slots allow


def test_sharding_edges(edge_docs, no_docs):
    found = sharding.shard_documents(edge_docs, 24).collect()
    assert len(found) == edge_docs.count() and all(r.law == "bytes" and r.grown_shard is None for r in found)
    sizes = {r.doc_id: r["size"] for r in found}
    assert sizes[2] == 8 and sizes[1] == 19 and sizes[12] == 50_008
    assert sharding.shard_documents(no_docs, 24).isEmpty()


def test_rebalancing_moves_few_slots(spark):
    r = random.Random(4)
    sizes = [r.randint(1, 1000) for _ in range(2000)]
    before = sharding.plan_slots(sizes, 10)
    after = sharding.rebalance_slots(before, sizes, 11)
    load = [sum(s for s, k in zip(sizes, after, strict=True) if k == shard) for shard in range(11)]
    moved = sum(s for s, a, b in zip(sizes, before, after, strict=True) if a != b)
    assert max(load) - min(load) <= 0.03 * max(load) and moved <= 1.2 * sum(sizes) / 11
    assert set(sharding.rebalance_slots(before, sizes, 9)) == set(range(9))
    store = sharding.SlotMapStore(spark, work_path(spark, "slots"))
    store.commit(sharding.slot_map(spark, before, sizes, [1] * 2000, 1), 1)
    grown = {x.virtual_slot: x.shard for x in store.grow(1, 11).collect()}
    assert [grown[k] for k in range(2000)] == after and store.read(1).count() == 2000
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(sharding.slot_map(spark, before, sizes, [1] * 2000, 2), 2)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup_edges(edge_docs, no_docs):
    groups = defaultdict(list)
    for r in edge_docs.collect():
        groups[lower(r.text)].append(r.doc_id)
    found = exact_dedup.mark_copies(edge_docs, n_salts=3).collect()
    want = Counter()
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        for i in ids:
            want[i, max(known, default=None), len(ids)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)
    left = exact_dedup.drop_copies(edge_docs)
    assert left.columns == edge_docs.columns and Counter(lower(r.text) for r in left.collect()) == Counter(groups.keys())
    assert exact_dedup.mark_copies(no_docs).isEmpty() and exact_dedup.drop_copies(no_docs).isEmpty()


def test_exact_dedup_equals_sql(spark, sf_dir):
    same_rows(queries.op4_exact_dedup(spark, sf_dir), queries.ORACLES["op4_exact_dedup"], sf_dir)


def test_large_group_of_copies(frame):
    docs = frame([(i, "Same Text" if i % 3 else f"text {i}") for i in range(600)]).repartition(40)
    (big,) = exact_dedup.copy_groups(docs).where("group_size > 1").collect()
    assert (big.keep_id, big.group_size) == (599, 400) and exact_dedup.drop_copies(docs).count() == 201


def brute_groups(rows, k, per_cent):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= per_cent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(text, r, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"w{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "edits"), [(2, (0, 1, 3, 5, 8, 14)), (5, (0, 1, 2, 4))])
def test_near_groups_equal_brute_force(frame, k, edits):
    r, rows = random.Random(k), []
    for base in range(14):
        text = prose(100 + base, r.choice([12, 60, 150]))
        rows += [(len(rows) + j, edited(text, r, r.choice(edits))) for j in range(r.choice([1, 2, 9, 40]))]
    chain = prose(77, 100).split()
    for step in range(12):  # each is near the next one, the first is far from the last
        rows.append((1000 + step, " ".join(chain[step * 5 :] + [f"c{x}" for x in range(step * 5)])))
    r.shuffle(rows)
    found = near_dedup.near_groups(frame(rows), k, 80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_groups(rows, k, 80)
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_near_edges(edge_docs, no_docs, frame):
    found = near_dedup.near_groups(edge_docs, 2).collect()
    assert len(found) == edge_docs.count()
    by = {x.doc_id: x for x in found if x.doc_id is not None}
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0 and by[2].kept and by[4].component_id == 4
    assert by[7].component_id == 6 and by[10].component_id == by[11].component_id == 9 and by[5].component_id == 1
    assert all(x.component_id is None and x.kept for x in found if x.doc_id is None)
    left = near_dedup.drop_near_copies(edge_docs, 2)
    assert left.columns == edge_docs.columns and {r.doc_id for r in left.collect()} == {x.doc_id for x in found if x.kept}
    assert near_dedup.near_groups(no_docs).isEmpty() and near_dedup.drop_near_copies(no_docs).isEmpty()
    assert near_dedup.near_groups(frame([(1, ""), (2, None)])).count() == 2


def test_sparse_large_group_in_blocks(frame, monkeypatch):
    """Variants of one text of which few are links: the comparison across components must find each."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(8)
    base = prose(5, 200)
    rows = [(i, edited(base, r, r.choice([6, 14, 18, 22]))) for i in range(130)]
    found = near_dedup.near_groups(frame(rows), 2, 80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_groups(rows, 2, 80)


def test_every_pair_within_the_distance_shares_a_key():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 16, (300, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:  # as many errors as the pigeonhole allows, two in each chunk but one
        spare = r.integers(near_dedup.CHUNKS)
        for c in range(near_dedup.CHUNKS):
            at = r.choice(near_dedup.CHUNK_SYMBOLS, 1 if c == spare else 2, replace=False) + c * near_dedup.CHUNK_SYMBOLS
            row[at] ^= np.uint16(1 + r.integers(1000))
    assert ((a != b).sum(1) == 2 * near_dedup.CHUNKS - 1).all()
    x, y = near_dedup.index_keys(a), near_dedup.index_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x.tolist(), y.tolist(), strict=True))
    assert len(np.unique(x)) == x.size


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(5)
    rows = []
    for _ in range(200):
        a = r.integers(0, 1 << 63, 400).astype(np.uint64)
        b = np.concatenate([a[:356], r.integers(0, 1 << 63, 44).astype(np.uint64)])  # 356 / 444 = 0.80
        sa, sb = near_dedup.signatures([np.unique(a), np.unique(b)])
        rows.append((sa == sb).mean())
    assert np.mean(rows) == pytest.approx(0.802, abs=0.01)


def test_op6_on_the_smallest_table(spark, sf_dir):
    same_rows(queries.op6_near_dedup(spark, sf_dir), queries.ORACLES["op6_near_dedup"], sf_dir)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op6_near_dedup(spark, sf_dir).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_groups(rows, 2, 80)


def test_hot_bucket_of_equal_sets(frame):
    docs = frame([(i, "a b c d e f g h" + " h" * (i % 2)) for i in range(300)])
    found = near_dedup.near_groups(docs, 2).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert [(r.component_id, r.n) for r in found] == [(0, 300)]


@pytest.mark.parametrize(("k", "edits"), [(2, (2, 4, 6)), (5, (1, 2, 3))])
def test_output_grows_with_a_group_and_not_with_its_pairs(frame, monkeypatch, k, edits):
    """Doubling one group of near copies: pairs tried and links put out stay within the number of representatives."""
    made, write = {}, near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: made.setdefault(name, write(df, name)))
    r, base = random.Random(k), prose(9, 60)
    rows = [(i, edited(base, r, r.choice(edits))) for i in range(700)]
    for n in (350, 700):
        made.clear()
        found = near_dedup.near_groups(frame(rows[:n]), k, 80).collect()
        reps = made["classes"].count()
        assert made["star-pairs"].count() <= reps and made["star-links"].count() <= reps
        assert made["cross-links"].count() <= 2 * reps
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in found} == brute_groups(rows, k, 80)


def test_one_id_with_several_texts_keeps_all_links(frame):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (5, prose(3, 60)), (5, a), (6, ""), (6, prose(4, 60)), (6, prose(4, 60))]
    found = near_dedup.near_groups(frame(rows), 2, 80).collect()
    assert {(x.doc_id, x.component_id) for x in found} == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 6)} and len(found) == len(rows)
    assert {x.doc_id for x in near_dedup.drop_near_copies(frame(rows), 2).collect()} == {1, 6}


def test_loss_of_the_index_at_the_least_similarity():
    """Of 4,000 pairs at similarity 0.80 to 0.82, those without a common key: none; the expected share is 3e-6 or less."""
    r = np.random.default_rng(11)
    ones, twos = [], []
    for _ in range(4000):
        n = int(r.integers(40, 300))
        shared = int(np.ceil(n * r.uniform(0.802, 0.82) * 2 / (1 + 0.81)))
        whole = r.integers(0, 1 << 63, 2 * n - shared).astype(np.uint64)
        ones.append(np.unique(whole[:n]))
        twos.append(np.unique(np.concatenate([whole[:shared], whole[n:]])))
    x, y = (near_dedup.index_keys(near_dedup.signatures(s)) for s in (ones, twos))
    similar = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(ones, twos, strict=True)]
    missed = [s for p, q, s in zip(x, y, similar, strict=True) if s >= 0.8 and not np.isin(p, q).any()]
    assert np.mean([0.8 <= s <= 0.83 for s in similar]) > 0.6 and not missed
