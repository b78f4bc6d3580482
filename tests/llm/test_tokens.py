"""Token files, packing and SentencePiece against the libraries themselves."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from chronoloom.llm import packing, pieces, queries, tokens
from chronoloom.llm.common import work_path
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

BPE = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
SP = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ODD = st.text(alphabet=st.characters(codec="utf-8"), max_size=60)
NEAR = st.text(alphabet="aAbz019 .,'s\t\n\r\x0b\x1c\x85\xa0éÜß€–日あ🙂<|endoftext|>", max_size=60)


def ids_of(text):
    return BPE.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, NEAR))
def test_encoder_equals_the_library(text):
    assert tokens.encoder(queries.byte_bpe()).encode(text) == BPE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("first", [0x20, 0xA1, 0x391, 0x410, 0x2010, 0x3041, 0x4E00])
def test_agreed_characters_split_alike(first):
    chars = [chr(c) for c in range(first, first + 3000) if not tokens.AGREED.search(chr(c))]
    text = "".join(f"{c}a {c} 1{c}\n{c}{c}  {c}" for c in chars)
    enc = tokens.encoder(queries.byte_bpe())
    assert enc.fast.encode_ordinary(text) == BPE.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_bits_round_trip(bits, ids):
    held = np.array([i % (1 << bits) for i in ids], np.uint32)
    data = tokens.pack_block(held, bits)
    assert len(data) == -(-len(held) * bits // 8) and (tokens.unpack_block(data, len(held), bits) == held).all()


@pytest.mark.parametrize("bits", [11, 16])
def test_file_random_access(tmp_path, bits):
    r = np.random.default_rng(1)
    docs = [r.integers(0, 1 << bits, n).astype(np.uint32) for n in (3, 1, 500, 64, 129)]
    w = tokens.TokenFileWriter(f"file://{tmp_path}/t.bits", bits, block_ids=64)
    for k, d in enumerate(docs):
        w.add(None if k == 1 else k, d)
    w.close()
    f = tokens.TokenFile(f"file://{tmp_path}/t.bits")
    assert f.doc_ids == [0, None, 2, 3, 4] and all((f.document(k) == d).all() for k, d in enumerate(docs))
    whole = np.concatenate(docs)
    assert (f.ids(60, 140) == whole[60:140]).all() and f.n_blocks == -(-len(whole) // 64)
    data = (tmp_path / "t.bits").read_bytes()
    (tmp_path / "cut.bits").write_bytes(data[:-5])
    with pytest.raises(ValueError):
        tokens.TokenFile(f"file://{tmp_path}/cut.bits")


def test_every_character_of_the_fast_path_beside_every_kind():
    """Each character that the fast path takes, before, after and between characters of each kind that splitting tells apart."""
    import sys

    enc = tokens.encoder(queries.byte_bpe())
    agreed = [c for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and not tokens.AGREED.search(c)]
    assert len(agreed) > 20_000
    kinds = ["a", "Z", "7", " ", "  ", "\n", "\t", "'", "'s", "'ll", ".", "é", "ж", "日", "€", "_"]
    texts = [f"{c}{k}{c}{k}y" for c in agreed for k in kinds]
    assert not any(tokens.AGREED.search(t) for t in texts[:1000])
    slow = [e.ids for e in BPE.encode_batch(texts, add_special_tokens=False)]
    assert slow == enc.fast.encode_ordinary_batch(texts, num_threads=4)


def test_token_files_of_edge_documents(spark, edge_docs, no_docs):
    found = tokens.token_round_trip(edge_docs, queries.byte_bpe()).orderBy("start").collect()
    order = [r.doc_id for r in found]
    assert order == sorted(order, key=lambda i: -(2**63) if i is None else i)
    at = 0
    for r in found:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    want = Counter((r.doc_id, tuple(ids_of(r.text))) for r in edge_docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in found) == want
    assert tokens.token_round_trip(no_docs, queries.byte_bpe()).isEmpty()


def test_packing_of_edge_documents(spark, edge_docs, no_docs):
    found = packing.pack_documents(edge_docs.where("doc_id IS NOT NULL AND doc_id <> 5"), queries.byte_bpe()).collect()
    want = {r.doc_id: ids_of(r.text) for r in edge_docs.collect()}
    pieces_of = {}
    for r in found:
        pieces_of.setdefault(r.doc_id, []).append(r)
        assert r.length <= 1024 and r.length & (r.length - 1) == 0 and r.offset == 0
    for i, held in pieces_of.items():
        held.sort(key=lambda r: r.start)
        assert b"".join(r.ids for r in held) == np.array(want[i], "<u4").tobytes() and held[0].doc_tokens == len(want[i])
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    lengths = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    assert packing.pack_documents(no_docs, queries.byte_bpe()).isEmpty()
    assert packing.pack_documents(edge_docs, queries.byte_bpe()).count() > len(found)
    with pytest.raises(ValueError):
        packing.document_pieces(edge_docs, queries.byte_bpe(), window=1000)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6))
def test_piece_lengths(n):
    parts = packing.piece_lengths(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and len({p for p in parts if p < 1024}) == len([p for p in parts if p < 1024])


@settings(max_examples=400, deadline=None)
@given(st.one_of(ODD, st.text(alphabet="ab ▁\n\t\x00é🙂<0x41></s>", max_size=40)))
def test_chunks_encode_like_the_library(text):
    assert pieces.chunk_encoder(MODEL).encode(text).tolist() == SP.encode(text)


def test_a_small_table_changes_nothing():
    enc = pieces.ChunkEncoder(MODEL, own_chunks=4)
    for text in ("a b c d e f g", "h i j  k l", "a b h i x y z"):
        assert enc.encode(text).tolist() == SP.encode(text) and len(enc.table) <= 12


def test_piece_round_trip_of_edge_documents(edge_docs, no_docs):
    found = pieces.piece_round_trip(edge_docs, MODEL).collect()
    want = Counter()
    for r in edge_docs.collect():
        ids = SP.encode(r.text or "", add_eos=True)
        want[r.doc_id, tuple(ids), SP.decode(ids)] += 1
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found) == want
    assert pieces.piece_round_trip(no_docs, MODEL).isEmpty()


@pytest.mark.parametrize("most", [0, 3, 25])
def test_the_table_has_the_commonest_chunks_and_changes_no_id(frame, most):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=40)) + r.choice(["", " once%d" % i, "  two  spaces ", " ▁mark"]) for i in range(80)]
    counts = Counter(w for t in texts for w in t.split(" ") if w and "▁" not in w)
    docs = frame(list(enumerate(texts)))
    table = pieces.chunk_table(docs, MODEL, most)
    assert len(table) <= most and all(counts[w] > 1 for w in table) and (most < 25 or len(table) >= 15)
    if table:
        assert min(counts[w] for w in table) > max([n for w, n in counts.items() if w not in table]) * 0.9
    assert all(np.frombuffer(ids, np.int32).tolist() == SP.encode(w) for w, ids in table.items())
    for x in pieces.piece_round_trip(docs, MODEL, most).collect():
        assert x.ids == SP.encode(texts[x.doc_id], add_eos=True) and x.decoded == SP.decode(x.ids)


def test_op7_columns_tell_where_every_id_lies(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held, sequences = {}, set()
    for r in queries.op7_packing(spark, sf_dir).collect():
        held.setdefault(r.doc_id, []).append(r)
        assert r.offset == 0 and r.sequence_id not in sequences and 1 <= r.length <= 1024
        sequences.add(r.sequence_id)
    assert set(held) == set(texts) and sequences == set(range(len(sequences)))
    for i, rows in held.items():
        ids, at = ids_of(texts[i]), 0
        rows.sort(key=lambda r: r.start)
        n = len(ids)
        want = [1024] * (n // 1024) + [1 << k for k in range(9, -1, -1) if n % 1024 >> k & 1]
        assert [r.length for r in rows] == want and all(r.doc_tokens == n for r in rows)
        for r in rows:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == n


def test_queries_hash_what_the_operators_return(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for r in queries.op2_token_files(spark, sf_dir).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(ids_of(texts[r.doc_id])), crc(ids_of(texts[r.doc_id])))
    for r in queries.op7_packing(spark, sf_dir).collect():
        assert r.ids_crc32 == crc(ids_of(texts[r.doc_id])[r.start : r.start + r.length])
    import hashlib

    for r in queries.op5_sentencepiece(spark, sf_dir).collect():
        ids = SP.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(SP.decode(ids).encode()).hexdigest()


def test_manifest_lists_files_in_order(spark, edge_docs):
    where = work_path(spark, "tokens")
    rows = tokens.write_token_files(edge_docs, queries.byte_bpe(), where).orderBy("part").collect()
    assert sum(r.n_docs for r in rows) == edge_docs.count() and tokens.bits_for(50257) == 16
