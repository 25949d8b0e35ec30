"""Token files and packing against direct encoding with the library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from corvane.llm import hashindex, packing, registry, tokenfile  # noqa: E402
from corvane.llm.tokens import Encoder  # noqa: E402

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ROWS = [(3, "Hello there,  world"), (1, None), (2, ""), (None, "no key"), (3, "Hello there,  world"), (7, "ünïcode 漢字 İstanbul"), (9, "x " * 9000)]
PARTS = ["a", "b ", "  ", " ", "\n", "\t", "é", "The", "'s", "'", "re", "12", "²", "ª", "İ", "Σ", "漢", " ", " ", "\r\n", "!", "...", "x's", "<|endoftext|>", "’", "_", "  \n", "\x1c", "́"]


def library(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_memo_gives_the_library_ids(path):
    rng, ours, theirs = random.Random(7), Encoder(path), library(path)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(ours.ids(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_hash_index_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 5000))
    index = hashindex.build(keys)
    assert sorted(hashindex.slots(index, keys).tolist()) == list(range(len(keys)))
    assert len(hashindex.slots(hashindex.build(np.zeros(0, np.int64)), keys)) == len(keys)


def test_store_round_trip_with_nulls_and_repeats(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, 1) for k, t in ROWS], "doc_id long, text string, start int")
    path = str(tmp_path / "store")
    tokenfile.write_store(docs, path, BYTE, end_id=0)
    back = tokenfile.read_store(spark, path).orderBy("start").collect()
    t = library(BYTE)
    expect = sorted(((-1 if k is None else k), t.encode(x or "", add_special_tokens=False).ids + [0]) for k, x in ROWS)
    assert [(-1 if r.key is None else r.key) for r in back] == [k for k, _ in expect]
    assert sorted((-1 if r.key is None else r.key, np.frombuffer(r.ids, "<u4").tolist()) for r in back) == expect
    at = 0
    for r in back:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    asked = spark.createDataFrame([(9,), (3,), (3,), (4,), (None,)], "doc_id long")
    assert sorted(r.key for r in tokenfile.look_up(asked, path).collect()) == [3, 3, 9]


def test_rows_of_a_store_come_through_its_index(spark, tmp_path):
    path = str(tmp_path / "store")
    docs = spark.createDataFrame([(k, t) for k, t in ROWS] + [(3, "another"), (None, "none"), (8, "y")], "doc_id long, text string")
    tokenfile.write_store(docs.coalesce(1), path, BYTE, end_id=0)
    for r in tokenfile.shards(spark, path):
        shard = tokenfile.Shard(f"{path}/{r['file']}")
        assert tokenfile.indexed_rows(shard).tolist() == list(range(len(shard.keys)))
        rows = shard.parts["row"].copy()
        if len(rows) > 1:
            whole = [b.to_pylist() for b in tokenfile._documents(shard, 0)]
            shard.parts["row"] = np.roll(rows, 1)
            with pytest.raises(ValueError, match="index"):
                list(tokenfile._documents(shard, 0))
            assert sum(map(len, whole)) == len(shard.keys)


def test_empty_store(spark, tmp_path):
    path = str(tmp_path / "store")
    tokenfile.write_store(spark.createDataFrame([], "doc_id long, text string"), path, BYTE, end_id=0)
    assert tokenfile.read_store(spark, path).count() == 0
    assert tokenfile.look_up(spark.createDataFrame([(1,)], "doc_id long"), path).count() == 0


def test_op2_against_direct_encoding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in registry.op2_token_files(spark, sf).collect()}
    t, at = library(BYTE), 0
    assert len(got) == len(docs)
    for d in docs:
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)


def test_closest_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        capacity = rng.randint(0, 60)
        best = max(s for s in (sum(x for i, x in enumerate(items) if m >> i & 1) for m in range(1 << len(items))) if s <= capacity)
        chosen = packing.closest_counts({x: items.count(x) for x in items}, capacity)
        assert all(n <= items.count(x) for x, n in chosen.items()) and sum(x * n for x, n in chosen.items()) == best


def check_pieces(rows, expect):
    """Each id of each document lies in one piece; sequences are gapless and within the window."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= packing.WINDOW
    assert set(by_doc) == set(expect)
    for k, ids in expect.items():
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    return packing.padding([sum(r.length for r in own) for own in by_sequence.values()])


def test_op6_pieces(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    t = library(WORD)
    expect = {d.doc_id: t.encode(d.text or "", add_special_tokens=False).ids + [2] for d in docs}
    slack = check_pieces(registry.op6_packing(spark, sf).collect(), expect)
    assert slack < packing.WINDOW


def test_pack_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in ROWS], "doc_id long, text string, offset int")
    rows = packing.pack(docs, WORD, end_id=2).collect()
    t = library(WORD)
    assert sum(r.length for r in rows) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ROWS)
    assert packing.pack(docs.limit(0), WORD, end_id=2).count() == 0
