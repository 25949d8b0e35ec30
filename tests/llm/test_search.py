"""Ranked lexical search, exact top-k search and clustering: against brute force, over odd rows, and their parts."""

from __future__ import annotations

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lexical, lloyd, normsearch, oracles, registry, vectors

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_lexical", "op12_topk", "op13_lloyd"])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    expect = con.sql(oracles.sql()[name])
    ours = registry.queries()[name](spark, sf)
    columns = expect.columns
    assert sorted(columns) == sorted(ours.columns)
    assert rows_of(ours, *columns) == sorted((tuple(r) for r in expect.fetchall()), key=str)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=20):
    """Every document scored for every item, by the definition."""
    words = [(d, terms(t)) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, n_words = len(words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    found = []
    for item, text in items:
        scores = []
        for d, w in words:
            m = 100 - 25 + (25 * len(w) * n_docs) // n_words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 12 * m)) for t in terms(text) if t in df)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        found += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(found, key=str)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "naïve", "x9", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 3, 20, 80])))) for i in range(n)]


@pytest.mark.parametrize("shard_words", [1, 60, 10**9])
def test_lexical_against_every_document(spark, shard_words, monkeypatch):
    """Shards of one document, of a few and of all, blocks of up to three postings, documents scored three at a time."""
    monkeypatch.setattr(lexical, "MOST", 3)
    monkeypatch.setattr(lexical, "TURN", 3)
    monkeypatch.setattr(lexical, "ITEMS", 4)
    docs = corpus(120)
    items = [(i, t) for i, t in corpus(15, seed=2)]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(lexical.rank(a, b, 5, shard_words), "item_id", "rank", "doc_id", "score") == ranked(docs, items, 5)


def test_lexical_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns, empty tables."""
    docs = [(3, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (1, "alpha beta"), (4, None), (5, ""), (6, "-- !!"), (7, "beta " * 40_000 + "gamma"), (8, "ALPHA\x00Beta_É é")]
    items = [(1, "Alpha alpha GAMMA"), (None, "beta"), (2, None), (3, "nothing here"), (1, "Alpha alpha GAMMA"), (4, "é É")]
    a = spark.createDataFrame([(d, t, "x", 9) for d, t in docs], "doc_id bigint, text string, term string, shard bigint")
    b = spark.createDataFrame([(d, t, "x", 9) for d, t in items], "item_id bigint, text string, part string, item bigint")
    assert rows_of(lexical.rank(a, b), "item_id", "rank", "doc_id", "score") == ranked(docs, items)
    assert lexical.rank(a.limit(0), b).collect() == [] == lexical.rank(a, b.limit(0)).collect()


def test_boundaries_are_the_cheapest():
    """Against every cut of short lists."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        length = rng.integers(1, 8, 3)
        scores, start = rng.integers(1, 100, length.sum()), np.cumsum(length) - length
        begins = lexical.boundaries(scores, start, length)

        def cost(own, cut):
            edges = [0, *[i for i in range(1, len(own)) if cut[i - 1]], len(own)]
            price = lexical.PRICE * max(1, int(own.sum()) // len(own))
            return sum(int(own[a:b].max()) * (b - a) + price for a, b in zip(edges, edges[1:], strict=False))

        for s, n in zip(start, length, strict=True):
            own, chosen = scores[s : s + n], begins[s : s + n]
            assert chosen[0]
            least = min(cost(own, [(c >> i) & 1 for i in range(n - 1)]) for c in range(2 ** (n - 1)))
            assert cost(own, chosen[1:]) == least


def test_blocks_are_skipped():
    """Most documents cannot reach the best score, and their blocks stay closed."""
    n = 2000
    scores = np.ones(n, np.int64)
    scores[700:720] = 1000
    at = np.arange(n)
    blocks, first = lexical.blocked(at, scores, np.asarray([0]), np.asarray([n]))
    opened = []
    spans = lexical.spans
    lexical.spans = lambda a, b: opened.append(int((b - a).sum())) or spans(a, b)
    try:
        found, score = lexical.walk(blocks, np.arange(first[0], first[1]), np.ones(first[1], np.int64), at, scores, n, at, 20)
    finally:
        lexical.spans = spans
    assert sorted(found) == list(range(700, 720)) and set(score) == {1000} and sum(opened) < 300


def whole(vector, scale):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def best_products(rows, k, every):
    own = [(i, d, whole(v, 256)) for i, (d, v) in enumerate(rows) if usable(v)]
    found = []
    for i, d, q in own:
        if d is None or d % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), e is None, e or 0, e) for j, e, v in own if j != i), key=lambda x: x[:3])
        found += [(d, r + 1, e, -s) for r, (s, _, _, e) in enumerate(scores[:k])]
    return sorted(found, key=str)


VECTORS = "vec_id bigint, embedding array<float>"


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_topk_against_all_products(spark, spread, monkeypatch):
    """Many buckets and blocks, lengths alike and lengths over orders of magnitude, close directions and any."""
    for name, value in (("BUCKET", 40), ("BLOCK", 7), ("AHEAD", 30), ("SLICE", 3)):
        monkeypatch.setattr(normsearch, name, value)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    data = base[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8)) * rng.choice([0.02, 1.0], (400, 1))
    data *= np.exp(spread * rng.normal(size=(400, 1)))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(data)]
    found = normsearch.top(spark.createDataFrame(rows, VECTORS), k=5, every=9)
    assert rows_of(found, "query_id", "rank", "vec_id", "score") == best_products(rows, 5, 9)


def test_topk_odd_rows(spark):
    """Null, ragged, empty, zero and non-finite vectors, null and repeated ids, ties, clashing columns, empty tables."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (None, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [0.0, 0.0]), (100, [0.0, 0.0]), (7, [-1.0, -2.0, 5.0]), (8, [-0.001, 0.5]), (2**60, [1.0, 2.0]), (2**60 + 1, [1.0, 2.0])]
    table = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id bigint, embedding array<float>, row int, part string")
    assert rows_of(normsearch.top(table), "query_id", "rank", "vec_id", "score") == best_products(rows, 5, 50)
    assert normsearch.top(table.limit(0)).collect() == []
    assert normsearch.top(table.where("vec_id = 50").limit(1)).collect() == []
    with pytest.raises(Exception, match="too large"):
        normsearch.top(spark.createDataFrame([(1, [3e38, 1.0])], VECTORS)).collect()


def test_coordinates_prune_and_lose_nothing():
    """Every vector that reaches the cosine is within the bounds of the largest coordinates, and few others are."""
    rng = np.random.default_rng(5)
    import pandas as pd

    points = (rng.normal(size=(3000, 6)) * 100).astype("<i8")
    rows = pd.DataFrame({"row": np.arange(3000), "vec_id": np.arange(3000), "no_id": False, "components": [p.tobytes() for p in points], "square": (points**2).sum(1)})
    bucket = normsearch.Bucket(rows, 6)
    for query in points[:20]:
        length = math.sqrt((query**2).sum())
        reach = (bucket.points @ query) / bucket.length / length >= 0.95
        places = bucket.within(query, length, 0.95)
        assert set(np.flatnonzero(reach)) <= set(places)
        assert len(places) < 600


def clustered(rows, k=8, rounds=10, size=64):
    points = [(d, whole(v, 1024)) for d, v in rows if usable(v) and len(v) == size]
    named = lambda d: (d is None, hashlib.sha256(f"3:{d}".encode()).hexdigest() if d is not None else "")
    first = sorted(points, key=lambda p: (named(p[0]), np.asarray(p[1], "<i8").tobytes()))[:k]
    centres = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in points:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(d, *nearest(v)) for d, v in points]
    total = {}
    for _, x, j in found:
        total[j] = total.get(j, 0) + x
    return sorted(((d, j, x, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for d, x, j in found), key=str)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_lloyd_against_plain_loops(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(rng.normal(size=(90, 64)))]
    table = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert rows_of(lloyd.cluster(table), *COLUMNS) == clustered(rows)


def test_lloyd_odd_rows(spark):
    """Null, short, long and non-finite vectors, null and repeated ids, ties, fewer vectors than clusters, clashing
    columns, an empty table."""
    one, two = [1.0] * 64, [-1.0] * 64
    rows = [(1, one), (1, one), (1, two), (None, one), (2**60, two), (2**60 + 1, two), (3, None), (4, [1.0] * 63), (5, [1.0] * 65), (6, [float("nan"), *one[1:]]), (7, [None, *one[1:]]), (8, [float("inf"), *one[1:]]), (9, [0.0] * 64)]
    table = spark.createDataFrame([(d, v, 1, "x") for d, v in rows], "vec_id bigint, embedding array<float>, cluster int, distance string")
    assert rows_of(lloyd.cluster(table), *COLUMNS) == clustered(rows)
    assert rows_of(lloyd.cluster(table.where("vec_id = 9")), *COLUMNS) == clustered(rows[-1:])
    assert lloyd.cluster(table.limit(0)).collect() == []


def test_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, []), (3, None)]
    found = vectors.quantised(spark.createDataFrame(rows, VECTORS), 256).withColumn("n", F.length("components")).collect()
    assert [(r.vec_id, r.size, r.square, r.n) for r in found] == [(1, 2, 128 * 128 + 1, 16), (2, 0, 0, 0)]
