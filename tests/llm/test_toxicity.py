"""Toxicity: probabilities, a scorer by hand, held-out accuracy and odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import registry, toxicity
from corvane.llm.toxicity import DISCOUNT, PRIOR_LENGTH, TOXIC_SHARE


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = registry.op3_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    toxic, ordinary = ([s for s, y in held if y == k] for k in (1, 0))
    pairs = [(a > b) + 0.5 * (a == b) for a in toxic for b in ordinary]
    assert sum(pairs) / len(pairs) > 0.97
    assert sum(s >= 0.5 for s in toxic) > 0.9 * len(toxic) and sum(s < 0.5 for s in ordinary) > 0.97 * len(ordinary)


def test_likelihoods_sum_to_one_in_each_class():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50):
        counts, contexts = rng.integers(0, 9, (n, 2)).astype(float), rng.integers(1, 9, n).astype(float)
        p = toxicity.kneser_ney(counts, contexts)
        assert (p > 0).all() and np.allclose(p.sum(0), 1)
        assert math.isclose(toxicity.shared_backoff(contexts).sum(), 1)
    assert np.allclose(toxicity.kneser_ney(np.zeros((0, 2)), np.zeros(0)), 1)


def by_hand(texts):
    """Log ratio of each word of (label, words), by dictionaries."""
    count, before = [Counter(), Counter()], defaultdict(set)
    for y, words in texts:
        last = None
        for w in dict.fromkeys(words):
            count[y][w] += 1
            before[w].add(last)
            last = w
    every, n = sum(map(len, before.values())), [sum(c.values()) for c in count]
    rest = (1 - sum((len(b) - DISCOUNT) / every for b in before.values())) / (len(before) + 1)
    base = {w: (len(b) - DISCOUNT) / every + rest for w, b in before.items()}
    freed = [1 - sum(max(c - DISCOUNT, 0) / n[y] for c in count[y].values()) for y in (0, 1)]

    def ratio(w, less=0):
        toxic, ordinary = (max(count[y][w] - (1 - y) * less - DISCOUNT, 0) / n[y] + freed[y] * base[w] for y in (1, 0))
        return math.log(1 - TOXIC_SHARE + TOXIC_SHARE * toxic / ordinary * freed[0] / freed[1])

    known = [(c, ratio(w, 1)) for w, c in count[0].items() if c + count[1][w] > 1]
    mean = sum(c * x for c, x in known) / sum(c for c, _ in known)
    return {w: ratio(w) - mean for w in before}


def test_model_agrees_with_one_made_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        words = [f"w{int(x)}" for x in rng.zipf(1.5, 30) if x < 200] + ["vile"] * (k % 3 == 0) + ["fool"] * (k % 6 == 0)
        rows.append((k, " ".join(f"({w.title()})," for w in words), int(k % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int"))
    expect = by_hand([(y, [toxicity.expression(p) for p in toxicity.pieces(t)]) for _, t, y in rows])
    memo = toxicity.Memo(model)
    assert len(model.known) == len(expect)
    for w, x in expect.items():
        assert memo[w.encode()] == pytest.approx(x, abs=1e-9)
    text = "Vile fool, W1 unheard-of!"
    assert toxicity.normalised(memo, text) == pytest.approx((expect["vile"] + expect["fool"] + expect["w1"]) / (4 + PRIOR_LENGTH), abs=1e-9)
    odd = spark.createDataFrame([(1, "vile"), (2, "vile fool"), (3, "Vile, fool! vile fool vile"), (4, "wholly unheard of"), (5, None), (6, " w1 w2 w3 "), (7, "w1\u00a0vile")], "doc_id long, text string")
    assert {r.doc_id: r.toxicity.predicted for r in toxicity.score(odd, model).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you vile fool", "x"), (1, "you vile fool", "x"), (2, None, "x"), (None, "", "x"), (3, "a fine day " * 5000, "x"), (4, "vile vile", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(1, 1), (4, 1), (3, 0), (2, None), (None, 1), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.toxicity.score <= 1 for r in out)
    assert {r.toxicity.ratio for r in out if not r.text} == {0.0}
    vile, fine = ({r.toxicity.score for r in out if w in (r.text or "")} for w in ("vile", "fine"))
    assert min(vile) > max(fine)
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.toxicity.score for r in toxicity.score(docs, empty).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), empty).count() == 0
