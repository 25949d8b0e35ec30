"""Global order, by brute force, and plans without a window over all rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import graph, match, order, sample, stats
from corvane.sources import io


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(("a", "b", None)), rng.choice((0.5, 1.5, rng.random() * 9)), rng.randint(0, 3)) for i in range(n)]


@pytest.fixture(scope="module")
def wide(spark):
    """Settings that keep several partitions of a small table."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_numbers_and_tiles(wide):
    rows = rows_of(300, 1)
    df = wide.createDataFrame(rows, "i int, k string, x double, w int").repartition(5)
    by = [F.desc("x"), F.col("i")]
    got = {r.i: r.n for r in order.numbered(df, by).collect()}
    assert got == {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    within = {r.i: (r.n, r.of) for r in order.numbered(df, by, keys=["k"], total="of").collect()}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))
        assert all(within[r[0]] == (n, len(own)) for n, r in enumerate(own))
    tiles = {r.i: r.t for r in order.tiles(df, by, 7, "t").collect()}
    assert tiles == {i: n * 7 // 300 for i, n in got.items()}
    assert order.numbered(df.limit(0), by).count() == 0 == order.tiles(df.limit(0), by, 3, "t").count()


def test_running_sums_and_neighbours(wide):
    rows = rows_of(300, 2)
    df = wide.createDataFrame(rows, "i int, k string, x double, w int").repartition(5)
    got = {r.i: (r.s, r.s_total) for r in order.running(df, ["k"], [F.col("x"), F.col("i")], {"s": "w"}).collect()}
    for key in ("a", "b", None):
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        sums = np.cumsum([r[3] for r in own]).tolist()
        assert [got[r[0]] for r in own] == [(s, sums[-1]) for s in sums]
    point = F.when(F.col("w") == 0, F.col("x"))
    for r in order.between(df, [F.col("x"), F.col("i")], point, "l", "r").collect():
        at = (r.x, r.i)
        marks = sorted((x, i) for i, _, x, w in rows if w == 0)
        assert r.l == max((m for m in marks if m <= at), default=(None,))[0]
        assert r.r == min((m for m in marks if m >= at), default=(None,))[0]


def test_quantiles_against_numpy(wide):
    rng = random.Random(3)
    rows = [(k, rng.gauss(0, 3) if rng.random() < 0.8 else None) for k in ("a", "b", "c") for _ in range(rng.randint(1, 90))] + [("d", 2.0)]
    df = wide.createDataFrame(rows, "k string, x double")
    shares = {"q1": 0.1, "q2": 0.5, "q3": 0.987}
    for r in stats.quantiles(df, ["k"], "x", shares).collect():
        own = [x for k, x in rows if k == r.k and x is not None]
        assert r.n == len(own) and [r[n] for n in shares] == pytest.approx(np.quantile(own, list(shares.values())).tolist())


def test_places_side_by_side_need_equal_lengths(wide):
    a = wide.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "x int, p string")
    b = wide.createDataFrame([(9.0,), (7.0,), (8.0,)], "y double")
    got = sorted(tuple(r) for r in match.by_position([(a, [F.col("x")]), (b, [F.desc("y")])]).select("row", "p", "y").collect())
    assert got == [(0, "a", 9.0), (1, "b", 8.0), (2, "c", 7.0)]
    with pytest.raises(ValueError, match="side by side"):
        match.by_position([(a, [F.col("x")]), (b.limit(2), [F.col("y")])])


def test_exactly_one_row(wide):
    table = wide.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [r.v for r in io.exactly_one(wide.createDataFrame([(1,)], "k int"), table, ["k"]).collect()] == ["a"]
    for k in (2, 3):
        with pytest.raises(Exception, match=f"rows of {k}"):
            io.exactly_one(wide.createDataFrame([(k,)], "k int"), table, ["k"]).collect()


def test_interleaving_that_runs_out(wide):
    df = wide.createDataFrame([(i, "a" if i % 3 else "b") for i in range(30)], "i int, g string")
    placed = sample.interleaved(df, "g", [F.col("i")], {"a": 4, "b": 3})
    assert {(r.batch, r.g): r["count"] for r in placed.groupBy("batch", "g").count().collect()} == {(b, g): n for b in range(3) for g, n in (("a", 4), ("b", 3))}
    with pytest.raises(ValueError, match="runs out"):
        sample.interleaved(df, "g", [F.col("i")], {"a": 4, "b": 3}, batches=4)


def test_components_and_chains(wide):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(90)]
    parent = {n: n for pair in links for n in pair}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(wide.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}
    nodes = wide.createDataFrame([(0, None, 15), (1, 0, 15), (2, 1, 15), (3, 2, 16), (4, 3, 16), (5, 9, 16)], "node long, parent long, pdg int")
    assert {r.node: r.last for r in graph.terminal_copies(nodes, kind="pdg").collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}


def test_quantiles_by_selection(spark, monkeypatch):
    """Few bins and rows at a time, so that steps repeat: equal values, null keys, long tails, infinite values, one row."""
    import numpy as np

    from corvane.operators import stats

    monkeypatch.setattr(stats, "SELECTION_BINS", 4)
    monkeypatch.setattr(stats, "SELECTION_ROWS", 5)
    rng = np.random.default_rng(4)
    groups = {"equal": [3.0] * 50, "tail": np.exp(rng.normal(size=200) * 8).tolist(), None: rng.normal(size=90).round(1).tolist(), "one": [7.5], "signs": [-1e308, 1e308, 0.0, 5e-324, -5e-324, 2.0], "few": rng.integers(0, 4, 300).astype(float).tolist()}
    rows = [(k, v) for k, own in groups.items() for v in [*own, None]]
    shares = {"a": 0.1, "m": 0.5, "z": 0.975}
    found = {r["k"]: r for r in stats.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", shares).collect()}
    assert set(found) == set(groups)
    for k, own in groups.items():
        r = found[k]
        assert (r["n"], r["min"], r["max"]) == (len(own), min(own), max(own))
        own = sorted(own)
        for name, share in shares.items():
            at = (len(own) - 1) * share
            low, high = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert np.isclose(r[name], low + (high - low) * (at - np.floor(at)), rtol=1e-12), (k, name)
    odd = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("nan"),)], "v double")
    r = stats.quantiles(odd, [], "v", {"q": 0.25, "m": 0.5}).first()
    assert (r["n"], r["min"], r["q"], r["m"]) == (5, float("-inf"), 1.0, 2.0) and np.isnan(r["max"])
    # Without rows there is no group; without keys there is one row, as of any aggregate.
    assert stats.quantiles(odd.limit(0), [], "v", {"m": 0.5}).first()["m"] is None
    assert stats.quantiles(odd.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"m": 0.5}).collect() == []
