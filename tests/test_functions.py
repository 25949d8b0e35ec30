"""Functions and operators at their edges, against independent formulas."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import classify, geometry, numeric
from corvane.operators import graph, hist, match, metrics, sample, stats, tensor
from corvane.sources import io


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_delta_phi_edges(spark):
    pi = math.pi
    a, b = F.col("a"), F.col("b")
    got = values(spark, [(pi, -pi), (-pi, pi), (pi, 0.0), (-pi, 0.0), (3.0, -3.0), (0.1, 0.2)], "a double, b double", geometry.delta_phi(a, b), geometry.delta_phi(a, b, True))
    expect = [(0.0, 0.0), (0.0, 0.0), (pi, pi), (pi, -pi), (6 - 2 * pi, 6 - 2 * pi), (-0.1, -0.1)]
    for x, y in zip(got, expect, strict=True):
        assert x == pytest.approx(y)


def test_four_vector_round_trip(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(1, 90), rng.uniform(-2, 2), rng.uniform(-3, 3), rng.uniform(0, 5)) for _ in range(50)]
    c = [F.col(x) for x in "abcd"]
    for back, r in zip(values(spark, rows, "a double, b double, c double, d double", geometry.from_p4(geometry.p4(*c)).alias("v")), rows, strict=True):
        assert tuple(back[0]) == pytest.approx(r, abs=1e-5)


def test_bins_at_edges(spark):
    x = F.col("x")
    rows = [(-0.1,), (0.0,), (0.999,), (1.0,), (9.999,), (10.0,), (10.1,), (None,)]
    assert [r[0] for r in values(spark, rows, "x double", numeric.uniform_bin(x, 0, 10, 10))] == [0, 1, 1, 2, 10, 11, 11, None]
    assert [r[0] for r in values(spark, rows, "x double", numeric.uniform_bin(x, 0, 10, 10, True))][:7] == [0, 1, 1, 2, 10, 10, 11]
    assert [r[0] for r in values(spark, rows[:7], "x double", numeric.edge_bin(x, [0.0, 1.0, 10.0]))] == [0, 1, 1, 2, 2, 3, 3]


def test_flags_and_guards(spark):
    rows = [(0.0,), (1.0,), (5e-324,), (float("nan"),), (float("inf"),), (None,), (-2.0,)]
    got = values(spark, rows, "x double", numeric.is_normal(F.col("x")), numeric.guarded(F.lit(1.0), F.col("x"), -9.0))
    assert [g[0] for g in got] == [False, True, False, False, False, False, True]
    assert got[0][1] == -9.0 and got[1][1] == 1.0 and got[5][1] == -9.0


def test_uniform_is_a_function_of_seed_and_key(spark):
    rows = [(i,) for i in range(200)]
    u = numeric.uniform(3, F.col("i"))
    one = sorted(values(spark, rows, "i long", "i", u))
    many = sorted(tuple(r) for r in spark.createDataFrame(rows, "i long").repartition(8).select("i", u).collect())
    assert one == many and all(0 <= x < 1 for _, x in one) and len({x for _, x in one}) == 200


def test_intervals_and_grids():
    r = numeric.Interval.parse("(1:3]")
    assert r == (1.0, 3.0, False, True) and r.overlaps(numeric.Interval(3, 4)) and not r.overlaps(numeric.Interval(0, 1, True, True))
    assert r.combined(numeric.Interval(0, 3)) == (0, 3.0, True, True) and r.scaled(2.0)[:2] == (2.0, 6.0)
    assert numeric.grid("0:1:0.25") == [0, 0.25, 0.5, 0.75, 1.0] == numeric.grid("0:1|5") == numeric.grid("0:1/4")
    with pytest.raises(ValueError, match="not a range"):
        numeric.Interval.parse("[1;2]")


def test_gen_match_boundaries(spark):
    cols = [F.col(c) for c in ("k", "l", "j", "d", "p")]
    rows = [(1, 0, -1, 0.2, 8.0), (1, 0, -1, 0.2001, 8.0), (5, 0, -1, 0.1, 14.9), (5, 0, -1, 0.1, 15.0), (1, -1, 0, 9.0, 0.0), (1, -1, -1, 0.0, 9.0)]
    assert [r[0] for r in values(spark, rows, "k int, l int, j int, d double, p double", classify.gen_match(*cols))] == [1, None, None, 5, 6, None]
    assert [r[0] for r in values(spark, rows[:1], "k int, l int, j int, d double, p double", classify.gen_match(*cols, edge_open=True))] == [None]
    with pytest.raises(Exception, match="unknown lepton kind"):
        values(spark, [(9, 0, -1, 0.1, 20.0)], "k int, l int, j int, d double, p double", classify.gen_match(*cols))


def test_rebin_of_fill_is_fill_of_coarse(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.uniform(-1, 11), rng.random()) for _ in range(500)], "x double, w double")
    fine, coarse = hist.Axis(0.0, 10.0, 20), hist.Axis(2.0, 8.0, 3)
    key = lambda h: sorted((r.b, r.n, round(r.sumw, 9), round(r.sumw2, 9)) for r in h.collect())
    a = hist.rebin(hist.fill(df, [], {"b": (F.col("x"), fine)}, F.col("w")), "b", fine, coarse)
    assert key(a) == key(hist.fill(df, [], {"b": (F.col("x"), coarse)}, F.col("w")))
    with pytest.raises(ValueError, match="whole bins"):
        hist.rebin(a, "b", fine, hist.Axis(0.0, 10.0, 7))


def test_partial_sums_merge(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", float("inf")), ("b", 2.0), ("c", None)], "k string, x double")
    got = {r.k: (r.n, r["mean"], r["std"]) for r in stats.combined(stats.partial(df, ["k"], F.col("x")), ["k"]).collect()}
    assert got == {"a": (2, 2.0, 1.0), "b": (1, None, None), "c": (0, None, None)}


def test_near_pairs_across_the_seam(spark):
    rng = random.Random(2)
    rows = [(i % 3, i, rng.uniform(-2, 2), rng.uniform(-math.pi, math.pi)) for i in range(150)] + [(0, 900, 0.0, math.pi - 0.01), (0, 901, 0.0, -math.pi + 0.01)]
    df = spark.createDataFrame(rows, "e int, i int, eta double, phi double")
    for radius in (0.3, 2.5):
        got = sorted((r.i, r.i_b) for r in match.near_pairs(df, df, ["e"], radius).collect())

        def dr(a, b):
            d = abs(a[3] - b[3])
            return math.hypot(a[2] - b[2], min(d, 2 * math.pi - d))

        assert got == sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and dr(a, b) < radius)


def test_merge_first_wins(spark):
    rows = [(1, 0, 0, 0.0, 3.1415, 10.0), (1, 1, 0, 0.001, -3.1415, 10.001), (1, 1, 1, 0.5, 0.0, 10.0), (2, 2, 0, 0.0, 0.0, 1.0)]
    got = sorted(tuple(r) for r in match.merge_first_wins(spark.createDataFrame(rows, "ev int, source int, idx int, eta double, phi double, pt double"), "ev").collect())
    assert got == [(1, 0.0, 3.1415, 10.0, 3), (1, 0.5, 0.0, 10.0, 2), (2, 0.0, 0.0, 1.0, 4)]


def test_closure_on_a_cycle_and_a_chain(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (10, 11)] + [(i, i + 1) for i in range(20, 50)], "a long, b long")
    start = spark.createDataFrame([(1, 1), (20, 20)], "root long, node long")
    got = {r.root: r.n for r in match.closure(start, links).groupBy("root").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 3, 20: 31}


def test_closure_follows_a_chain_of_any_length(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.range(110).selectExpr("id as a", "id + 1 as b").coalesce(1)
    assert match.closure(spark.createDataFrame([(0, 0)], "root long, node long"), links).count() == 111


def test_terminal_copies(spark):
    df = spark.createDataFrame([(i, i - 1 if i % 100 else None) for i in range(1, 300)] + [(400, 401), (401, 400)], "node long, parent long").where("node <> 100 or parent is null")
    got = {r.node: r.last for r in graph.terminal_copies(df.fillna({"parent": -1}).replace(-1, None, ["parent"])).collect()}
    assert got.get(299) == 200 and 400 not in got


def test_curves(spark):
    rng = random.Random(3)
    rows = [(float(i), True) for i in range(50, 60)] + [(float(i), False) for i in range(10)]
    auc = lambda rows: metrics.auc(metrics.roc(spark.createDataFrame(rows, "s double, t boolean"), [], "s", F.col("t")), []).first()[0]
    assert auc(rows) == pytest.approx(1.0)
    assert auc([(1.0, bool(i % 2)) for i in range(20)]) == pytest.approx(0.5)
    mixed = [(rng.choice((1.0, 2.0, 3.0, 4.0)), rng.random() < 0.4) for _ in range(200)]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in mixed if x for b, y in mixed if not y]
    assert auc(mixed) == pytest.approx(sum(pairs) / len(pairs))


def test_exact_interval_against_binomial_sums():
    alpha = 0.317311
    tail = lambda ks, n, p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
    for n in (1, 5, 30):
        for k in range(n + 1):
            low, high = metrics.exact_interval(k, n, alpha)
            assert k == 0 and low == 0 or tail(range(k, n + 1), n, low) == pytest.approx(alpha / 2, abs=1e-9)
            assert k == n and high == 1 or tail(range(k + 1), n, high) == pytest.approx(alpha / 2, abs=1e-9)


def test_interpolation_at_common_points(spark):
    a = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (2.0, 5.0)], "x double, y double")
    b = spark.createDataFrame([(0.0, 0.0), (1.0, 10.0)], "x double, y double")
    assert sorted(tuple(r) for r in metrics.at_common_points(a, b, "x", "y").collect()) == [(0.0, 1.0, 0.0), (0.5, 2.0, 5.0)]


def test_cells(spark):
    x = F.col("x")
    rows = [(0.0,), (0.009,), (-0.011,), (0.011,), (-0.05,), (0.05,), (0.12,)]
    assert [r[0] for r in values(spark, rows, "x double", tensor.cell_index(x, 0.02, 11))] == [5, 5, 4, 6, 2, 8, None]
    assert [r[0] for r in values(spark, rows, "x double", tensor.cell_index(x, 0.02, 4))] == [2, 2, 1, 2, None, None, None]
    assert values(spark, [([1.0],), ([],), ([1.0, 2.0, 3.0],)], "x array<double>", tensor.padded(x, 2)) == [([1.0, 0.0],), ([0.0, 0.0],), ([1.0, 2.0],)]


def test_mix_and_sieve(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 5)], "g string, n long")
    assert {r.g: r.fraction for r in sample.mix_fractions(sizes, "g", {"a": 1.0, "b": 1.0}).collect()} == pytest.approx({"a": 0.1, "b": 1.0})
    assert values(spark, [(80.0,), (60.0,)], "x double", sample.sieve(F.col("x"))) == [(1.0,), (pytest.approx(math.exp(-1)),)]


def test_column_patterns_and_properties():
    assert io.chosen_columns(["tau_pt", "tau_eta", "evt", "x"], ["^tau_", "evt"], ["^.*_eta$"]) == ["tau_pt", "evt"]
    assert io.properties('# c\na: x=1 \\\n y="two words"\nb: z=3 # end\n') == {"a": {"x": "1", "y": "two words"}, "b": {"z": "3"}}
    for bad in ("a: x=1\na: y=2", "a: x=1 x=2", "no colon"):
        with pytest.raises(ValueError, match="repeated"):
            io.properties(bad)


def test_sources_and_sinks(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    for kind in ("parquet", "orc", "json"):
        io.snapshot(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), str(tmp_path / kind), by=["o_orderstatus"], compression="gzip" if kind == "json" else "zstd", rows_per_file=500, kind=kind)
        back = io.scan(spark, [str(tmp_path / kind)], ["o_orderkey", "half"], "o_orderstatus = 'F'", {"half": "o_totalprice / 2"}, kind)
        assert back.count() == o.where("o_orderstatus = 'F'").count() and back.columns == ["o_orderkey", "half"]
    assert io.inventory(spark.read.parquet(str(tmp_path / "parquet"))).agg(F.sum("rows")).first()[0] == o.count()
    lines = spark.createDataFrame([("./a/one.root 10",), ("# no",), ("./b/two.root 20 # c",), ("",)], "value string")
    files = io.file_list(lines)
    assert sorted((r.path, r.entries) for r in files.collect()) == [("./a/one.root", 10), ("./b/two.root", 20)]
    assert [r.path for r in io.matching(files, r"\./a", r"on.\.root").collect()] == ["./a/one.root"]
    assert [r.o_orderkey for r in io.entry_range(o, ["o_orderkey"], 2, 4).collect()] == [r.o_orderkey for r in o.orderBy("o_orderkey").limit(4).collect()][2:]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, io.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_the_library_does_not_need_the_training_data_operators():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "corvane"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "corvane.llm" not in path.read_text(), path
