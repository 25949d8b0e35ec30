"""Selectors, features, pools, decays and formats at their edges."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import features, numeric, text
from corvane.functions.numeric import Interval
from corvane.operators import graph, hist, match, metrics, select, stats, tensor
from corvane.plans import more, nested
from corvane.sources import io

MUON = "struct<pt:double,eta:double,phi:double,charge:int,iso:double,dz:double,dxy:double,loose:boolean,medium:boolean,tight:boolean>"
ELECTRON = "struct<pt:double,eta:double,phi:double,charge:int,iso:double,dz:double,dxy:double,mva:boolean,veto:boolean>"
CANDIDATE = "struct<index:int,tau:struct<pt:double,eta:double,phi:double,charge:int,mode:int,found:boolean,vs_jet:double,vs_jet_raw:double,dz:double>,lepton:struct<kind:int,pt:double,eta:double,phi:double>,gen_jet:struct<eta:double>,jet:struct<pt:double,eta:double,phi:double>>"
EVENT = f"ev int, muons array<{MUON}>, electrons array<{ELECTRON}>, candidates array<{CANDIDATE}>, triggers array<struct<eta:double,phi:double,labels:array<string>>>, met struct<pt:double,phi:double>"


def muon(pt=30.0, eta=0.0, phi=0.0, charge=1, iso=0.05, medium=True):
    return (pt, eta, phi, charge, iso, 0.0, 0.0, True, medium, False)


def tau(index, pt=40.0, eta=1.0, charge=-1, raw=0.9):
    return (index, (pt, eta, 0.0, charge, 1, True, 1.0, raw, 0.0), None, None, None)


def test_selectors_on_small_events(spark):
    fired = [(0.1, 0.1, [select.TRIGGER])]
    rows = [
        (1, [muon(), muon(pt=40.0), muon(iso=0.1, eta=1.5, charge=-1, pt=16.0)], [], [tau(0), tau(1, raw=0.95), tau(2, raw=0.99, eta=0.1)], fired, (10.0, 0.0)),
        (2, [muon()], [], [tau(0, charge=1)], fired, (10.0, 0.0)),
        (3, [muon()], [], [tau(0)], [(2.0, 2.0, [select.TRIGGER])], (10.0, 0.0)),
        (4, [muon(pt=24.0)], None, [tau(0)], fired, (10.0, 0.0)),
        (5, None, None, [], [], (200.0, 0.0)),
        (6, [], [(50.0, 0.0, 0.0, 1, 0.01, 0.0, 0.0, True, True)], [(0, None, (5, 20.0, 0.05, 0.0), None, (50.0, 0.1, 0.0)), (1, None, None, None, (30.0, 1.0, 0.0)), (2, None, None, None, (30.0, 1.5, 0.0))], [], (0.0, 0.0)),
        (7, [], [], [(0, None, (5, 20.0, 0.0, 0.0), (0.0,), None), (1, None, (1, 30.0, 0.0, 0.0), (0.0,), None), (2, None, (2, 25.0, 0.0, 0.0), (0.0,), None)], [], (0.0, 0.0)),
    ]
    df = spark.createDataFrame(rows, EVENT)
    got = {n: {r.ev: r for r in select.select(df, n).collect()} for n in select.SELECTORS}
    assert set(got["None"]) == {1, 2, 3, 4, 6, 7}
    assert {k: [s["index"] for s in r.selected] for k, r in got["MuTau"].items()} == {1: [1]}
    tag = got["MuTau"][1].tag
    assert (tag.pt, tag.id, tag.extra_muon, tag.dimuon, tag.extra_electron) == (40.0, 3, True, True, False)
    assert {k: [(s["index"], s.type) for s in r.selected] for k, r in got["TagAndProbe"].items() if k > 5} == {6: [(1, "ElectronTag"), (0, "GenBased")], 7: [(1, "PtOrdered"), (2, "PtOrdered"), (0, "GenBased")]}
    assert got["TagAndProbe"][6].tag.gen_kind == 5 and got["TagAndProbe"][7].tag is None
    assert set(got["genTauTau"]) == set() and set(got["TauJetTag"]) == {6, 7}
    with pytest.raises(ValueError, match="unknown selector"):
        select.select(df, "Nothing")
    assert select.select(df.limit(0), "TagAndProbe").count() == 0


def test_features_of_unusable_values(spark):
    x = F.col("x")
    made = features.measured("v", lambda n: F.col("x") if n == "v" else F.col("e"))
    rows = [(0.5, 0.1), (-999.0, 0.1), (0.5, 0.0), (0.5, None), (float("nan"), 0.1), (0.0, 0.1)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "x double, e double").select(*[c.alias(n) for n, c in made.items()]).collect()]
    assert got[0] == (1.0, 0.5, 5.0) and got[1:] == [(0.0, 0.0, 0.0)] * 5
    assert [r[0] for r in spark.createDataFrame(rows, "x double, e double").select(features.flag(features.finite(x))).collect()] == [1, 1, 1, 1, 0, 1]


def test_grids_and_inner_cells(spark):
    rows = [(1, 0, 10.0, 0.0, 0.0), (1, 0, 20.0, 0.001, 0.0), (1, 1, 5.0, 0.3, 0.0), (1, 1, 5.0, 0.6, 0.0)]
    df = spark.createDataFrame([(*r, 100.0, 0.0, 0.0) for r in rows], "c int, type int, pt double, eta double, phi double, tau_pt double, tau_eta double, tau_phi double")
    found = tensor.grids(df, ["c"], [F.desc("pt")])
    got = sorted((r.inner, r.type, r.cell, r.n, r.pt) for r in found.collect())
    assert got == [(False, 0, 220, 2, 20.0), (False, 1, 346, 1, 5.0), (True, 0, 60, 2, 20.0)]
    assert sorted(r.inner for r in tensor.without_inner(found, ["c"]).collect()) == [False, True]
    assert sorted(r.inner for r in tensor.grids(df, ["c"], [F.desc("pt")], remove_inner=True).collect()) == [False, True]


def test_candidate_pool_completes(spark):
    p = lambda *rows: spark.createDataFrame(list(rows), "event int, idx int, eta double, phi double")
    pool = match.candidate_pool([("lepton", p((1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0)), {}), ("jet", p((1, 0, 0.1, 0.0), (1, 1, -2.0, 0.0)), {"lepton": 0.4}), ("tau", p((1, 0, 0.05, 0.0), (1, 1, -2.1, 0.0), (2, 0, 0.0, 0.0)), {"lepton": 0.1, "jet": 0.3})], ["event"])
    got = sorted(((r.event, r.lepton_idx, r.jet_idx, r.tau_idx) for r in pool.collect()), key=str)
    assert got == sorted([(1, 0, 0, 0), (1, 1, None, None), (1, None, 1, 1), (2, None, None, 0)], key=str)


def test_lepton_decays_by_hand(spark):
    rows = [
        (1, 0, None, 15, True, True, False, 1.0), (1, 1, 0, 15, True, False, True, 1.0), (1, 2, 0, 22, False, True, True, 2.0), (1, 3, 1, 16, False, True, True, 3.0), (1, 4, 1, 213, False, True, True, 4.0), (1, 5, 4, 211, False, True, True, 5.0), (1, 6, 4, 111, False, True, True, 6.0),
        (1, 7, 6, 22, False, True, True, 7.0), (2, 0, None, -13, True, True, True, 8.0),
    ]
    df = spark.createDataFrame([(*r[:7], r[7], 0.0, 0.0, r[7]) for r in rows], "ev int, idx int, mother int, pdg int, prompt boolean, first boolean, last boolean, px double, py double, pz double, e double")
    got = {r.ev: r for r in graph.lepton_decays(df, ["ev"]).collect()}
    r = got[1]
    assert (r.kind, r.last_copy, r.n_neutrinos, r.n_charged, r.n_neutral, r.visible_px, r.radiated_px) == (5, 1, 1, 1, 1, 12.0, 2.0)
    assert (got[2].kind, got[2].n_muons, got[2].visible_px) == (2, 1, 8.0)
    with pytest.raises(Exception, match="no last copy"):
        graph.lepton_decays(df.withColumn("last", F.col("idx") != 7), ["ev"]).collect()


def test_derivative_against_a_loop(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.integers(0, 2, 60)).astype(float)
    x = np.cumsum(rng.random(60))
    for window in (1, 4):
        expect, n = [], 0
        while n < len(y) - window:
            k = n + window
            while k < len(y) and y[k] == y[n]:
                k += 1
            if k < len(y):
                expect.append(((x[k] + x[n]) / 2, (y[k] - y[n]) / (x[k] - x[n])))
            n = k
        df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
        got = sorted(tuple(r) for r in metrics.derivative(df, "x", "y", window).collect())
        assert np.allclose(got, expect)


def test_weighted_thresholds_and_no_convergence(spark):
    rows = [(float(i), float(-i), float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, w double")
    found = metrics.converged_thresholds(df, ["a"], "true", {"a": 0.75}, weight="w")
    total = sum(r[2] for r in rows)
    assert found["a"] == next(x for x, c in zip(range(100), np.cumsum([r[2] for r in rows]), strict=True) if c >= 0.25 * total)
    with pytest.raises(ValueError, match="still move"):
        metrics.converged_thresholds(df, ["a", "b"], "true", {"a": 0.9, "b": 0.9}, most=1)


def test_acceptance_rules_and_errors(spark):
    axes = {"ix": hist.Axis(0.0, 1.0, 1), "iy": hist.Axis(0.0, 1.0, 2)}
    h = spark.createDataFrame([("a", 1, 1, 4, 4.0, 4.0), ("a", 1, 2, 2, 2.0, 2.0)], "k string, ix int, iy int, n long, sumw double, sumw2 double")
    got = {r.iy: r.probability for r in hist.acceptance_to_flat(h, ["k"], axes).collect()}
    assert got == {1: 0.5, 2: 1.0}
    with pytest.raises(Exception, match="empty bin"):
        hist.acceptance_to_flat(h.where("iy = 1"), ["k"], axes).collect()
    n = spark.createDataFrame([("a", 10), ("b", 5)], "k string, n long")
    with pytest.raises(ValueError, match="no rows"):
        hist.class_probabilities(n, "k", {"a": 1.0, "z": -1.0})
    other = h.withColumn("ix", F.lit(9))
    with pytest.raises(Exception, match="different bins"):
        hist.divided(h, other, ["k", "ix", "iy"]).collect()


def test_formulas_ranges_and_precision(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "x double, y double")
    one = lambda c: df.select(c).first()[0]
    x, y = F.col("x"), F.col("y")
    assert one(numeric.formula("-(x + 1) * 3 ** 2 / sqrt(9)", x=x)) == -9.0 and one(numeric.formula("x / y", x=x, y=y)) is None
    assert one(numeric.formula("2 * 3.5")) == 7.0
    for bad in ("x.y", "__import__('os')", "x if x else 1", "z + 1"):
        with pytest.raises(ValueError, match="not a formula"):
            numeric.formula(bad, x=x)
    assert Interval.around(1.0, -0.5, 0.25) == (0.5, 1.25, True, True)
    with pytest.raises(ValueError, match="relative"):
        Interval.around(1.0, 0.5, 1.0)
    assert one(numeric.on_circle(F.lit(-3.1), 3.0, 3.4)) and not one(numeric.on_circle(F.lit(0.0), 3.0, 3.4))
    assert one(numeric.precision(F.lit(1000.3), 3)) == 1024.0 and one(numeric.precision(F.lit(0.0), 3)) == 0.0


def test_texts(spark):
    df = spark.createDataFrame([("a, b,,c", "dir/x_12.root")], "t string, p string")
    one = lambda c: df.select(c).first()[0]
    t, p = F.col("t"), F.col("p")
    assert one(text.pieces(t)) == ["a", "b", "c"] and one(text.file_number(p)) == 12 and one(text.stem(p)) == "dir/x_12"
    for bad, message in ((text.pieces(F.lit("a a"), " ", unique=True), "repeated part"), (text.pieces(t, count=2), "not 2 parts"), (text.parsed(t, "int"), "not a int"), (text.value_of(t, {1: "one"}), "unknown name"), (text.event_id(t), "not 3 parts")):
        with pytest.raises(Exception, match=message):
            one(bad)
    assert one(text.common_suffix(F.array(F.lit("xab"), F.lit("ab"), F.lit("cab")))) == "ab" and one(text.common_suffix(F.array(F.lit("x"), F.lit("")))) == ""


def test_files(spark, sf, tmp_path):
    assert io.size_batches([("a", 5), ("b", 6), ("c", 1), ("d", 20), ("e", 1)], 10) == [["a", "b"], ["c", "d"], ["e"]]
    o = spark.read.parquet(f"{sf}/orders.parquet").limit(100)
    for k in range(3):
        o.write.parquet(str(tmp_path / f"part{k}"))
    files = [(r.path, r.size) for r in io.discovered(spark, str(tmp_path), r".*\.parquet", exclude=r"_.*").collect()]
    assert io.merged_files(spark, files, 2 * files[0][1], str(tmp_path / "merged")) == 2
    assert sum(spark.read.parquet(str(tmp_path / "merged" / str(k))).count() for k in range(2)) == 300
    assert io.try_scan(spark, str(tmp_path / "none")) is None and io.try_scan(spark, str(tmp_path / "part0")).count() == 100
    assert json.loads(o.select(io.float_list(F.array(F.lit(1.5), F.lit(-2e-7)))).first()[0]) == [1.5, -2e-7]
    yaml = pytest.importorskip("yaml")
    assert io.settings("a: &x {k: 1}\nb:\n  <<: *x\n  m: 2\n")["b"] == {"k": 1, "m": 2} and yaml


def test_tensor_differences(spark):
    df = spark.createDataFrame([([1.0, 2.0, float("nan")], [1.0, 2.5, float("nan")])], "a array<double>, b array<double>")
    assert df.select(tensor.differences(F.col("a"), F.col("b"))).first()[0] == [1]
    with pytest.raises(Exception, match="unequal length"):
        df.select(tensor.differences(F.col("a"), F.slice("b", 1, 2))).collect()


def test_information_of_bound_columns(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    assert math.isinf(stats.information(df, "x", "y", (1.0, 1.0)).first().mutual)
    with pytest.raises(ValueError, match="two rows"):
        stats.information(df.limit(1), "x", "y", (1.0, 1.0))


def test_crystal_ball_against_numerical_integration():
    edge, power = 1.5 / 2.0, 3.0
    z = np.linspace(-400, 4000, 4_000_001)
    tail = np.exp(-edge * edge / 2) * (1 + edge / power * np.maximum(z - edge, 0)) ** -power
    density = np.where(z <= edge, np.exp(-z * z / 2), tail)
    below = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2 * np.diff(z))])
    for m in (30.0, 39.0, 41.0, 45.0, 80.0):
        assert nested.crystal_ball_integral(m, 40.0, 2.0, 1.5, 3.0, 1.0) == pytest.approx(float(np.interp((m - 40) / 2, z, below) / below[-1]), abs=1e-5)
