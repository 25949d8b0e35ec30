"""Feature lists from a configuration, errors by resampling and as-of joins by stretches, on small cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import featureset, match, sample

TAU = "tau_pt double, tau_eta double, tau_phi double, x double, other double"
MUON = "muon array<struct<pt double, eta double, phi double, dxy double, dxy_error double, extra double>>"


def rows(spark):
    one = (2.0, 0.5, 0.25, 0.3, 0.1, 7.0)
    return spark.createDataFrame([(1, 4.0, 0.0, 0.0, 1.5, 0.0, [one, (8.0, 0.0, 0.0, -1.0, 0.0, float("inf"))]), (2, 4.0, 0.0, 0.0, None, 0.0, None), (3, 4.0, 0.0, 0.0, float("nan"), 0.0, [])], f"id int, {TAU}, {MUON}")


def vectors(df, config):
    found = featureset.chosen(df, config)
    return found, {r.id: r for r in featureset.vectors(df, ["id"], found, "double").collect()}


def test_lists_pick_raw_and_computed_features_in_order(spark):
    config = {"feature_names": {"muon": ["extra", "rel_pt", "dxy_sig", "nothing"], "global": ["x", "tau_pt", "tau_rho"], "jet": ["pt"]}, "defaults": {"muon": {"extra": 9}, "global": {"x": -1}}}
    found, got = vectors(rows(spark), config)
    assert found.missing == {"muon": ["nothing"], "global": ["tau_rho"], "jet": ["pt"]}
    assert got[1].muon == [[7.0, 0.5, pytest.approx(3.0)], [9.0, 2.0, 0.0]]
    assert got[2].muon == [] and got[3].muon == [] and got[1].jet == []
    assert [list(got[k]["global"]) for k in (1, 2, 3)] == [[1.5, 4.0], [-1.0, 4.0], [-1.0, 4.0]]


def test_disabled_names_and_types(spark):
    config = {"feature_names": {"muon": ["extra", "rel_pt"], "global": ["x"]}, "disabled": {"muon": ["extra"], "global": True}}
    found, got = vectors(rows(spark), config)
    assert found.names == {"muon": ["rel_pt"]} and got[1].muon == [[0.5], [2.0]]


@pytest.mark.parametrize("config", [{"feature_names": {"global": ["x", "x"]}}, {"feature_names": {"global": ["x"]}, "defaults": {"global": {"y": 0}}}, {"feature_names": {"global": ["x"]}, "disabled": {"global": ["y"]}}, {"feature_names": {"global": ["x"]}, "disabled": {"muon": ["y"]}}])
def test_lists_that_contradict_themselves(spark, config):
    with pytest.raises(ValueError):
        featureset.chosen(rows(spark), config)


def test_a_value_that_is_not_finite_needs_a_default(spark):
    with pytest.raises(Exception, match="global x has no finite value"):
        vectors(rows(spark), {"feature_names": {"global": ["x"]}})


def interval(centre, values, loss):
    v, out = sorted(values), int(len(values) * loss)
    found = [(v[len(v) - (out - k) - 1] - v[k], v[k], v[len(v) - (out - k) - 1]) for k in range(out + 1) if v[k] <= centre <= v[len(v) - (out - k) - 1]]
    return min(found, default=None)


def test_errors_by_resampling_follow_the_trials(spark):
    rng = random.Random(3)
    data = [(k % 2, k, rng.gauss(5, 2)) for k in range(400)] + [(None, 1000 + k, float(k)) for k in range(30)]
    df = spark.createDataFrame(data, "g int, k long, x double")
    sums = sample.trial_sums(df, ["g"], F.col("k"), {"n": F.col("__w"), "s": F.col("__w") * F.col("x")}, 60, 5)
    trials = {}
    for r in sums.collect():
        trials.setdefault(r.g, {})[r.trial] = r.s / r.n
    got = {r.g: r for r in sample.resampled([sums], ["g"], F.expr("s / n"), 0.31731).collect()}
    assert set(got) == {0, 1, None}
    for g, t in trials.items():
        plain = [x for gg, _, x in data if gg == g]
        assert got[g].value == pytest.approx(sum(plain) / len(plain)) and got[g].trials == 60
        _, low, high = interval(got[g].value, [v for k, v in t.items() if k], 0.31731)
        assert (got[g].down, got[g].up) == (pytest.approx(got[g].value - low), pytest.approx(high - got[g].value))
    error = 2 / 200**0.5  # the deviation of the mean
    assert 0.5 * error < (got[0].down + got[0].up) / 2 < 1.6 * error


def test_errors_of_too_few_trials_or_no_value_are_null(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (2, 3, None)], "g int, k long, x double")
    sums = sample.trial_sums(df, ["g"], F.col("k"), {"n": F.col("__w"), "s": F.col("__w") * F.col("x")}, 3, 5)
    got = {r.g: r for r in sample.resampled([sums], ["g"], F.expr("try_divide(s, n)")).collect()}
    assert (got[1].value, got[1].down, got[1].up) == (2.0, None, None) and (got[2].value, got[2].up, got[2].trials) == (None, None, 0)
    assert sample.resampled([sums.where("false")], ["g"], F.expr("try_divide(s, n)")).collect() == []
    with pytest.raises(ValueError):
        sample.resampled([sums], ["g"], F.col("s"), 1.0)


@pytest.mark.parametrize("kind", ["double", "timestamp", "timestamp_ntz"])
def test_as_of_by_stretches_equals_one_window(spark, kind):
    rng = random.Random(8)
    at = lambda: None if rng.random() < 0.03 else float(rng.randrange(-400, 4000))
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    time = F.col("t") if kind == "double" else F.timestamp_seconds(F.col("t") + 1_700_000_000).cast(kind)
    left = spark.createDataFrame([(k, key(), at()) for k in range(300)], "id long, g int, t double").withColumn("t", time)
    seen = {(key(), at()): k for k in range(200)}
    right = spark.createDataFrame([(g, t, v) for (g, t), v in seen.items()], "g int, t double, v long").withColumn("t", time)
    shown = lambda width: sorted(map(tuple, match.as_of(left, right, ["g"], "t", ["v"], width).collect()), key=repr)
    whole = shown(None)
    assert len(whole) == 300 and any(r[-1] is not None for r in whole)
    assert shown(100.0) == whole and shown(7.5) == whole and shown(1e9) == whole
    assert [r[-1] for r in match.as_of(left, right.where("false"), ["g"], "t", ["v"], 50.0).collect()] == [None] * 300
