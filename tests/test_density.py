"""Densities and bandwidths against sums over all pairs."""

from __future__ import annotations

import math

import numpy as np
import pytest

from corvane.operators import density


def normal(z):
    return np.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def test_density_of_many_values(spark):
    """More values than any array would hold, far outliers, nulls, repeated rows, points outside of all values."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.gamma(2, 1, 20_000), rng.normal(300, 5, 500), [1e6, 1e6]])
    points = np.concatenate([rng.uniform(-3, 320, 200), [1e6, 5e5, 0.0, 0.0]])
    sample = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(4)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(points)] + [(-1, None)], "i int, x double")
    found = {r.i: r.density for r in density.kde(sample, rows, "x", 0.7).collect()}
    assert found.pop(-1) is None and len(found) == len(points)
    for i, p in enumerate(points):
        assert found[i] == pytest.approx(normal((p - x) / 0.7).sum() / len(x) / 0.7, abs=1e-11)
    with pytest.raises(ValueError, match="sample"):
        density.kde(sample.limit(0), rows, "x", 0.7)
    with pytest.raises(ValueError, match="positive"):
        density.kde(sample, rows, "x", 0.0)


@pytest.mark.parametrize("r", [0.0, -0.8])
def test_density_of_pairs(spark, r):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(2, 400)).round(2)
    x, y = np.append(x, x[:50]), np.append(y, y[:50])
    sample = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0)], "x double, y double")
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x[:40] * 3, y[:40] * 3, strict=True)] + [(0.0, 0.0), (0.0, 0.0), (1.0, None)], "x double, y double")
    found = density.kde_2d(sample, points, "x", "y", (0.3, 0.5), r).collect()
    assert len(found) == 43
    for p in found:
        if p.y is None:
            assert p.density is None
            continue
        u, v = (p.x - x) / 0.3, (p.y - y) / 0.5
        kernel = np.exp(-(u * u - 2 * r * u * v + v * v) / (2 * (1 - r * r))) / (2 * math.pi * 0.3 * 0.5 * math.sqrt(1 - r * r))
        assert p.density == pytest.approx(kernel.mean(), abs=1e-12)


def all_pairs(x, order, g):
    z = (x[:, None] - x[None, :]) / g
    he = np.polynomial.hermite_e.hermeval(z, [0] * order + [1])
    return float((he * np.exp(-z * z / 2)).sum() / (math.sqrt(2 * math.pi) * g ** (order + 1) * len(x) * (len(x) - 1)))


class Pairs:
    """Sums over all pairs, one by one."""

    width = 0.0

    def __init__(self, x):
        self.x, self.total = x, float(len(x))

    def psi(self, order, g):
        return all_pairs(self.x, order, g)


def test_bandwidths_match_sums_over_all_pairs(spark):
    """Skewed, two-peaked and rounded values, of few and many; groups without a bandwidth are left out."""
    rng = np.random.default_rng(3)
    groups = {"gamma": rng.gamma(2, 1, 900), "peaks": np.concatenate([rng.normal(0, 0.05, 400), rng.normal(9, 1, 400)]), "round": rng.normal(size=700).round(1), "few": rng.normal(size=12), None: rng.normal(5, 3, 300)}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("one", 1.0), ("same", 2.0), ("same", 2.0), ("gamma", None)]
    found = {r.k: r.bandwidth for r in density.bandwidths(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v").collect()}
    assert set(found) == set(groups)
    for k, own in groups.items():
        assert found[k] == pytest.approx(density.plug_in(Pairs(own), float(own.std(ddof=1)), 1e-6), rel=2e-6)


def test_bandwidth_solves_its_equation_and_nears_the_normal_rule(spark):
    x = np.random.default_rng(5).normal(0, 2, 600)
    h = density.bandwidths(spark.createDataFrame([(float(v),) for v in x], "v double"), [], "v").first().bandwidth
    assert 0.5 < h / (1.06 * 2 * 600**-0.2) < 1.3
    n, s = 600, x.std(ddof=1)
    g1, g2 = (-6 / math.sqrt(2 * math.pi) / (-15 / (16 * math.sqrt(math.pi)) * s**-7 * n)) ** (1 / 7), (30 / math.sqrt(2 * math.pi) / (105 / (32 * math.sqrt(math.pi)) * s**-9 * n)) ** (1 / 9)
    gamma = (-6 * math.sqrt(2) * all_pairs(x, 4, g1) / all_pairs(x, 6, g2)) ** (1 / 7)
    assert h == pytest.approx((2 * math.sqrt(math.pi) * all_pairs(x, 4, gamma * h ** (5 / 7)) * n) ** -0.2, rel=1e-5)
