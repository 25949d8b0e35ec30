"""Special functions and spin observables against numpy and plain sums."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import spin
from corvane.plans import more, nested

V = "struct<px:double,py:double,pz:double,e:double>"


def boost(p, f):
    b = np.asarray(f[:3]) / f[3]
    g = 1 / math.sqrt(1 - b @ b)
    m = np.eye(4)
    m[0, 0], m[0, 1:], m[1:, 0] = g, -g * b, -g * b
    m[1:, 1:] += (g - 1) * np.outer(b, b) / (b @ b)
    out = m @ np.asarray([p[3], *p[:3]])
    return np.asarray([*out[1:], out[0]])


def random_p4(rng, mass):
    x, y, z = (rng.gauss(0, 10) for _ in range(3))
    return (x, y, z, math.sqrt(x * x + y * y + z * z + mass * mass))


def test_boost_and_acoplanarity(spark):
    rng = random.Random(6)
    rows = [tuple(random_p4(rng, m) for m in (1.777, 1.777, 0.14, 0.14, 0.135)) for _ in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {V}" for c in ("t1", "t2", "a", "b", "c")))
    got = df.select(spin.pair_acoplanarity(*map(F.col, ("t1", "t2", "a", "b", "c"))).alias("x")).collect()
    dot = lambda p, q: p[3] * q[3] - p[:3] @ q[:3]
    for r, row in zip(got, rows, strict=True):
        f = np.add(row[0], row[1])
        t1, t2, a, b, c = (boost(p, f) for p in row)
        assert tuple(spin.boosted(np.asarray([row[0]]), np.asarray([f]))[0]) == pytest.approx(tuple(t1), abs=1e-9)
        q, n = b - c, t2 - b - c
        h1 = -a[:3] / np.linalg.norm(a[:3])
        h2 = (2 * dot(q, n) * q[:3] - dot(q, q) * n[:3]) * math.sqrt(dot(t2, t2)) / (2 * dot(q, n) * dot(q, t2) - dot(q, q) * dot(n, t2))
        h2 /= np.linalg.norm(h2)
        u1, u2 = t1[:3] / np.linalg.norm(t1[:3]), t2[:3] / np.linalg.norm(t2[:3])
        k1, k2 = np.cross(h1, u1), np.cross(h2, u2)
        k1, k2 = k1 / np.linalg.norm(k1), k2 / np.linalg.norm(k2)
        x = math.atan2(np.linalg.norm(np.cross(k1, k2)), k1 @ k2)
        assert r.x == pytest.approx(x if np.cross(h1, h2) @ u1 <= 0 else 2 * math.pi - x, abs=1e-6)


def test_no_plane_gives_minus_99():
    p = np.asarray([[1.0, 0.0, 0.0, 2.0]])
    assert spin.acoplanarity(spin.polarimeter(p, p), spin.polarimeter(p, p), p, p).tolist() == [-99.0]
    assert spin.boosted(p, np.asarray([[0.0, 0.0, 0.0, 1.0]])).tolist() == p.tolist()


def test_upper_gamma_and_kolmogorov():
    for x in (0.1, 1.0, 5.0, 30.0):
        assert more.upper_gamma(0.5, x) == pytest.approx(math.erfc(math.sqrt(x)), rel=1e-9)
        assert more.upper_gamma(1.0, x) == pytest.approx(math.exp(-x), rel=1e-9)
    assert more.kolmogorov(0.0) == 1.0 and more.kolmogorov(1.3581) == pytest.approx(0.05, abs=1e-4)


def test_crystal_ball_is_a_distribution():
    f = lambda m: nested.crystal_ball_integral(m, 40, 2, 1.5, 3, 1)
    grid = [f(m) for m in np.linspace(1, 1000, 500)]
    assert all(a <= b + 1e-12 for a, b in zip(grid, grid[1:])) and grid[0] < 1e-6 and 0.99 < grid[-1] <= 1
    with pytest.raises(ValueError, match="range"):
        f(0.5)
