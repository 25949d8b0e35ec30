"""Boosts, polarimetric vectors and the acoplanarity angle, on arrays of four-vectors (rows of px, py, pz, e), and as a
pandas function on columns. As Column expressions these would repeat their inputs exponentially often."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("px", "py", "pz", "e")


def product(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Minkowski product of each row."""
    return p[:, 3] * q[:, 3] - (p[:, :3] * q[:, :3]).sum(1)


def unit(v: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return v / np.linalg.norm(v, axis=1)[:, None]


def boosted(p: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """p as seen from the rest frame of `frame`; unchanged where that is at rest."""
    b = frame[:, :3] / frame[:, 3:]
    b2 = (b * b).sum(1)
    gamma = 1 / np.sqrt(1 - b2)
    along = (b * p[:, :3]).sum(1)
    k = np.where(b2 > 0, (gamma - 1) * along / np.where(b2 > 0, b2, 1), 0) - gamma * p[:, 3]
    return np.column_stack([p[:, :3] + k[:, None] * b, gamma * (p[:, 3] - along)])


def polarimeter(tau: np.ndarray, pion: np.ndarray, neutral: np.ndarray | None = None) -> np.ndarray:
    """Polarimetric vector of a decay to a pion, or to a charged and a neutral one: with q the pions' difference and n
    the neutrino, m (2 (qn) q - q^2 n) / (2 (qn)(q tau) - q^2 (n tau))."""
    if neutral is None:
        return -pion[:, :3]
    q, n = pion - neutral, tau - pion - neutral
    qn, qq = product(q, n), product(q, q)
    scale = np.sqrt(np.maximum(product(tau, tau), 0)) / (2 * qn * product(q, tau) - qq * product(n, tau))
    return scale[:, None] * (2 * qn[:, None] * q[:, :3] - qq[:, None] * n[:, :3])


def acoplanarity(h1: np.ndarray, h2: np.ndarray, tau1: np.ndarray, tau2: np.ndarray) -> np.ndarray:
    """Angle in [0, 2 pi) between the planes of polarimetric vectors and taus, all in the frame of the pair; -99 where a
    plane is undefined."""
    h1, h2, t1, t2 = unit(h1), unit(h2), unit(tau1[:, :3]), unit(tau2[:, :3])
    k1, k2 = unit(np.cross(h1, t1)), unit(np.cross(h2, t2))
    angle = np.arctan2(np.linalg.norm(np.cross(k1, k2), axis=1), (k1 * k2).sum(1))
    side = (np.cross(h1, h2) * t1).sum(1)
    out = np.where(side <= 0, angle, 2 * np.pi - angle)
    return np.where(np.isfinite(out), out, -99.0)


def pair_acoplanarity(tau1: Column, tau2: Column, pion1: Column, pion2: Column, neutral2: Column) -> Column:
    """Of a one-pion and a two-pion decay, from struct columns (px, py, pz, e)."""

    @F.pandas_udf("double")
    def angle(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame, e: pd.DataFrame) -> pd.Series:
        t1, t2, p1, p2, n2 = (x[list(PARTS)].to_numpy(float) for x in (a, b, c, d, e))
        frame = t1 + t2
        t1, t2, p1, p2, n2 = (boosted(x, frame) for x in (t1, t2, p1, p2, n2))
        return pd.Series(acoplanarity(polarimeter(t1, p1), polarimeter(t2, p2, n2), t1, t2))

    return angle(tau1, tau2, pion1, pion2, neutral2)
