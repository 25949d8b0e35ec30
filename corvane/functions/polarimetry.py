"""Decays of a tau lepton to three pions and a neutrino: form factors, hadronic current, polarimetric vector, structure
functions and angles, on arrays of four-vectors (rows of px, py, pz, e), and as a pandas function on columns.

The current is J = sum of F_k V_k, where V_k is the difference of two pions without its part along their sum. With the
neutrino n and the tau p, the vector and axial parts of the lepton's rate are PV = 2 (2 Re((J n) J*) - (J J*) n) and
PA = 2 Im eps(J*, J, n), and the polarimetric vector is (m^2 (PA - PV) - p (p PA - p PV)) / (m (p PV - p PA)).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.spin import PARTS, boosted, product, unit

# Masses in GeV; resonances as (mass, width); strengths and phases (in pi) of the isobars.
PION, NEUTRAL_PION, TAU = 0.13957018, 0.1349766, 1.776
RHO, RHO_PRIME, F2, F0, SIGMA = (0.7743, 0.1491), (1.370, 0.386), (1.275, 0.185), (1.186, 0.350), (0.860, 0.880)
A1 = (1.275, 0.700)
ISOBARS = {"rho_s": (1.0, 0.0), "rho_prime_s": (0.12, 0.99), "rho_d": (0.37, -0.15), "rho_prime_d": (0.87, 0.53), "f2": (0.71, 0.56), "sigma": (2.10, 0.23), "f0": (0.77, -0.54)}
SPREADS = {"rho_prime_s": (0.094, 0.253), "rho_d": (0.094, 0.104), "rho_prime_d": (0.296, 0.170), "f2": (0.167, 0.104), "sigma": (0.284, 0.036), "f0": (0.148, 0.063)}
# Mass-dependent width of the a1 to three pions: threshold, cubic rise, and quartic from 0.823 GeV^2 on; K* K above its own.
WIDTH_CHARGED = (0.1753, (5.80900, -3.00980, 4.57920), (-13.91400, 27.67900, -13.39300, 3.19240, -0.10487))
WIDTH_NEUTRAL = (0.1676, (6.28450, -2.95950, 4.33550), (-15.41100, 32.08800, -17.66600, 4.93550, -0.37498))
WIDTH_KINK, A1_COUPLING, KSTAR_COUPLING, KSTAR, KAON, A1_NORM = 0.823, 0.2384, 4.7621, 0.894, 0.496, 1.3281 * 0.806
# The simpler model of the structure functions.
PLAIN = {"rho": (0.773, 0.145), "rho_prime": (1.370, 0.510), "a1": (1.251, 0.599), "pi_prime": (1.300, 0.3)}
BETA, F_PI, F_PI_PRIME, G_PI_PRIME, G_RHO = -0.145, 0.093, 0.08, 5.8, 6.08


def square(p: np.ndarray) -> np.ndarray:
    return product(p, p)


def isobar(s: np.ndarray, resonance: tuple[float, float], a: float, b: float, spin: int) -> np.ndarray:
    """Amplitude of a resonance in two particles of masses a and b, with a width that grows with their momentum."""
    mass, width = resonance
    momentum = lambda w2: np.sqrt(np.abs((w2 - (a + b) ** 2) * (w2 - (a - b) ** 2)) / w2)
    grown = width * mass**2 / np.sqrt(s) * (momentum(s) / momentum(mass**2)) ** (2 * spin + 1)
    return mass**2 / (mass**2 - s - 1j * np.where(s > (a + b) ** 2, grown, 0.0))


def strengths(shift: float = 0.0) -> dict[str, complex]:
    """Complex strength of each isobar, moved by so many standard deviations."""
    moved = {k: [x + shift * d for x, d in zip(v, SPREADS.get(k, (0.0, 0.0)), strict=True)] for k, v in ISOBARS.items()}
    return {k: r * np.exp(1j * np.pi * phase) for k, (r, phase) in moved.items()}


def a1_width(s: np.ndarray) -> np.ndarray:
    """Mass times width of the a1 at a squared mass."""
    total = np.zeros_like(s)
    for threshold, (c, *rise), quartic in (WIDTH_CHARGED, WIDTH_NEUTRAL):
        above = np.maximum(s - threshold, 0.0)
        low = c * above**3 * (1 + rise[0] * above + rise[1] * above**2)
        total = total + np.where(s < WIDTH_KINK, low, np.polynomial.polynomial.polyval(s, quartic))
    pair = np.maximum((s - (KSTAR + KAON) ** 2) * (s - (KSTAR - KAON) ** 2), 0.0)
    kaons = np.where(s > (KSTAR + KAON) ** 2, np.sqrt(pair) / (2 * s), 0.0)
    return A1_COUPLING**2 * (total + KSTAR_COUPLING**2 * kaons)


def a1(s: np.ndarray) -> np.ndarray:
    mass, width = A1
    return mass**2 / (mass**2 - s - 1j * mass * width / A1_NORM * a1_width(s))


def form_factors(q2: np.ndarray, s: tuple[np.ndarray, np.ndarray, np.ndarray], neutral: bool = True, shift: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Form factors of the three differences of pions. s: squared masses of the pairs that leave out pion 1, 2 and 3.
    neutral: the first two pions are neutral, else all are charged."""
    masses = (NEUTRAL_PION, NEUTRAL_PION, PION) if neutral else (PION,) * 3
    m2, of = [m * m for m in masses], strengths(shift)
    pair = [(masses[1], masses[2]), (masses[2], masses[0]), (masses[0], masses[1])]

    def amplitudes(s: list[np.ndarray]) -> tuple:
        amp = lambda name, resonance, k, spin: of[name] * isobar(s[k], resonance, *pair[k], spin)
        swave = lambda k: amp("rho_s", RHO, k, 1) + amp("rho_prime_s", RHO_PRIME, k, 1)
        dwave = lambda k: amp("rho_d", RHO, k, 1) + amp("rho_prime_d", RHO_PRIME, k, 1)
        tensor = lambda k: amp("f2", F2, k, 2)
        scalar = lambda k: amp("sigma", SIGMA, k, 0) + amp("f0", F0, k, 0)
        over = lambda i, k: (s[i] - m2[i]) - (s[k] - m2[k])
        # Share of a spin-2 pair along its own recoil.
        along = lambda k: (q2 - m2[k] + s[k]) * (2 * (sum(m2) - m2[k]) - s[k]) / (18 * s[k])
        return swave, dwave, tensor, scalar, over, along

    # Two of the squared masses are taken as they are, and the last one from their sum.
    def outer(i: int, k: int) -> np.ndarray:
        """With the pair that leaves out i in the S wave; k is the other of the first two pions."""
        swave, dwave, tensor, scalar, over, along = amplitudes([s[0], s[1], q2 - s[0] - s[1] + sum(m2)])
        found = swave(i) - over(2, i) / 3 * dwave(k)
        if neutral:
            return found + along(2) * tensor(2) + 2 / 3 * scalar(2)
        return found + over(k, 2) / 2 * tensor(i) + along(k) * tensor(k) + 2 / 3 * scalar(k)

    _, dwave, tensor, scalar, over, along = amplitudes([s[0], q2 - s[0] - s[2] + sum(m2), s[2]])
    third = over(1, 2) / 3 * dwave(0) + over(2, 0) / 3 * dwave(1)
    if neutral:
        third = third - over(0, 1) / 2 * tensor(2)
    else:
        third = third + along(0) * tensor(0) - along(1) * tensor(1) + 2 / 3 * (scalar(0) - scalar(1))
    return outer(0, 1) * a1(q2), outer(1, 0) * a1(q2), third * a1(q2)


def across(difference: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Difference of two momenta without its part along the total."""
    return difference - total * (product(total, difference) / square(total))[:, None]


def current(pions: tuple[np.ndarray, np.ndarray, np.ndarray], neutral: bool = True, shift: float = 0.0) -> np.ndarray:
    """Hadronic current (x, y, z, t) of two pions of one sign and the third of the other."""
    q1, q2, q3 = pions
    total = q1 + q2 + q3
    f = form_factors(square(total), (square(q2 + q3), square(q1 + q3), square(q1 + q2)), neutral, shift)
    strength = 2 * np.sqrt(2) / 3
    vectors = (across(q2 - q3, total), across(q3 - q1, total), across(q1 - q2, total))
    return sum((sign * strength * f[k])[:, None] * vectors[k] for k, sign in enumerate((1, -1, 1)))


def axial(j: np.ndarray, n: np.ndarray) -> np.ndarray:
    """2 Im eps(J*, J, n): with J = a + ib, four times the vector across a, b and n."""
    a, b = j.real, j.imag
    space = n[:, 3:] * np.cross(a[:, :3], b[:, :3]) + np.cross(n[:, :3], b[:, 3:] * a[:, :3] - a[:, 3:] * b[:, :3])
    time = (n[:, :3] * np.cross(a[:, :3], b[:, :3])).sum(1)
    return 4 * np.column_stack([space, time])


def polarimeter(tau: np.ndarray, pions: tuple[np.ndarray, np.ndarray, np.ndarray], charge: int = 1, neutral: bool = True, shift: float = 0.0) -> np.ndarray:
    """Polarimetric four-vector. pions: the two of the tau's sign, then the other; neutral: with the amplitudes of two
    neutral pions and a charged one, which the stored results are made with; else those of three charged pions."""
    n, j = tau - sum(pions), current(pions, neutral, shift)
    jn = product(j, n.astype(complex))
    vector = 2 * (2 * (jn[:, None] * j.conj()).real - product(j, j.conj()).real[:, None] * n)
    pseudo = -charge * axial(j, n)
    mass, pv, pa = np.sqrt(square(tau)), product(tau, vector), product(tau, pseudo)
    with np.errstate(all="ignore"):
        return ((mass**2)[:, None] * (pseudo - vector) - tau * (pa - pv)[:, None]) / ((pv - pa) * mass)[:, None]


def plain_resonance(q: np.ndarray, kind: str) -> np.ndarray:
    """Amplitude at a mass in the simpler model."""
    mass, width = PLAIN[kind]
    q2, rho = q * q, PLAIN["rho"][0]
    if kind == "rho":
        cube = lambda x: np.maximum(x - 4 * PION**2, 0.0) ** 1.5
        grown = width * mass * cube(q2) / cube(mass**2) / q
    elif kind == "rho_prime":
        grown = width * q2 / mass**2
    elif kind == "a1":
        grown = width * plain_a1(q2) / plain_a1(np.asarray(mass**2))
    else:
        grown = width * (q / mass) ** 5 * ((1 - rho**2 / q2) / (1 - rho**2 / mass**2)) ** 3
    # The numerator of the imaginary part is q * grown, as in the stored results, not mass**2 * q * grown.
    bottom = (mass**2 - q2) ** 2 + mass**2 * grown**2
    return (mass**2 * (mass**2 - q2) + 1j * q * grown) / bottom


def plain_a1(q2: np.ndarray) -> np.ndarray:
    """Growth of the a1's width, a fit above and below the mass of a rho and a pion."""
    above = q2 - 9 * PION**2
    high = q2 * (1.623 + 10.38 / q2 - 9.32 / q2**2 + 0.65 / q2**3)
    return np.where(q2 > (PLAIN["rho"][0] + PION) ** 2, high, 4.1 * above**3 * (1 - 3.3 * above + 5.8 * above**2))


def plain_factors(q2: np.ndarray, s: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """F1, F2 (differences of pions 1 and 3, and 2 and 3) and F4 (along the sum) of the simpler model."""
    q, (s1, s2, s3) = np.sqrt(q2), s
    rho = lambda x: (plain_resonance(np.sqrt(x), "rho") + BETA * plain_resonance(np.sqrt(x), "rho_prime")) / (1 + BETA)
    front = -2j * np.sqrt(2) / 3 / F_PI * plain_resonance(q, "a1")
    along = -1j * G_PI_PRIME * G_RHO * F_PI_PRIME / 2 / PLAIN["rho"][0] ** 4 / PLAIN["pi_prime"][0] ** 3
    fourth = along * plain_resonance(q, "pi_prime") * (s1 * (s2 - s3) * rho(s1) + s2 * (s1 - s3) * rho(s2))
    return front * rho(s2), front * rho(s1), fourth


STRUCTURES = ("WA", "WC", "WD", "WE", "WSA", "WSB", "WSC", "WSD", "WSE")


def structure_functions(pions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """The nine structure functions of the current in the pions' rest frame, with the third pion along x and all of them
    across z: WA, WC = |Jx|^2 +- |Jy|^2, WD = 2 Re(Jx Jy*), WE = 2 Im(Jx Jy*), WSA = |J0|^2, WSB - i WSC = 2 Jx J0*,
    WSD - i WSE = 2 Jy J0*. The signs of Jx are kept, which the usual closed forms lose where one pion flies far along the
    third."""
    total = sum(pions)
    q1, q2, q3 = (boosted(p, total)[:, :3] for p in pions)
    x, z = unit(q3), unit(np.cross(q1, q2))
    y = np.cross(z, x)
    q = square(total)
    f1, f2, f4 = plain_factors(q, (square(pions[1] + pions[2]), square(pions[0] + pions[2]), square(pions[0] + pions[1])))
    j = f1[:, None] * (q1 - q3) + f2[:, None] * (q2 - q3)
    jx, jy, j0 = (j * x).sum(1), (j * y).sum(1), f4 * np.sqrt(q)
    xy, x0, y0 = jx * jy.conj(), jx * j0.conj(), jy * j0.conj()
    size = lambda a: np.abs(a) ** 2
    return dict(zip(STRUCTURES, (size(jx) + size(jy), size(jx) - size(jy), 2 * xy.real, 2 * xy.imag, size(j0), 2 * x0.real, -2 * x0.imag, 2 * y0.real, -2 * y0.imag), strict=True))


ANGLES = ("cos_theta", "cos_psi", "cos_beta", "cos_gamma")


def angles(tau: np.ndarray, pions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """cos_theta: of the hadrons in the tau's rest frame to its flight, from their share of its energy; cos_psi: of tau
    and laboratory as the hadrons see them; cos_beta: of the pions' normal to the hadrons' flight; cos_gamma: of the third
    pion to that flight, in the pions' plane. Null (NaN) where undefined."""
    total = sum(pions)
    q2, share, energy = square(total), total[:, 3] / tau[:, 3], tau[:, 3]
    m2 = TAU**2
    inside = [boosted(p, total)[:, :3] for p in pions]
    flight, normal, third = unit(total[:, :3]), unit(np.cross(inside[0], inside[1])), unit(inside[2])
    with np.errstate(all="ignore"):
        theta = (2 * share * m2 - m2 - q2) / ((m2 - q2) * np.sqrt(1 - m2 / energy**2))
        psi = (share * (m2 + q2) - 2 * q2) / ((m2 - q2) * np.sqrt(share**2 - q2 / energy**2))
        beta = (flight * normal).sum(1)
        gamma = (flight * third).sum(1) / np.sqrt(1 - beta**2)
    return {"cos_theta": theta, "cos_psi": psi, "cos_beta": beta, "cos_gamma": gamma}


RESULT_DDL = "hx double, hy double, hz double, " + ", ".join(f"{c} double" for c in (*ANGLES, *STRUCTURES))


def three_pions(tau: Column, same1: Column, same2: Column, opposite: Column, charge: int = 1, neutral: bool = True) -> Column:
    """Struct of the polarimetric vector (hx, hy, hz) in the tau's rest frame, the angles and the structure functions, from
    struct columns (px, py, pz, e). Null where a value is undefined."""

    @F.pandas_udf(RESULT_DDL)
    def found(a: pd.DataFrame, b: pd.DataFrame, c: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        t, *pions = (x[list(PARTS)].to_numpy(float) for x in (a, b, c, d))
        rest = [boosted(x, t) for x in (t, *pions)]
        h = polarimeter(rest[0], tuple(rest[1:]), charge, neutral)
        columns = {"hx": h[:, 0], "hy": h[:, 1], "hz": h[:, 2]} | angles(t, tuple(pions)) | structure_functions(tuple(pions))
        return pd.DataFrame({k: pd.Series(v).where(np.isfinite(v), None) for k, v in columns.items()})

    return found(tau, same1, same2, opposite)
