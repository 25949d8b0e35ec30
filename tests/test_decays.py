"""Three-pion decays: against scalar code from the definitions, exact properties, and an integrated width."""

from __future__ import annotations

import cmath
import itertools
import math

import numpy as np

from corvane.functions import polarimetry as pol
from corvane.functions.spin import boosted
from corvane.plans import decays

PARTS = ("px", "py", "pz", "e")


def dot(p, q):
    return p[3] * q[3] - sum(a * b for a, b in zip(p[:3], q[:3], strict=True))


def add(*ps):
    return [sum(x) for x in zip(*ps, strict=True)]


def sub(p, q):
    return [a - b for a, b in zip(p, q, strict=True)]


def sign(order):
    """Of a permutation of x, y, z, t, with t, x, y, z as the even one."""
    order = [(k + 1) % 4 for k in order]
    return (-1) ** sum(order[i] > order[j] for i in range(4) for j in range(i + 1, 4))


def amplitude(s, mass, width, m1, m2, spin):
    k = lambda x: math.sqrt(abs((x - (m1 + m2) ** 2) * (x - (m1 - m2) ** 2)) / x)
    g = width * mass**2 / math.sqrt(s) * (k(s) / k(mass**2)) ** (2 * spin + 1) if math.sqrt(s) > m1 + m2 else 0
    return mass**2 / complex(mass**2 - s, -g)


def scalar_factor(which, q2, sa, sb, neutral):
    """Form factors written out term by term."""
    m = (0.1349766, 0.1349766, 0.13957018) if neutral else (0.13957018,) * 3
    b = [cmath.rect(r, math.pi * f) for r, f in ((1, 0), (0.12, 0.99), (0.37, -0.15), (0.87, 0.53), (0.71, 0.56), (2.10, 0.23), (0.77, -0.54))]
    e = [x * x for x in m]
    if which < 3:
        s1, s2 = sa, sb
        s3 = q2 - s1 - s2 + sum(e)
    else:
        s3, s1 = sa, sb
        s2 = q2 - s3 - s1 + sum(e)
    bw = lambda s, res, i, j, spin: amplitude(s, *res, m[i], m[j], spin)
    ro, rp, f2, f0, sg = (0.7743, 0.1491), (1.370, 0.386), (1.275, 0.185), (1.186, 0.350), (0.860, 0.880)
    d = [s1 - e[0], s2 - e[1], s3 - e[2]]
    ro1, rp1, ro2, rp2 = bw(s1, ro, 1, 2, 1), bw(s1, rp, 1, 2, 1), bw(s2, ro, 2, 0, 1), bw(s2, rp, 2, 0, 1)
    if which < 3:
        total = b[0] * ro1 + b[1] * rp1 + (d[0] - d[2]) / 3 * (b[2] * ro2 + b[3] * rp2)
        if neutral:
            total += b[4] * (q2 - e[2] + s3) * (2 * e[0] + 2 * e[1] - s3) / s3 / 18 * bw(s3, f2, 0, 1, 2)
            total += 2 / 3 * (b[5] * bw(s3, sg, 0, 1, 0) + b[6] * bw(s3, f0, 0, 1, 0))
        else:
            total += b[4] * ((d[1] - d[2]) / 2 * bw(s1, f2, 1, 2, 2) + (q2 - e[1] + s2) * (2 * e[0] + 2 * e[2] - s2) / s2 / 18 * bw(s2, f2, 2, 0, 2))
            total += 2 / 3 * (b[5] * bw(s2, sg, 2, 0, 0) + b[6] * bw(s2, f0, 2, 0, 0))
    else:
        total = (d[1] - d[2]) / 3 * (b[2] * ro1 + b[3] * rp1) + (d[2] - d[0]) / 3 * (b[2] * ro2 + b[3] * rp2)
        if neutral:
            total -= b[4] * (d[0] - d[1]) / 2 * bw(s3, f2, 0, 1, 2)
        else:
            total += b[4] * ((q2 - e[0] + s1) * (2 * e[1] + 2 * e[2] - s1) / s1 / 18 * bw(s1, f2, 1, 2, 2) - (q2 - e[1] + s2) * (2 * e[0] + 2 * e[2] - s2) / s2 / 18 * bw(s2, f2, 2, 0, 2))
            total += 2 / 3 * (b[5] * (bw(s1, sg, 1, 2, 0) - bw(s2, sg, 2, 0, 0)) + b[6] * (bw(s1, f0, 1, 2, 0) - bw(s2, f0, 2, 0, 0)))
    s, t = q2, 0.0
    for threshold, rise, quartic in ((0.1753, (5.80900, -3.00980, 4.57920), (-13.91400, 27.67900, -13.39300, 3.19240, -0.10487)), (0.1676, (6.28450, -2.95950, 4.33550), (-15.41100, 32.08800, -17.66600, 4.93550, -0.37498))):
        x = s - threshold
        t += 0 if x < 0 else rise[0] * x**3 * (1 + rise[1] * x + rise[2] * x * x) if s < 0.823 else sum(c * s**i for i, c in enumerate(quartic))
    kk = math.sqrt((s - 1.39**2) * (s - 0.398**2)) / 2 / s if s > 1.39**2 else 0
    width = 1.275 * 0.7 / (1.3281 * 0.806) * (0.2384**2 * t + (4.7621 * 0.2384) ** 2 * kk)
    return total * 1.275**2 / complex(1.275**2 - s, -width)


def scalar_polarimeter(tau, q1, q2, q3, charge, neutral):
    """Component by component, with the antisymmetric tensor as a sum over permutations."""
    total = add(q1, q2, q3)
    n = sub(tau, total)
    w = dot(total, total)
    s = [dot(x, x) for x in (add(q2, q3), add(q1, q3), add(q1, q2))]
    f = [scalar_factor(1, w, s[0], s[1], neutral), -scalar_factor(2, w, s[1], s[0], neutral), scalar_factor(3, w, s[2], s[0], neutral)]
    j = [0j] * 4
    for x, difference in zip(f, (sub(q2, q3), sub(q3, q1), sub(q1, q2)), strict=True):
        part = dot(total, difference) / w
        j = [a + 2 * math.sqrt(2) / 3 * x * (d - part * t) for a, d, t in zip(j, difference, total, strict=True)]
    c = [x.conjugate() for x in j]
    jn, jj = dot(j, n), dot(j, c).real
    vector = [2 * (2 * (jn * x).real - jj * y) for x, y in zip(c, n, strict=True)]
    lower = lambda v: [-v[0], -v[1], -v[2], v[3]]
    cl, jl, nl = lower(c), lower(j), lower(n)
    pseudo = []
    for mu in range(4):
        x = sum(sign((mu, *o)) * cl[o[0]] * jl[o[1]] * nl[o[2]] for o in itertools.permutations([k for k in range(4) if k != mu]))
        pseudo.append(2 * charge * x.imag)
    m, pv, pa = math.sqrt(dot(tau, tau)), dot(tau, vector), dot(tau, pseudo)
    return [(m * m * (a - v) - t * (pa - pv)) / ((pv - pa) * m) for a, v, t in zip(pseudo, vector, tau, strict=True)]


def made(spark, sf, n=200):
    rows = decays.decays(spark, sf).limit(n).collect()
    arrays = [np.asarray([[r[c][k] for k in PARTS] for r in rows]) for c in ("tau", "p1", "p2", "p3")]
    return arrays[0], tuple(arrays[1:])


def test_polarimeter_against_scalar_code(spark, sf):
    tau, pions = made(spark, sf)
    assert len(tau) > 100
    for charge in (1, -1):
        for neutral in (True, False):
            found = pol.polarimeter(tau, pions, charge, neutral)
            for k in range(0, len(tau), 7):
                expect = scalar_polarimeter(tau[k].tolist(), *[p[k].tolist() for p in pions], charge, neutral)
                np.testing.assert_allclose(found[k], expect, rtol=1e-6, atol=1e-6)


def test_polarimetric_vector_is_a_unit_vector(spark, sf):
    """A massless neutrino of one helicity leaves no information behind, so its length is 1; exchange of the two pions of
    one sign changes nothing; opposite charges turn only the axial part."""
    tau, pions = made(spark, sf)
    rest = [boosted(x, tau) for x in (tau, *pions)]
    h = pol.polarimeter(rest[0], tuple(rest[1:]), neutral=False)
    np.testing.assert_allclose((h[:, :3] ** 2).sum(1), 1, atol=1e-9)
    np.testing.assert_allclose(h[:, 3], 0, atol=1e-9)
    np.testing.assert_allclose(pol.polarimeter(rest[0], (rest[2], rest[1], rest[3]), neutral=False), h, atol=1e-9)
    assert np.abs(pol.polarimeter(rest[0], tuple(rest[1:]), -1, False) - h).max() > 1e-3
    assert np.abs(pol.polarimeter(rest[0], tuple(rest[1:]), 1, False, shift=1.0) - h).max() > 1e-3


def test_structure_functions_against_invariants(spark, sf):
    """Closed forms in squared masses."""
    _, pions = made(spark, sf)
    found = pol.structure_functions(pions)
    m2 = 0.13957018**2
    for k in range(0, len(pions[0]), 5):
        q1, q2, q3 = (p[k].tolist() for p in pions)
        total = add(q1, q2, q3)
        w = dot(total, total)
        s1, s2, s3 = (dot(x, x) for x in (add(q2, q3), add(q1, q3), add(q1, q2)))
        f1, f2, f4 = (complex(x[0]) for x in pol.plain_factors(np.asarray([w]), tuple(np.asarray([x]) for x in (s1, s2, s3))))
        v1, v2 = s2 - 4 * m2 + (s3 - s1) ** 2 / 4 / w, s1 - 4 * m2 + (s3 - s2) ** 2 / 4 / w
        v12 = w / 2 - s3 - m2 / 2 + (s3 - s1) * (s3 - s2) / 4 / w
        h0 = (2 * m2 - s1 - s2) ** 2 / w - 4 * m2
        h = (s1 * s2 * s3 - m2 * (w - m2) ** 2) / h0 / w
        cross, q = f1 * f2.conjugate(), math.sqrt(w)
        # The roots of v1 - h and v2 - h, with the sign that they have where one pion flies far along the third.
        energy, k3 = [(w + m2 - x) / 2 / q for x in (s1, s2, s3)], math.sqrt(h0) / 2
        r1, r2 = (k3 - (energy[i] * energy[2] - (x - 2 * m2) / 2) / k3 for i, x in ((0, s2), (1, s1)))
        np.testing.assert_allclose([r1 * r1, r2 * r2], [v1 - h, v2 - h], rtol=1e-4, atol=1e-5)
        a, b = f1 * f4.conjugate(), f2 * f4.conjugate()
        expect = {
            "WA": v1 * abs(f1) ** 2 + v2 * abs(f2) ** 2 + 2 * v12 * cross.real,
            "WC": (v1 - 2 * h) * abs(f1) ** 2 + (v2 - 2 * h) * abs(f2) ** 2 + (2 * v12 + 4 * h) * cross.real,
            "WE": 3 * math.sqrt(h * h0) * cross.imag,
            "WSA": w * abs(f4) ** 2,
            "WSB": -2 * q * (r1 * a.real + r2 * b.real), "WSC": 2 * q * (r1 * a.imag + r2 * b.imag),
            "WSD": 2 * q * math.sqrt(h) * (a.real - b.real), "WSE": -2 * q * math.sqrt(h) * (a.imag - b.imag),
            "WD": -math.sqrt(h) * (2 * r1 * abs(f1) ** 2 - 2 * r2 * abs(f2) ** 2 + (w - m2 + s3) * (s1 - s2) * cross.real / w / math.sqrt(h0)),
        }
        for name, value in expect.items():
            np.testing.assert_allclose(found[name][k], value, rtol=1e-5, atol=1e-6 * abs(expect["WA"]), err_msg=name)


def integrated(q2, n=60):
    """Squared current over the plane of squared masses, without the a1."""
    m, q = pol.PION, math.sqrt(q2)
    s1 = 4 * m * m + ((q - m) ** 2 - 4 * m * m) * (np.arange(n) + 0.5) / n
    e2, e3 = np.sqrt(s1) / 2, (q2 - s1 - m * m) / 2 / np.sqrt(s1)
    k2, k3 = np.sqrt(e2**2 - m * m), np.sqrt(e3**2 - m * m)
    low, high = (e2 + e3) ** 2 - (k2 + k3) ** 2, (e2 + e3) ** 2 - (k2 - k3) ** 2
    part = (np.arange(n) + 0.5) / n
    a, b = (x.ravel() for x in np.broadcast_arrays(s1[:, None], low[:, None] + (high - low)[:, None] * part))
    weight = np.repeat((high - low) / n, n) * ((q - m) ** 2 - 4 * m * m) / n
    s = (a, b, q2 + 3 * m * m - a - b)
    # Momenta in the plane: the third pion along x.
    e = [(q2 + m * m - x) / 2 / q for x in s]
    p = [np.sqrt(np.maximum(x * x - m * m, 0)) for x in e]
    c = (p[1] ** 2 - p[0] ** 2 - p[2] ** 2) / 2 / p[0] / p[2]
    zero = np.zeros_like(a)
    q1 = np.column_stack([p[0] * c, p[0] * np.sqrt(np.maximum(1 - c * c, 0)), zero, e[0]])
    q3 = np.column_stack([p[2], zero, zero, e[2]])
    second = np.column_stack([-q1[:, 0] - q3[:, 0], -q1[:, 1], zero, e[1]])
    j = pol.current((q1, second, q3), neutral=False)
    size = (np.abs(j[:, :3]) ** 2).sum(1) - np.abs(j[:, 3]) ** 2
    return float((size * weight).sum() / q2 / np.abs(pol.a1(np.asarray(q2))) ** 2)


def test_width_is_the_integrated_current():
    """The fit of the width follows the integral over three charged pions from 0.6 to 2 GeV^2."""
    grid = np.asarray([0.6, 0.8, 1.0, 1.3, 1.6, 2.0])
    threshold, (c, b1, b2), quartic = pol.WIDTH_CHARGED
    above = grid - threshold
    fit = np.where(grid < pol.WIDTH_KINK, c * above**3 * (1 + b1 * above + b2 * above**2), np.polynomial.polynomial.polyval(grid, quartic))
    ratio = np.asarray([integrated(x) for x in grid]) / fit
    np.testing.assert_allclose(ratio / ratio.mean(), 1, atol=0.06)


def test_rho_width_is_the_integral_of_its_momentum():
    """The width in two pions grows as the cube of their momentum over the mass."""
    for q in (0.4, 0.773, 1.1):
        found = complex(pol.plain_resonance(np.asarray([q]), "rho")[0])
        k = lambda x: math.sqrt(x * x / 4 - pol.PION**2)
        g = 0.145 * 0.773 * (k(q) / k(0.773)) ** 3 / q
        bottom = (0.773**2 - q * q) ** 2 + 0.773**2 * g * g
        assert abs(found - complex(0.773**2 * (0.773**2 - q * q), q * g) / bottom) < 1e-12


def test_query_rows(spark, sf):
    tau, pions = made(spark, sf, 10_000)
    ids = [r.vec_id for r in decays.decays(spark, sf).collect()]
    rows = {r.vec_id: r for r in decays.polarimetry_a1(spark, sf).collect()}
    assert sorted(rows) == sorted(ids) and len(rows) > 400
    for k in range(0, len(ids), 50):
        flight = tau[k, :3] / np.linalg.norm(tau[k, :3])
        r = rows[ids[k]]
        assert abs(r.hx**2 + r.hy**2 + r.hz**2 - 1) < 1e-5
        h = boosted(sum(p[k : k + 1] for p in pions), tau[k : k + 1])[0, :3]
        # The angle from the energy share is that of the hadrons in the tau's rest frame.
        assert abs(r.cos_theta - h @ flight / np.linalg.norm(h)) < 1e-4
        assert -1 <= r.cos_beta <= 1 and r.WA > 0
