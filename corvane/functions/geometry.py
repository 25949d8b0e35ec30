"""Angles, distances and four-vectors as Column expressions. A four-vector is a struct (pt, eta, phi, mass)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

PI, TWO_PI = math.pi, 2 * math.pi

#: Eta of the detector's cracks, and effective areas of the electron isolation below each upper eta.
ETA_CRACKS = [0.0, 4.44747e-01, 7.92824e-01, 1.14090, 1.47464]
EFFECTIVE_AREAS = [(1.0, 0.1440), (1.479, 0.1562), (2.0, 0.1032), (2.2, 0.0859), (2.3, 0.1116), (2.4, 0.1321), (5.0, 0.1654)]
TAU_MASS = 1.77682


def delta_phi(a: Column, b: Column, closed: bool = False) -> Column:
    """a - b moved by one turn into (-pi, pi], or into [-pi, pi] if closed."""
    d = a - b
    below = d < -PI if closed else d <= -PI
    return F.when(d > PI, d - TWO_PI).when(below, d + TWO_PI).otherwise(d)


def normalised_angle(a: Column, period: float = TWO_PI, symmetric: bool = True) -> Column:
    """Angle in (-period/2, period/2], or in [0, period)."""
    turned = F.pmod(a, F.lit(period))
    return F.when(turned > period / 2, turned - period).otherwise(turned) if symmetric else turned


def delta_r2(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    return F.pow(eta1 - eta2, F.lit(2.0)) + F.pow(delta_phi(phi1, phi2), F.lit(2.0))


def delta_r(eta1: Column, phi1: Column, eta2: Column, phi2: Column) -> Column:
    return F.sqrt(delta_r2(eta1, phi1, eta2, phi2))


def polar(deta: Column, dphi: Column) -> Column:
    """Struct (r, theta) of a point around an axis."""
    return F.struct(F.hypot(deta, dphi).alias("r"), F.atan2(dphi, deta).alias("theta"))


def from_polar(r: Column, theta: Column) -> Column:
    return F.struct((r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"))


def signal_cone(pt: Column) -> Column:
    """Cone that shrinks with pt: 3 over pt from 30 on, at least 0.05."""
    return F.greatest(F.lit(3.0) / F.greatest(pt, F.lit(30.0)), F.lit(0.05))


def p4(pt: Column, eta: Column, phi: Column, mass: Column) -> Column:
    """Struct (px, py, pz, e)."""
    pz = pt * F.sinh(eta)
    e = F.sqrt(pt * pt + pz * pz + mass * mass)
    return F.struct((pt * F.cos(phi)).alias("px"), (pt * F.sin(phi)).alias("py"), pz.alias("pz"), e.alias("e"))


def p4_sum(a: Column, b: Column) -> Column:
    return F.struct(*[(a[c] + b[c]).alias(c) for c in ("px", "py", "pz", "e")])


def invariant_mass(v: Column) -> Column:
    m2 = v["e"] * v["e"] - v["px"] * v["px"] - v["py"] * v["py"] - v["pz"] * v["pz"]
    return F.sqrt(F.greatest(m2, F.lit(0.0)))


def from_p4(v: Column) -> Column:
    """Struct (pt, eta, phi, mass) of (px, py, pz, e); eta is null without transverse momentum."""
    pt = F.hypot(v["px"], v["py"])
    return F.struct(pt.alias("pt"), F.asinh(F.try_divide(v["pz"], pt)).alias("eta"), F.atan2(v["py"], v["px"]).alias("phi"), invariant_mass(v).alias("mass"))


def energy_over_pt(pt: Column, eta: Column, mass: Column) -> Column:
    return F.try_divide(F.sqrt(F.pow(pt * F.cosh(eta), F.lit(2.0)) + mass * mass), pt)


def transverse_mass(pt1: Column, phi1: Column, pt2: Column, phi2: Column) -> Column:
    return F.sqrt(F.lit(2.0) * pt1 * pt2 * (F.lit(1.0) - F.cos(delta_phi(phi1, phi2))))


def total_transverse_mass(*legs: tuple[Column, Column]) -> Column:
    """Of two leptons and the missing momentum, each (pt, phi)."""
    (a, b), (c, d), (e, f) = legs
    parts = [transverse_mass(a, b, e, f), transverse_mass(c, d, e, f), transverse_mass(a, b, c, d)]
    return F.sqrt(sum((x * x for x in parts), F.lit(0.0)))


def impact_xy(dx: Column, dy: Column, pt: Column, phi: Column) -> Column:
    """Transverse impact parameter of a track at (dx, dy) from the vertex."""
    return F.try_divide(dy * pt * F.cos(phi) - dx * pt * F.sin(phi), pt)


def impact_z(dx: Column, dy: Column, dz: Column, px: Column, py: Column, pz: Column) -> Column:
    pt2 = px * px + py * py
    return dz - F.try_divide((dx * px + dy * py) * pz, pt2)


def p_zeta(pt1: Column, phi1: Column, pt2: Column, phi2: Column, met: Column | None = None, met_phi: Column | None = None) -> Column:
    """Projection of the summed transverse momenta on the bisector of two legs; with met, the missing one included."""
    ux, uy = F.cos(phi1) + F.cos(phi2), F.sin(phi1) + F.sin(phi2)
    px, py = pt1 * F.cos(phi1) + pt2 * F.cos(phi2), pt1 * F.sin(phi1) + pt2 * F.sin(phi2)
    if met is not None:
        px, py = px + met * F.cos(met_phi), py + met * F.sin(met_phi)
    return F.try_divide(px * ux + py * uy, F.hypot(ux, uy))


def gottfried_jackson(mass: Column, p: Column, cos_flight: Column) -> Column:
    """Measured less largest Gottfried-Jackson angle; null where either is undefined."""
    top = F.try_divide(F.lit(TAU_MASS**2) - mass * mass, F.lit(2 * TAU_MASS) * p)
    return F.when((F.abs(top) <= 1) & (F.abs(cos_flight) <= 1), F.acos(cos_flight) - F.asin(top))


def crack_distance(eta: Column) -> Column:
    """Distance in eta to the nearest crack on either side."""
    return F.least(*[F.least(F.abs(eta - c), F.abs(eta + c)) for c in ETA_CRACKS])


def muon_isolation(charged: Column, neutral: Column, photon: Column, pileup: Column, pt: Column) -> Column:
    return F.try_divide(charged + F.greatest(neutral + photon - F.lit(0.5) * pileup, F.lit(0.0)), pt)


def electron_isolation(charged: Column, neutral: Column, photon: Column, rho: Column, eta: Column, pt: Column) -> Column:
    area = F.lit(EFFECTIVE_AREAS[-1][1])
    for top, value in reversed(EFFECTIVE_AREAS):
        area = F.when(F.abs(eta) < top, F.lit(value)).otherwise(area)
    return F.try_divide(charged + F.greatest(neutral + photon - area * rho, F.lit(0.0)), pt)


def cluster_energies(energies: Column) -> Column:
    """Struct of the first energy, the sum of the others and the number of clusters."""
    rest = F.aggregate(F.slice(energies, 2, F.greatest(F.size(energies), F.lit(1))), F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.get(energies, F.lit(0)).alias("first"), rest.alias("others"), F.size(energies).alias("n"))
