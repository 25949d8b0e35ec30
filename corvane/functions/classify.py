"""Row classification of candidates: truth match, class, jet type and particle type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.geometry import delta_r

#: Codes that stored tables use.
GEN_MATCH = {"electron": 1, "muon": 2, "tau_electron": 3, "tau_muon": 4, "tau": 5, "none": 6}
CLASSES = {"e": 0, "mu": 1, "tau": 2, "jet": 3, "emb_e": 4, "emb_mu": 5, "emb_tau": 6, "emb_jet": 7, "data": 8}
SAMPLES = {"data": 0, "mc": 1, "embedded": 2}
PARTICLE_TYPES = {11: 2, 13: 3, 22: 4, 211: 1, 130: 5, 1: 6, 2: 7}
#: Class by (match, sample).
CLASS_OF = {
    (1, 1): 0, (3, 1): 0, (2, 1): 1, (4, 1): 1, (5, 1): 2, (5, 2): 6,
    (6, 1): 3, (6, 0): 8, (6, 2): 7, (4, 2): 5, (3, 2): 4,
}


def gen_match(kind: Column, lepton: Column, jet: Column, distance: Column, visible_pt: Column, edge_open: bool = False) -> Column:
    """Match code by lepton kind (1 to 5), or that of no match for a jet, else null. A lepton farther than 0.2, or
    softer than 8 (15 for kind 5), matches nothing. edge_open also refuses a distance of exactly 0.2."""
    near = distance < 0.2 if edge_open else distance <= 0.2
    hard = visible_pt >= F.when(kind == 5, 15.0).otherwise(8.0)
    known = F.when(kind.between(1, 5), kind).otherwise(F.raise_error(F.concat(F.lit("unknown lepton kind "), kind.cast("string"))).cast("int"))
    return F.when(lepton >= 0, F.when(near & hard, known)).when(jet >= 0, F.lit(GEN_MATCH["none"]))


def candidate_class(match: Column, sample: Column, strict: bool = False) -> Column:
    """Class code of a match and sample; pairs that do not go together give -1, or an error if strict."""
    out = F.raise_error("incompatible match and sample").cast("int") if strict else F.lit(-1)
    for (m, s), c in CLASS_OF.items():
        out = F.when((match == m) & (sample == s), F.lit(c)).otherwise(out)
    return out


def particle_type(pdg: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PARTICLE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.abs(pdg)), F.lit(0))


def jet_type(jet: Column, pt: Column, eta: Column, tau: Column, gen_jet: Column, gen_pt: Column, gen_eta: Column, lepton_free: Column, cuts: Column | None = None) -> Column:
    """1 for a tau jet, 0 for a plain one, null for neither. cuts (vertex, visible pt and distance) decide the tau side
    where they are given; as stored tables were made, they do not."""
    inside = (jet >= 0) & (pt > 20.0) & (F.abs(eta) < 2.4)
    plain = (gen_jet >= 0) & lepton_free & (gen_pt > 20.0) & (F.abs(gen_eta) < 2.4)
    true = tau if cuts is None else tau & cuts
    return F.when(inside & true, 1).when(inside & ~tau & plain, 0)


def near_axis(eta: Column, phi: Column, axes: Column, radius: float) -> Column:
    """Whether a point is within radius of any axis, axes being an array of struct(eta, phi)."""
    return F.exists(axes, lambda a: delta_r(eta, phi, a["eta"], a["phi"]) < radius)
