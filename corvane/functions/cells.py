"""Features of the best object of each type in a grid cell, as arrays in a fixed order. A feature that an object lacks, or
that is not finite, is 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import geometry
from corvane.functions.features import ELECTRON_ENERGIES, Get, finite, within
from corvane.functions.numeric import is_normal

# The features of each type, in order.
PLACE = ["valid", "rel_pt", "deta", "dphi"]
VERTEX = ["vertex_dx", "vertex_dy", "vertex_dz", "vertex_dx_tauFL", "vertex_dy_tauFL", "vertex_dz_tauFL"]
TRACK = ["hasTrackDetails", "hasTimeDetails", "dxy", "dxy_sig", "dz", "dz_sig", "time", "vertex_dt", "time_sig", "track_chi2_ndof", "track_ndof"]
HITS = ["lostInnerHits", "nPixelHits"]
ELECTRON_RATIOS = ["eSuperClusterOverP", "eSeedClusterOverP", "eSeedClusterOverPout", "eEleClusterOverPout", "deltaEtaSuperClusterTrackAtVtx", "deltaEtaSeedClusterTrackAtCalo", "deltaEtaEleClusterTrackAtCalo", "deltaPhiEleClusterTrackAtCalo", "deltaPhiSuperClusterTrackAtVtx", "deltaPhiSeedClusterTrackAtCalo"]
ELECTRON_INPUTS = ["mvaInput_earlyBrem", "mvaInput_lateBrem", "mvaInput_sigmaEtaEta", "mvaInput_hadEnergy", "mvaInput_deltaEta"]
MUON_COUNTS = [f"n_{what}_{detector}_{station}" for what in ("matches", "hits") for detector in ("DT", "CSC", "RPC") for station in (1, 2, 3, 4)]
FEATURES = {
    "pf_electron": [*PLACE, "pvAssociationQuality", "puppiWeight", "charge", *HITS, *VERTEX, *TRACK],
    "pf_muon": [*PLACE, "pvAssociationQuality", "fromPV", "puppiWeight", "charge", *HITS, *VERTEX, *TRACK],
    "pf_charged": [*PLACE, "tauLeadChargedHadrCand", "pvAssociationQuality", "fromPV", "puppiWeight", "puppiWeightNoLep", "charge", *HITS, *VERTEX, *TRACK, "hcalFraction", "rawCaloFraction"],
    "pf_neutral": [*PLACE, "puppiWeight", "puppiWeightNoLep", "hcalFraction"],
    "pf_photon": [*PLACE, "pvAssociationQuality", "fromPV", "puppiWeight", "puppiWeightNoLep", *HITS, *VERTEX, *TRACK],
    "electron": [*PLACE, "cc_valid", "cc_ele_rel_energy", "cc_gamma_rel_energy", "cc_n_gamma", *[f"rel_{n}" for n in ELECTRON_ENERGIES if n != "gsfTrack_pt"], "ecalEnergy_sig", *ELECTRON_RATIOS, *ELECTRON_INPUTS, "gsfTrack_normalizedChi2", "gsfTrack_numberOfValidHits", "rel_gsfTrack_pt", "gsfTrack_pt_sig", "has_closestCtfTrack", "closestCtfTrack_normalizedChi2", "closestCtfTrack_numberOfValidHits"],
    "muon": [*PLACE, "dxy", "dxy_sig", "normalizedChi2_valid", "normalizedChi2", "numberOfValidHits", "segmentCompatibility", "caloCompatibility", "pfEcalEnergy_valid", "rel_pfEcalEnergy", *MUON_COUNTS],
}
GLOBAL = ["rho", "tau_pt", "tau_eta", "tau_inside_ecal_crack", "pv_t", "pv_t_sig"]
#: Types of particle candidates by their number, and the numbers of those that enter no grid.
PARTICLE_KINDS, NO_KINDS = {1: "pf_charged", 2: "pf_electron", 3: "pf_muon", 4: "pf_photon", 5: "pf_neutral"}, (0, 6, 7)

#: How a feature is scaled: (type, feature, value, whether the grid is the inner one) -> value.
Scale = Callable[[str, str, Column, Column], Column]


def kind_of(particle_type: Column) -> Column:
    """Type of a particle candidate; null for those that enter no grid, an error for a number that is none."""
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in PARTICLE_KINDS.items() for x in pair]), particle_type)
    wrong = F.raise_error(F.concat(F.lit("unknown particle type "), particle_type.cast("string"))).cast("string")
    return F.when(particle_type.isin(*NO_KINDS), F.lit(None).cast("string")).otherwise(F.coalesce(known, wrong))


def linear(low: float, high: float, inner: tuple[float, float] | None = None) -> Callable[[Column, Column], Column]:
    """Scaling of a range to [-1, 1], values beyond it clamped; inner: the range in the inner grid."""
    to = lambda x, a, b: F.least(F.greatest((x - (a + b) / 2) / ((b - a) / 2), F.lit(-1.0)), F.lit(1.0))
    return lambda x, is_inner: F.when(is_inner, to(x, *(inner or (low, high)))).otherwise(to(x, low, high))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def place(obj: Column, get: Get) -> dict[str, Column]:
    return {"valid": F.lit(1.0), "rel_pt": ratio(obj["pt"], get("tau_pt")), "deta": obj["eta"] - get("tau_eta"), "dphi": geometry.delta_phi(obj["phi"], get("tau_phi"))}


def particle(kind: str, obj: Column, get: Get) -> dict[str, Column]:
    """Of a particle candidate of any type. A photon without a vertex keeps the flight length alone."""
    out = place(obj, get)
    for axis in "xyz":
        shift = obj[f"vertex_{axis}"] - get(f"pv_{axis}")
        flight = get(f"tau_flightLength_{axis}")
        placed = finite(obj["vertex_z"] - get("pv_z")) if kind == "pf_photon" else F.lit(True)
        out |= {f"vertex_d{axis}": within(placed, shift), f"vertex_d{axis}_tauFL": F.when(placed, shift - flight).otherwise(-flight)}
    track, timed = obj["hasTrackDetails"] == 1, obj["timeError"] >= 0
    out |= {"hasTrackDetails": track.cast("double"), "hasTimeDetails": timed.cast("double")}
    for name in ("dxy", "dz"):
        out |= {name: within(track, obj[name]), f"{name}_sig": within(track, ratio(F.abs(obj[name]), obj[f"{name}_error"]))}
    late = obj["time"] - get("pv_t")
    out |= {"time": within(timed, obj["time"]), "vertex_dt": within(timed, late), "time_sig": within(timed, ratio(F.abs(late), obj["timeError"]))}
    fitted = track & (obj["track_ndof"] > 0)
    return out | {"track_chi2_ndof": within(fitted, ratio(obj["track_chi2"], obj["track_ndof"])), "track_ndof": within(fitted, obj["track_ndof"].cast("double"))}


def electron(kind: str, obj: Column, get: Get) -> dict[str, Column]:
    clustered, closest = obj["cc_ele_energy"] >= 0, obj["closestCtfTrack_normalizedChi2"] >= 0
    out = place(obj, get) | {"cc_valid": clustered.cast("double"), "cc_ele_rel_energy": within(clustered, ratio(obj["cc_ele_energy"], obj["pt"]))}
    out |= {"cc_gamma_rel_energy": within(clustered, ratio(obj["cc_gamma_energy"], obj["cc_ele_energy"])), "cc_n_gamma": within(clustered, obj["cc_n_gamma"])}
    out |= {f"rel_{n}": ratio(obj[n], obj["pt"]) for n in ELECTRON_ENERGIES}
    out |= {f"{n}_sig": ratio(obj[n], obj[f"{n}_error"]) for n in ("ecalEnergy", "gsfTrack_pt")}
    out["has_closestCtfTrack"] = closest.cast("double")
    return out | {n: within(closest, obj[n]) for n in ("closestCtfTrack_normalizedChi2", "closestCtfTrack_numberOfValidHits")}


def muon(kind: str, obj: Column, get: Get) -> dict[str, Column]:
    fitted, stopped, usual = obj["normalizedChi2"] >= 0, obj["pfEcalEnergy"] >= 0, is_normal(obj["dxy"]) & is_normal(obj["dxy_error"])
    out = place(obj, get) | {"dxy_sig": within(usual, ratio(F.abs(obj["dxy"]), obj["dxy_error"])), "normalizedChi2_valid": fitted.cast("double")}
    out |= {n: within(fitted, obj[n]) for n in ("normalizedChi2", "numberOfValidHits")}
    return out | {"pfEcalEnergy_valid": stopped.cast("double"), "rel_pfEcalEnergy": within(stopped, ratio(obj["pfEcalEnergy"], obj["pt"]))}


def usable(values: list[Column]) -> Column:
    """Values as one array of floats. The test is one step over the array, so that no value's expression is repeated."""
    return F.transform(F.array(*values), lambda x: F.when(finite(x), x).otherwise(0.0).cast("float"))


def vector(kind: str, obj: Column, inner: Column, get: Get = F.col, scale: Scale | None = None) -> Column:
    """Features of an object of a type as an array of floats; those without a rule are the object's own columns."""
    rules = {"electron": electron, "muon": muon}.get(kind, particle)(kind, obj, get)
    values = []
    for name in FEATURES[kind]:
        value = rules[name] if name in rules else obj[name]
        value = value.cast("double")
        if scale and name != "valid":
            value = scale(kind, name, value, inner)
        values.append(value)
    return usable(values)


def global_vector(inner: Column, get: Get = F.col, scale: Scale | None = None) -> Column:
    """Features of the candidate that every cell with an object has."""
    rules = {"pv_t_sig": ratio(F.abs(get("pv_t")), get("pv_tE"))}
    values = []
    for name in GLOBAL:
        value = (rules[name] if name in rules else get(name)).cast("double")
        value = scale("global", name, value, inner) if scale else value
        values.append(value)
    return usable(values)
