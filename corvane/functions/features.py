"""Training features of a candidate and of the objects around it, as Column expressions built from a few rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import geometry
from corvane.functions.numeric import guarded, is_normal

Get = Callable[[str], Column]

#: Columns of a candidate that are features as they are.
PLAIN = [
    "rho", "tau_pt", "tau_eta", "tau_phi", "tau_mass", "tau_charge", "tau_chargedIsoPtSum", "tau_footprintCorrection", "tau_neutralIsoPtSum", "tau_photonPtSumOutsideSignalCone", "tau_puCorrPtSum",
    "tau_dz", "tau_flightLength_x", "tau_flightLength_y", "tau_flightLength_z", "tau_flightLength_sig", "tau_pt_weighted_deta_strip", "tau_pt_weighted_dphi_strip", "tau_pt_weighted_dr_signal",
    "tau_pt_weighted_dr_iso", "tau_leadingTrackNormChi2", "tau_n_photons", "tau_emFraction", "tau_inside_ecal_crack",
]

#: Features that are quotients, 0 where there is nothing to divide by.
QUOTIENTS = {
    "tau_chargedIsoPtSumdR03_over_dR05": ("tau_chargedIsoPtSumdR03", "tau_chargedIsoPtSum"),
    "tau_neutralIsoPtSumWeight_over_neutralIsoPtSum": ("tau_neutralIsoPtSumWeight", "tau_neutralIsoPtSum"),
    "tau_neutralIsoPtSumWeightdR03_over_neutralIsoPtSum": ("tau_neutralIsoPtSumWeightdR03", "tau_neutralIsoPtSum"),
    "tau_neutralIsoPtSumdR03_over_dR05": ("tau_neutralIsoPtSumdR03", "tau_neutralIsoPtSum"),
}

#: Columns of an electron that count as missing at -1 and below.
ELECTRON_SHAPES = [f"{a}{b}" for a in ("", "full5x5_") for b in ("sigmaEtaEta", "sigmaIetaIeta", "sigmaIphiIphi", "sigmaIetaIphi", "e1x5", "e2x5Max", "e5x5", "r9", "hcalDepth1OverEcal", "hcalDepth2OverEcal", "hcalDepth1OverEcalBc", "hcalDepth2OverEcalBc", "eLeft", "eRight", "eBottom", "eTop")] + [f"full5x5_e2x5{side}" for side in ("Left", "Right", "Bottom", "Top")]
#: Energies and momenta of an electron that are taken relative to its pt.
ELECTRON_ENERGIES = ["trackMomentumAtVtx", "trackMomentumAtCalo", "trackMomentumOut", "trackMomentumAtEleClus", "trackMomentumAtVtxWithConstraint", "ecalEnergy", "gsfTrack_pt"]
#: Particle types of objects that are no particle candidates.
ELECTRON_TYPE, MUON_TYPE, CANDIDATE_TYPE = 7, 8, 9


def within(good: Column, value: Column, other: float = 0.0) -> Column:
    """value where the flag holds, else a number; a null flag does not hold."""
    return F.when(good, value).otherwise(F.lit(other))


def flag(good: Column) -> Column:
    return F.coalesce(good.cast("float"), F.lit(0.0).cast("float"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def measured(name: str, get: Get) -> dict[str, Column]:
    """An impact parameter with its error: whether both are usable, the value and its significance."""
    value, error = get(name), get(f"{name}_error")
    good = is_normal(value) & (value > -10) & is_normal(error) & (error > 0)
    return {f"{name}_valid": flag(good), name: within(good, value), f"{name}_sig": within(good, F.abs(value) / error)}


def candidate_features(get: Get = F.col, prongs_from: int = 0) -> dict[str, Column]:
    """All flat features of a candidate by name. prongs_from is added to the number of charged prongs."""
    out = {name: get(name) for name in PLAIN}
    out |= {name: guarded(get(a), get(b)) for name, (a, b) in QUOTIENTS.items()}
    out["tau_E_over_pt"] = geometry.energy_over_pt(get("tau_pt"), get("tau_eta"), get("tau_mass"))
    mode = get("tau_decayMode")
    out["tau_n_charged_prongs"] = F.floor(mode / 5).cast("int") + prongs_from
    out["tau_n_neutral_prongs"] = mode % 5
    for name in ("tau_dxy", "tau_ip3d"):
        out |= measured(name, get)
    dz, error = get("tau_dz"), get("tau_dz_error")
    usable = is_normal(dz) & is_normal(error) & (error > 0)
    out |= {"tau_dz_sig_valid": flag(usable), "tau_dz_sig": within(usable, F.abs(dz) / error)}
    ratio, angle = get("tau_e_ratio"), get("tau_gj_angle_diff")
    out |= {"tau_e_ratio_valid": flag(is_normal(ratio) & (ratio > 0)), "tau_e_ratio": within(is_normal(ratio) & (ratio > 0), ratio)}
    out |= {"tau_gj_angle_diff_valid": flag(finite(angle) & (angle >= 0)), "tau_gj_angle_diff": within(finite(angle) & (angle >= 0), angle, -1.0)}
    for axis in "xyz":
        out[f"tau_sv_minus_pv_{axis}"] = within(get("tau_hasSecondaryVertex") != 0, get(f"tau_sv_{axis}") - get(f"pv_{axis}"))
    out["tau_leadChargedCand_etaAtEcalEntrance_minus_tau_eta"] = get("tau_leadChargedCand_etaAtEcalEntrance") - get("tau_eta")
    out["particle_type"] = F.lit(CANDIDATE_TYPE)
    return out


def around(obj: Column, get: Get) -> dict[str, Column]:
    """Place and pt of an object relative to the candidate."""
    deta, dphi = obj["eta"] - get("tau_eta"), geometry.delta_phi(obj["phi"], get("tau_phi"), closed=True)
    at = geometry.polar(deta, dphi)
    return {"deta": deta, "dphi": dphi, "rel_pt": F.try_divide(obj["pt"], get("tau_pt")), "r": at["r"], "theta": at["theta"]}


def particle_features(obj: Column, get: Get = F.col) -> dict[str, Column]:
    """Features of a particle candidate; its track's are 0 without track details."""
    out = around(obj, get) | {"particle_type": obj["particleType"] - 1}
    placed = finite(obj["vertex_z"])
    for axis in "xyz":
        shift = obj[f"vertex_{axis}"] - get(f"pv_{axis}")
        for name, value in ((f"vertex_d{axis}", shift), (f"vertex_d{axis}_tauFL", shift - get(f"tau_flightLength_{axis}"))):
            out[name] = within(placed, value, -10.0) if axis == "z" else value
    track = obj["hasTrackDetails"] == 1
    for name in ("dxy", "dz"):
        sig = F.try_divide(F.abs(obj[name]), obj[f"{name}_error"])
        out |= {name: within(track & finite(obj[name]), obj[name]), f"{name}_sig": within(track & finite(sig), sig)}
    fitted = track & (obj["track_ndof"] > 0)
    return out | {"track_ndof": within(fitted, obj["track_ndof"].cast("double")), "chi2_ndof": within(fitted, F.try_divide(obj["track_chi2"], obj["track_ndof"].cast("double")))}


def electron_features(obj: Column, get: Get = F.col) -> dict[str, Column]:
    """Features of an electron: cluster and track energies relative to its pt, its closest track and its shower shape."""
    out = around(obj, get) | {"particle_type": F.lit(ELECTRON_TYPE)}
    clustered, closest = obj["cc_ele_energy"] >= 0, obj["closestCtfTrack_normalizedChi2"] >= 0
    out |= {"cc_valid": flag(clustered), "cc_ele_rel_energy": within(clustered, F.try_divide(obj["cc_ele_energy"], obj["pt"]))}
    out |= {"cc_gamma_rel_energy": within(clustered, F.try_divide(obj["cc_gamma_energy"], obj["cc_ele_energy"])), "cc_n_gamma": within(clustered, obj["cc_n_gamma"], -1)}
    out |= {f"rel_{name}": F.try_divide(obj[name], obj["pt"]) for name in ELECTRON_ENERGIES}
    out |= {f"{name}_sig": F.try_divide(obj[name], obj[f"{name}_error"]) for name in ("ecalEnergy", "gsfTrack_pt")}
    out["has_closestCtfTrack"] = flag(closest)
    out |= {name: within(closest, obj[name]) for name in ("closestCtfTrack_normalizedChi2", "closestCtfTrack_numberOfValidHits")}
    return out | {name: within(obj[name] > -1, obj[name], -1.0) for name in ELECTRON_SHAPES}


def muon_features(obj: Column, get: Get = F.col) -> dict[str, Column]:
    """Features of a muon: impact parameter, track fit and calorimeter energy, each under its own validity."""
    out = around(obj, get) | {"particle_type": F.lit(MUON_TYPE)}
    sig = F.try_divide(F.abs(obj["dxy"]), obj["dxy_error"])
    fitted, stopped = finite(obj["normalizedChi2"]) & (obj["normalizedChi2"] > 0), obj["pfEcalEnergy"] >= 0
    out |= {"dxy_sig": within(finite(sig), sig), "normalizedChi2_valid": flag(fitted)}
    out |= {name: within(fitted, obj[name]) for name in ("normalizedChi2", "numberOfValidHits")}
    return out | {"pfEcalEnergy_valid": flag(stopped), "rel_pfEcalEnergy": within(stopped, F.try_divide(obj["pfEcalEnergy"], obj["pt"]))}


def packed(features: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in features.items()])
