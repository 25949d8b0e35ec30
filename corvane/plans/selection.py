"""Queries on event selection. An event is an order; its lines are muons (flag A), electrons (R), triggers (N) and, all of
them, candidates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import select
from corvane.operators.select import DECAY_MODES, TRIGGER
from corvane.queries import query, table

#: Columns of a line as a lepton, tau, true lepton and jet, read alike by Spark and DuckDB.
FIELDS = {
    "ev": "l_orderkey", "flag": "l_returnflag", "idx": "l_linenumber * 1000000 + l_partkey", "pt": "CAST(l_quantity * 1.3 + 5 AS DOUBLE)", "eta": "CAST(l_discount * 50 - 2.5 AS DOUBLE)", "phi": "CAST(l_tax * 60 - 2.4 AS DOUBLE)",
    "charge": "CAST((l_partkey % 2) * 2 - 1 AS INT)", "iso": "CAST((l_suppkey % 10) / 50.0 AS DOUBLE)", "dz": "CAST((l_partkey % 9) / 50.0 AS DOUBLE)", "dxy": "CAST((l_partkey % 6) / 120.0 AS DOUBLE)", "loose": "l_partkey % 7 <> 0", "medium": "l_partkey % 5 <> 0", "tight": "l_partkey % 3 <> 0",
    "mode": "CAST(l_suppkey % 13 AS INT)", "vs_jet": "CAST((l_partkey % 4) / 3.0 AS DOUBLE)", "raw": "CAST((l_partkey % 50) / 50.0 AS DOUBLE)", "kind": "CAST(1 + l_suppkey % 6 AS INT)", "has_tau": "l_linenumber % 4 <> 0", "has_lepton": "l_partkey % 3 <> 1", "has_gen_jet": "l_partkey % 4 <> 2", "has_jet": "l_suppkey % 5 <> 3",
}
LABEL = "CASE WHEN l_partkey % 3 = 0 THEN 'other' ELSE '" + TRIGGER + "' END"
MET = {"met_pt": "CAST((o_custkey % 20) * 12.37 AS DOUBLE)", "met_phi": "CAST((o_custkey % 60) / 10.0 - 3 AS DOUBLE)"}

DPHI = "(CASE WHEN {a}.phi - {b}.phi > pi() THEN {a}.phi - {b}.phi - 2 * pi() WHEN {a}.phi - {b}.phi <= -pi() THEN {a}.phi - {b}.phi + 2 * pi() ELSE {a}.phi - {b}.phi END)"


def dr(a: str, b: str) -> str:
    return f"sqrt(({a}.eta - {b}.eta) ^ 2 + {DPHI.format(a=a, b=b)} ^ 2)"


def lepton(pt: float, eta: float, iso: float, flags: str) -> str:
    return f"pt > {pt} AND abs(eta) < {eta} AND iso < {iso} AND {flags}"


VERTEX = "abs(dz) < 0.2 AND abs(dxy) < 0.045"
EXTRA_MUON, EXTRA_ELECTRON = lepton(10, 2.4, 0.3, f"medium AND {VERTEX}"), lepton(10, 2.5, 0.3, "medium")
PAIR_MUON, PAIR_ELECTRON = lepton(15, 2.4, 0.3, f"loose AND {VERTEX}"), lepton(15, 2.5, 0.3, "loose")
BASE = f"""
    WITH l AS (SELECT {", ".join(f"{e} AS {n}" for n, e in FIELDS.items())}, {LABEL} AS label, {", ".join(f"{e} AS {n}" for n, e in MET.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    mu AS (SELECT * FROM l WHERE flag = 'A'), el AS (SELECT * FROM l WHERE flag = 'R'),
    pairs AS (SELECT DISTINCT a.ev, 'm' AS what FROM (SELECT * FROM mu WHERE {PAIR_MUON}) a JOIN (SELECT * FROM mu WHERE {PAIR_MUON}) b ON a.ev = b.ev AND a.idx < b.idx AND a.charge + b.charge = 0 AND {dr("a", "b")} > 0.15
      UNION ALL SELECT DISTINCT a.ev, 'e' FROM (SELECT * FROM el WHERE {PAIR_ELECTRON}) a JOIN (SELECT * FROM el WHERE {PAIR_ELECTRON}) b ON a.ev = b.ev AND a.idx < b.idx AND a.charge + b.charge = 0 AND {dr("a", "b")} > 0.15)
"""
FLAGS = f"""EXISTS (FROM mu x WHERE x.ev = t.ev AND {EXTRA_MUON} AND NOT (t.tag = 'muon' AND x.idx = t.idx)) AS extra_muon, EXISTS (FROM el x WHERE x.ev = t.ev AND {EXTRA_ELECTRON} AND NOT (t.tag = 'electron' AND x.idx = t.idx)) AS extra_electron,
      EXISTS (FROM pairs x WHERE x.ev = t.ev AND what = 'm') AS dimuon, EXISTS (FROM pairs x WHERE x.ev = t.ev AND what = 'e') AS dielectron"""


def tag_sql(name: str, pt: float) -> str:
    return f"{name} AS (SELECT *, 'muon' AS tag FROM mu WHERE {lepton(pt, 2.1, 0.15, f'medium AND {VERTEX}')} QUALIFY row_number() OVER (PARTITION BY ev ORDER BY iso, pt DESC, idx) = 1)"


#: What a line's columns above are made of.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"]

#: Arrays of an event by the flag of their lines, structs of a candidate by the field that says whether it is there, and
#: what they hold of a line's columns: names, or a name here and one above.
TRACK = "idx pt eta phi charge iso dz dxy"
ARRAYS = {"muons": ("A", f"{TRACK} loose medium tight"), "electrons": ("R", f"{TRACK} mva:medium veto:loose"), "triggers": ("N", "idx eta phi labels")}
OBJECTS = {"tau": ("has_tau", "pt eta phi charge mode found:loose vs_jet vs_jet_raw:raw dz"), "lepton": ("has_lepton", "pt eta phi kind"), "gen_jet": ("has_gen_jet", "eta"), "jet": ("has_jet", "pt eta phi")}
#: What a selector looks at beside the candidates' numbers.
USED = {"None": [], "MuTau": ["muons", "electrons", "triggers", "tau"], "genTauTau": ["lepton"], "TauJetTag": ["lepton", "gen_jet", "jet"], "TagAndProbe": ["muons", "electrons", "lepton", "gen_jet", "jet"]}


def events(spark: SparkSession, sf_dir: str, used: list[str]) -> DataFrame:
    """Orders with the arrays and candidates' structs that are used. Lines are dealt by order as they are read, and an order's
    lines and the order meet before anything is derived: the shuffle and the join carry narrow columns instead of the structs.
    An order's lines are sorted by idx once, and so are all arrays, which are made from the lines and not from each other.
    Fractions are divided as doubles, as in the SQL."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in MET.items()])
    raw = F.sort_array(F.collect_list(F.struct(F.expr(FIELDS["idx"]).alias("idx"), *LINE)))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE).repartition("l_orderkey").groupBy("l_orderkey").agg(raw.alias("lines"))
    both = lines.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    of = {n: re.sub(r"(\d\.\d+)", r"\1D", re.sub(r"\bl_", "x.l_", e)) for n, e in (FIELDS | {"labels": f"array({LABEL})"}).items()} | {"idx": "x.idx"}
    struct = lambda names: "struct(" + ", ".join(f"{of[n.split(':')[-1]]} AS {n.split(':')[0]}" for n in names.split()) + ")"
    objects = "".join(f", CASE WHEN {of[there]} THEN {struct(names)} END AS {n}" for n, (there, names) in OBJECTS.items() if n in used)
    parts = {n: f"transform(filter(lines, x -> x.l_returnflag = '{flag}'), x -> {struct(names)})" for n, (flag, names) in ARRAYS.items() if n in used}
    parts["candidates"] = f"transform(lines, x -> struct(x.idx AS index{objects}))"
    met = F.struct(F.col("met_pt").alias("pt"), F.col("met_phi").alias("phi")).alias("met")
    return both.select(F.col("l_orderkey").alias("ev"), met, *[F.expr(e).alias(n) for n, e in parts.items()])


def chosen(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return select.select(events(spark, sf_dir, USED[name]), name).select("ev", "tag", F.explode("selected").alias("s")).select("ev", "tag", "s.index", "s.type")


@query("selector_all", "SELECT l_orderkey AS ev, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def selector_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, "None").groupBy("ev").agg(F.count("*").alias("n"))


TAG_COLUMNS = ("kind", "charge", "id", "isolation", "extra_muon", "extra_electron", "dimuon", "dielectron")


@query(
    "selector_mu_tau",
    f"""
    {BASE}, {tag_sql("tags", 25)},
    fired AS (SELECT t.* FROM tags t WHERE sqrt(2 * pt * met_pt * (1 - cos(phi - met_phi))) < 30 AND EXISTS (SELECT 1 FROM l x WHERE x.ev = t.ev AND x.flag = 'N' AND x.label = '{TRIGGER}' AND {dr("t", "x")} < 0.3)),
    best AS (SELECT c.ev, c.idx AS index, c.charge AS tau_charge FROM l c JOIN fired t ON c.ev = t.ev WHERE c.has_tau AND c.pt > 20 AND abs(c.eta) < 2.3 AND c.loose AND c.mode IN ({", ".join(map(str, DECAY_MODES))}) AND c.vs_jet > 0.5 AND abs(c.dz) < 0.2 AND {dr("t", "c")} > 0.5
      QUALIFY row_number() OVER (PARTITION BY c.ev ORDER BY c.raw DESC, c.pt DESC, c.idx) = 1)
    SELECT t.ev, index, t.tag AS kind, t.charge, t.loose::INT + 2 * t.medium::INT + 4 * t.tight::INT AS id, t.iso AS isolation, {FLAGS} FROM fired t JOIN best ON t.ev = best.ev AND t.charge + tau_charge = 0
    """,
)
def selector_mu_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, "MuTau").select("ev", "index", *[F.col("tag")[c].alias(c) for c in TAG_COLUMNS])


@query("selector_gen_tau_tau", BASE + " SELECT ev, idx AS index FROM l WHERE has_lepton AND kind = 5 AND pt > 10 AND abs(eta) < 2.5 QUALIFY count(*) OVER (PARTITION BY ev) = 2")
def selector_gen_tau_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, "genTauTau").select("ev", "index")


@query("selector_tau_jet_tag", BASE + " SELECT ev, idx AS index FROM l WHERE has_lepton OR has_gen_jet OR has_jet")
def selector_tau_jet_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, "TauJetTag").select("ev", "index")


@query(
    "selector_tag_and_probe",
    f"""
    {BASE}, {tag_sql("tm", 28)},
    te AS (SELECT *, 'electron' AS tag FROM el WHERE {lepton(34, 2.3, 0.15, f"medium AND {VERTEX}")} AND ev NOT IN (SELECT ev FROM tm) QUALIFY row_number() OVER (PARTITION BY ev ORDER BY iso, pt DESC, idx) = 1),
    t AS (SELECT * FROM tm UNION ALL SELECT * FROM te),
    jets AS (SELECT c.ev, c.idx, coalesce(CASE t.tag WHEN 'muon' THEN 'MuonTag' WHEN 'electron' THEN 'ElectronTag' END, 'HighMET') AS type FROM l c LEFT JOIN t ON c.ev = t.ev
      WHERE c.has_jet AND abs(c.eta) < 2.8 AND (t.ev IS NULL AND c.met_pt > 180 OR {dr("t", "c")} > 0.4) QUALIFY row_number() OVER (PARTITION BY c.ev ORDER BY c.pt DESC, c.idx) = 1),
    rest AS (SELECT ev, idx, 'PtOrdered' AS type FROM l WHERE has_lepton AND has_gen_jet AND abs(eta) < 2.8 AND met_pt <= 180 AND ev NOT IN (SELECT ev FROM t) QUALIFY row_number() OVER (PARTITION BY ev ORDER BY pt DESC, idx) <= 2),
    probes AS (SELECT * FROM jets UNION ALL SELECT * FROM rest),
    s AS (SELECT * FROM probes UNION ALL SELECT ev, idx, 'GenBased' FROM l WHERE has_lepton AND abs(eta) < 2.8 AND kind IN (3, 4, 5) AND (ev, idx) NOT IN (SELECT (ev, idx) FROM probes)),
    flagged AS (SELECT t.ev, t.tag AS kind, t.charge, CASE t.tag WHEN 'muon' THEN t.loose::INT + 2 * t.medium::INT + 4 * t.tight::INT ELSE t.medium::INT END AS id, t.iso AS isolation, {FLAGS},
      (SELECT arg_max(c.kind, c.idx) FROM l c WHERE c.ev = t.ev AND c.has_lepton AND {dr("t", "c")} < 0.1) AS gen_kind FROM t)
    SELECT s.ev, s.idx AS index, s.type, {", ".join(f"f.{c}" for c in (*TAG_COLUMNS, "gen_kind"))} FROM s LEFT JOIN flagged f ON s.ev = f.ev
    """,
)
def selector_tag_and_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir, "TagAndProbe").select("ev", "index", "type", *[F.col("tag")[c].alias(c) for c in (*TAG_COLUMNS, "gen_kind")])
