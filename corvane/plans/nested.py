"""Queries on arrays, geometry, matching, tensors, graphs and metrics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as geo
from corvane.functions import numeric
from corvane.operators import graph, match, metrics, tensor
from corvane.queries import query, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


#: Embedding components as (eta, phi): the first two, four times as large.
POINT_SQL = "SELECT vec_id, label, vec_id // 50 AS event, 4 * embedding[1]::DOUBLE AS eta, 4 * embedding[2]::DOUBLE AS phi, 10 + 5 * abs(embedding[3]::DOUBLE) AS pt, embedding[4]::DOUBLE AS x4 FROM embeddings"
DPHI_SQL = "CASE WHEN {d} > pi() THEN {d} - 2 * pi() WHEN {d} <= -pi() THEN {d} + 2 * pi() ELSE {d} END"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.expr("vec_id div 50").alias("event"), (4 * e(0)).alias("eta"), (4 * e(1)).alias("phi"), (10 + 5 * F.abs(e(2))).alias("pt"), e(3).alias("x4"))


def r6(c, name: str):
    return F.round(c, 6).alias(name)


NESTED_SQL = "SELECT l_orderkey, list(struct_pack(q := l_quantity, d := l_discount, p := l_partkey, f := l_returnflag) ORDER BY l_quantity DESC, l_partkey, l_discount, l_returnflag) AS c FROM lineitem GROUP BY 1"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct((-F.col("l_quantity")).alias("nq"), F.col("l_partkey").alias("p"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("f"))
    return items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("c"))


@query(
    "geom_functions",
    f"""
    SELECT vec_id, round({DPHI_SQL.format(d="(phi - x4)")}, 6) AS dphi, round(sqrt((eta - 0.1) ^ 2 + ({DPHI_SQL.format(d="(phi - x4)")}) ^ 2), 6) AS dr, round(atan2(phi, eta), 6) AS theta,
      round(greatest(3 / greatest(pt, 30), 0.05), 6) AS cone, round(sqrt(pt ^ 2 + (pt * (exp(eta) - exp(-eta)) / 2) ^ 2 + 0.01), 5) AS e, round(sqrt(2 * pt * 20 * (1 - cos({DPHI_SQL.format(d="(phi - x4)")}))), 5) AS mt,
      round((0.2 * pt * cos(phi) - 0.1 * pt * sin(phi)) / pt, 6) AS dxy,
      round(((pt * cos(phi) + 20 * cos(x4)) * (cos(phi) + cos(x4)) + (pt * sin(phi) + 20 * sin(x4)) * (sin(phi) + sin(x4))) / sqrt((cos(phi) + cos(x4)) ^ 2 + (sin(phi) + sin(x4)) ^ 2), 5) AS pzeta FROM ({POINT_SQL})
    """,
)
def geom_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    eta, phi, pt, x = (F.col(c) for c in ("eta", "phi", "pt", "x4"))
    twenty = F.lit(20.0)
    return points(spark, sf_dir).select(
        "vec_id", r6(geo.delta_phi(phi, x), "dphi"), r6(geo.delta_r(eta, phi, F.lit(0.1), x), "dr"), r6(geo.polar(eta, phi)["theta"], "theta"), r6(geo.signal_cone(pt), "cone"),
        F.round(geo.p4(pt, eta, phi, F.lit(0.1))["e"], 5).alias("e"), F.round(geo.transverse_mass(pt, phi, twenty, x), 5).alias("mt"), r6(geo.impact_xy(F.lit(0.1), F.lit(0.2), pt, phi), "dxy"), F.round(geo.p_zeta(pt, phi, twenty, x), 5).alias("pzeta"),
    )


CRACK_SQL = "least(" + ", ".join(f"abs(eta - {c}), abs(eta + {c})" for c in geo.ETA_CRACKS) + ")"
AREA_SQL = "CASE " + " ".join(f"WHEN abs(eta) < {top} THEN {v}" for top, v in geo.EFFECTIVE_AREAS) + f" ELSE {geo.EFFECTIVE_AREAS[-1][1]} END"


@query(
    "geom_variants",
    f"""
    SELECT vec_id, round({CRACK_SQL}, 6) AS crack, round((1 + greatest(2 + x4 - 0.5 * pt / 10, 0)) / pt, 6) AS mu_iso, round((1 + greatest(2 + x4 - ({AREA_SQL}) * 20, 0)) / pt, 6) AS e_iso,
      round(sqrt((pt * (exp(eta) + exp(-eta)) / 2) ^ 2 + 0.25) / pt, 6) AS e_over_pt, round(eta ^ 2 + ({DPHI_SQL.format(d="(phi - x4)")}) ^ 2, 6) AS dr2 FROM ({POINT_SQL})
    """,
)
def geom_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    eta, phi, pt, x = (F.col(c) for c in ("eta", "phi", "pt", "x4"))
    one, two = F.lit(1.0), F.lit(2.0)
    return points(spark, sf_dir).select("vec_id", r6(geo.crack_distance(eta), "crack"), r6(geo.muon_isolation(one, two, x, pt / 10, pt), "mu_iso"), r6(geo.electron_isolation(one, two, x, F.lit(20.0), eta, pt), "e_iso"), r6(geo.energy_over_pt(pt, eta, F.lit(0.5)), "e_over_pt"), r6(geo.delta_r2(eta, phi, F.lit(0.0), x), "dr2"))


PAIR_SQL = f"WITH p AS ({POINT_SQL}), n AS (SELECT a.vec_id, b.vec_id AS other, a.event, sqrt((a.eta - b.eta) ^ 2 + ({DPHI_SQL.format(d='(a.phi - b.phi)')}) ^ 2) AS dr, b.pt AS other_pt FROM p a JOIN p b ON a.event = b.event AND a.vec_id < b.vec_id)"


@query("match_nearest", PAIR_SQL + " SELECT vec_id, other, round(dr, 6) AS dr FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dr, other) AS k FROM n WHERE dr < 0.5) WHERE k = 1")
def match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("vec_id", "event", "eta", "phi", "pt")
    pairs = match.near_pairs(p, p, ["event"], 0.5).where("vec_id < vec_id_b")
    return match.nearest(pairs, ["vec_id"], [F.col("dr"), F.col("vec_id_b")]).select("vec_id", F.col("vec_id_b").alias("other"), r6("dr", "dr"))


@query("match_variants", PAIR_SQL + " SELECT vec_id, count(*) AS near, max(other_pt) > 12 AS hard FROM n WHERE dr < 0.8 GROUP BY 1")
def match_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("vec_id", "event", "eta", "phi", "pt")
    return match.near_pairs(p, p, ["event"], 0.8).where("vec_id < vec_id_b").groupBy("vec_id").agg(F.count("*").alias("near"), (F.max("pt_b") > 12).alias("hard"))


NEAR_SQL = "sqrt((c.eta - {eta}) ^ 2 + (" + DPHI_SQL.format(d="(c.phi - {phi})") + ") ^ 2)"


@query(
    "match_priority",
    f"""
    WITH p AS ({POINT_SQL}), d AS (
      SELECT c.event, c.vec_id, o.vec_id AS object, {NEAR_SQL.format(eta="o.eta", phi="o.phi")} AS d1, sqrt((c.x4 - o.eta) ^ 2 + ({DPHI_SQL.format(d="(c.x4 - o.phi)")}) ^ 2) AS d2
      FROM p c JOIN p o ON c.event = o.event AND c.label < 3 AND o.label >= 3),
    r AS (SELECT event, vec_id, object, CASE WHEN d1 < 0.3 THEN d1 END AS d1, CASE WHEN d2 < 0.6 THEN d2 END AS d2 FROM d WHERE d1 < 0.3 OR d2 < 0.6)
    SELECT event, vec_id, object, round(d1, 6) AS dr_1, round(d2, 6) AS dr_2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d1 NULLS LAST, d2 NULLS LAST, object) AS k FROM r) WHERE k = 1
    """,
)
def match_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    found = match.priority_match(p.where("label < 3"), p.where("label >= 3"), ["event"], "vec_id", "vec_id", [("eta", "phi", 0.3), ("x4", "x4", 0.6)])
    return found.select("event", "vec_id", "object", r6("dr_1", "dr_1"), r6("dr_2", "dr_2"))


@query("cone_semi", f"WITH p AS ({POINT_SQL}) SELECT event, count(*) AS kept FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.event = a.event AND b.label = 1 AND sqrt((a.eta - b.eta) ^ 2 + ({DPHI_SQL.format(d='(a.phi - b.phi)')}) ^ 2) < 0.5) GROUP BY 1")
def cone_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("event", "vec_id", "label", "eta", "phi")
    return match.near_any(p, p.where("label = 1"), ["event"], ["vec_id"], 0.5).groupBy("event").agg(F.count("*").alias("kept"))


@query(
    "cone_semi_axes",
    f"WITH p AS ({POINT_SQL}) SELECT vec_id FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.event = a.event AND b.label < 2 AND sqrt((a.eta - b.eta) ^ 2 + ({DPHI_SQL.format(d='(a.phi - b.phi)')}) ^ 2) < CASE b.label WHEN 0 THEN 0.3 ELSE 0.6 END)",
)
def cone_semi_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects within the cone of any axis, whose radius is that of the axis's kind."""
    p = points(spark, sf_dir).select("event", "vec_id", "label", "eta", "phi")
    return match.near_any_of(p, [(p.where("label = 0"), 0.3), (p.where("label = 1"), 0.6)], ["event"], ["vec_id"]).select("vec_id")


@query(
    "closure",
    """
    WITH RECURSIVE u AS (SELECT DISTINCT l_partkey AS a, -1 - l_suppkey AS b FROM lineitem UNION SELECT -1 - l_suppkey, l_partkey FROM lineitem),
    c(node, label) USING KEY (node) AS (
      SELECT a, min(least(a, b)) FROM u GROUP BY 1
      UNION SELECT u.a, min(c.label) FROM u JOIN c ON u.b = c.node JOIN recurring.c AS own ON own.node = u.a WHERE c.label < own.label GROUP BY u.a),
    s AS (SELECT label, count(*) AS reached FROM c GROUP BY 1)
    SELECT node AS root, reached FROM c JOIN s USING (label) WHERE node >= 0
    """,
)
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that each part reaches over lines to suppliers and back."""
    links = items(spark, sf_dir).select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b"))
    labels = graph.components(links)
    return labels.where("node >= 0").join(labels.groupBy("label").agg(F.count("*").alias("reached")), "label").select(F.col("node").alias("root"), "reached")


@query(
    "cluster_merge",
    f"""
    WITH RECURSIVE p AS ({POINT_SQL}), r AS (SELECT event, eta, phi, pt, source, row_number() OVER (PARTITION BY event ORDER BY source, vec_id) AS n FROM (SELECT event, vec_id, (label % 3)::INT AS source, round(eta, 1) AS eta, round(phi, 1) AS phi, round(pt, 0) AS pt FROM p)),
    k(event, n, kept) AS (
      SELECT DISTINCT event, 0::BIGINT, []::STRUCT(e DOUBLE, p DOUBLE, t DOUBLE, b INT)[] FROM r UNION ALL
      SELECT event, n, CASE WHEN m IS NULL OR m = 0 THEN list_append(kept, {{'e': eta, 'p': phi, 't': pt, 'b': 1 << source}}) ELSE list_transform(kept, lambda x, i: CASE WHEN i = m THEN {{'e': x.e, 'p': x.p, 't': x.t, 'b': x.b | (1 << source)}} ELSE x END) END
      FROM (SELECT r.*, kept, list_position(list_transform(kept, lambda x: sqrt((x.e - eta) ^ 2 + ({DPHI_SQL.format(d="(x.p - phi)")}) ^ 2) < 0.01 AND abs(x.t - pt) < 0.01), true) AS m FROM k JOIN r ON r.event = k.event AND r.n = k.n + 1))
    SELECT event, len(last)::BIGINT AS n, list_sum(list_transform(last, lambda x: bit_count(x.b)))::BIGINT AS bits FROM (SELECT event, max_by(kept, n) AS last FROM k GROUP BY 1)
    """,
)
def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("event", (F.col("label") % 3).alias("source"), F.col("vec_id").alias("idx"), F.round("eta", 1).alias("eta"), F.round("phi", 1).alias("phi"), F.round("pt", 0).alias("pt"))
    return match.merge_first_wins(rows, "event").groupBy("event").agg(F.count("*").alias("n"), F.sum(F.bit_count("bits")).cast("long").alias("bits"))


@query("pairwise_self_join", f"WITH p AS ({POINT_SQL}) SELECT a.event, count(*) AS pairs, round(avg((a.pt + b.pt) / 2), 6) AS mean_pt FROM p a JOIN p b ON a.event = b.event GROUP BY 1")
def pairwise_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all pairs of two rows is the mean over the rows, so no pair is made."""
    return points(spark, sf_dir).groupBy("event").agg((F.count("*") * F.count("*")).alias("pairs"), r6(F.avg("pt"), "mean_pt"))


@query("nested_transform", f"WITH g AS ({NESTED_SQL}) SELECT l_orderkey, len(c) AS n, round(list_sum(list_transform(c, lambda x: greatest(x.q - 25, -1))), 6) AS clipped, len(list_filter(c, lambda x: x.d > 0.05)) AS kept, c[1].p AS first FROM g")
def nested_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    clipped = F.aggregate(F.transform(c, lambda x: F.greatest(-x["nq"] - 25, F.lit(-1.0))), F.lit(0.0), lambda a, x: a + x)
    return nested(spark, sf_dir).select("l_orderkey", F.size(c).cast("long").alias("n"), r6(clipped, "clipped"), F.size(F.filter(c, lambda x: x["d"] > 0.05)).cast("long").alias("kept"), F.get(c, F.lit(0))["p"].alias("first"))


@query("nested_flag_filter", f"WITH g AS ({NESTED_SQL}) SELECT l_orderkey, len(list_filter(c, lambda x: x.f = 'A' AND x.q > 10)) AS prompt, len(list_filter(c, lambda x: x.f = 'R')) > 0 AS matched FROM g")
def nested_flag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("l_orderkey", F.size(F.filter("c", lambda x: (x["f"] == "A") & (x["nq"] < -10))).cast("long").alias("prompt"), F.exists("c", lambda x: x["f"] == "R").alias("matched"))


@query("event_selectors", f"WITH g AS ({NESTED_SQL}) SELECT l_orderkey, c[1].p AS best, len(list_filter(c[2:], lambda x: x.q > 40)) > 0 AS veto FROM g WHERE len(c) >= 2 AND c[1].q > 30")
def event_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("c", F.lit(0))
    others = F.slice("c", 2, F.greatest(F.size("c"), F.lit(1)))
    return nested(spark, sf_dir).where((F.size("c") >= 2) & (first["nq"] < -30)).select("l_orderkey", first["p"].alias("best"), F.exists(others, lambda x: x["nq"] < -40).alias("veto"))


@query("array_sum_by_category", "SELECT l_orderkey, round(sum(l_quantity), 4) AS ht, round(sum(l_quantity) FILTER (l_returnflag = 'N'), 4) AS visible, count(*) FILTER (l_returnflag <> 'N') AS others FROM lineitem GROUP BY 1")
def array_sum_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s - x["nq"])
    n = F.filter("c", lambda x: x["f"] == "N")
    return nested(spark, sf_dir).select("l_orderkey", F.round(total(F.col("c")), 4).alias("ht"), F.when(F.size(n) > 0, F.round(total(n), 4)).alias("visible"), F.size(F.filter("c", lambda x: x["f"] != "N")).cast("long").alias("others"))


@query("argmax_nested", f"WITH g AS ({NESTED_SQL}) SELECT l_orderkey, list_filter(c, lambda x: x.f IN ('A', 'R'))[1].p AS best FROM g")
def argmax_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("l_orderkey", F.get(F.filter("c", lambda x: x["f"].isin("A", "R")), F.lit(0))["p"].alias("best"))


MOTHERS = ["l_partkey % 999", "l_suppkey % 999", "l_orderkey % 999", "l_linenumber", "l_partkey % 7", "l_suppkey % 5"]


@query("mother_decode", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [({'), ('.join(MOTHERS)})]::BIGINT[] AS mothers, {' + '.join(f'(({m})::BIGINT + 1) * {1000**k}' for k, m in enumerate(MOTHERS))} AS code FROM lineitem")
def mother_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six mother indices of each line as one number, and back."""
    code = graph.encoded_mothers(F.array(*[F.expr(m).cast("long") for m in MOTHERS]))
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", code.alias("code")).withColumn("mothers", graph.decoded_mothers(F.col("code")))


@query("array_checks", "SELECT vec_id, len(embedding) = 64 AS whole, list_position(list_transform(embedding, lambda x: x > 0), true)::BIGINT AS first_positive, len(list_filter(embedding, lambda x: abs(x) > 0.2)) AS over, len(list_filter(embedding, lambda x: x <> 0)) = 0 AS padding FROM embeddings")
def array_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.size(e) == 64).alias("whole"), F.array_position(F.transform(e, lambda x: x > 0), True).alias("first_positive"), F.size(F.filter(e, lambda x: F.abs(x) > F.lit(0.2).cast("float"))).cast("long").alias("over"), tensor.has_padding(e).alias("padding"))


CELL_SQL = "(floor(abs({x}) / 0.2 + 0.5) * sign({x}))::INT + 5"


@query("tensor_cells", f"WITH p AS (SELECT *, {CELL_SQL.format(x='eta')} AS ce, {CELL_SQL.format(x='phi')} AS cp FROM ({POINT_SQL})) SELECT event, (ce * 11 + cp)::INT AS cell, vec_id, round(pt, 6) AS pt FROM (SELECT *, row_number() OVER (PARTITION BY event, ce, cp ORDER BY pt DESC, vec_id) AS k FROM p WHERE ce BETWEEN 0 AND 10 AND cp BETWEEN 0 AND 10) WHERE k = 1")
def tensor_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda x: tensor.cell_index(F.col(x), 0.2, 11)
    p = points(spark, sf_dir).withColumn("cell", tensor.flat_cell(c("eta"), c("phi"), 11)).where("cell is not null")
    return tensor.top_of_cell(p, ["event", "cell"], [F.desc("pt"), F.col("vec_id")]).select("event", "cell", "vec_id", r6("pt", "pt"))


@query("tensor_sequences", f"WITH g AS ({NESTED_SQL}) SELECT l_orderkey, list_resize(list_transform(c, lambda x: x.q)[:4], 4, 0::DOUBLE) AS q FROM g")
def tensor_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).select("l_orderkey", tensor.padded(F.transform("c", lambda x: -x["nq"]), 4).alias("q"))


@query("batch_split", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch, ('0x' || substr(md5('9|' || source), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 < 0.8 AS training FROM documents")
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return tensor.numbered_batches(d, [F.col("doc_id")], 64).select("doc_id", "batch", (numeric.uniform(9, F.col("source")) < 0.8).alias("training"))


@query("length_bucket", "WITH b AS (SELECT doc_id, least(floor(log2(greatest(n_chars, 1)))::INT, 14) AS bucket FROM documents) SELECT bucket, batch, count(*) AS n FROM (SELECT bucket, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1) // 32 AS batch FROM b) GROUP BY ALL")
def length_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "documents").select("doc_id", F.least(F.floor(F.log2(F.greatest("n_chars", F.lit(1)))).cast("int"), F.lit(14)).alias("bucket"))
    return tensor.numbered_batches(b, [F.col("doc_id")], 32, ["bucket"]).groupBy("bucket", "batch").agg(F.count("*").alias("n"))


@query("feature_concat", "SELECT vec_id, list_concat(embedding[:2], embedding[63:]) AS features, 1.0::DOUBLE AS weight FROM embeddings UNION ALL SELECT -vec_id, list_concat(embedding[3:4], embedding[:2]), 0.0 FROM embeddings")
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", F.concat(F.slice("embedding", 1, 2), F.slice("embedding", 63, 2)).alias("features"), F.lit(1.0).alias("weight"))
    return a.unionByName(e.select((-F.col("vec_id")).alias("vec_id"), F.concat(F.slice("embedding", 3, 2), F.slice("embedding", 1, 2)).alias("features"), F.lit(0.0).alias("weight")))


@query("nan_guard", "SELECT count(*) AS rows, sum(len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))))::BIGINT AS bad FROM embeddings")
def nan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.size(F.filter("embedding", lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("rows"), F.sum(bad).alias("bad"))


@query("label_arrays", "SELECT event_id, [(event_type = 'click')::DOUBLE, value, value * value] AS y FROM events WHERE event_type IN ('click', 'view') AND value > 1")
def label_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type in ('click', 'view') and value > 1").select("event_id", F.array((F.col("event_type") == "click").cast("double"), F.col("value"), F.col("value") * F.col("value")).alias("y"))


@query("decay_graph", "WITH RECURSIVE n AS (SELECT DISTINCT l_orderkey AS node, CASE WHEN l_orderkey > 3 THEN l_orderkey // 3 END AS parent FROM lineitem), t(node, last) AS (SELECT node, node FROM n WHERE parent IS NULL UNION ALL SELECT n.node, t.last FROM n JOIN t ON n.parent = t.node) SELECT last, count(*) AS n FROM t GROUP BY 1")
def decay_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = items(spark, sf_dir).select(F.col("l_orderkey").alias("node")).distinct().withColumn("parent", F.when(F.col("node") > 3, F.expr("node div 3")))
    return graph.terminal_copies(n).groupBy("last").agg(F.count("*").alias("n"))


@query("graph_collect", "WITH n AS (SELECT DISTINCT l_orderkey AS node, l_orderkey // 3 AS parent FROM lineitem) SELECT count(*) AS leaves, sum(node)::BIGINT AS total FROM n WHERE node NOT IN (SELECT parent FROM n)")
def graph_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = items(spark, sf_dir).select(F.col("l_orderkey").alias("node")).distinct().withColumn("parent", F.expr("node div 3"))
    return graph.final_state(n, []).agg(F.count("*").alias("leaves"), F.sum("node").alias("total"))


#: A tree of orders: a third of the key is the mother, where there is such an order; the code hangs on the customer.
TREE_SQL = "o AS (SELECT o_orderkey AS node, o_orderkey // 3 AS up, o_orderstatus AS kind, (o_custkey % 5 * 4 - 6)::INT AS code FROM orders), n AS (SELECT o.node, m.node AS parent, m.kind AS above, o.kind, o.code FROM o LEFT JOIN o m ON o.up = m.node AND o.node <> m.node)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.expr("o_orderkey div 3").alias("up"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 5 * 4 - 6).cast("int").alias("code"))
    above = o.select(F.col("node").alias("parent"), F.col("kind").alias("above"))
    return o.join(above, (F.col("up") == F.col("parent")) & (F.col("node") != F.col("parent")), "left").drop("up")


@query("terminal_copy_kinds", f"WITH RECURSIVE {TREE_SQL}, t(node, last) AS (SELECT node, node FROM n WHERE parent IS NULL OR above <> kind UNION ALL SELECT n.node, t.last FROM n JOIN t ON n.parent = t.node AND n.above = n.kind) SELECT node, last FROM t")
def terminal_copy_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copy of each particle: up the chain as long as the kind is its own."""
    return graph.terminal_copies(tree(spark, sf_dir).drop("above"), kind="kind")


@query(
    "final_state_daughters",
    f"""
    WITH RECURSIVE {TREE_SQL}, t(root, node) AS (SELECT node, node FROM n WHERE kind = 'F' AND above <> 'F' AND code <> 10 UNION SELECT t.root, n.node FROM t JOIN n ON n.parent = t.node WHERE n.code <> 10)
    SELECT root, count(*) AS n, sum(node)::BIGINT AS total, count(*) FILTER (code > 0) AS positive FROM t JOIN n USING (node) WHERE node NOT IN (SELECT parent FROM n WHERE parent IS NOT NULL) AND abs(code) <> 2 GROUP BY 1
    """,
)
def final_state_daughters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each first copy of one kind decays to, without one code, and without entering particles of another."""
    n = tree(spark, sf_dir)
    starts = n.where("kind = 'F' and above <> 'F'").select(F.col("node").alias("root"), "node")
    found = graph.final_daughters(starts, n.select(F.col("parent").alias("mother"), F.col("node").alias("daughter")), n, [2], n.where("code = 10"))
    return found.groupBy("root").agg(F.count("*").alias("n"), F.sum("node").alias("total"), F.count_if(F.col("code") > 0).alias("positive"))


#: Truth and score: labels.quality and the number of characters.
SCORED_SQL = "SELECT l.doc_id, lang, quality = 1 AS truth, n_chars::DOUBLE AS score, toxic FROM labels l JOIN documents d USING (doc_id)"
CURVE_SQL = "SELECT score AS threshold, sum(q) OVER w / sum(q) OVER () AS fpr, sum(p) OVER w / sum(p) OVER () AS tpr FROM (SELECT score, sum(truth::INT)::DOUBLE AS p, sum((NOT truth)::INT)::DOUBLE AS q FROM (" + SCORED_SQL + ") WHERE {test} GROUP BY 1) WINDOW w AS (ORDER BY score DESC)"
ROC_SQL = f"WITH c AS ({CURVE_SQL.format(test='true')})"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("truth", F.col("quality") == 1)


@query("roc_auc", ROC_SQL + " SELECT round(sum((fpr - coalesce(f, 0)) * (tpr + coalesce(t, 0)) / 2), 9) AS auc FROM (SELECT *, lag(fpr) OVER (ORDER BY threshold DESC) AS f, lag(tpr) OVER (ORDER BY threshold DESC) AS t FROM c)")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(metrics.roc(scored(spark, sf_dir), [], "score", F.col("truth")), []).select(F.round("auc", 9).alias("auc"))


@query("curve_bins_prune", ROC_SQL + " SELECT threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM c QUALIFY row_number() OVER (PARTITION BY round(tpr, 1) ORDER BY threshold DESC) = 1")
def curve_bins_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pruned(metrics.roc(scored(spark, sf_dir), [], "score", F.col("truth")), [], 1).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("nearest_threshold", ROC_SQL + " SELECT (SELECT max(threshold) FROM c WHERE tpr >= 0.8) AS at_least, (SELECT threshold FROM c ORDER BY abs(tpr - 0.5), threshold LIMIT 1) AS nearest")
def nearest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = metrics.roc(scored(spark, sf_dir), [], "score", F.col("truth"))
    near = F.min(F.struct(F.abs(F.col("tpr") - 0.5), F.col("threshold").alias("threshold")))
    return c.agg(F.max(F.when(F.col("tpr") >= 0.8, F.col("threshold"))).alias("at_least"), near["threshold"].alias("nearest"))


@query("nearest_within", ROC_SQL + " SELECT x AS target, (SELECT CASE WHEN abs(tpr - x) <= 0.01 THEN threshold END FROM c ORDER BY abs(tpr - x), threshold LIMIT 1) AS threshold FROM (SELECT unnest([0.25, 0.5, 0.9]::DOUBLE[]) AS x)")
def nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold nearest to an efficiency, where one is near enough."""
    c = metrics.roc(scored(spark, sf_dir), [], "score", F.col("truth"))
    found = [metrics.nearest_to(c, x).select(F.lit(x).alias("target"), "threshold") for x in (0.25, 0.5, 0.9)]
    return found[0].unionAll(found[1]).unionAll(found[2])


THRESHOLDS = [500.0, 1500.0, 3000.0]


@query("pass_counts", f"SELECT lang, t AS threshold, count(*) FILTER (score > t) AS passed, count(*) AS total FROM ({SCORED_SQL}), (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) GROUP BY ALL")
def pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pass_counts(scored(spark, sf_dir), ["lang"], "score", THRESHOLDS)


def interval_sql(counts: str, keys: str) -> str:
    """Exact intervals of rows (keys, passed, total) by bisection of binomial sums."""
    term = "exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) + i * ln((lo + hi) / 2) + (total - i) * ln(1 - (lo + hi) / 2))"
    tail = f"CASE WHEN upper THEN list_sum([{term} for i in range(0, passed + 1)]) > 0.1586555 ELSE list_sum([{term} for i in range(passed, total + 1)]) < 0.1586555 END"
    return f"""
    WITH RECURSIVE c AS ({counts}), b AS (SELECT *, 0 AS it, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM c, (SELECT unnest([false, true]) AS upper) UNION ALL
      SELECT {keys}, passed, total, upper, it + 1, CASE WHEN {tail} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {tail} THEN hi ELSE (lo + hi) / 2 END FROM b WHERE it < 50),
    e AS (SELECT * FROM b WHERE it = 50)
    SELECT {", ".join(f"c.{k.strip()}" for k in keys.split(","))}, c.passed, c.total, round(c.passed / c.total, 6) AS efficiency, CASE WHEN c.passed = 0 THEN 0 ELSE round(l.lo, 6) END AS low, CASE WHEN c.passed = c.total THEN 1 ELSE round(h.lo, 6) END AS high
    FROM c JOIN e l ON NOT l.upper AND {" AND ".join(f"l.{k.strip()} = c.{k.strip()}" for k in keys.split(","))} JOIN e h ON h.upper AND {" AND ".join(f"h.{k.strip()} = c.{k.strip()}" for k in keys.split(","))}
    """


@query("working_points", interval_sql(f"SELECT truth, t AS threshold, count(*) FILTER (score > t) AS passed, count(*) AS total FROM ({SCORED_SQL}), (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS t) GROUP BY ALL", "truth, threshold"))
def working_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.with_interval(metrics.pass_counts(scored(spark, sf_dir), ["truth"], "score", THRESHOLDS))
    return found.select("truth", "threshold", "passed", "total", *[r6(c, c) for c in ("efficiency", "low", "high")])


@query("diff_efficiency", interval_sql("SELECT k, count(*) FILTER (quality = 1) AS passed, count(*) AS total FROM (SELECT quality, (n_chars > 500)::INT + (n_chars > 2000)::INT + (n_chars > 8000)::INT AS k FROM labels JOIN documents USING (doc_id)) GROUP BY 1", "k"))
def diff_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = sum(((F.col("score") > e).cast("int") for e in (500.0, 2000.0, 8000.0)), F.lit(0))
    c = scored(spark, sf_dir).groupBy(k.alias("k")).agg(F.count_if("truth").alias("passed"), F.count("*").alias("total"))
    return metrics.with_interval(c).select("k", "passed", "total", *[r6(x, x) for x in ("efficiency", "low", "high")])


@query("clopper_pearson", interval_sql("SELECT l_linenumber AS k, count(*) FILTER (l_discount > 0.05) AS passed, count(*) AS total FROM lineitem GROUP BY 1", "k"))
def clopper_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = items(spark, sf_dir).groupBy(F.col("l_linenumber").alias("k")).agg(F.count_if(F.col("l_discount") > 0.05).alias("passed"), F.count("*").alias("total"))
    return metrics.with_interval(counts).select("k", "passed", "total", *[r6(c, c) for c in ("efficiency", "low", "high")])


@query(
    "threshold_iter",
    f"""
    WITH RECURSIVE p AS (SELECT eta AS vs_jet, phi AS vs_e FROM ({POINT_SQL}) WHERE label < 5),
    t(i, jet, e) AS (SELECT 0, '-inf'::DOUBLE, '-inf'::DOUBLE UNION ALL
      SELECT i + 1, (SELECT min(x) FROM (SELECT vs_jet AS x, row_number() OVER (ORDER BY vs_jet) AS k, count(*) OVER () AS n FROM p WHERE vs_e > t.e) WHERE k >= (1 - 0.8) * n), (SELECT min(x) FROM (SELECT vs_e AS x, row_number() OVER (ORDER BY vs_e) AS k, count(*) OVER () AS n FROM p WHERE vs_jet > t.jet) WHERE k >= (1 - 0.9) * n) FROM t WHERE i < 30)
    SELECT 'vs_jet' AS name, jet AS threshold FROM t WHERE i = 30 UNION ALL SELECT 'vs_e', e FROM t WHERE i = 30
    """,
)
def threshold_iter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir).select("label", F.col("eta").alias("vs_jet"), F.col("phi").alias("vs_e"))
    found = metrics.converged_thresholds(rows, ["vs_jet", "vs_e"], "label < 5", {"vs_jet": 0.8, "vs_e": 0.9})
    return spark.createDataFrame(list(found.items()), "name string, threshold double")


@query(
    "roc_ratio",
    f"""
    WITH a AS (SELECT tpr AS x, min(fpr) AS y FROM ({CURVE_SQL.format(test="toxic = 0")}) GROUP BY 1), b AS (SELECT tpr AS x, min(fpr) AS y FROM ({CURVE_SQL.format(test="true")}) GROUP BY 1),
    j AS (SELECT a.x, a.y, max(b.x) FILTER (b.x <= a.x) AS lx, min(b.x) FILTER (b.x >= a.x) AS rx FROM a, b GROUP BY ALL),
    v AS (SELECT j.x, j.y AS ya, l.y + CASE WHEN rx > lx THEN (r.y - l.y) / (rx - lx) * (j.x - lx) ELSE 0 END AS yb FROM j JOIN b l ON l.x = lx JOIN b r ON r.x = rx)
    SELECT round(x, 6) AS tpr, round(ya / yb, 6) AS ratio FROM v WHERE yb > 0
    """,
)
def roc_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    one = lambda df: metrics.roc(df, [], "score", F.col("truth")).groupBy("tpr").agg(F.min("fpr").alias("fpr"))
    both = metrics.at_common_points(one(s.where("toxic = 0")), one(s), "tpr", "fpr").where("yb > 0")
    return both.select(F.round("x", 6).alias("tpr"), F.round(F.col("ya") / F.col("yb"), 6).alias("ratio"))


@query("confusion_matrix", f"SELECT CASE t WHEN 4 THEN 3 ELSE t END AS truth, CASE p WHEN 4 THEN 3 ELSE p END AS predicted, count(*) AS n FROM (SELECT (n_chars % 5)::INT AS t, (doc_id % 5)::INT AS p FROM labels JOIN documents USING (doc_id)) GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = lambda c: F.when(c == 4, 3).otherwise(c.cast("int"))
    return scored(spark, sf_dir).groupBy(fold(F.col("score").cast("long") % 5).alias("truth"), fold(F.col("doc_id") % 5).alias("predicted")).agg(F.count("*").alias("n"))


@query("score_compare", "SELECT doc_id, abs(n_chars - length(text))::BIGINT AS delta FROM documents ORDER BY delta DESC, doc_id LIMIT 30")
def score_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.abs(F.col("n_chars") - F.length("text")).alias("delta")).orderBy(F.desc("delta"), "doc_id").limit(30)


P_SQL = "least(greatest(1 / (1 + exp(-(n_chars - 1500) / 1000.0)), 1e-7), 1 - 1e-7)"


@query("loss_rows", f"SELECT round(avg(-(quality * ln({P_SQL}) + (1 - quality) * ln(1 - {P_SQL}))), 6) AS log_loss, round(avg(((quality = 1) = ({P_SQL} > 0.5))::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id)")
def loss_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = 1 / (1 + F.exp(-(F.col("score") - 1500) / 1000.0))
    s = scored(spark, sf_dir)
    return s.agg(F.round(F.avg(numeric.log_loss(F.col("quality"), p)), 6).alias("log_loss"), F.round(F.avg((F.col("truth") == (p > 0.5)).cast("int")), 6).alias("accuracy"))


#: erfc(x) as a series; under 1e-6 beyond 3.5 on either side.
ERFC_SQL = "CASE WHEN {x} > 3.5 THEN 0.0 WHEN {x} < -3.5 THEN 2.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(80), lambda n: (-1) ^ n * {x} ^ (2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))) END"
#: A peak: centre, width, alpha, power and norm.
PEAK = (40.0, 2.0, 1.5, 3.0, 1.0)
EDGE = PEAK[2] / PEAK[1]
TAIL = math.exp(-EDGE * EDGE / 2) * PEAK[3] / (EDGE * (PEAK[3] - 1))


@query(
    "crystal_ball",
    f"""
    WITH v AS (SELECT o_orderkey, 1 + o_totalprice / 4000 AS m FROM orders), z AS (SELECT *, (m - {PEAK[0]}) / {PEAK[1]} AS z FROM v),
    c AS (SELECT *, sqrt(pi() / 2) * ({ERFC_SQL.format(x=f"(-least(z, {EDGE}) / sqrt(2))")}) AS core, {TAIL!r} * (1 - (1 + {EDGE} * greatest(z - {EDGE}, 0) / {PEAK[3]}) ^ (1 - {PEAK[3]})) AS beyond, sqrt(pi() / 2) * ({ERFC_SQL.format(x=f"(-{EDGE} / sqrt(2))")}) + {TAIL!r} AS whole FROM z)
    SELECT o_orderkey, round((core + beyond) / whole, 5) AS value FROM c
    """,
)
def crystal_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a peak up to a price in units of four thousand."""

    @F.pandas_udf("double")
    def turn_on(m: pd.Series) -> pd.Series:
        return pd.Series(crystal_ball_integral(m.to_numpy(float), *PEAK))

    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(turn_on(1 + F.col("o_totalprice") / 4000), 5).alias("value"))


def crystal_ball_integral(m: np.ndarray | float, centre: float, width: float, alpha: float, power: float, norm: float) -> np.ndarray | float:
    """Share, times norm, of a crystal-ball peak up to m, which must be from 1 to 1000. In units of its width the density
    is exp(-z^2 / 2) up to the edge |alpha / width| and falls as a power from there, with value and slope continued; a
    negative alpha mirrors it."""
    if np.any((np.asarray(m) < 1) | (np.asarray(m) > 1000)):
        raise ValueError(f"{m} is out of the range 1 to 1000")
    z = math.copysign(1.0, alpha) * (np.asarray(m, float) - centre) / abs(width)
    edge = abs(alpha / width)
    whole_tail = math.exp(-edge * edge / 2) * power / (edge * (power - 1))
    core = math.sqrt(math.pi / 2) * ERFC(-np.minimum(z, edge) / math.sqrt(2))
    beyond = 1 - (1 + edge * np.maximum(z - edge, 0.0) / power) ** (1 - power)
    whole = math.sqrt(math.pi / 2) * math.erfc(-edge / math.sqrt(2)) + whole_tail
    found = norm * (core + whole_tail * beyond) / whole
    return found if np.ndim(m) else float(found)


ERFC = np.vectorize(math.erfc, otypes=[float])
