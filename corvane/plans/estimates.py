"""Queries on information, derivatives, distances of distributions, candidate pools, decays, group scans and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import geometry as geo
from corvane.functions import numeric
from corvane.operators import density, graph, hist, match, metrics, order, sample, stats, tensor
from corvane.operators.hist import Axis
from corvane.plans.histograms import bin_sql
from corvane.plans.nested import DPHI_SQL, POINT_SQL, ROC_SQL, SCORED_SQL, points, r6, scored
from corvane.queries import query, table
from corvane.sources import io


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


HX, HY = 2.5, 0.01
NORMAL_SQL = "sum(s.n * exp(-0.5 * ((p.{a} - s.{a}) / {h}) ^ 2)) / ({h} * sqrt(2 * pi()) * sum(s.n))"


@query(
    "mutual_information",
    f"""
    WITH c AS (SELECT l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), r AS (SELECT corr(l_quantity, l_discount) AS r FROM lineitem),
    a AS (SELECT p.x, {NORMAL_SQL.format(a="x", h=HX)} AS px FROM (SELECT DISTINCT x FROM c) p, c s GROUP BY 1), b AS (SELECT p.y, {NORMAL_SQL.format(a="y", h=HY)} AS py FROM (SELECT DISTINCT y FROM c) p, c s GROUP BY 1),
    d AS (SELECT p.x, p.y, p.n, sum(s.n * exp(-(((p.x - s.x) / {HX}) ^ 2 - 2 * r * ((p.x - s.x) / {HX}) * ((p.y - s.y) / {HY}) + ((p.y - s.y) / {HY}) ^ 2) / (2 * (1 - r * r)))) / (2 * pi() * {HX} * {HY} * sqrt(1 - any_value(r) * any_value(r)) * sum(s.n)) AS pxy FROM c p, c s, r GROUP BY ALL),
    e AS (SELECT sum(-n * log2(px)) / sum(n) AS ex, sum(-n * log2(py)) / sum(n) AS ey, sum(n * log2(pxy / (px * py))) / sum(n) AS mi FROM d JOIN a USING (x) JOIN b USING (y))
    SELECT round(ex, 6) AS entropy_x, round(ey, 6) AS entropy_y, round(mi, 6) AS mutual, round(1 - mi / greatest(ex, ey), 6) AS scaled_mi FROM e
    """,
)
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.information(items(spark, sf_dir), "l_quantity", "l_discount", (HX, HY))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    "kde_divergence_2d",
    f"""
    WITH c AS (SELECT l_returnflag AS f, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, count(*)::DOUBLE AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL),
    d AS (SELECT p.x, p.y, p.n, {", ".join(f"sum(s.n * exp(-0.5 * (((p.x - s.x) / {HX}) ^ 2 + ((p.y - s.y) / {HY}) ^ 2))) FILTER (s.f = '{f}') / sum(s.n) FILTER (s.f = '{f}') AS {k}" for f, k in (("A", "p"), ("R", "q")))} FROM c p, c s WHERE p.f = 'A' GROUP BY ALL)
    SELECT round(sum(n * log2(p / q)) / sum(n), 9) AS kl, round(sum(n * log2(p / ((p + q) / 2))) / sum(n), 9) AS js_half FROM d
    """,
)
def kde_divergence_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    a, r = rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")
    at = density.kde_2d(a, a.groupBy("x", "y").agg(F.count("*").alias("n")), "x", "y", (HX, HY)).withColumnRenamed("density", "p")
    at = density.kde_2d(r, at, "x", "y", (HX, HY)).withColumnRenamed("density", "q")
    mean = lambda e: F.round(F.sum(F.col("n") * e) / F.sum("n"), 9)
    return at.agg(mean(F.log2(F.col("p") / F.col("q"))).alias("kl"), mean(F.log2(F.col("p") / ((F.col("p") + F.col("q")) / 2))).alias("js_half"))


@query(
    "curve_derivative",
    "WITH RECURSIVE curve AS (SELECT tpr AS x, fpr AS y, row_number() OVER (ORDER BY tpr, fpr) - 1 AS n FROM ("
    + ROC_SQL
    + """ SELECT * FROM c)), step AS (SELECT a.n, min(b.n) AS m FROM curve a JOIN curve b ON b.n >= a.n + 3 AND b.y <> a.y GROUP BY 1),
    chain(n) AS (SELECT 0::BIGINT UNION ALL SELECT m FROM chain JOIN step USING (n))
    SELECT round((a.x + b.x) / 2, 9) AS x, CASE WHEN b.x <> a.x THEN round((b.y - a.y) / (b.x - a.x), 6) END AS slope FROM chain JOIN step USING (n) JOIN curve a USING (n) JOIN curve b ON b.n = m
    """,
)
def curve_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.roc(scored(spark, sf_dir), [], "score", F.col("truth"))
    return metrics.derivative(curve, "tpr", "fpr", 3).select(F.round("x", 9).alias("x"), r6("slope", "slope"))


VALUE = Axis(0.0, 100.0, 10)


def kolmogorov_chance(x: Column) -> Column:
    """Chance of a larger scaled distance."""
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, j: a - F.pow(F.lit(-1.0), j) * F.exp(-2 * j * j * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), 2 * terms))


@query(
    "chunk_ks",
    f"""
    WITH r AS (SELECT floor((row_number() OVER (ORDER BY event_id) - 1) * 10 / count(*) OVER ())::INT AS chunk, {bin_sql("value", VALUE)} AS k FROM events),
    g AS (SELECT chunk, k, count(r2.k)::DOUBLE AS n FROM (SELECT DISTINCT chunk FROM r) CROSS JOIN (SELECT unnest(range(0, 12))::INT AS k) LEFT JOIN (SELECT chunk, k FROM r) r2 USING (chunk, k) GROUP BY 1, 2),
    f AS (SELECT chunk, k, sum(n) OVER (PARTITION BY chunk ORDER BY k) / sum(n) OVER (PARTITION BY chunk) AS f, sum(n) OVER (PARTITION BY chunk) AS t FROM g),
    d AS (SELECT b.chunk, max(abs(b.f - a.f)) AS d, any_value(sqrt(a.t * b.t / (a.t + b.t))) AS s FROM f a JOIN f b USING (k) WHERE a.chunk = 0 AND b.chunk > 0 GROUP BY 1)
    SELECT chunk, round(d, 9) AS distance, round(CASE WHEN d * s < 0.2 THEN 1 ELSE least(1, 2 * list_sum([(-1) ^ (j - 1) * exp(-2 * j * j * (d * s) ^ 2) for j in range(1, 101)])) END, 6) AS p FROM d
    """,
)
def chunk_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov distance of each chunk's histogram to the first one's."""
    r = order.tiles(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("event_id")], 10, "chunk")
    h = hist.fill(r, ["chunk"], {"k": (F.col("value"), VALUE)})
    grid = h.select("chunk").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VALUE.bins + 1))))
    w = Window.partitionBy("chunk")  # of the bins of one histogram
    n = F.coalesce("n", F.lit(0))
    f = grid.join(h, ["chunk", "k"], "left").select("chunk", "k", (F.sum(n).over(w.orderBy("k")) / F.sum(n).over(w)).alias("f"), F.sum(n).over(w).alias("t"))
    a = f.where("chunk = 0").select("k", F.col("f").alias("fa"), F.col("t").alias("ta"))
    d = f.where("chunk > 0").join(F.broadcast(a), "k").groupBy("chunk").agg(F.max(F.abs(F.col("f") - F.col("fa"))).alias("d"), F.max(F.sqrt(F.col("ta") * F.col("t") / (F.col("ta") + F.col("t")))).alias("s"))
    return d.select("chunk", F.round("d", 9).alias("distance"), r6(kolmogorov_chance(F.col("d") * F.col("s")), "p"))


@query("hist3d_chunks", f"SELECT floor((row_number() OVER (ORDER BY event_id) - 1) * 10 / count(*) OVER ())::INT AS chunk, {bin_sql('value', VALUE)} AS k, (hour(ts) // 6)::INT AS third, event_id FROM events".join(("SELECT chunk, k, third, count(*) AS n FROM (", ") GROUP BY ALL")))
def hist3d_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = order.tiles(table(spark, sf_dir, "events").select("event_id", "value", "ts"), [F.col("event_id")], 10, "chunk")
    return r.groupBy("chunk", VALUE.bin(F.col("value")).alias("k"), F.floor(F.hour("ts") / 6).cast("int").alias("third")).agg(F.count("*").alias("n"))


@query(
    "hist_blinded",
    f"SELECT k, CASE WHEN blind THEN NULL ELSE n END AS n, blind FROM (SELECT {bin_sql('l_quantity', Axis(0.0, 50.0, 10))} AS k, count(*) AS n, k BETWEEN 4 AND 5 OR k = 8 AS blind FROM lineitem GROUP BY 1)",
)
def hist_blinded(spark: SparkSession, sf_dir: str) -> DataFrame:
    axis = Axis(0.0, 50.0, 10)
    h = hist.fill(items(spark, sf_dir), [], {"k": (F.col("l_quantity"), axis)})
    return hist.blinded(h, "k", axis, [numeric.Interval(16.0, 21.0), numeric.Interval(35.0, 40.0)]).select("k", "n", "blind")


@query("hist_scaled", "SELECT l_returnflag, round(sum(l_tax) * 1.2, 6) AS sumw, round(sqrt(sum(l_tax * l_tax) * 1.44 + (sum(l_tax) * 1.2 * 0.05) ^ 2), 6) AS error FROM lineitem GROUP BY 1")
def hist_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = items(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_tax").alias("sumw"), F.sum(F.col("l_tax") * F.col("l_tax")).alias("sumw2"))
    return hist.scaled(h, 1.2, 0.05).select("l_returnflag", r6("sumw", "sumw"), r6(F.sqrt("sumw2"), "error"))


def dr(a: str, b: str) -> str:
    dphi = DPHI_SQL.format(d=f"({a}.phi - {b}.phi)")
    return f"sqrt(({a}.eta - {b}.eta) ^ 2 + ({dphi}) ^ 2)"


@query(
    "candidate_pool",
    f"""
    WITH p AS ({POINT_SQL}), l AS (SELECT * FROM p WHERE label < 2), j AS (SELECT * FROM p WHERE label BETWEEN 2 AND 4), t AS (SELECT * FROM p WHERE label > 4),
    m1 AS (SELECT l.vec_id AS l, j.vec_id AS j FROM l JOIN j USING (event) WHERE {dr("l", "j")} < 0.6 QUALIFY row_number() OVER (PARTITION BY l.vec_id ORDER BY {dr("l", "j")}, j.vec_id) = 1),
    c1 AS (SELECT event, l.vec_id AS l, m1.j FROM l LEFT JOIN m1 ON l.vec_id = m1.l UNION ALL SELECT event, NULL, vec_id FROM j WHERE vec_id NOT IN (SELECT j FROM m1)),
    d AS (SELECT c1.l, c1.j, t.vec_id AS t, CASE WHEN {dr("l", "t")} < 0.3 THEN {dr("l", "t")} END AS d1, CASE WHEN {dr("j", "t")} < 0.5 THEN {dr("j", "t")} END AS d2
      FROM c1 JOIN t ON c1.event = t.event LEFT JOIN l ON l.vec_id = c1.l LEFT JOIN j ON j.vec_id = c1.j),
    m2 AS (SELECT * FROM d WHERE d1 IS NOT NULL OR d2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l, j ORDER BY d1 NULLS LAST, d2 NULLS LAST, t) = 1)
    SELECT event, c1.l AS lepton_idx, c1.j AS jet_idx, t AS tau_idx FROM c1 LEFT JOIN m2 ON c1.l IS NOT DISTINCT FROM m2.l AND c1.j IS NOT DISTINCT FROM m2.j
    UNION ALL SELECT event, NULL, NULL, vec_id FROM t WHERE vec_id NOT IN (SELECT t FROM m2)
    """,
)
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("event", F.col("vec_id").alias("idx"), "eta", "phi", "label")
    part = lambda test: p.where(test).drop("label")
    pool = match.candidate_pool([("lepton", part("label < 2"), {}), ("jet", part("label between 2 and 4"), {"lepton": 0.6}), ("tau", part("label > 4"), {"lepton": 0.3, "jet": 0.5})], ["event"])
    return pool.select("event", "lepton_idx", "jet_idx", "tau_idx")


#: Particle codes that lines stand for.
CODES = [11, -12, 211, 111, 22, -13, 14, 321]
PDG_SQL = "CASE l_partkey % 8 " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(CODES)) + " END"
P4 = {"px": "l_quantity", "py": "l_extendedprice / 1000", "pz": "l_tax * 100", "e": "l_discount * 1000"}
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query(
    "lepton_decays",
    f"""
    WITH RECURSIVE raw AS (SELECT l_orderkey AS ev, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) - 1 AS idx, {PDG_SQL} AS code, l_suppkey, {", ".join(f"{e} AS {n}" for n, e in P4.items())} FROM lineitem),
    p AS (SELECT *, CASE WHEN idx > 0 THEN (idx - 1) // 2 END AS mother, abs(CASE WHEN idx = 0 OR idx = 1 AND ev % 2 = 0 THEN 11 + 2 * (ev % 3) ELSE code END) AS pdg, NOT (idx = 0 AND ev % 2 = 0 AND count(*) OVER (PARTITION BY ev) > 1) AS last FROM raw),
    walk(ev, node, root, decayed) AS (SELECT ev, idx, pdg, last FROM p WHERE idx = 0 UNION ALL SELECT w.ev, c.idx, w.root, w.decayed OR (c.pdg = w.root AND c.last) FROM walk w JOIN p c ON c.ev = w.ev AND c.mother = w.node),
    d AS (SELECT a.ev, a.idx, count(b.idx) AS n, count(*) FILTER (b.pdg IS NOT NULL AND b.pdg NOT IN (11, 12, 13, 14, 15, 16, 22)) AS hard FROM p a LEFT JOIN p b ON b.ev = a.ev AND b.mother = a.idx GROUP BY ALL),
    f AS (SELECT w.*, p.pdg, p.px, p.e, d.n = 0 AS final, d.hard FROM walk w JOIN p ON p.ev = w.ev AND p.idx = w.node JOIN d ON d.ev = w.ev AND d.idx = w.node WHERE p.last OR d.n > 0),
    g AS (SELECT ev, any_value(root) AS root, count(*) FILTER (final AND decayed AND pdg IN (12, 14, 16)) AS n_neutrinos, count(*) FILTER (final AND decayed AND pdg = 11) AS n_electrons, count(*) FILTER (final AND decayed AND pdg = 13) AS n_muons,
      count(*) FILTER (decayed AND pdg IN (211, 321) AND hard = 0) AS n_charged, count(*) FILTER (decayed AND pdg = 111 AND hard = 0) AS n_neutral,
      round(coalesce(sum(px) FILTER (final AND decayed AND pdg NOT IN (12, 14, 16)), 0), 4) AS visible_px, round(coalesce(sum(e) FILTER (final AND decayed AND pdg NOT IN (12, 14, 16)), 0), 4) AS visible_e, round(coalesce(sum(px) FILTER (final AND NOT decayed), 0), 4) AS radiated_px FROM f GROUP BY 1)
    SELECT * EXCLUDE (root), CASE root WHEN 11 THEN 1 WHEN 13 THEN 2 ELSE CASE WHEN n_electrons > 0 THEN 3 WHEN n_muons > 0 THEN 4 WHEN n_charged + n_neutral > 0 THEN 5 ELSE 6 END END AS kind FROM g
    """,
)
def lepton_decays(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")  # one order is one event
    raw = items(spark, sf_dir).select(F.col("l_orderkey").alias("ev"), (F.row_number().over(w.orderBy(*LINE_ORDER)) - 1).alias("idx"), F.count("*").over(w).alias("n"), F.expr(PDG_SQL).alias("code"), *[F.expr(e).alias(n) for n, e in P4.items()])
    copied = F.col("ev") % 2 == 0
    pdg = F.when((F.col("idx") == 0) | ((F.col("idx") == 1) & copied), 11 + 2 * (F.col("ev") % 3)).otherwise(F.col("code")).cast("int")
    particles = raw.select("ev", "idx", F.when(F.col("idx") > 0, F.expr("(idx - 1) div 2").cast("int")).alias("mother"), pdg.alias("pdg"), F.lit(True).alias("prompt"), (F.col("idx") == 0).alias("first"), (~((F.col("idx") == 0) & copied & (F.col("n") > 1))).alias("last"), *P4)
    found = graph.lepton_decays(particles, ["ev"])
    return found.select("ev", "kind", "n_neutrinos", "n_electrons", "n_muons", "n_charged", "n_neutral", *[F.round(c, 4).alias(c) for c in ("visible_px", "visible_e", "radiated_px")])


@query("pile_up", "SELECT l_orderkey, coalesce(min(l_partkey) FILTER (l_linenumber = 3), -3.4028234663852886e38)::DOUBLE AS interactions FROM lineitem GROUP BY 1")
def pile_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.struct((F.col("l_linenumber") - 3).alias("crossing"), F.col("l_partkey").alias("interactions"))
    g = items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(info)).alias("infos"))
    return g.select("l_orderkey", graph.pile_up(F.col("infos")).alias("interactions"))


@query(
    "group_scan",
    """
    SELECT o_orderkey, dataset_id, 77 AS dataset_group_id, o_orderstatus AS kind FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS entry FROM orders)
    JOIN (VALUES ('1-URGENT', 0, 11), ('3-MEDIUM', 1, 12), ('5-LOW', 2, 13)) AS f(o_orderpriority, pos, dataset_id) USING (o_orderpriority)
    WHERE (pos > 0 OR entry >= 100) AND (pos < 2 OR entry <= 200) AND o_orderstatus IN ('F', 'O')
    """,
)
def group_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities stand for the files of a group."""
    files = spark.createDataFrame([("1-URGENT", 0, 11), ("3-MEDIUM", 1, 12), ("5-LOW", 2, 13)], "o_orderpriority string, position int, dataset_id int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    found = io.group_scan(o, files, "o_orderpriority", [F.col("o_orderkey")], (0, 100), (2, 200), 77, F.col("o_orderstatus"), ["F", "O"])
    return found.select("o_orderkey", "dataset_id", "dataset_group_id", "kind")


@query("flat_tables", "SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS place, l_partkey, floor(l_extendedprice / s + 0.5) * s AS price FROM (SELECT *, 2 ^ (floor(log2(l_extendedprice)) - 6) AS s FROM lineitem)".replace("- 1 AS place", "::INT - 1 AS place"))
def flat_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    nested = items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return io.flat_tables(nested, ["l_orderkey"], {"lines": 6})["lines"].select("l_orderkey", "place", "l_partkey", "price")


@query("float_lists", "SELECT l_returnflag, '[ ' || string_agg(format('{:.4e}', m), ', ' ORDER BY l_linenumber) || ' ]' AS curve FROM (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) AS m FROM lineitem GROUP BY ALL) GROUP BY 1")
def float_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = items(spark, sf_dir).groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_extendedprice").alias("m"))
    curves = m.groupBy("l_returnflag").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "m"))).alias("c"))
    return curves.select("l_returnflag", io.float_list(F.col("c.m")).alias("curve"))


@query(
    "numeric_variants",
    f"""
    SELECT vec_id, pmod_in AS on_arc, round(f, 6) AS formula, inside, round(CASE WHEN abs(top) <= 1 THEN acos(cos(phi)) - asin(top) END, 6) AS gj, round(dz, 6) AS dz, round(first, 6) AS first, round(others, 6) AS others, round(focal, 6) AS focal FROM (
      SELECT vec_id, phi, (phi - 2.5) - 2 * pi() * floor((phi - 2.5) / (2 * pi())) <= 1.5 AS pmod_in, pt * (1 + eta / 2) - sqrt(abs(phi)) / 3 AS f, x4 BETWEEN -0.1 AND 0.2 AS inside, (1.77682 ^ 2 - eta ^ 2) / (2 * 1.77682 * (pt / 10)) AS top,
        0.3 - (0.1 * pt * cos(phi) + 0.2 * pt * sin(phi)) * (eta * 7) / (pt ^ 2 * cos(phi) ^ 2 + pt ^ 2 * sin(phi) ^ 2) AS dz, pt AS first, eta + phi AS others, -(CASE WHEN label = 1 THEN (1 - q) ^ 2 * ln(q) ELSE q ^ 2 * ln(1 - q) END) AS focal
      FROM (SELECT *, 1 / (1 + exp(-eta)) AS q FROM ({POINT_SQL})))
    """,
)
def numeric_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    eta, phi, pt = F.col("eta"), F.col("phi"), F.col("pt")
    q = 1 / (1 + F.exp(-eta))
    cluster = geo.cluster_energies(F.array(pt, eta, phi))
    return points(spark, sf_dir).select(
        "vec_id", numeric.on_circle(phi, 2.5, 4.0).alias("on_arc"), r6(numeric.formula("pt * (1 + eta / 2) - sqrt(abs(phi)) / 3", pt=pt, eta=eta, phi=phi), "formula"), numeric.Interval.around(0.05, -0.15, 0.15).contains(F.round("x4", 12)).alias("inside"),
        r6(geo.gottfried_jackson(eta, pt / 10, F.cos(phi)), "gj"), r6(geo.impact_z(F.lit(0.1), F.lit(0.2), F.lit(0.3), pt * F.cos(phi), pt * F.sin(phi), eta * 7), "dz"), r6(cluster["first"], "first"), r6(cluster["others"], "others"), r6(numeric.focal_loss((F.col("label") == 1).cast("int"), q), "focal"),
    )


WP = [0.2, 0.5, 0.8]
D_SQL = "least(greatest(n_chars / 5000.0 / (n_chars / 5000.0 + 0.4 + 1e-7), 1e-7), 1 - 1e-7)"


@query(
    "working_point_loss",
    f"""
    WITH d AS (SELECT quality AS q, lang, {D_SQL} AS d FROM labels JOIN documents USING (doc_id)), s AS (SELECT *, ({" + ".join(f"(1 - tanh(40 * (d - {p}))) / 2" for p in WP)}) / {len(WP)} AS missed, ({" + ".join(f"(1 + tanh(40 * (d - {p}))) / 2" for p in WP)}) / {len(WP)} AS passed FROM d)
    SELECT lang, round(avg(-(1 + passed) * (1 - q) * d ^ 2 * ln(1 - d) - (1 + missed) * q * (1 - d) ^ 2 * ln(d)), 6) AS loss, round(sum(d) FILTER ((q = 1) = (d > 0.5)) / sum(d), 6) AS weighted_accuracy FROM s GROUP BY 1
    """,
)
def working_point_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("q", F.col("truth").cast("double"))
    x = F.col("score") / 5000.0
    d = F.least(F.greatest(x / (x + 0.4 + 1e-7), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = numeric.working_point_loss(F.col("q"), 1 - F.col("q"), x, F.lit(0.4), WP)
    right = F.col("truth") == (F.col("d") > 0.5)
    return s.withColumns({"d": d, "loss": loss}).groupBy("lang").agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.sum(F.when(right, F.col("d"))) / F.sum("d"), 6).alias("weighted_accuracy"))


@query("tensor_compare", "SELECT vec_id, len(b)::INT AS n_bad, b[1]::INT AS first_bad FROM (SELECT vec_id, [i for i in range(0, len(embedding)) if abs(embedding[i + 1]::DOUBLE - round(embedding[i + 1]::DOUBLE * 10) / 10) > 0.045] AS b FROM embeddings)")
def tensor_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings against themselves at one decimal."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    b = F.transform("embedding", lambda x: F.round(x.cast("double") * 10) / 10)
    bad = table(spark, sf_dir, "embeddings").select("vec_id", tensor.differences(a, b, 0.045).alias("b"))
    return bad.select("vec_id", F.size("b").alias("n_bad"), F.get("b", F.lit(0)).cast("int").alias("first_bad"))


@query("even_shares", "WITH f AS (SELECT DISTINCT o_orderstatus AS kind, o_orderpriority AS file FROM orders) SELECT kind, file, 1 / (count(*) OVER (PARTITION BY kind) * (SELECT count(DISTINCT kind) FROM f)) AS share FROM f")
def even_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("file")).distinct()
    return sample.even_shares(f, "kind").select("kind", "file", "share")


@query(
    "score_checks",
    """
    SELECT l_returnflag, round(avg((abs(l_discount - l_tax) < 0.0205)::INT), 9) AS close, round(max(abs(l_discount - l_tax)), 6) AS largest, avg((l_quantity <= 5 OR l_quantity >= 45)::INT) > 0.1 AS clamped, round(avg(CASE WHEN l_linenumber IN (5, 6) THEN -10 ELSE l_tax END), 6) AS substituted,
      count(*) FILTER (l_tax < 0.01) AS invalid, min(l_discount) >= 0 AND max(l_discount) <= 1 AS in_range FROM lineitem GROUP BY 1
    """,
)
def score_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("l_discount") - F.col("l_tax"))
    share = lambda test: F.avg(test.cast("int"))
    edge = (F.col("l_quantity") <= 5) | (F.col("l_quantity") >= 45)
    return items(spark, sf_dir).groupBy("l_returnflag").agg(
        F.round(share(gap < 0.0205), 9).alias("close"), F.round(F.max(gap), 6).alias("largest"), (share(edge) > 0.1).alias("clamped"), F.round(F.avg(F.when(F.col("l_linenumber").isin(5, 6), -10.0).otherwise(F.col("l_tax"))), 6).alias("substituted"),
        F.count_if(F.col("l_tax") < 0.01).alias("invalid"), ((F.min("l_discount") >= 0) & (F.max("l_discount") <= 1)).alias("in_range"),
    )


@query("weighted_pass_counts", f"SELECT lang, t AS threshold, round(coalesce(sum(1 + toxic) FILTER (score > t), 0), 6) AS passed, round(sum(1 + toxic)::DOUBLE, 6) AS total FROM ({SCORED_SQL}), (SELECT unnest([500, 1500, 3000]::DOUBLE[]) AS t) GROUP BY ALL".replace("coalesce(sum(1 + toxic) FILTER (score > t), 0)", "coalesce(sum(1 + toxic) FILTER (score > t), 0)::DOUBLE"))
def weighted_pass_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.array(*map(F.lit, (500.0, 1500.0, 3000.0)))).alias("threshold")
    w = 1.0 + F.col("toxic")
    s = scored(spark, sf_dir).select("lang", "score", w.alias("w"), at)
    return s.groupBy("lang", "threshold").agg(r6(F.sum(F.when(F.col("score") > F.col("threshold"), F.col("w")).otherwise(0.0)), "passed"), r6(F.sum("w"), "total"))
