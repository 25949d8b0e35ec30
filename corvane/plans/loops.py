"""Queries on the mixing loop with its stop rule, and on pairs of one row's particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.numeric import uniform
from corvane.operators import hist, match, sample
from corvane.plans.histograms import ACCEPT_SQL, KEY, X, Y, axes, bin_sql, counted, items, u_sql
from corvane.queries import query, table

#: Sources are line status and line number, types are return flags with their chances of being kept.
SOURCE_SQL, CHANCES = "l_linestatus || l_linenumber::VARCHAR", {"A": 0.5, "R": 0.8, "N": 1.0}
LOOP_SQL = f"""
    r AS (SELECT *, {SOURCE_SQL} AS source, {bin_sql("l_discount", X)} AS ix, {bin_sql("l_quantity", Y)} AS iy, {u_sql(33, *KEY)} AS u, {u_sql(34, *KEY)} AS v,
      row_number() OVER (PARTITION BY {SOURCE_SQL} ORDER BY {u_sql(32, *KEY)}, {", ".join(KEY)}) - 1 AS turn FROM lineitem),
    s AS (SELECT source, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM s),
    b AS (SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / total AS lower, (sum(n) OVER (ORDER BY source))::DOUBLE / total AS upper FROM s, t),
    q AS (SELECT step, {u_sql(31, "step")} AS w FROM (SELECT unnest(range(total + 1)) AS step FROM t)),
    d AS (SELECT step, source, n, row_number() OVER (PARTITION BY source ORDER BY step) - 1 AS turn FROM q JOIN b ON w >= lower AND w < upper),
    e AS (SELECT min(step) AS stop FROM d WHERE turn = n),
    taken AS (SELECT step, r.* FROM d JOIN r USING (source, turn), e WHERE step < stop)"""
TYPE_SQL = "CASE l_returnflag " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CHANCES.items()) + " END"


def loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the loop takes, and whether type and spectrum accept each."""
    rows = items(spark, sf_dir).select(*KEY, "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    key = [F.col(k) for k in KEY]
    taken = sample.mixed(rows, F.concat("l_linestatus", F.col("l_linenumber").cast("string")), key, 31)
    spectrum = hist.acceptance(counted(spark, sf_dir), ["l_returnflag"])
    found = hist.look_up(taken, F.broadcast(spectrum), ["l_returnflag"], axes(), "probability", 0.0)
    of_type = F.try_element_at(F.create_map(*[F.lit(x) for pair in CHANCES.items() for x in pair]), F.col("l_returnflag"))
    return found.withColumn("accepted", (uniform(33, *key) < of_type) & (uniform(34, *key) <= F.col("probability")))


@query("mixing_loop", f"WITH a AS ({ACCEPT_SQL}), {LOOP_SQL} SELECT step, source, l_orderkey, l_linenumber, l_returnflag FROM taken JOIN a USING (l_returnflag, ix, iy) WHERE u < {TYPE_SQL} AND v <= probability")
def mixing_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the mixed table, each with the step that took it."""
    return loop(spark, sf_dir).where("accepted").select("step", "source", "l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "mixing_report",
    f"""
    WITH a AS ({ACCEPT_SQL}), {LOOP_SQL}, c AS (SELECT source, count(*) AS taken, count(*) FILTER (u < {TYPE_SQL} AND v <= probability) AS kept, max(step) AS last_step FROM taken JOIN a USING (l_returnflag, ix, iy) GROUP BY 1)
    SELECT source, n AS rows, coalesce(taken, 0) AS taken, coalesce(kept, 0) AS kept, n - coalesce(taken, 0) AS "left", last_step FROM s LEFT JOIN c USING (source)
    """,
)
def mixing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loop took of each source: a source that it used up has none left."""
    source = F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("source")
    all_rows = items(spark, sf_dir).groupBy(source).agg(F.count("*").alias("rows"))
    taken = loop(spark, sf_dir).groupBy("source").agg(F.count("*").alias("taken"), F.count_if("accepted").alias("kept"), F.max("step").alias("last_step"))
    found = all_rows.join(taken, "source", "left").na.fill(0, ["taken", "kept"])
    return found.select("source", "rows", "taken", "kept", (F.col("rows") - F.col("taken")).alias("left"), "last_step")


#: Sixteen particles of each vector: eta, phi, pt and a strength that makes up two heads of scores.
PARTICLES = 16
PAIR_SQL = f"""
    p AS (SELECT vec_id, i, embedding[4 * i + 1]::DOUBLE AS eta, embedding[4 * i + 2]::DOUBLE AS phi, abs(embedding[4 * i + 3]::DOUBLE) AS pt, embedding[4 * i + 4]::DOUBLE AS s FROM embeddings, (SELECT unnest(range({PARTICLES})) AS i)),
    m AS (SELECT a.vec_id, head, a.i, b.i AS j, sqrt((a.eta - b.eta) * (a.eta - b.eta) + (a.phi - b.phi) * (a.phi - b.phi)) AS distance, (a.pt + b.pt) / 2 AS mean_pt, CASE head WHEN 0 THEN a.s * b.s ELSE a.s - b.s END AS score FROM p a JOIN p b USING (vec_id), (SELECT unnest([0, 1]) AS head))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    particle = lambda i: F.struct(e(4 * i).alias("eta"), e(4 * i + 1).alias("phi"), F.abs(e(4 * i + 2)).alias("pt"), e(4 * i + 3).alias("s"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*map(particle, range(PARTICLES))).alias("p"))
    grid_of = lambda f: F.transform("p", lambda x: F.transform("p", lambda y: f(x, y)))
    heads = [lambda x, y: x["s"] * y["s"], lambda x, y: x["s"] - y["s"]]
    scores = F.array(*[grid_of(f) for f in heads])
    found = match.pair_matrix(rows, ["vec_id"], F.col("p"), scores, 64, ["eta", "phi", "pt"])
    distance = F.sqrt((F.col("a_eta") - F.col("b_eta")) * (F.col("a_eta") - F.col("b_eta")) + (F.col("a_phi") - F.col("b_phi")) * (F.col("a_phi") - F.col("b_phi")))
    return found.select("vec_id", "head", "i", "j", distance.alias("distance"), ((F.col("a_pt") + F.col("b_pt")) / 2).alias("mean_pt"), "score")


@query("pair_matrix", f"WITH {PAIR_SQL} SELECT vec_id, head, i::INTEGER AS i, j::INTEGER AS j, round(distance, 6) AS distance, round(mean_pt, 6) AS mean_pt, round(score, 6) AS score FROM m")
def pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a row's particles with their distance, mean pt and score."""
    return pairs(spark, sf_dir).select("vec_id", "head", "i", "j", *[F.round(c, 6).alias(c) for c in ("distance", "mean_pt", "score")])


@query("pair_score_profile", f"WITH {PAIR_SQL} SELECT head, floor(distance / 0.1)::BIGINT AS bin, count(*) AS pairs, round(avg(score), 6) AS score FROM m GROUP BY ALL")
def pair_score_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each head by bins of the pairs' distance."""
    return pairs(spark, sf_dir).groupBy("head", F.floor(F.col("distance") / 0.1).alias("bin")).agg(F.count("*").alias("pairs"), F.round(F.avg("score"), 6).alias("score"))
