"""Queries on statistics, windows, quantiles and estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import significant_digits
from corvane.operators import density, order, stats
from corvane.queries import query, table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "dedup_first_wins",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, copies FROM (
      SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1
    """,
)
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")]
    rows = items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return stats.first_wins(rows, ["l_orderkey", "l_linenumber"], by).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copies")


CHECKED = ["l_quantity", "l_discount", "l_tax"]


@query(
    "variable_check",
    " UNION ALL ".join(f"SELECT '{c}' AS name, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS avg, round(stddev_pop({c}), 6) AS std, max(abs({c})) AS abs_max, round(avg(abs({c})), 6) AS abs_avg, stddev_pop({c}) <= 1e-12 AS is_const FROM lineitem" for c in CHECKED),
)
def variable_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.variable_check(items(spark, sf_dir), CHECKED)
    return r.select("name", "min", "max", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"), "abs_max", F.round("abs_avg", 6).alias("abs_avg"), "is_const")


@query("scaling_partial_merge", "SELECT l_returnflag, count(*) AS n, format('{:.3e}', avg(l_extendedprice))::DOUBLE AS mean, format('{:.3e}', stddev_pop(l_extendedprice))::DOUBLE AS std FROM lineitem GROUP BY 1")
def scaling_partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stats.partial(items(spark, sf_dir), ["l_returnflag", "l_linestatus"], F.col("l_extendedprice"))
    return stats.combined(parts, ["l_returnflag"]).select("l_returnflag", "n", significant_digits(F.col("mean")).alias("mean"), significant_digits(F.col("std")).alias("std"))


@query(
    "scaling_cone_split",
    "SELECT CASE WHEN l_discount < 0.05 THEN 'inner' ELSE 'outer' END AS cone, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1",
)
def scaling_cone_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = items(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_discount", "l_quantity")).alias("parts"))
    flat = nested.select(F.explode("parts").alias("p")).select(F.when(F.col("p.l_discount") < 0.05, "inner").otherwise("outer").alias("cone"), F.col("p.l_quantity").alias("x"))
    return stats.combined(stats.partial(flat, ["cone"], F.col("x")), ["cone"]).select("cone", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "scaling_snapshots",
    """
    WITH p AS (SELECT ts::DATE AS day, count(value) AS n, sum(value) AS s1, sum(value * value) AS s2 FROM events GROUP BY 1),
    c AS (SELECT day, sum(n) OVER w AS n, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM p WINDOW w AS (ORDER BY day))
    SELECT day, n::BIGINT AS n, round(s1 / n, 6) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) ^ 2, 0)), 6) AS std FROM c
    """,
)
def scaling_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.partial(events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["day"], F.col("value"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    c = p.select("day", *[F.sum(x).over(w).alias(x) for x in ("n", "s1", "s2")])
    mean = F.col("s1") / F.col("n")
    return c.select("day", "n", F.round(mean, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0))), 6).alias("std"))


QUANTILES = {"median": 0.5} | {f"sigma_{'m' if s < 0 else 'p'}{abs(s)}": v for s, v in stats.SIGMA_SHARES.items()}


@query(
    "quantile_block",
    "SELECT o_orderstatus, min(o_totalprice) AS min, max(o_totalprice) AS max, " + ", ".join(f"round(quantile_cont(o_totalprice, {v!r}), 4) AS {n}" for n, v in QUANTILES.items()) + " FROM orders GROUP BY 1",
)
def quantile_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.quantile_block(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")
    return r.select("o_orderstatus", "min", "max", *[F.round(n, 4).alias(n) for n in QUANTILES])


@query(
    "weighted_quantile",
    """
    WITH s AS (SELECT l_returnflag, l_quantity AS x, sum(l_tax + 0.01) AS w FROM lineitem GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
    SELECT l_returnflag, min(x) AS quantile FROM c WHERE c >= 0.31 * t GROUP BY 1
    """,
)
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_quantile(items(spark, sf_dir).withColumn("w", F.col("l_tax") + 0.01), ["l_returnflag"], "l_quantity", "w", 0.31)


@query(
    "midpoint_quantile",
    """
    WITH s AS (SELECT l_returnflag, l_quantity AS x, sum(l_tax + 0.01) AS w FROM lineitem GROUP BY ALL),
    c AS (SELECT *, (sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) - w / 2) / sum(w) OVER (PARTITION BY l_returnflag) AS p FROM s),
    n AS (SELECT *, lead(p) OVER (PARTITION BY l_returnflag ORDER BY x) AS p2, lead(x) OVER (PARTITION BY l_returnflag ORDER BY x) AS x2 FROM c)
    SELECT l_returnflag, round(max(x + (x2 - x) * (0.4 - p) / (p2 - p)), 6) AS quantile FROM n WHERE p <= 0.4 AND p2 > 0.4 GROUP BY 1
    """,
)
def midpoint_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.midpoint_quantile(items(spark, sf_dir).withColumn("w", F.col("l_tax") + 0.01), ["l_returnflag"], "l_quantity", "w", 0.4)
    return r.select("l_returnflag", F.round("quantile", 6).alias("quantile"))


@query(
    "groupby_max_rate",
    "WITH g AS (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT t AS threshold, round((count(*) FILTER (m > t))::DOUBLE / count(*), 6) AS rate FROM g, (VALUES (20000.0::DOUBLE), (50000.0), (80000.0)) AS v(t) GROUP BY 1",
)
def groupby_max_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = items(spark, sf_dir).groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("m"))
    points = F.explode(F.array(*map(F.lit, (20000.0, 50000.0, 80000.0)))).alias("threshold")
    return g.select("m", points).groupBy("threshold").agg(F.round(F.count_if(F.col("m") > F.col("threshold")) / F.count("*"), 6).alias("rate"))


@query("value_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("bucket_mean", "WITH m AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT k, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT value, least(floor((value - a) / ((b - a) / 8))::INT, 7) AS k FROM events, m) GROUP BY 1")
def bucket_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("value")
    m = e.agg(F.min("value").alias("a"), F.max("value").alias("b"))
    k = F.least(F.floor((F.col("value") - F.col("a")) / ((F.col("b") - F.col("a")) / 8)).cast("int"), F.lit(7))
    return e.join(F.broadcast(m)).groupBy(k.alias("k")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("argmax_row", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def argmax_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best).select("o_custkey", (-F.col("b.k")).alias("o_orderkey"), F.col("b.o_totalprice").alias("o_totalprice"))


@query("low_stat_null", "SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) > 1 THEN round(avg(l_quantity), 6) END AS mean FROM lineitem GROUP BY 1")
def low_stat_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.combined(stats.partial(items(spark, sf_dir), ["l_orderkey"], F.col("l_quantity")), ["l_orderkey"])
    return r.select("l_orderkey", "n", F.round("mean", 6).alias("mean"))


@query("group_mean", "SELECT event_type, user_id % 7 AS layer, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def group_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 7).alias("layer")).agg(F.round(F.avg("value"), 6).alias("mean"))


@query("progress_report", "SELECT o_orderstatus, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return g.select("o_orderstatus", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("station_pivot", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def station_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = items(spark, sf_dir).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return p.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("resolution_state", "SELECT l_returnflag, round(var_pop(l_discount - l_tax), 9) AS absolute, round(var_pop((l_discount - l_tax) / l_quantity), 9) AS relative, count(*) AS n FROM lineitem GROUP BY 1")
def resolution_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount") - F.col("l_tax")
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.var_pop(d), 9).alias("absolute"), F.round(F.var_pop(d / F.col("l_quantity")), 9).alias("relative"), F.count("*").alias("n"))


@query("corr_cov", "SELECT l_returnflag, round(var_samp(l_quantity), 6) AS var, round(covar_samp(l_quantity, l_extendedprice), 2) AS cov, round(greatest(-0.99, least(0.99, corr(l_quantity, l_extendedprice))), 6) AS corr FROM lineitem GROUP BY 1")
def corr_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_quantity"), F.col("l_extendedprice")
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.var_samp(a), 6).alias("var"), F.round(F.covar_samp(a, b), 2).alias("cov"), F.round(F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.corr(a, b))), 6).alias("corr"))


@query(
    "central_interval",
    """
    WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n, median(value) OVER (PARTITION BY event_type) AS c FROM events)
    SELECT a.event_type, min(struct_pack(w := b.value - a.value, low := a.value, high := b.value)).low AS low, min(struct_pack(w := b.value - a.value, low := a.value, high := b.value)).high AS high
    FROM s a JOIN s b ON a.event_type = b.event_type AND b.k = a.n - (floor(a.n * 0.31731)::BIGINT - a.k) - 1 WHERE a.k <= floor(a.n * 0.31731) AND a.c BETWEEN a.value AND b.value GROUP BY 1
    """,
)
def central_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", "value")
    c = stats.quantiles(e, ["event_type"], "value", {"centre": 0.5}).select("event_type", "centre")
    return stats.central_interval(e.join(F.broadcast(c), "event_type"), ["event_type"], "value", "centre")


@query(
    "interquartile_range",
    """
    WITH s AS (SELECT o_orderstatus, list(o_totalprice ORDER BY o_totalprice) AS v FROM orders GROUP BY 1), h AS (SELECT *, len(v) AS n, len(v) // 2 AS h FROM s)
    SELECT o_orderstatus, round(list_aggregate(v[n - h + 1:], 'median') - list_aggregate(v[:h], 'median'), 4) AS iqr, round(2 * (list_aggregate(v[n - h + 1:], 'median') - list_aggregate(v[:h], 'median')) / n ^ (1.0 / 3), 4) AS bin_size FROM h
    """,
)
def interquartile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.interquartile_range(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")
    return r.select("o_orderstatus", F.round("iqr", 4).alias("iqr"), F.round("bin_size", 4).alias("bin_size"))


KDE_SQL = "SELECT p.{a} AS x, sum(exp(-0.5 * ((p.{a} - s.l_quantity) / {h}) ^ 2)) / ({h} * sqrt(2 * pi()) * count(*)) AS d FROM (SELECT DISTINCT l_quantity AS {a} FROM lineitem WHERE l_returnflag = '{f}') p, (SELECT l_quantity FROM lineitem WHERE l_returnflag = '{g}' AND l_linestatus = 'F') s GROUP BY 1"


@query("kde_density", "SELECT x::DOUBLE AS x, round(d, 9) AS density FROM (" + KDE_SQL.format(a="q", h=2.5, f="A", g="R") + ")")
def kde_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    points = i.where("l_returnflag = 'A'").select(F.col("l_quantity").alias("x")).distinct()
    sample = i.where("l_returnflag = 'R' and l_linestatus = 'F'").select(F.col("l_quantity").alias("x"))
    return density.kde(sample, points, "x", 2.5).select("x", F.round("density", 9).alias("density"))


@query(
    "kde_divergence",
    """
    WITH c AS (SELECT l_returnflag AS f, l_quantity AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
    d AS (SELECT x.v, x.n, sum(s.n * exp(-0.5 * ((x.v - s.v) / 2.5) ^ 2)) FILTER (s.f = 'A') / sum(s.n) FILTER (s.f = 'A') AS p, sum(s.n * exp(-0.5 * ((x.v - s.v) / 2.5) ^ 2)) FILTER (s.f = 'N') / sum(s.n) FILTER (s.f = 'N') AS q FROM c x, c s WHERE x.f = 'A' GROUP BY x.v, x.n)
    SELECT round(sum(n * (log2(p) - log2(q))) / sum(n), 9) AS kl, round(sum(n * (log2(p) - log2((p + q) / 2))) / sum(n), 9) AS js_half FROM d
    """,
)
def kde_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).select("l_returnflag", F.col("l_quantity").alias("x"))
    a, n = i.where("l_returnflag = 'A'"), i.where("l_returnflag = 'N'")
    points = a.groupBy("x").agg(F.count("*").alias("n"))
    p = density.kde(a, points, "x", 2.5).withColumnRenamed("density", "p")
    d = density.kde(n, p, "x", 2.5).withColumnRenamed("density", "q")
    part = lambda e: F.round(F.sum(F.col("n") * e) / F.sum("n"), 9)
    return d.agg(part(F.log2("p") - F.log2("q")).alias("kl"), part(F.log2("p") - F.log2((F.col("p") + F.col("q")) / 2)).alias("js_half"))


@query("prev_row_pair", "SELECT event_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), -99), 6) AS pair FROM events")
def prev_row_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events(spark, sf_dir).select("event_id", F.round(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(-99.0)), 6).alias("pair"))


@query(
    "rolling_stats",
    """
    WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT event_id, round(avg(value) OVER w, 6) AS mean, CASE WHEN count(*) OVER w >= 2 THEN round(stddev_samp(value) OVER w, 6) END AS std, CASE WHEN count(*) OVER w >= 2 THEN round(regr_slope(value, k) OVER w, 6) END AS slope
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, sf_dir).withColumn("k", F.row_number().over(up))
    w = up.rowsBetween(-4, 0)
    two = F.count("*").over(w) >= 2
    return e.select("event_id", F.round(F.avg("value").over(w), 6).alias("mean"), F.when(two, F.round(F.stddev_samp("value").over(w), 6)).alias("std"), F.when(two, F.round(F.regr_slope("value", "k").over(w), 6)).alias("slope"))


@query(
    "running_diff",
    """
    WITH p AS (SELECT ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1)
    SELECT day, round(CASE WHEN lead(v) OVER (ORDER BY day) IS NULL THEN (v - first(v) OVER (ORDER BY day)) / first(v) OVER (ORDER BY day) ELSE (v - lag(v) OVER (ORDER BY day)) / lag(v) OVER (ORDER BY day) END, 6) AS change FROM p
    """,
)
def running_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("day")
    p = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    rel = lambda b: (F.col("v") - b) / b
    return p.select("day", F.round(F.when(F.lead("v").over(w).isNull(), rel(F.first("v").over(w))).otherwise(rel(F.lag("v").over(w))), 6).alias("change"))


@query("chunk_tiles", "SELECT event_id, floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 7 / count(*) OVER ())::INT AS chunk FROM events")
def chunk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.tiles(events(spark, sf_dir).select("ts", "event_id"), [F.col("ts"), F.col("event_id")], 7, "chunk").select("event_id", "chunk")


@query("row_in_event", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS entry, count(*) OVER (PARTITION BY l_orderkey) AS entries FROM lineitem")
def row_in_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    k = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.alias("entry"), F.count("*").over(w).alias("entries"))


@query("topk_per_group", "SELECT l_suppkey, l_orderkey, l_extendedprice, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INT AS n FROM lineitem) WHERE n <= 2")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return items(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 2").select("l_suppkey", "l_orderkey", "l_extendedprice", "n")


@query("multi_key_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_custkey DESC, o_orderkey)::INT AS place FROM orders")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [F.col("o_orderdate"), F.desc("o_custkey"), F.col("o_orderkey")]
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    return order.numbered(o, by).select("o_orderkey", (F.col("n") + 1).cast("int").alias("place"))


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 10")
def limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(30).select("o_orderkey", "o_totalprice")


@query("quantity_format", "SELECT l_returnflag, format('{:.2f}', avg(l_quantity)) || ' +/- ' || format('{:.1e}', stddev_samp(l_quantity) / sqrt(count(*))) AS shown FROM lineitem GROUP BY 1")
def quantity_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.stddev_samp("l_quantity") / F.sqrt(F.count("*").cast("double"))
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.concat(F.format_string("%.2f", F.avg("l_quantity")), F.lit(" +/- "), F.format_string("%.1e", error)).alias("shown"))
