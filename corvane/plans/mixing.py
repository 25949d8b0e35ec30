"""Queries on texts, files, acceptance rules, batches, truth matches and curves of rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.functions.numeric import clamp_scale, edge_bin, exact_sum
from corvane.operators import hist, match, metrics, order, stats, tensor
from corvane.plans.histograms import COUNT_SQL, axes, counted
from corvane.plans.nested import DPHI_SQL, NESTED_SQL, POINT_SQL, nested, points, r6
from corvane.queries import query, table
from corvane.sources import io, shared

STATUS = {0: "F", 1: "O", 2: "P"}


@query(
    "text_values",
    """
    SELECT o_orderkey, 3 AS n_parts, o_custkey AS second, 'ev_' || o_orderkey || '.' || o_orderstatus AS filled, (o_orderkey % 97)::INT AS file_number, 'dir/' || o_orderstatus AS folder, 'f_' || (o_orderkey % 97) AS stem, o_custkey AS lumi,
      CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status, o_orderstatus AS status_name, o_orderkey % 2 = 0 AS flag, o_orderkey || '; ' || o_custkey AS joined, ('0x' || substr(md5(o_orderpriority), 1, 15))::BIGINT AS id FROM orders
    """,
)
def text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    path = F.concat(F.lit("dir/"), s, F.lit("/f_"), (k % 97).cast("string"), F.lit(".root"))
    parts = text.pieces(F.concat_ws(" ,, ", k.cast("string"), F.concat(F.lit("c"), c.cast("string")), F.lit("x")), ", ", unique=True, count=3)
    value = text.value_of(s, STATUS)
    return o.select(
        "o_orderkey", F.size(parts).alias("n_parts"), text.parsed(F.ltrim(F.get(parts, F.lit(1)), F.lit("c")), "bigint").alias("second"), text.filled("ev_{key}.{status}", key=k, status=s).alias("filled"), text.file_number(path).alias("file_number"), text.folder(path).alias("folder"),
        text.file_name(text.stem(path)).alias("stem"), text.event_id(F.concat_ws(":", k, c, k))["lumi"].alias("lumi"), value.alias("status"), text.named(value, STATUS).alias("status_name"), text.parsed((k % 2 == 0).cast("string"), "boolean").alias("flag"),
        text.joined(F.array(k, c), "; ").alias("joined"), text.text_id(F.col("o_orderpriority")).alias("id"),
    )


@query("common_suffix", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN '.parquet' WHEN count(DISTINCT l_returnflag) > 1 THEN l_linestatus || '.parquet' WHEN count(DISTINCT l_linenumber) > 1 THEN '_' || l_returnflag || l_linestatus || '.parquet' ELSE l_linenumber || '_' || l_returnflag || l_linestatus || '.parquet' END AS suffix FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) OVER w AS f, max(l_linestatus) OVER w AS s, l_returnflag, l_linestatus FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)) GROUP BY 1, f, s".replace("|| l_linestatus ||", "|| s ||").replace("'_' || l_returnflag", "'_' || f").replace("THEN l_linestatus ||", "THEN s ||").replace("|| '_' || f || s", "|| '_' || f || s").replace("ELSE l_linenumber", "ELSE max(l_linenumber)"))
def common_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names such as 3_AO.parquet of the lines of an order; line numbers have one digit."""
    name = F.concat("l_linenumber", F.lit("_"), "l_returnflag", "l_linestatus", F.lit(".parquet"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(name).alias("names"))
    return g.select("l_orderkey", text.common_suffix(F.col("names")).alias("suffix"))


@query("csv_roundtrip", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.place(spark, "csv")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", "o_orderdate")
    io.snapshot(o, path, kind="csv", compression="gzip")
    back = spark.read.schema(o.schema).csv(path)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("latest"))


@query("file_discovery", "SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder, true AS sized, o_orderstatus = 'F' AS known FROM orders WHERE o_orderstatus <> 'P'")
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found under a folder by pattern, with sizes that an earlier inventory may know already."""
    root = shared.place(spark, "found")
    io.snapshot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), root, by=["o_orderstatus"])
    files = io.discovered(spark, root, r".*\.parquet", exclude_folders=r".*/o_orderstatus=P")
    old = files.where(F.col("path").contains("o_orderstatus=F"))
    found = io.sizes(files, old)
    return found.groupBy(text.file_name(text.folder(F.col("path"))).alias("folder")).agg(F.min(F.col("size") > 0).alias("sized"), F.max("known").alias("known"))


@query("first_entries", "WITH o AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 200) SELECT o_orderkey AS key, count(l_orderkey) AS lines FROM o LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 200 orders, which is the feature, and the lines that belong to them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    own, lines = io.first_entries(o, [F.col("key")], 200, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])
    return own.join(lines.groupBy("key").agg(F.count("*").alias("lines")), "key", "left").fillna(0)


@query("report_rows", "SELECT l_returnflag || ',' || count(*) || ',' || format('{:.3e}', avg(l_quantity)) || ',' || format('{:.3e}', stddev_pop(l_quantity)) AS line FROM lineitem GROUP BY l_returnflag")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"))
    return io.report(r, digits=4)


@query(
    "acceptance_rules",
    f"""
    WITH g AS (SELECT f AS l_returnflag, ix::INT AS ix, iy::INT AS iy FROM (SELECT DISTINCT l_returnflag AS f FROM lineitem), (SELECT unnest(range(1, 6)) AS ix), (SELECT unnest(range(1, 11)) AS iy)),
    e AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN ({COUNT_SQL}) USING (l_returnflag, ix, iy)), r AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (1.0 / 50) / n END AS ratio FROM e),
    m AS (SELECT *, max(ratio) OVER w AS top, sum(CASE WHEN iy >= 9 THEN n ELSE 0 END) OVER w AS last FROM r WINDOW w AS (PARTITION BY l_returnflag))
    SELECT l_returnflag, ix, iy, round(ratio / top, 9) AS scaled, round(ratio * least(1, 0.3 * last * top) / top, 9) AS limited FROM m
    """,
)
def acceptance_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = counted(spark, sf_dir)
    grid = {"ix": axes()["ix"][1], "iy": axes()["iy"][1]}
    one = hist.acceptance_to_flat(h, ["l_returnflag"], grid, empty=0.0).withColumnRenamed("probability", "scaled")
    two = hist.acceptance_to_flat(h, ["l_returnflag"], grid, empty=0.0, last="iy", imbalance=0.3).withColumnRenamed("probability", "limited")
    both = one.join(two, ["l_returnflag", "ix", "iy"])
    return both.select("l_returnflag", "ix", "iy", F.round("scaled", 9).alias("scaled"), F.round("limited", 9).alias("limited"))


@query(
    "class_probabilities",
    "WITH n AS (SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1), r AS (SELECT kind, share / n AS rate FROM n JOIN (VALUES ('click', 2.0), ('view', 1.0), ('purchase', 0.5)) AS s(kind, share) USING (kind)) SELECT kind, round(rate / max(rate) OVER (), 9) AS probability FROM r UNION ALL SELECT 'error', 1.0",
)
def class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return hist.class_probabilities(n, "kind", {"click": 2.0, "view": 1.0, "purchase": 0.5, "error": -1.0}).select("kind", F.round("probability", 9).alias("probability"))


VARIABLE = {1: [0.0, 10.0, 20.0, 50.0], 2: [0.0, 25.0, 50.0], 3: [0.0, 5.0, 10.0, 30.0, 50.0]}


@query(
    "hist_variable_algebra",
    "WITH h AS (SELECT (l_linenumber % 3 + 1)::INT AS iy, CASE "
    + " ".join(f"WHEN l_linenumber % 3 + 1 = {k} THEN " + " + ".join(f"(l_quantity >= {e})::INT" for e in edges) for k, edges in VARIABLE.items())
    + """ END AS ix, l_returnflag = 'A' AS a, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
    d AS (SELECT iy, ix, sum(n) FILTER (a) / sum(n) FILTER (NOT a) AS ratio FROM h GROUP BY ALL)
    SELECT f.iy, f.fx, round(ratio, 9) AS ratio FROM (SELECT y AS iy, x::INT AS fx, CASE """
    + " ".join(f"WHEN y = {k} THEN " + " + ".join(f"(x * 5 - 2.5 >= {e})::INT" for e in edges) for k, edges in VARIABLE.items())
    + " END AS ix FROM (SELECT unnest([1, 2, 3]) AS y), (SELECT unnest(range(1, 11)) AS x)) f JOIN d USING (iy, ix)",
)
def hist_variable_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins in x that differ with y: filled, divided and spread over the finest equal bins."""
    r = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3 + 1).cast("int").alias("iy"), F.col("l_quantity").alias("x"), (F.col("l_returnflag") == "A").alias("a"))
    ix = F.lit(None).cast("int")
    for k, edges in VARIABLE.items():
        ix = F.when(F.col("iy") == k, edge_bin(F.col("x"), edges)).otherwise(ix)
    h = r.groupBy("iy", ix.alias("ix"), "a").agg(F.count("*").alias("n"), F.count("*").cast("double").alias("sumw"), F.count("*").cast("double").alias("sumw2"))
    ratio = hist.divided(h.where("a").drop("a"), h.where("not a").drop("a"), ["iy", "ix"])
    return hist.expanded(ratio, VARIABLE, ["ratio"]).select("iy", "fx", F.round("ratio", 9).alias("ratio"))


@query(
    "scale_by_cone",
    """
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount < 0.05 THEN 'inner' ELSE 'outer' END AS cone, l_quantity AS q, l_extendedprice AS e FROM lineitem),
    s AS (SELECT cone, avg(q) AS mq, stddev_pop(q) AS sq, avg(e) AS me, stddev_pop(e) AS se FROM p GROUP BY 1)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(-1, least(1, (q - mq) / sq)), 6) AS quantity, round(greatest(-5, least(5, (e - me) / se)), 6) AS price FROM p JOIN s USING (cone)
    """,
)
def scale_by_cone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features scaled by the mean and deviation of their own cone, with limits of their own."""
    cone = F.when(F.col("l_discount") < 0.05, "inner").otherwise("outer").alias("cone")
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cone, "l_quantity", "l_extendedprice")
    s = p.groupBy("cone").agg(*[f(c).alias(f"{n}_{c}") for c in ("l_quantity", "l_extendedprice") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    both = p.join(F.broadcast(s), "cone")  # one row for each of two cones
    scaled = lambda c, limit: clamp_scale(F.col(c), F.col(f"mean_{c}"), F.col(f"std_{c}"), -limit, limit)
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(scaled("l_quantity", 1.0), "quantity"), r6(scaled("l_extendedprice", 5.0), "price"))


def dr(a: str, b: str, ends: tuple[str, str] = ("eta", "phi")) -> str:
    dphi = DPHI_SQL.format(d=f"({a}.phi - {b}.{ends[1]})")
    return f"sqrt(({a}.eta - {b}.{ends[0]}) ^ 2 + ({dphi}) ^ 2)"


@query(
    "truth_match",
    f"""
    WITH p AS ({POINT_SQL}), d AS (SELECT a.vec_id, b.vec_id AS truth, least({dr("a", "b")}, {dr("a", "b", ("x4", "x4"))}) AS d FROM p a JOIN p b ON a.event = b.event AND a.label >= 5 AND b.label IN (0, 1, 3) AND b.pt > 10.2)
    SELECT vec_id, truth, round(d, 6) AS dr FROM d WHERE d < 0.3 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, truth) = 1
    """,
)
def truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest true object of chosen kinds over a pt, by the smaller of the distances to its two axes."""
    p = points(spark, sf_dir)
    reco = p.where("label >= 5").select("event", "vec_id", "eta", "phi")
    truth = p.where("label in (0, 1, 3) and pt > 10.2")
    found = match.nearest_axis(reco, truth, ["event"], "vec_id", "vec_id", [("eta", "phi"), ("x4", "x4")], 0.3)
    return found.select("vec_id", F.col("object").alias("truth"), r6("dr", "dr"))


@query(
    "sequence_blocks",
    f"""
    WITH g AS ({NESTED_SQL}), s AS (SELECT l_orderkey, list_filter(c, lambda x: x.f <> 'R')[:3] AS c FROM g)
    SELECT l_orderkey, list_resize(flatten(list_transform(c, lambda x: [(x.p % 7)::DOUBLE, (x.f = 'A')::INT::DOUBLE])), 6, 0::DOUBLE) AS categorical, list_resize(flatten(list_transform(c, lambda x: [1::DOUBLE, x.q, x.d])), 9, 0::DOUBLE) AS general FROM s
    """,
)
def sequence_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the first objects that pass a filter, as a categorical and a general block, filled up with zeros."""
    blocks = {"categorical": lambda x: [(x["p"] % 7).cast("double"), (x["f"] == "A").cast("double")], "general": lambda x: [F.lit(1.0), -x["nq"], x["d"]]}
    made = tensor.sequence_blocks(F.filter("c", lambda x: x["f"] != "R"), 3, blocks)
    return nested(spark, sf_dir).select("l_orderkey", *[c.alias(n) for n, c in made.items()])


@query("regression_targets", "SELECT l_orderkey, [count(*) FILTER (l_returnflag = 'A')::DOUBLE, count(*) FILTER (l_returnflag = 'N')::DOUBLE, round(sqrt(sum(l_quantity) ^ 2 + sum(l_tax) ^ 2), 6), round(sum(l_extendedprice) ^ 2 / 1e6, 6)] AS y FROM lineitem WHERE l_discount < 0.09 GROUP BY 1")
def regression_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of charged and neutral products, pt and squared mass of rows that pass the selection."""
    rows = table(spark, sf_dir, "lineitem").where("l_discount < 0.09").groupBy("l_orderkey")
    n = lambda f: F.count_if(F.col("l_returnflag") == f)
    g = rows.agg(n("A").alias("charged"), n("N").alias("neutral"), F.hypot(F.sum("l_quantity"), F.sum("l_tax")).alias("pt"), (F.pow(exact_sum(F.col("l_extendedprice")), F.lit(2.0)) / 1e6).alias("m2"))
    return g.select("l_orderkey", tensor.regression_targets(F.col("charged"), F.col("neutral"), F.round("pt", 6), F.round("m2", 6)).alias("y"))


@query(
    "adversarial_batches",
    """
    WITH a AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 48 AS batch FROM events WHERE event_type <> 'error'), b AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 16 AS batch FROM events WHERE event_type = 'error'),
    k AS (SELECT batch FROM a INTERSECT SELECT batch FROM b) SELECT batch, count(*) AS n, sum(w) AS weight, sum(event_id)::BIGINT AS ids FROM (SELECT *, 1.0::DOUBLE AS w FROM a UNION ALL SELECT *, 0.0 FROM b) JOIN k USING (batch) GROUP BY 1
    """,
)
def adversarial_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    one = tensor.numbered_batches(e.where("event_type <> 'error'"), [F.col("event_id")], 48)
    two = tensor.numbered_batches(e.where("event_type = 'error'"), [F.col("event_id")], 16)
    return tensor.adversarial(one, two).groupBy("batch").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum("event_id").alias("ids"))


@query("file_split", "WITH f AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT source, k < floor(n * 0.8) AS training, count(*) AS rows FROM documents JOIN f USING (source) GROUP BY ALL")
def file_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources stand for files; the first four fifths of them train."""
    d = table(spark, sf_dir, "documents").select("source")
    return tensor.split_by_file(d, "source", 0.8).groupBy("source", "training").agg(F.count("*").alias("rows"))


EFFICIENCIES = [0.2, 0.5, 0.8, 0.95]


@query(
    "rate_curve",
    "WITH t AS (" + " UNION ALL ".join(f"SELECT {e} AS efficiency, quantile_cont(l_extendedprice, {1 - e!r}) AS threshold FROM lineitem WHERE l_returnflag = 'A'" for e in EFFICIENCIES) + "), g AS (SELECT l_orderkey, max(l_extendedprice) AS m FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT efficiency::DOUBLE AS efficiency, round(threshold, 4) AS threshold, round(count(*) FILTER (m > threshold) / count(*), 9) AS rate FROM g, t GROUP BY ALL",
)
def rate_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_returnflag")
    curve = metrics.rate_curve(i.where("l_returnflag <> 'A'"), ["l_orderkey"], i.where("l_returnflag = 'A'"), "l_extendedprice", EFFICIENCIES)
    return curve.select("efficiency", F.round("threshold", 4).alias("threshold"), F.round("rate", 9).alias("rate"))


@query(
    "quantity_compatible",
    "WITH q AS (SELECT l_returnflag AS f, avg(l_quantity) AS v, stddev_samp(l_quantity) / sqrt(count(*)) AS d, 2 * stddev_samp(l_quantity) / sqrt(count(*)) AS u FROM lineitem GROUP BY 1) SELECT a.f AS a, b.f AS b, CASE WHEN a.v < b.v THEN b.v - a.v <= b.d + a.u WHEN a.v > b.v THEN a.v - b.v <= a.d + b.u ELSE true END AS compatible FROM q a JOIN q b ON a.f < b.f",
)
def quantity_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by flag, with errors that are twice as large upwards; three rows."""
    e = F.stddev_samp("l_quantity") / F.sqrt(F.count("*").cast("double"))
    q = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.struct(F.avg("l_quantity").alias("value"), e.alias("down"), (2 * e).alias("up")).alias("q"))
    a, b = (q.select(F.col("l_returnflag").alias(n), F.col("q").alias(f"q_{n}")) for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", stats.compatible(F.col("q_a"), F.col("q_b")).alias("compatible"))


@query("jobs_combined", "SELECT l_returnflag, count(*) AS n, format('{:.3e}', avg(l_extendedprice))::DOUBLE AS mean, format('{:.3e}', stddev_pop(l_extendedprice))::DOUBLE AS std, -5.0::DOUBLE AS low, 5.0::DOUBLE AS high FROM lineitem GROUP BY 1")
def jobs_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of jobs, one for each supplier's remainder, merged by weight; all must have the same limits."""
    jobs = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", (F.col("l_suppkey") % 5).alias("job")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"), F.avg(F.col("l_extendedprice") * F.col("l_extendedprice")).alias("sqmean"))
    return stats.jobs_combined(jobs.withColumns({"low": F.lit(-5.0), "high": F.lit(5.0)}), ["l_returnflag"], ["low", "high"])


@query("parity_all", "SELECT p, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders JOIN (VALUES (0), (1), (3)) AS v(p) ON p = 3 OR o_orderkey % 2 = p GROUP BY 1")
def parity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each parity, and all of them under 3."""
    ps = F.explode(F.filter(F.array(*map(F.lit, (0, 1, 3))), lambda p: (p == 3) | (F.col("o_orderkey") % 2 == p))).alias("p")
    return table(spark, sf_dir, "orders").select("o_orderkey", ps).groupBy("p").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "hourly_medians",
    "SELECT h AS hour, round(quantile_cont(value, 0.5), 6) AS median, count(*) AS n FROM (SELECT hour(ts)::INT AS h, value FROM events) GROUP BY 1",
)
def hourly_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.hour("ts").alias("hour"), "value")
    return stats.quantiles(e, ["hour"], "value", {"median": 0.5}).select("hour", r6("median", "median"), "n")
