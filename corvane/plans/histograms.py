"""Queries on histograms, acceptance and sampling. Candidates are line items: discount and quantity are the two axes,
the return flag is the class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import edge_bin, uniform
from corvane.operators import hist, order, sample
from corvane.operators.hist import Axis
from corvane.queries import query, table

X, Y = Axis(0.0, 0.1, 5, True), Axis(0.0, 50.0, 10, True)
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def bin_sql(x: str, axis: Axis) -> str:
    """The bin of uniform_bin() in SQL."""
    top = axis.bins if axis.close_top else axis.bins + 1
    return f"(CASE WHEN {x} < {axis.low} THEN 0 WHEN {x} = {axis.high} THEN {top} WHEN {x} > {axis.high} THEN {axis.bins + 1} ELSE least(floor(({x} - {axis.low}) * {axis.bins / (axis.high - axis.low)!r})::INT + 1, {axis.bins}) END)"


def u_sql(seed: int, *key: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"{k}::VARCHAR" for k in key]])
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


HIST_SQL = f"SELECT l_returnflag, {bin_sql('l_discount', X)} AS ix, {bin_sql('l_quantity', Y)} AS iy, count(*) AS n, sum(l_extendedprice) AS sumw, sum(l_extendedprice * l_extendedprice) AS sumw2 FROM lineitem GROUP BY ALL"
COUNT_SQL = f"SELECT l_returnflag, {bin_sql('l_discount', X)} AS ix, {bin_sql('l_quantity', Y)} AS iy, count(*) AS n, count(*)::DOUBLE AS sumw FROM lineitem GROUP BY ALL"
ACCEPT_SQL = f"SELECT *, (1.0 / sumw) / max(1.0 / sumw) OVER (PARTITION BY l_returnflag) AS probability FROM ({COUNT_SQL})"


def axes() -> dict:
    return {"ix": (F.col("l_discount"), X), "iy": (F.col("l_quantity"), Y)}


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.fill(items(spark, sf_dir), ["l_returnflag"], axes())


@query(
    "flagship_spectrum_sample",
    f"""
    WITH a AS ({ACCEPT_SQL}), r AS (
      SELECT l_returnflag, {bin_sql("l_discount", X)} AS ix, {bin_sql("l_quantity", Y)} AS iy, {u_sql(7, *KEY)} AS u FROM lineitem)
    SELECT a.l_returnflag, a.ix, a.iy, any_value(a.n) AS n, round(any_value(probability), 6) AS probability, count(*) FILTER (u < probability) AS kept
    FROM a JOIN r USING (l_returnflag, ix, iy) GROUP BY ALL
    """,
)
def flagship_spectrum_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select(*KEY, "l_returnflag", "l_discount", "l_quantity")
    chance = hist.acceptance(hist.fill(rows, ["l_returnflag"], axes()), ["l_returnflag"])
    found = hist.look_up(rows, F.broadcast(chance.select("l_returnflag", "ix", "iy", "n", "probability")), ["l_returnflag"], axes(), "probability", 0.0)
    keep = uniform(7, *map(F.col, KEY)) < F.col("probability")
    counts = found.groupBy("l_returnflag", "ix", "iy").agg(F.count("*").alias("n"), F.max("probability").alias("p"), F.count_if(keep).alias("kept"))
    return counts.select("l_returnflag", "ix", "iy", "n", F.round("p", 6).alias("probability"), "kept")


@query("hist2d_by_class", f"SELECT l_returnflag, ix, iy, n FROM ({COUNT_SQL})")
def hist2d_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir).select("l_returnflag", "ix", "iy", "n")


@query(
    "hist1d_weighted",
    f"SELECT l_returnflag, {bin_sql('l_quantity', Y)} AS iy, count(*) AS n, round(sum(l_discount) / {Y.width}, 6) AS density, round(sqrt(sum(l_discount * l_discount)) / {Y.width}, 6) AS error FROM lineitem GROUP BY ALL",
)
def hist1d_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist.fill(items(spark, sf_dir), ["l_returnflag"], {"iy": (F.col("l_quantity"), Y)}, F.col("l_discount"))
    return h.select("l_returnflag", "iy", "n", F.round(F.col("sumw") / Y.width, 6).alias("density"), F.round(F.sqrt("sumw2") / Y.width, 6).alias("error"))


@query(
    "hist_rebin",
    f"""
    SELECT l_returnflag, {bin_sql("l_quantity", Axis(10.0, 40.0, 3))} AS iy, count(*) AS n, round(sum(l_tax), 6) AS sumw, round(sqrt(sum(l_tax * l_tax)), 6) AS error
    FROM lineitem GROUP BY ALL
    """,
)
def hist_rebin(spark: SparkSession, sf_dir: str) -> DataFrame:
    fine = Axis(0.0, 50.0, 50)
    h = hist.fill(items(spark, sf_dir), ["l_returnflag"], {"iy": (F.col("l_quantity"), fine)}, F.col("l_tax"))
    r = hist.rebin(h, "iy", fine, Axis(10.0, 40.0, 3))
    return r.select("l_returnflag", "iy", "n", F.round("sumw", 6).alias("sumw"), F.round(F.sqrt("sumw2"), 6).alias("error"))


@query(
    "hist_divide_renorm",
    f"""
    WITH h AS ({COUNT_SQL}), s AS (SELECT *, sumw / sum(sumw) OVER (PARTITION BY l_returnflag) AS share FROM h)
    SELECT a.ix, a.iy, round(a.share / b.share, 6) AS ratio, round((a.share / b.share) / max(a.share / b.share) OVER (), 6) AS keep
    FROM s a JOIN s b USING (ix, iy) WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'
    """,
)
def hist_divide_renorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = hist.renormalised(counted(spark, sf_dir), ["l_returnflag"])
    side = lambda flag, name: s.where(F.col("l_returnflag") == flag).select("ix", "iy", F.col("sumw").alias(name))
    r = side("A", "a").join(side("R", "b"), ["ix", "iy"]).withColumn("r", F.try_divide("a", "b"))
    return r.select("ix", "iy", F.round("r", 6).alias("ratio"), F.round(F.col("r") / F.max("r").over(Window.partitionBy()), 6).alias("keep"))


@query(
    "hist_expected_entries",
    f"SELECT l_returnflag, sum(n)::BIGINT AS n, round(sum(n * CASE WHEN iy BETWEEN 2 AND 9 THEN probability ELSE 1 END), 6) AS expected FROM ({ACCEPT_SQL}) GROUP BY ALL",
)
def hist_expected_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = counted(spark, sf_dir)
    chance = hist.acceptance(h, ["l_returnflag"]).where("iy between 2 and 9").select("l_returnflag", "ix", "iy", "probability")
    both = h.join(chance, ["l_returnflag", "ix", "iy"], "left")
    return both.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.coalesce("probability", F.lit(1.0))), 6).alias("expected"))


EDGES = {1: [0.0, 10.0, 20.0, 50.0], 2: [0.0, 25.0, 50.0], 3: [0.0, 5.0, 10.0, 30.0, 50.0]}


@query(
    "hist_variable_y",
    "WITH r AS (SELECT (l_linenumber % 3 + 1) AS iy, l_quantity AS x FROM lineitem) SELECT iy::INT AS iy, CASE "
    + " ".join(f"WHEN iy = {k} THEN " + " + ".join(f"(x >= {e})::INT" for e in edges) for k, edges in EDGES.items())
    + " END AS ix, count(*) AS n FROM r GROUP BY ALL",
)
def hist_variable_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = items(spark, sf_dir).select((F.col("l_linenumber") % 3 + 1).cast("int").alias("iy"), F.col("l_quantity").alias("x"))
    ix = F.lit(None).cast("int")
    for k, edges in EDGES.items():
        ix = F.when(F.col("iy") == k, edge_bin(F.col("x"), edges)).otherwise(ix)
    return r.groupBy("iy", ix.alias("ix")).agg(F.count("*").alias("n"))


@query(
    "hist_imbalance",
    f"SELECT ix, iy, max(n) AS most, min(n) AS least, round(max(n)::DOUBLE / min(n), 6) AS imbalance, max(n)::DOUBLE / min(n) <= 1.5 AS balanced FROM ({COUNT_SQL}) GROUP BY ALL",
)
def hist_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = counted(spark, sf_dir).groupBy("ix", "iy").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    ratio = F.try_divide(F.col("most").cast("double"), F.col("least").cast("double"))
    return r.select("ix", "iy", "most", "least", F.round(ratio, 6).alias("imbalance"), (ratio <= 1.5).alias("balanced"))


@query("hist_normalised", f"SELECT l_returnflag, ix, iy, round(sumw / sum(sumw) OVER (PARTITION BY l_returnflag), 9) AS share FROM ({COUNT_SQL})")
def hist_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist.renormalised(counted(spark, sf_dir), ["l_returnflag"]).select("l_returnflag", "ix", "iy", F.round("sumw", 9).alias("share"))


@query(
    "hist_add_copy_check",
    f"""
    WITH h AS ({COUNT_SQL}), a AS (SELECT * FROM h WHERE l_returnflag = 'A'), b AS (SELECT * FROM h WHERE l_returnflag = 'N')
    SELECT ix, iy, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, round(coalesce(a.sumw, 0) + 0.5 * coalesce(b.sumw, 0), 6) AS sumw,
      round(sqrt(coalesce(a.sumw, 0) + 0.25 * coalesce(b.sumw, 0)), 6) AS error FROM a FULL JOIN b USING (ix, iy)
    """,
)
def hist_add_copy_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = counted(spark, sf_dir)
    side = lambda flag: h.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    return hist.added(side("A"), side("N"), ["ix", "iy"], 0.5).select("ix", "iy", "n", F.round("sumw", 6).alias("sumw"), F.round(F.sqrt("sumw2"), 6).alias("error"))


PRICE = Axis(0.0, 110000.0, 5000)


@query("hist_missing_bins", f"WITH h AS (SELECT DISTINCT l_returnflag AS f, {bin_sql('l_extendedprice', PRICE)} AS k FROM lineitem) SELECT k, any_value(CASE f WHEN 'A' THEN 'a' ELSE 'b' END) AS side FROM h WHERE f IN ('A', 'R') GROUP BY 1 HAVING count(*) = 1")
def hist_missing_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist.fill(items(spark, sf_dir), ["l_returnflag"], {"k": (F.col("l_extendedprice"), PRICE)})
    return hist.same_bins(h.where("l_returnflag = 'A'"), h.where("l_returnflag = 'R'"), ["k"])


@query("hist_project_merge", f"SELECT iy, count(*) AS n FROM (SELECT {bin_sql('l_quantity', Y)} AS iy, {bin_sql('l_discount', X)} AS ix FROM lineitem) WHERE ix BETWEEN 2 AND 4 GROUP BY ALL")
def hist_project_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = counted(spark, sf_dir).where("ix between 2 and 4").drop("ix")
    return hist.merged(h.where("l_returnflag = 'A'").drop("l_returnflag"), h.where("l_returnflag <> 'A'").drop("l_returnflag")).select("iy", "n")


@query("hist_integral", f"SELECT l_returnflag, round(sum(sumw), 4) AS value, round(sqrt(sum(sumw2)), 4) AS error FROM ({HIST_SQL}) WHERE iy BETWEEN 1 AND {Y.bins} GROUP BY ALL")
def hist_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist.fill(items(spark, sf_dir), ["l_returnflag"], axes(), F.col("l_extendedprice"))
    return hist.integral(h, ["l_returnflag"], {"iy": Y}).select("l_returnflag", F.round("value", 4).alias("value"), F.round("error", 4).alias("error"))


@query(
    "spectrum_weights",
    """
    WITH h AS (SELECT o_orderpriority, least(floor(o_totalprice / 50000)::INT, 9) AS k, count(*)::DOUBLE AS n FROM orders GROUP BY ALL),
    t AS (SELECT k, count(*)::DOUBLE AS spec FROM (SELECT least(floor(o_totalprice / 50000)::INT, 9) AS k FROM orders) GROUP BY k)
    SELECT o_orderpriority, k, round(spec / n * (sum(n) OVER (PARTITION BY o_orderpriority) / sum(spec) OVER (PARTITION BY o_orderpriority)), 6) AS weight, n <= 100 AS low_count FROM h JOIN t USING (k)
    """,
)
def spectrum_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select("o_orderpriority", F.least(F.floor(F.col("o_totalprice") / 50000).cast("int"), F.lit(9)).alias("k"))
    h = r.groupBy("o_orderpriority", "k").agg(F.count("*").cast("double").alias("n"))
    t = h.groupBy("k").agg(F.sum("n").alias("spec"))
    w = Window.partitionBy("o_orderpriority")
    weight = F.try_divide("spec", "n") * F.sum("n").over(w) / F.sum("spec").over(w)
    return h.join(F.broadcast(t), "k").select("o_orderpriority", "k", F.round(weight, 6).alias("weight"), (F.col("n") <= 100).alias("low_count"))


@query(
    "ratio_with_errors",
    f"""
    WITH h AS (SELECT l_linestatus, {bin_sql("l_quantity", Y)} AS iy, count(*) AS n, sum(l_discount) AS w, sum(l_discount * l_discount) AS w2 FROM lineitem GROUP BY ALL)
    SELECT iy, round(a.n / b.w, 6) AS ratio, round(a.n / b.w * sqrt(1.0 / a.n + b.w2 / (b.w * b.w)), 6) AS error FROM h a JOIN h b USING (iy) WHERE a.l_linestatus = 'F' AND b.l_linestatus = 'O'
    """,
)
def ratio_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hist.fill(items(spark, sf_dir), ["l_linestatus"], {"iy": (F.col("l_quantity"), Y)}, F.col("l_discount"))
    r = hist.ratio_with_errors(h.where("l_linestatus = 'F'"), h.where("l_linestatus = 'O'"), ["iy"])
    return r.select("iy", F.round("ratio", 6).alias("ratio"), F.round("error", 6).alias("error"))


@query(
    "hist_lookup_weight",
    f"""
    WITH a AS ({ACCEPT_SQL}) SELECT o_orderpriority, count(*) AS n, round(sum(probability), 6) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN a ON a.l_returnflag = lineitem.l_returnflag AND a.ix = {bin_sql("l_discount", X)} AND a.iy = {bin_sql("l_quantity", Y)} GROUP BY ALL
    """,
)
def hist_lookup_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    chance = hist.acceptance(counted(spark, sf_dir), ["l_returnflag"])
    rows = items(spark, sf_dir).select("l_orderkey", "l_returnflag", "l_discount", "l_quantity")
    weighted = hist.look_up(rows, F.broadcast(chance), ["l_returnflag"], axes(), "probability", 0.0)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return weighted.join(orders, "l_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("probability"), 6).alias("weight"))


@query(
    "chunk_chi2",
    f"""
    WITH r AS (SELECT floor((row_number() OVER (ORDER BY event_id) - 1) * 10 / count(*) OVER ())::INT AS chunk, {bin_sql("value", Axis(0.0, 100.0, 10))} AS k FROM events),
    h AS (SELECT chunk, k, count(*)::DOUBLE AS n FROM r GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY chunk) AS t FROM h)
    SELECT b.chunk, round(sum((b.n / b.t - a.n / a.t) ^ 2 / (b.n / (b.t * b.t) + a.n / (a.t * a.t))), 6) AS chi2, count(*) AS bins FROM s a JOIN s b USING (k) WHERE a.chunk = 0 AND b.chunk > 0 GROUP BY ALL
    """,
)
def chunk_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = order.tiles(e.select("event_id", "value"), [F.col("event_id")], 10, "chunk")
    h = hist.fill(r, ["chunk"], {"k": (F.col("value"), Axis(0.0, 100.0, 10))})
    s = h.select("chunk", "k", F.col("sumw").alias("n"), F.sum("sumw").over(Window.partitionBy("chunk")).alias("t"))
    a = s.where("chunk = 0").select("k", F.col("n").alias("na"), F.col("t").alias("ta"))
    term = F.pow(F.col("n") / F.col("t") - F.col("na") / F.col("ta"), F.lit(2.0)) / (F.col("n") / F.pow("t", F.lit(2.0)) + F.col("na") / F.pow("ta", F.lit(2.0)))
    return s.where("chunk > 0").join(F.broadcast(a), "k").groupBy("chunk").agg(F.round(F.sum(term), 6).alias("chi2"), F.count("*").alias("bins"))


@query("sample_class_spectrum", f"SELECT l_returnflag, count(*) AS n FROM lineitem JOIN (VALUES ('A', 0.5), ('R', 0.25), ('N', -1.0)) AS p(l_returnflag, p) USING (l_returnflag) WHERE p < 0 OR {u_sql(11, *KEY)} < p GROUP BY ALL")
def sample_class_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("l_returnflag") == "A", 0.5).when(F.col("l_returnflag") == "R", 0.25).otherwise(-1.0)
    return sample.accepted(items(spark, sf_dir), p, 11, *map(F.col, KEY)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(
    "sample_mix",
    f"""
    WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), f AS (SELECT event_type, share / n AS rate FROM s JOIN (VALUES ('click', 3.0), ('purchase', 1.0), ('view', 2.0)) AS m(event_type, share) USING (event_type)),
    g AS (SELECT event_type, rate / max(rate) OVER () AS fraction FROM f)
    SELECT event_type, count(*) AS n FROM events JOIN g USING (event_type) WHERE {u_sql(3, "event_id")} < fraction GROUP BY ALL
    """,
)
def sample_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    f = sample.mix_fractions(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", {"click": 3.0, "purchase": 1.0, "view": 2.0})
    return sample.accepted(e.join(F.broadcast(f.drop("n")), "event_type"), F.col("fraction"), 3, F.col("event_id")).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "batch_interleave",
    """
    WITH p AS (SELECT event_id, event_type, per, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // per AS batch FROM events JOIN (VALUES ('click', 3), ('view', 5)) AS b(event_type, per) USING (event_type)),
    f AS (SELECT min(c // per) AS whole FROM (SELECT event_type, per, count(*) AS c FROM p GROUP BY ALL))
    SELECT batch::BIGINT AS batch, event_type, count(*) AS n, min(event_id) AS first_id FROM p, f WHERE batch < whole GROUP BY ALL
    """,
)
def batch_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sample.interleaved(e, "event_type", [F.col("event_id")], {"click": 3, "view": 5}).groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("drop_by_hist", f"SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem WHERE {u_sql(12345, *KEY)} < CASE WHEN l_quantity >= 30 THEN 1 ELSE exp(0.05 * (l_quantity - 30)) END GROUP BY ALL")
def drop_by_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sample.accepted(items(spark, sf_dir), sample.sieve(F.col("l_quantity"), 30.0), 12345, *map(F.col, KEY))
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))


@query("shuffle_deterministic", f"SELECT o_orderkey, row_number() OVER (ORDER BY {u_sql(5, 'o_orderkey')}, o_orderkey) AS place FROM orders")
def shuffle_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", uniform(5, F.col("o_orderkey")).alias("u"))
    return order.numbered(o, [F.col("u"), F.col("o_orderkey")]).select("o_orderkey", (F.col("n") + 1).alias("place"))


@query("acceptance_full", f"WITH a AS ({ACCEPT_SQL}), r AS (SELECT l_returnflag, {bin_sql('l_discount', X)} AS ix, {bin_sql('l_quantity', Y)} AS iy, {u_sql(1, *KEY)} AS u, {u_sql(2, *KEY)} AS v FROM lineitem) SELECT l_returnflag, count(*) AS n FROM a JOIN r USING (l_returnflag, ix, iy) WHERE u < probability AND v < CASE l_returnflag WHEN 'A' THEN 0.3 ELSE 0.9 END GROUP BY ALL")
def acceptance_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    chance = hist.acceptance(counted(spark, sf_dir), ["l_returnflag"])
    found = hist.look_up(items(spark, sf_dir).select(*KEY, "l_returnflag", "l_discount", "l_quantity"), F.broadcast(chance), ["l_returnflag"], axes(), "probability", 0.0)
    key = [F.col(k) for k in KEY]
    kept = sample.accepted(sample.accepted(found, F.col("probability"), 1, *key), F.when(F.col("l_returnflag") == "A", 0.3).otherwise(0.9), 2, *key)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


POISSON = sample.POISSON


def trial_sql(seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}|' || trial || '|' || concat_ws('-', {', '.join(KEY)})), 1, 8))::UBIGINT::DOUBLE / 4294967296.0)"


TRIAL_SQL = trial_sql(17)


@query(
    "bootstrap_mean",
    f"""
    WITH d AS (SELECT l_returnflag, trial, l_quantity AS x, {TRIAL_SQL} AS u FROM lineitem, (SELECT unnest(range(1, 21)) AS trial)), w AS (SELECT l_returnflag, trial, x, {" + ".join(f"(u >= {p!r})::INT" for p in POISSON)} AS n FROM d),
    m AS (SELECT l_returnflag, trial, sum(n * x) / sum(n) AS mean FROM w GROUP BY ALL) SELECT l_returnflag, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS error FROM m GROUP BY 1
    """,
)
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir)
    key = F.concat_ws("-", *KEY)
    return sample.bootstrap(i, ["l_returnflag"], key, F.col("l_quantity"), 20, 17).groupBy("l_returnflag").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.stddev_samp("mean"), 6).alias("error"))


TRIALS = 20


def weighted_sql(name: str, seed: int, where: str, sums: dict[str, str]) -> str:
    """Sums in the weight w of each trial; trial 0 is the rows as they are."""
    count = " + ".join(f"(u >= {p!r})::INT" for p in POISSON)
    made = ", ".join(f"sum({e}) AS {n}" for n, e in sums.items())
    return f"""{name} AS (SELECT l_returnflag, trial, {made} FROM (SELECT *, CASE WHEN trial = 0 THEN 1 ELSE {count} END AS w FROM
      (SELECT *, {trial_sql(seed)} AS u FROM lineitem, (SELECT unnest(range(0, {TRIALS + 1})) AS trial) WHERE {where})) GROUP BY ALL)"""


def errors_sql(of: str) -> str:
    """Value and errors from of: (l_returnflag, trial, v)."""
    return f"""
    a AS (SELECT l_returnflag, max(v) FILTER (WHERE trial = 0) AS c, list_sort(list(v) FILTER (WHERE trial > 0)) AS s FROM ({of}) GROUP BY 1), n AS (SELECT *, floor(len(s) * 0.31731)::INT AS gone FROM a),
    e AS (SELECT l_returnflag, s[k + 1] AS low, s[len(s) - (gone - k)] AS high FROM (SELECT *, unnest(range(0, gone + 1)) AS k FROM n) WHERE c BETWEEN s[k + 1] AND s[len(s) - (gone - k)]),
    b AS (SELECT l_returnflag, arg_min(low, (high - low, low)) AS low, arg_min(high, (high - low, low)) AS high FROM e GROUP BY 1)
    SELECT l_returnflag, round(c, 6) AS value, round(c - low, 6) AS down, round(high - c, 6) AS up, len(s)::INT AS trials FROM n LEFT JOIN b USING (l_returnflag)
    """


def with_errors(parts: list[DataFrame], value: Column) -> DataFrame:
    found = sample.resampled(parts, ["l_returnflag"], value)
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("value", "down", "up")], "trials")


#: Sums that a correlation of quantity and price is made of, in Spark and DuckDB alike.
MOMENTS = {"n": "w", "x": "w * l_quantity", "y": "w * l_extendedprice", "xx": "w * l_quantity * l_quantity", "yy": "w * l_extendedprice * l_extendedprice", "xy": "w * l_quantity * l_extendedprice"}
CORRELATION = "(n * xy - x * y) / (sqrt(n * xx - x * x) * sqrt(n * yy - y * y))"


@query("resampled_correlation", f"WITH {weighted_sql('t', 17, 'true', MOMENTS)}, {errors_sql(f'SELECT l_returnflag, trial, {CORRELATION} AS v FROM t')}")
def resampled_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of quantity and price with errors by resampling both together."""
    sums = {n: F.expr(e.replace("w", "__w", 1)) for n, e in MOMENTS.items()}
    i = items(spark, sf_dir).select(*KEY, "l_returnflag", "l_quantity", "l_extendedprice")
    return with_errors([sample.trial_sums(i, ["l_returnflag"], F.concat_ws("-", *KEY), sums, TRIALS, 17)], F.expr(CORRELATION))


@query("resampled_difference", f"WITH {weighted_sql('p', 17, 'l_discount > 0.05', {'n': 'w', 'x': 'w * l_quantity'})}, {weighted_sql('q', 18, 'l_discount <= 0.05', {'o': 'w', 'y': 'w * l_quantity'})}, {errors_sql('SELECT l_returnflag, trial, x / n - y / o AS v FROM p JOIN q USING (l_returnflag, trial)')}")
def resampled_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantity of lines with a high discount less that of the others; the two samples are drawn apart."""
    i = items(spark, sf_dir).select(*KEY, "l_returnflag", "l_quantity", "l_discount")
    key, w = F.concat_ws("-", *KEY), F.col("__w")
    high = sample.trial_sums(i.where("l_discount > 0.05"), ["l_returnflag"], key, {"n": w, "x": w * F.col("l_quantity")}, TRIALS, 17)
    low = sample.trial_sums(i.where("l_discount <= 0.05"), ["l_returnflag"], key, {"o": w, "y": w * F.col("l_quantity")}, TRIALS, 18)
    return with_errors([high, low], F.expr("try_divide(x, n) - try_divide(y, o)"))
