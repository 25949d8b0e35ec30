"""Queries on projections, predicates, joins, set operations, strings, maps and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import classify, numeric
from corvane.functions.numeric import bit, guarded, pack_bits, ratio_score, significance
from corvane.operators import match
from corvane.queries import query, table
from corvane.sources import io


def t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


items, orders, events, customers, parts, suppliers = map(t, ("lineitem", "orders", "events", "customer", "part", "supplier"))


@query("filter_strict_bins", "SELECT count(*) FILTER (l_quantity > 10 AND l_quantity < 40 AND abs(l_discount) < 0.08) AS strict, count(*) FILTER (l_quantity >= 10 AND l_quantity < 40) AS closed_low, count(*) FILTER (l_quantity > 10 AND l_quantity <= 40) AS closed_high FROM lineitem")
def filter_strict_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    inside = lambda text: numeric.Interval.parse(text).contains(q)
    return items(spark, sf_dir).agg(F.count_if(inside("(10:40)") & (F.abs("l_discount") < 0.08)).alias("strict"), F.count_if(inside("[10:40)")).alias("closed_low"), F.count_if(inside("(10:40]")).alias("closed_high"))


@query("bitset_pack_test", "WITH b AS (SELECT p_partkey, (p_size > 10)::INT + 2 * (p_size > 25)::INT + 4 * (p_retailprice > 1500)::INT AS bits FROM part) SELECT bits, count(*) AS n, bits & 2 <> 0 AS medium FROM b GROUP BY 1")
def bitset_pack_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = pack_bits([F.col("p_size") > 10, F.col("p_size") > 25, F.col("p_retailprice") > 1500])
    return parts(spark, sf_dir).select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n")).withColumn("medium", bit(F.col("bits"), 1))


MATCH_SQL = "CASE WHEN l_linenumber >= 3 THEN CASE WHEN l_discount * 4 <= 0.2 AND l_quantity >= CASE WHEN k = 5 THEN 15 ELSE 8 END THEN k END WHEN l_tax > 0.02 THEN 6 END"
CLASS_SQL = "CASE " + " ".join(f"WHEN m = {m} AND s = {s} THEN {c}" for (m, s), c in classify.CLASS_OF.items()) + " ELSE -1 END"


@query("classify_case", f"WITH r AS (SELECT *, (l_partkey % 5 + 1)::INT AS k, (l_suppkey % 3)::INT AS s FROM lineitem), m AS (SELECT s, {MATCH_SQL} AS m FROM r) SELECT m AS match, s AS sample, {CLASS_SQL} AS class, count(*) AS n FROM m GROUP BY ALL")
def classify_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.col("l_partkey") % 5 + 1).cast("int")
    lepton = F.when(F.col("l_linenumber") >= 3, 0).otherwise(-1)
    jet = F.when(F.col("l_tax") > 0.02, 0).otherwise(-1)
    m = classify.gen_match(kind, lepton, jet, F.col("l_discount") * 4, F.col("l_quantity"))
    r = items(spark, sf_dir).select(m.alias("match"), (F.col("l_suppkey") % 3).cast("int").alias("sample"))
    return r.groupBy("match", "sample").agg(F.count("*").alias("n")).withColumn("class", classify.candidate_class(F.col("match"), F.col("sample")))


OPEN_SQL = MATCH_SQL.replace("<= 0.2", "< 0.2")


@query("classify_open_edge", f"SELECT m AS match, count(*) AS n FROM (SELECT {OPEN_SQL} AS m FROM (SELECT *, (l_partkey % 5 + 1)::INT AS k FROM lineitem)) GROUP BY 1")
def classify_open_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match by kind with its distance below the edge instead of up to it."""
    kind = (F.col("l_partkey") % 5 + 1).cast("int")
    lepton, jet = F.when(F.col("l_linenumber") >= 3, 0).otherwise(-1), F.when(F.col("l_tax") > 0.02, 0).otherwise(-1)
    m = classify.gen_match(kind, lepton, jet, F.col("l_discount") * 4, F.col("l_quantity"), edge_open=True)
    return items(spark, sf_dir).groupBy(m.alias("match")).agg(F.count("*").alias("n"))


@query("classify_variants", "SELECT CASE WHEN l_linenumber > 2 AND l_quantity > 20 AND l_tax < 2.4 THEN CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN 0 END END AS kind, count(*) AS n, count(*) FILTER (l_linenumber > 2 AND l_quantity > 20 AND l_returnflag = 'A' AND l_discount < 0.04) AS cut FROM lineitem GROUP BY 1")
def classify_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    tau, plain = F.col("l_returnflag") == "A", (F.col("l_linestatus") == "O") & (F.col("l_discount") > 0.05)
    args = [F.when(F.col("l_linenumber") > 2, 1).otherwise(-1), F.col("l_quantity"), F.col("l_tax"), tau, F.lit(1), F.lit(21.0), F.lit(0.0), plain]
    kind = classify.jet_type(*args)
    cut = classify.jet_type(*args, cuts=F.col("l_discount") < 0.04) == 1
    return items(spark, sf_dir).select(kind.alias("kind"), cut.alias("c")).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("c").alias("cut"))


@query("particle_types", "SELECT p_size, CASE p_size " + " ".join(f"WHEN {k} THEN {v}" for k, v in classify.PARTICLE_TYPES.items()) + " ELSE 0 END AS kind, count(*) AS n FROM part GROUP BY 1")
def particle_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).groupBy("p_size").agg(F.count("*").alias("n")).withColumn("kind", classify.particle_type(-F.col("p_size")))


@query("one_hot_labels", "SELECT event_id, (event_type = 'click')::INT AS label_click, (event_type = 'purchase')::INT AS label_purchase, [(event_type = 'view')::INT, (event_type = 'click')::INT] AS labels FROM events")
def one_hot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.tensor import one_hot

    is_ = lambda v: (F.col("event_type") == v).cast("int")
    return events(spark, sf_dir).select("event_id", is_("click").alias("label_click"), is_("purchase").alias("label_purchase"), one_hot(F.col("event_type"), ["view", "click"]).alias("labels"))


@query("column_regex_select", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def column_regex_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = items(spark, sf_dir)
    return df.select(io.chosen_columns(df.columns, ["^l_order", "^l_(quant|ret)", "l_tax"], ["l_tax"]))


@query("scale_clamp", "SELECT l_returnflag, round(sum(least(greatest((l_quantity - 25) / 10, -1), 1)), 6) AS s FROM lineitem GROUP BY 1")
def scale_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.sum(numeric.clamp_scale(F.col("l_quantity"), 25, 10, -1, 1)), 6).alias("s"))


@query(
    "guarded_ratio_flags",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE 0 END, 6) AS ratio, round(CASE WHEN l_tax > 0 THEN abs(l_discount - 0.05) / l_tax ELSE 0 END, 6) AS sig, round(CASE WHEN l_tax > 0 THEN l_tax / (l_tax + l_discount) ELSE 0 END, 6) AS score, l_discount <> 0 AS is_normal FROM lineitem",
)
def guarded_ratio_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, x = F.col("l_discount"), F.col("l_tax")
    return items(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(guarded(x, d), 6).alias("ratio"), F.round(significance(d - 0.05, x), 6).alias("sig"), F.round(ratio_score(x, d), 6).alias("score"), numeric.is_normal(d).alias("is_normal"))


@query(
    "string_functions",
    """
    SELECT c_custkey, len(list_distinct(string_split_regex(trim(c_name), '[#]+'))) AS pieces, try_cast(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number, concat_ws(':', c_custkey, c_nationkey, c_mktsegment) AS event_id,
      replace('id_{wp}', '{wp}', c_mktsegment) AS named, regexp_full_match(c_name, '[A-Za-z]+#[0-9]+') AS fits, reverse(c_mktsegment) AS back FROM customer
    """,
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return customers(spark, sf_dir).select(
        "c_custkey", F.size(F.array_distinct(F.split(F.trim(name), "[#]+"))).cast("long").alias("pieces"), F.regexp_extract(name, "([0-9]+)$", 1).try_cast("long").alias("number"), F.concat_ws(":", "c_custkey", "c_nationkey", "c_mktsegment").alias("event_id"),
        F.replace(F.lit("id_{wp}"), F.lit("{wp}"), F.col("c_mktsegment")).alias("named"), name.rlike("^(?:[A-Za-z]+#[0-9]+)$").alias("fits"), F.reverse("c_mktsegment").alias("back"),
    )


@query("json_params", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def json_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = events(spark, sf_dir).select("event_type", F.from_json("props", "map<string,bigint>").alias("m"))
    return maps.select("event_type", F.explode("m").alias("name", "v")).where("name = 'k'").groupBy("event_type").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("map_set_functions", "SELECT event_type, list_sort(list_distinct(list((props->>'$.k')::BIGINT))) AS ks FROM events GROUP BY 1")
def map_set_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.map_values(F.from_json("props", "map<string,bigint>"))
    each = events(spark, sf_dir).select("event_type", F.explode(values).alias("k")).distinct()
    return each.groupBy("event_type").agg(F.array_sort(F.collect_list("k")).alias("ks"))


@query("join_equi", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def join_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = orders(spark, sf_dir).join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return sums.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n", F.round("s", 2).alias("total"))


@query("join_left", "SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return customers(spark, sf_dir).select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round("s", 2), F.lit(0.0)).alias("total"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).join(orders(spark, sf_dir).where("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).join(items(spark, sf_dir).where("l_quantity > 45"), F.col("l_partkey") == F.col("p_partkey"), "left_anti").select("p_partkey")


@query("join_theta", "SELECT s_suppkey, count(*) AS n FROM supplier JOIN customer ON s_nationkey = c_nationkey AND abs(s_acctbal - c_acctbal) < 500 GROUP BY 1")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range is a little wider than the condition, which is then tested as it stands: the sum of a balance and 500 is
    rounded otherwise than the difference of two balances."""
    s = suppliers(spark, sf_dir).select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("y"), (F.col("s_acctbal") - 501).alias("low"), (F.col("s_acctbal") + 501).alias("high"))
    c = customers(spark, sf_dir).select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"))
    return match.range_join(c, s, "x", "low", "high", 1000.0, ["nation"]).where(F.abs(F.col("y") - F.col("x")) < 500).groupBy("s_suppkey").agg(F.count("*").alias("n"))


@query("join_range", "SELECT k, count(*) AS n FROM events JOIN (VALUES (1, 0.0::DOUBLE, 12.5::DOUBLE), (2, 10.0, 55.0), (3, 50.0, 51.0)) AS r(k, lo, hi) ON value >= lo AND value < hi GROUP BY 1")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([(1, 0.0, 12.5), (2, 10.0, 55.0), (3, 50.0, 51.0)], "k int, lo double, hi double")
    return match.range_join(events(spark, sf_dir).select("value"), r, "value", "lo", "hi", 10.0).groupBy("k").agg(F.count("*").alias("n"))


@query("join_asof", "SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase"))
    return match.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), p, ["user_id"], "ts", ["last_purchase"], width=7 * 86400.0).select("event_id", "last_purchase")


@query("match_outer_complete", "SELECT coalesce(o_custkey, c_custkey) AS id, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 450000) FULL JOIN customer ON o_custkey = c_custkey")
def match_outer_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = orders(spark, sf_dir).where("o_totalprice > 450000").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return match.completed(m, customers(spark, sf_dir).select(F.col("c_custkey").alias("id")), ["id"])


@query(
    "positional_concat",
    """
    WITH a AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents), b AS (SELECT doc_id AS longest, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)
    SELECT r - 1 AS "row", doc_id, n_chars, longest, coalesce(toxic, 0) AS toxic FROM a JOIN b USING (r) LEFT JOIN labels USING (doc_id)
    """,
)
def positional_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of documents side by side by place, each in its own order, and labels scattered back to their rows."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ranked = d.select(F.col("doc_id").alias("longest"), F.col("n_chars").alias("of"))
    both = match.by_position([(d, [F.col("doc_id")]), (ranked, [F.desc("of"), F.col("longest")])])
    l = table(spark, sf_dir, "labels").select("doc_id", "toxic")  # noqa: E741
    return both.join(l, "doc_id", "left").select("row", "doc_id", "n_chars", "longest", F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("setops_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
def setops_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query("setops_intersect", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def setops_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).select(F.col("s_nationkey").alias("k")).intersect(customers(spark, sf_dir).select("c_nationkey"))


@query("setops_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def setops_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select(F.col("c_custkey").alias("k")).subtract(orders(spark, sf_dir).where("o_orderstatus = 'F'").select("o_custkey"))


@query("filter_project_expr", "SELECT o_orderkey AS in_orderkey, round(o_totalprice / 1000, 6) AS in_k FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT o_orderpriority IN ('1-URGENT') AND abs(o_totalprice - 100000) < 50000")
def filter_project_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir).where("(o_orderstatus = 'F' or o_orderstatus = 'P') and not o_orderpriority in ('1-URGENT')").where("abs(o_totalprice - 100000) < 50000")
    return df.select(F.col("o_orderkey").alias("orderkey"), F.round(F.col("o_totalprice") / 1000, 6).alias("k")).withColumnsRenamed({c: f"in_{c}" for c in ("orderkey", "k")})


@query("parity_filter", "SELECT o_orderkey % 2 AS parity, count(*) AS n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1")
def parity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).where("o_orderkey % 2 = 1").groupBy((F.col("o_orderkey") % 2).alias("parity")).agg(F.count("*").alias("n"))


@query("null_sentinel_clean", "SELECT l_returnflag, count(x) AS valid, round(avg(x), 6) AS mean FROM (SELECT l_returnflag, CASE WHEN l_linenumber <> 4 AND l_quantity > 5 THEN l_quantity END AS x FROM lineitem) GROUP BY 1")
def null_sentinel_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("l_linenumber") == 4, F.lit(-1.7976931348623157e308)).otherwise(F.col("l_quantity"))
    clean = F.when(F.col("x") > -1.7976931348623157e308, F.col("x"))
    r = items(spark, sf_dir).select("l_returnflag", raw.alias("x")).withColumn("x", clean).withColumn("x", F.when(F.col("x") > 5, F.col("x")))
    return r.groupBy("l_returnflag").agg(F.count("x").alias("valid"), F.round(F.avg("x"), 6).alias("mean"))


@query("feature_lists_remap", "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE -1 END AS dataset, list_position(['purchase', 'click', 'view'], event_type) AS place FROM events")
def feature_lists_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, ("purchase", "click", "view"))), F.col("event_type"))
    return events(spark, sf_dir).select("event_id", F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(-1).alias("dataset"), F.when(place > 0, place.cast("int")).alias("place"))


@query("link_pairs", "SELECT l_orderkey, count(*) AS n, count(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY 1")
def link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir).where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    p = parts(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return items(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey").join(s, "l_suppkey", "left_semi").join(p, "l_partkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


@query(
    "filemap_curve_lookup",
    """
    WITH curves AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS points, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ALL)
    SELECT c_mktsegment AS segment, points, mean FROM (SELECT DISTINCT c_mktsegment FROM customer) JOIN (VALUES ('AUTOMOBILE', 'F', '1-URGENT'), ('BUILDING', 'O', '5-LOW'), ('MACHINERY', 'P', '3-MEDIUM')) AS m(c_mktsegment, status, priority) USING (c_mktsegment) JOIN curves USING (status, priority)
    """,
)
def filemap_curve_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map names the curve of each segment; each wanted key must have exactly one curve."""
    curves = orders(spark, sf_dir).groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("points"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    names = spark.createDataFrame([("AUTOMOBILE", "F", "1-URGENT"), ("BUILDING", "O", "5-LOW"), ("MACHINERY", "P", "3-MEDIUM")], "segment string, status string, priority string")
    segments = customers(spark, sf_dir).select(F.col("c_mktsegment").alias("segment")).distinct()
    return io.exactly_one(segments.join(names, "segment"), curves, ["status", "priority"]).select("segment", "points", "mean")


@query("merge_sort_collections", "SELECT kind, id, bal, row_number() OVER (ORDER BY bal DESC, kind, id)::INT AS place FROM (SELECT 's' AS kind, s_suppkey AS id, s_acctbal AS bal FROM supplier UNION ALL SELECT 'c', c_custkey, c_acctbal FROM customer) QUALIFY place <= 100")
def merge_sort_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir).select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    c = customers(spark, sf_dir).select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    top = s.unionByName(c).orderBy(F.desc("bal"), "kind", "id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("bal"), "kind", "id")))


@query("integer_split_unscale", "SELECT l_linenumber, l_linenumber // 5 AS prongs, l_linenumber % 5 AS neutrals, round(l_discount * 980 + 20, 6) AS pt, greatest(l_quantity, l_tax * 1000) AS most FROM lineitem")
def integer_split_unscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("l_linenumber", F.expr("cast(l_linenumber div 5 as int)").alias("prongs"), (F.col("l_linenumber") % 5).alias("neutrals"), F.round(F.col("l_discount") * 980 + 20, 6).alias("pt"), F.greatest("l_quantity", F.col("l_tax") * 1000).alias("most"))


@query("hash_ids", "SELECT c_custkey, substr(md5(c_name), 1, 16) AS id FROM customer")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).select("c_custkey", F.substring(F.md5("c_name"), 1, 16).alias("id"))


@query("sample_lumi_weight", "SELECT o_orderstatus, count(*) AS n, round(59.7 / (count(*) * 3), 9) AS weight, min(o_totalprice) >= 0 AS in_range FROM orders GROUP BY 1")
def sample_lumi_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.lit(59.7) / (F.count("*") * 3), 9).alias("weight"), (F.min("o_totalprice") >= 0).alias("in_range"))


@query("job_split", "SELECT job, count(*) AS n, min(o_orderkey) AS first FROM (SELECT o_orderkey, floor((row_number() OVER (ORDER BY o_orderkey) - 1) * 7 / count(*) OVER ())::INT AS job FROM orders) GROUP BY 1")
def job_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.job_split(orders(spark, sf_dir).select("o_orderkey"), ["o_orderkey"], 7).groupBy("job").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"))


@query("file_inventory", "SELECT 'orders.parquet' AS file, count(*) AS rows FROM orders")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.inventory(orders(spark, sf_dir)).select(F.regexp_extract("file", "(orders[^/]*)(?:/.*)?$", 1).alias("file"), "rows").groupBy("file").agg(F.sum("rows").alias("rows"))


#: Points of two axes, and a range with an open end.
DISCOUNTS, QUANTITIES, PRICES = numeric.grid("0:0.1:0.02"), numeric.grid("1:41|5"), numeric.Interval.parse("[1000:40000)")


@query(
    "ranges_and_grids",
    f"""
    WITH g AS (SELECT i, j, ({DISCOUNTS!r}::DOUBLE[])[i] AS x, ({QUANTITIES!r}::DOUBLE[])[j] AS y FROM (SELECT unnest(range(1, {len(DISCOUNTS) + 1})) AS i), (SELECT unnest(range(1, {len(QUANTITIES) + 1})) AS j)),
    c AS (SELECT len(list_filter({DISCOUNTS!r}::DOUBLE[], lambda e: e <= l_discount)) AS i, len(list_filter({QUANTITIES!r}::DOUBLE[], lambda e: e <= l_quantity)) AS j, count(*) AS n FROM lineitem WHERE l_extendedprice >= {PRICES.low} AND l_extendedprice < {PRICES.high} GROUP BY 1, 2)
    SELECT x, y, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (i, j)
    """,
)
def ranges_and_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows at each point of a grid of two axes, up to the next points, whose price is in a range; points without rows too."""
    points = lambda values, name: F.posexplode(F.array(*map(F.lit, values))).alias(f"{name}_at", name)
    grid = spark.range(1).select(points(DISCOUNTS, "x")).select("*", points(QUANTITIES, "y"))
    rows = table(spark, sf_dir, "lineitem").where(PRICES.contains(F.col("l_extendedprice")))
    counts = rows.groupBy((numeric.edge_bin(F.col("l_discount"), DISCOUNTS) - 1).alias("x_at"), (numeric.edge_bin(F.col("l_quantity"), QUANTITIES) - 1).alias("y_at")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["x_at", "y_at"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows."""
    return events(spark, sf_dir).groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("ext_sliding", "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1")
def ext_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sliding windows."""
    return events(spark, sf_dir).groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("ext_session", "WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 12 HOUR, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: session windows."""
    return events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
