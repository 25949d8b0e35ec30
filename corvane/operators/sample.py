"""Reproducible sampling: every choice is a function of the seed and the row's key, never of the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import uniform
from corvane.operators import order


def accepted(df: DataFrame, probability: Column, seed: int, *key: Column) -> DataFrame:
    """Rows whose number lies under their probability; a negative probability takes all."""
    return df.where((probability < 0) | (uniform(seed, *key) < probability))


def sieve(pt: Column, low: float = 80.0, slope: float = 0.05) -> Column:
    """Chance of keeping a row under `low`, which falls exponentially; 1 from there on."""
    return F.when(pt >= low, 1.0).otherwise(F.exp(F.lit(slope) * (pt - low)))


def mix_fractions(sizes: DataFrame, name: str, shares: dict[str, float]) -> DataFrame:
    """Fraction of each group to take so that the shares hold and the scarcest group is used up. sizes: (name, n)."""
    table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    rate = F.try_divide(F.try_element_at(table, F.col(name)), F.col("n").cast("double"))
    return sizes.withColumn("rate", rate).where("rate > 0").withColumn("fraction", F.col("rate") / F.max("rate").over(Window.partitionBy())).drop("rate")


def interleaved(df: DataFrame, group: str, by: list[Column], per_batch: dict[str, int], batches: int | None = None) -> DataFrame:
    """Batch number of each row, every batch having so many rows of each group: as many batches as all groups can fill,
    or the number asked for, which a group that runs out of rows makes an error."""
    table = F.create_map(*[F.lit(x) for pair in per_batch.items() for x in pair])
    wanted = df.where(F.col(group).isin(list(per_batch)))
    sizes = {r[0]: r[1] for r in wanted.groupBy(group).agg(F.count("*")).collect()}  # one row for each group named
    full = min(sizes.get(g, 0) // n for g, n in per_batch.items())
    if batches is not None and full < batches:
        raise ValueError(f"a group runs out of rows after {full} of {batches} batches")
    placed = order.numbered(wanted, by, "__n", [group])
    return placed.withColumn("batch", F.floor(F.col("__n") / F.try_element_at(table, F.col(group))).cast("long")).drop("__n").where(F.col("batch") < (full if batches is None else batches))


def shuffled(df: DataFrame, seed: int, *key: Column) -> DataFrame:
    """Rows in an order that the seed and key decide."""
    return df.withColumn("__u", uniform(seed, *key)).orderBy("__u", *key).drop("__u")


#: Chances of a Poisson number of mean 1 to be at most 0, 1, 2, ...
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def poisson(v: Column) -> Column:
    """How often a row counts whose number is v, with a mean of 1."""
    return sum((F.when(v >= s, 1).otherwise(0) for s in POISSON), F.lit(0))


def bootstrap(df: DataFrame, keys: list[str], key: Column, x: Column, trials: int, seed: int) -> DataFrame:
    """Mean of x in each resampling trial: a row counts as often as a Poisson number of mean 1 that hangs on trial and
    key, so trials are partial sums and no row is copied about."""
    w = F.col("__w")
    sums = trial_sums(df.withColumn("__x", x), keys, key, {"__n": w, "__s": w * F.col("__x")}, trials, seed).where("trial > 0")
    return sums.select(*keys, "trial", F.try_divide("__s", "__n").alias("mean"))


def trial_sums(df: DataFrame, keys: list[str], key: Column, sums: dict[str, Column], trials: int, seed: int) -> DataFrame:
    """(keys, trial, sums): sums of expressions in the weight __w over each resampling trial, from 1, and in trial 0 over
    the rows as they are. A row counts as often as a number says that hangs on seed, trial and key, so neither partitions
    nor retries change a trial, and rows of one key are drawn together. Only sums are shuffled."""
    rows = df.withColumn("__k", key).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials))))
    # The number has its own step: inside a condition it would be computed once for each comparison.
    numbers = rows.withColumn("__u", uniform(seed, F.col("trial"), F.col("__k"))).withColumn("__p", poisson(F.col("__u")))
    return numbers.withColumn("__w", F.when(F.col("trial") == 0, 1).otherwise(F.col("__p"))).groupBy(*keys, "trial").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def resampled(parts: list[DataFrame], keys: list[str], value: Column, loss: float = 0.31731) -> DataFrame:
    """(keys, value, down, up, trials): an estimator, which is an expression of sums, with its errors below and above by
    resampling. parts are trial_sums() of one sample, or of several that are drawn apart, with different seeds and names.
    The errors reach to the ends of the shortest interval between trials that leaves out floor(trials * loss) of them and
    holds the value. Trials in which the estimator has no value do not count; a key whose value lies in no such interval,
    or that has too few trials to leave one out on the narrower side, has null errors, as has a key without a value."""
    if not 0 < loss < 1:
        raise ValueError("loss lies between 0 and 1")
    both = parts[0]
    for p in parts[1:]:
        both = order.same(both, p, [*keys, "trial"])
    of = both.withColumn("__v", value.cast("double"))
    found = of.groupBy(*keys).agg(F.max(F.when(F.col("trial") == 0, F.col("__v"))).alias("value"), F.array_sort(F.collect_list(F.when((F.col("trial") > 0) & ~F.isnan("__v"), F.col("__v")))).alias("__a"))
    n, v = F.size("__a"), F.col("value")
    out = F.floor(n * F.lit(loss)).cast("int")
    ends = F.transform(F.sequence(F.lit(0), out), lambda k: F.struct((F.get("__a", n - (out - k) - 1) - F.get("__a", k)).alias("width"), F.get("__a", k).alias("low"), F.get("__a", n - (out - k) - 1).alias("high")))
    best = F.array_min(F.filter(ends, lambda e: (e["low"] <= v) & (v <= e["high"])))
    enough = F.floor(n * F.lit(min(loss, 1 - loss))) >= 1
    rows = found.select(*keys, "value", F.when(enough, best).alias("__b"), n.alias("trials"))
    return rows.select(*keys, "value", (v - F.col("__b.low")).alias("down"), (F.col("__b.high") - v).alias("up"), "trials")


def even_shares(files: DataFrame, kind: str) -> DataFrame:
    """files with the chance of drawing from each, so that all kinds come alike and within a kind all its files."""
    own = files.groupBy(kind).agg(F.count("*").alias("__n"))
    kinds = own.agg(F.count("*").alias("__k"))
    return files.join(F.broadcast(own.join(kinds)), kind).withColumn("share", 1 / (F.col("__n") * F.col("__k"))).drop("__n", "__k")


#: Sources of a mixing loop, at most; their bounds are part of the plan. Steps of a part, and rows of a source in a part, of
#: which one is sorted at a time; they change no result.
SOURCES, STEPS, ROWS = 1_000, 1 << 22, 1 << 19


def drawn(spark: SparkSession, sizes: list[tuple[str, int]], seed: int, shares: dict[str, float] | None = None) -> DataFrame:
    """(step, source, turn) of a loop that draws a source at every step, with chances in proportion to its rows or to the
    shares, and takes its next row: the turn is how often it was drawn before. The loop ends before the first draw of a
    source without rows left. By then it has taken at most all rows, so one step more than rows is enough to find it."""
    if len(sizes) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    total, chances = sum(n for _, n in sizes), [float(shares.get(s, 0.0) if shares else n) for s, n in sizes]
    uppers, whole = [], sum(chances)
    for k in range(len(chances)):
        uppers.append(sum(chances[: k + 1]) / whole)
    if not whole:
        return spark.createDataFrame([], "step bigint, source string, turn bigint")
    # The number has its own step, as in trial_sums(), and the source is never null: a join's test for null would be pushed
    # below that step, where the number is computed once for each bound.
    passed = sum(((F.col("__u") >= e).cast("int") for e in uppers), F.lit(0))
    steps = spark.range(total + 1).select(F.col("id").alias("step"), uniform(seed, F.col("id")).alias("__u"))
    steps = steps.select("step", F.coalesce(F.get(F.array(*[F.lit(s) for s, _ in sizes]), passed), F.lit("")).alias("source"))
    part = F.floor(F.col("step") / STEPS).cast("int")
    rows = F.try_element_at(F.create_map(*[F.lit(x) for pair in sizes for x in pair]), F.col("source"))
    # The last draw lies in the first part in which a source is drawn once more than it has rows: that part alone is searched.
    draws = order.part_sizes(steps.withColumn(order.PART, part), ["source"])
    last = draws.where((F.col("__b") <= rows) & (rows < F.col("__b") + F.col("__c"))).agg(F.min(order.PART)).first()[0]
    upto = steps.where(F.col("step") < (last + 1) * STEPS)
    before = draws.where(F.col(order.PART) == last).select("source", F.col("__b").alias("before"))
    there = upto.where(F.col("step") >= last * STEPS).join(F.broadcast(before), "source")
    there = there.withColumn("turn", F.col("before") + F.row_number().over(Window.partitionBy("source").orderBy("step")) - 1)
    end = there.where(F.col("turn") == rows).agg(F.min("step")).first()[0]
    return order.numbered_by_parts(steps.where(F.col("step") < end), [F.col("step")], part, "turn", ["source"])


def mixed(df: DataFrame, source: Column, key: list[Column], seed: int, shares: dict[str, float] | None = None) -> DataFrame:
    """Rows that a mixing loop takes, with their source and step: each source gives its rows in an order that the seed and
    key decide, and nothing follows the step at which a source that has run out is drawn. Rows without a source, or with
    one that has no share, are never taken."""
    rows = df.withColumns({"source": source.cast("string"), "__u": uniform(seed + 1, *key)}).where("source is not null")
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.count("*").alias("n")).orderBy("source").limit(SOURCES + 1).collect()]
    parts = max((n for _, n in sizes), default=0) // ROWS + 1
    placed = order.numbered_by_parts(rows, [F.col("__u"), *key], F.floor(F.col("__u") * parts).cast("int"), "turn", ["source"]).drop("__u")
    return placed.join(drawn(df.sparkSession, sizes, seed, shares), ["source", "turn"]).drop("turn")
