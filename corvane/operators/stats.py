"""Mergeable statistics, weighted quantiles and order-dependent estimators."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import significant_digits
from corvane.operators import density, order
from corvane.sources import shared

#: Chance below a normal deviate of so many sigmas.
SIGMA_SHARES = {s: 0.5 * (1 + math.erf(s / math.sqrt(2))) for s in (-5, -3, -2, -1, 1, 2, 3, 5)}


def partial(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """Sums of a column that add up over any split of the rows: n, s1 and s2. NaN and infinities count as null."""
    finite = F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), x.cast("double"))
    return df.groupBy(*keys).agg(F.count(finite).alias("n"), F.sum(finite).alias("s1"), F.sum(finite * finite).alias("s2"))


def combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation from partial sums; null for fewer than two values."""
    total = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
    mean = F.col("s1") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    enough = F.col("n") > 1
    return total.select(*keys, "n", F.when(enough, mean).alias("mean"), F.when(enough, deviation).alias("std"))


def quantile_block(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median, extremes and quantiles at 1, 2, 3 and 5 sigmas on both sides, interpolated."""
    shares = {"median": 0.5} | {f"sigma_{'m' if s < 0 else 'p'}{abs(s)}": v for s, v in SIGMA_SHARES.items()}
    return quantiles(df, keys, x, shares).select(*keys, "min", "max", *shares)


#: Bins of one step of a selection, and the rows of a bin that are put in order at once.
SELECTION_BINS, SELECTION_ROWS = 4096, 1_000_000


def selected(rows: DataFrame, keys: list[str], wanted: Callable[[Column], list[Column]]) -> DataFrame:
    """(keys, value, end, count, n) of the distinct values of rows (keys, value: double) that hold a wanted place in order
    (wanted(n) gives them, from 0): `count` rows have the value, and `end` have it or a smaller one. No value is sorted to
    find them: each step counts the rows of equal bins between the ends of what is left, and goes on in the bins that hold
    a place. A bin of one value is done, however many rows have it; a bin or group of few rows is put in order. Infinite
    values and NaN, the largest, have bins of their own."""
    finite = ~F.isnan("value") & (F.abs("value") < F.lit(math.inf))
    ends = [F.min(F.when(finite, F.col("value"))).alias("lo"), F.max(F.when(finite, F.col("value"))).alias("hi")]
    groups = shared.written(rows.groupBy(*keys).agg(*ends, F.count("*").alias("n")).withColumn("before", F.lit(0).cast("long")), "selection")
    largest = groups.agg(F.max("n")).first()[0]
    by, left, found = list(keys), rows, []
    at = lambda end, n: F.exists(F.array(*wanted(F.col("n"))), lambda p: (p < end) & (p >= end - F.col("count")))

    def in_order(counts: DataFrame, by: list[str], order_by: str) -> DataFrame:
        end = F.col("before") + F.sum("count").over(Window.partitionBy(*by).orderBy(order_by))
        return counts.withColumn("end", end).where(at(F.col("end"), F.col("n")))

    while largest and largest > SELECTION_ROWS:
        name = f"__bin{len(by) - len(keys)}"
        width = F.col("hi") - F.col("lo")
        share = F.when(width < math.inf, F.try_divide(F.col("value") - F.col("lo"), width)).otherwise((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        inside = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share * SELECTION_BINS), F.lit(SELECTION_BINS - 1))).otherwise(0)
        k = F.when(F.isnan("value"), SELECTION_BINS + 1).when(F.col("value") == math.inf, SELECTION_BINS).when(F.col("value") == -math.inf, -1).otherwise(inside)
        placed = order.same(left, groups, by).withColumn(name, k.cast("int")).drop("lo", "hi")
        counts = placed.groupBy(*by, name, "before", "n").agg(F.count("*").alias("count"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        runs = shared.written(in_order(counts, by, name), "selection")
        found.append(runs.where("lo = hi").select(*keys, F.col("lo").alias("value"), "end", "count", "n"))
        open_ = runs.where("lo < hi")
        largest = open_.agg(F.max("count")).first()[0]
        by, left = [*by, name], placed.drop("before", "n")
        groups = open_.withColumn("before", F.col("end") - F.col("count")).drop("end", "count")
    counts = order.same(left, groups.drop("lo", "hi"), by).groupBy(*by, "value", "before", "n").agg(F.count("*").alias("count"))
    found.append(in_order(counts, by, "value").select(*keys, "value", "end", "count", "n"))
    return reduce(DataFrame.unionByName, found)


def quantiles(df: DataFrame, keys: list[str], x: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by linear interpolation between sorted values, with min, max and n, from the values that hold the two
    places beside each quantile. Nulls are left out. Without keys an empty table gives one row of nulls."""
    rows = df.select(*keys, F.col(x).cast("double").alias("value")).where("value is not null")

    def wanted(n: Column) -> list[Column]:
        return [F.lit(0).cast("long"), n - 1, *[f((n - 1) * F.lit(s)) for s in shares.values() for f in (F.floor, F.ceil)]]

    def held(place: Column) -> Column:
        return F.max(F.when((place < F.col("end")) & (place >= F.col("end") - F.col("count")), F.col("value")))

    places = {(side, name): f((F.col("n") - 1) * F.lit(share)) for name, share in shares.items() for side, f in (("l", F.floor), ("r", F.ceil))}
    found = [F.min("value").alias("min"), F.max("value").alias("max"), F.first("n").alias("n"), *[held(p).alias(f"__{side}_{name}") for (side, name), p in places.items()]]
    ends = selected(rows, keys, wanted).groupBy(*keys).agg(*found)

    def value(name: str, share: float) -> Column:
        low, high, at = F.col(f"__l_{name}"), F.col(f"__r_{name}"), (F.col("n") - 1) * F.lit(share)
        return (low + (high - low) * (at - F.floor(at))).alias(name)

    return ends.select(*keys, "min", "max", "n", *[value(*s) for s in shares.items()])


def weighted_quantile(df: DataFrame, keys: list[str], x: str, w: str, share: float) -> DataFrame:
    """Smallest x whose cumulative weight reaches share of the total. Equal values are summed first, and
    running sums take no window over a key's values."""
    at = order.crossing(df.groupBy(*keys, x).agg(F.sum(w).alias("w")), keys, [F.col(x)], "w", share)
    return at.select(*keys, F.col(x).alias("quantile"))


def midpoint_quantile(df: DataFrame, keys: list[str], x: str, w: str, share: float) -> DataFrame:
    """Quantile by linear interpolation between values placed at the middle of their weight."""
    placed = order.running(df.groupBy(*keys, x).agg(F.sum(w).alias("w")), keys, [F.col(x)], {"c": "w"})
    point = F.struct(((F.col("c") - F.col("w") / 2) / F.col("c_total")).alias("at"), F.col(x).cast("double").alias("x"))
    below, above = F.max(F.when(point["at"] <= share, point)), F.min(F.when(point["at"] > share, point))
    ends = placed.groupBy(*keys).agg(below.alias("l"), above.alias("r"))
    inside = F.col("l.x") + (F.col("r.x") - F.col("l.x")) * (F.lit(share) - F.col("l.at")) / (F.col("r.at") - F.col("l.at"))
    return ends.select(*keys, F.coalesce(inside, F.col("l.x"), F.col("r.x")).alias("quantile"))


def first_wins(df: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key, with the number of rows that had it."""
    w = Window.partitionBy(*key)
    return df.withColumns({"__n": F.row_number().over(w.orderBy(*by)), "copies": F.count("*").over(w)}).where("__n = 1").drop("__n")


def variable_check(df: DataFrame, columns: list[str], flat: float = 1e-12) -> DataFrame:
    """One row for each column: extremes, mean, population deviation, largest and mean magnitude, and whether it is
    constant."""
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (name, x)")
    found = long.groupBy("name").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("avg"), F.stddev_pop("x").alias("std"), F.max(F.abs("x")).alias("abs_max"), F.avg(F.abs("x")).alias("abs_avg"))
    return found.withColumn("is_const", F.coalesce(F.col("std") <= flat, F.lit(True)))


def central_interval(df: DataFrame, keys: list[str], x: str, centre: str, loss: float = 0.31731) -> DataFrame:
    """Shortest interval between sorted values that leaves out floor(n * loss) of them and holds the centre."""
    placed = order.numbered(df.select(*keys, x, centre), [F.col(x)], "k", keys, total="n")
    out = F.floor(F.col("n") * loss)
    high = placed.select(*keys, F.col("k").alias("k2"), F.col(x).alias("high"))
    cut = placed.where(F.col("k") <= out).withColumn("k2", F.col("n") - (out - F.col("k")) - 1)
    pairs = cut.join(high, [*keys, "k2"]).where((F.col(centre) >= F.col(x)) & (F.col(centre) <= F.col("high")))
    best = F.min(F.struct((F.col("high") - F.col(x)).alias("width"), F.col(x).alias("low"), F.col("high").alias("high"))).alias("b")
    return pairs.groupBy(*keys).agg(best).select(*keys, F.col("b.low").alias("low"), F.col("b.high").alias("high"))


def interquartile_range(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median of the upper half less median of the lower half, with the Freedman-Diaconis bin size."""
    placed = order.numbered(df.select(*keys, F.col(x).cast("double").alias("x")), [F.col("x")], "k", keys, total="n").withColumn("k", F.col("k") + 1)
    half = F.floor(F.col("n") / 2)
    middle = lambda first: F.col("k").between(first + F.floor((half + 1) / 2), first + F.floor(half / 2) + 1)
    of = placed.groupBy(*keys).agg(F.avg(F.when(middle(F.lit(0)), F.col("x"))).alias("q1"), F.avg(F.when(middle(F.col("n") - half), F.col("x"))).alias("q3"), F.max("n").alias("n"))
    iqr = F.col("q3") - F.col("q1")
    return of.select(*keys, iqr.alias("iqr"), (F.lit(2.0) * iqr / F.pow(F.col("n"), F.lit(1.0 / 3.0))).alias("bin_size"))


def information(sample: DataFrame, x: str, y: str, bandwidths: tuple[float, float]) -> DataFrame:
    """One row of entropies (bits, by kernel densities) of two columns, their mutual information, and scaled_mi, 1 less
    its share of the larger entropy. Fully correlated columns have infinite mutual information; fewer than two rows are
    an error."""
    pairs = sample.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    n, correlation = pairs.agg(F.count("*"), F.corr("x", "y")).first()
    if n < 2:
        raise ValueError("mutual information needs two rows")
    points = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    points = density.kde(pairs, points, "x", bandwidths[0]).withColumnRenamed("density", "px")
    points = density.kde(pairs, points, "y", bandwidths[1]).withColumnRenamed("density", "py")
    bound = correlation is not None and abs(correlation) >= 1
    if not bound:
        points = density.kde_2d(pairs, points, "x", "y", bandwidths, correlation or 0.0)
    mean = lambda e: F.sum(F.col("n") * e) / F.sum("n")
    mi = F.lit(math.inf) if bound else mean(F.log2(F.col("density") / (F.col("px") * F.col("py"))))
    found = points.agg(mean(-F.log2("px")).alias("entropy_x"), mean(-F.log2("py")).alias("entropy_y"), mi.alias("mutual"))
    return found.withColumn("scaled_mi", 1 - F.col("mutual") / F.greatest("entropy_x", "entropy_y"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two quantities (value, down, up) agree within their errors towards each other."""
    gap = F.abs(a["value"] - b["value"])
    return F.when(a["value"] < b["value"], gap <= b["down"] + a["up"]).when(a["value"] > b["value"], gap <= a["down"] + b["up"]).otherwise(a["value"] == b["value"])


def jobs_combined(jobs: DataFrame, keys: list[str], fixed: list[str], digits: int = 4) -> DataFrame:
    """Results of jobs (keys, n, mean, sqmean, fixed columns) merged by weight: n, mean and std with so many significant
    digits. The fixed columns must be the same in all jobs of a key."""
    n = F.sum("n")
    same = [F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit(f"jobs differ in {c}")).cast("double")).alias(c) for c in fixed]
    mean, square = F.sum(F.col("mean") * F.col("n")) / n, F.sum(F.col("sqmean") * F.col("n")) / n
    found = jobs.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), *same)
    return found.withColumns({c: significant_digits(F.col(c), digits) for c in ("mean", "std")})
