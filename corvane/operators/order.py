"""Global order without a window over all rows: row numbers, equal tiles, running sums and neighbours.

Rows are range-partitioned and sorted, and each gets its partition and its place there; the table is written to the
shared folder, so every later step sees the same partitions. What a partition must know of those before it is one row
for each partition and key, and only those rows meet in one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources import shared

PART, AT = "__part", "__at"


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with its partition in a global order and its place there, from 0. Rows that order does not tell apart stand in
    any order."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return shared.written(placed.withColumns({PART: F.shiftright(AT, 33).cast("int"), AT: F.col(AT).bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; right's keys are dropped."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right is one row
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def numbered(df: DataFrame, order: list[Column], name: str = "n", keys: list[str] | None = None, total: str | None = None) -> DataFrame:
    """df with the number of each row in order, from 0, within keys if given; and the number of rows, if named."""
    keys = keys or []
    placed = ranged(df, [*map(F.col, keys), *order])
    parts = placed.groupBy(*keys, PART).agg(F.count("*").alias("__c"), F.min(AT).alias("__f"))
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*keys, PART, (F.coalesce(F.sum("__c").over(up), F.lit(0)) - F.col("__f")).alias("__b"), *([F.sum("__c").over(every).alias(total)] if total else []))
    out = placed.join(F.broadcast(before), PART) if not keys else same(placed, before, [*keys, PART])
    return out.withColumn(name, F.col("__b") + F.col(AT)).drop("__b", PART, AT)


def numbered_by_parts(df: DataFrame, order: list[Column], part: Column, name: str, keys: list[str]) -> DataFrame:
    """As numbered() within keys, where a number of few values is known that rises with the order: rows are sorted only
    within their part, and no table is written. df is read twice, so it must give the same rows each time."""
    rows = df.withColumn(PART, part)
    sizes = part_sizes(rows, keys)
    w = Window.partitionBy(*keys, PART).orderBy(*order)
    placed = same(rows.withColumn(AT, F.row_number().over(w)), F.broadcast(sizes.drop("__c")), [*keys, PART])
    return placed.withColumn(name, F.col("__b") + F.col(AT) - 1).drop("__b", PART, AT)


def part_sizes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, __c, __b): the rows of each part, and those of the parts before it."""
    up = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*keys, PART).agg(F.count("*").alias("__c"))
    return sizes.withColumn("__b", F.coalesce(F.sum("__c").over(up), F.lit(0).cast("bigint")))


def tiles(df: DataFrame, order: list[Column], n: int, name: str) -> DataFrame:
    """df with the number of its tile: n equal runs of rows in order, with none left over."""
    placed = numbered(df, order, "__n", total="__t")
    return placed.withColumn(name, F.floor(F.col("__n") * n / F.col("__t")).cast("int")).drop("__n", "__t")


def crossing(df: DataFrame, keys: list[str], order: list[Column], weight: str, share: float) -> DataFrame:
    """First row of each key, in an order that tells rows apart, at which the running sum of a weight (not negative)
    reaches a share of its total. Only the partition in which that happens is summed row by row."""
    placed = ranged(df, [*map(F.col, keys), *order])
    parts = placed.groupBy(*keys, PART).agg(F.sum(weight).alias("__p"))
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(PART)
    sums = parts.select(*keys, PART, F.sum("__p").over(up).alias("__s"), "__p", F.sum("__p").over(every).alias("__t"))
    reached = F.col("__s") >= F.lit(share) * F.col("__t")
    where = sums.where(reached).groupBy(*keys).agg(F.min(F.struct(PART, (F.col("__s") - F.col("__p")).alias("__b"), "__t")).alias("__w")).select(*keys, "__w.*")
    own = same(placed, where, [*keys, PART])
    here = Window.partitionBy(*keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    first = own.withColumn("__s", F.col("__b") + F.sum(weight).over(here)).where(F.col("__s") >= F.lit(share) * F.col("__t"))
    rest = [c for c in df.columns if c not in keys]
    return first.groupBy(*keys).agg(F.min_by(F.struct(*rest), AT).alias("__r")).select(*keys, "__r.*")


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with running sums within keys, in an order that tells rows apart: sums maps a new column to the one summed. The
    total of each is in the column with _total behind the new name."""
    placed = ranged(df, [*map(F.col, keys), *order])
    parts = placed.groupBy(*keys, PART).agg(*[F.sum(c).alias(f"__p_{n}") for n, c in sums.items()])
    every, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(*keys, PART, *[F.coalesce(F.sum(f"__p_{n}").over(up), F.lit(0)).alias(f"__b_{n}") for n in sums], *[F.sum(f"__p_{n}").over(every).alias(f"{n}_total") for n in sums])
    here = Window.partitionBy(*keys, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"__l_{n}": F.sum(c).over(here) for n, c in sums.items()})
    out = same(local, before, [*keys, PART])
    return out.withColumns({n: F.col(f"__b_{n}") + F.col(f"__l_{n}") for n in sums}).drop(PART, AT, *[f"__{a}_{n}" for a in "bl" for n in sums])


def between(df: DataFrame, order: list[Column], point: Column, before: str, after: str) -> DataFrame:
    """df with the last point at or before each row and the first one at or after it; rows where point is null have
    none."""
    placed = ranged(df.withColumn("__v", point), order)
    up = Window.partitionBy(PART).orderBy(AT)
    back, ahead = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(0, Window.unboundedFollowing)
    seen = F.col("__v").isNotNull()
    ends = placed.groupBy(PART).agg(F.max_by("__v", F.when(seen, F.col(AT))).alias("__last"), F.min_by("__v", F.when(seen, F.col(AT))).alias("__first"))
    w = Window.orderBy(PART)
    carried = ends.select(PART, F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__b"), F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__a"))
    out = placed.withColumns({"__lb": F.last("__v", True).over(back), "__la": F.first("__v", True).over(ahead)}).join(F.broadcast(carried), PART)
    return out.withColumns({before: F.coalesce("__lb", "__b"), after: F.coalesce("__la", "__a")}).drop("__v", "__lb", "__la", "__a", "__b", PART, AT)
