"""Histograms as DataFrames: one row for each key and bin, with n, sumw and sumw2. Bin 0 and bins + 1 hold what lies
outside. Every operation is a group-by or a join on bin numbers, whose count does not depend on the rows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.numeric import Interval, uniform_bin


class Axis(NamedTuple):
    low: float
    high: float
    bins: int
    close_top: bool = False

    def bin(self, x: Column) -> Column:
        return uniform_bin(x, self.low, self.high, self.bins, self.close_top)

    def edge(self, k: Column) -> Column:
        """Lower edge of bin k."""
        return F.lit(self.low) + (k - 1) * F.lit(self.width)

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.bins


def fill(df: DataFrame, keys: list[str], axes: dict[str, tuple[Column, Axis]], weight: Column | None = None) -> DataFrame:
    """Histogram by keys; axes maps a bin column's name to its value and axis. Null values are left out."""
    w = F.lit(1.0) if weight is None else weight
    rows = df.select(*keys, *[axis.bin(x).alias(name) for name, (x, axis) in axes.items()], w.alias("w")).dropna(subset=list(axes))
    return rows.groupBy(*keys, *axes).agg(F.count("*").alias("n"), F.sum("w").alias("sumw"), F.sum(F.col("w") * F.col("w")).alias("sumw2"))


def rebin(hist: DataFrame, name: str, source: Axis, target: Axis) -> DataFrame:
    """Histogram on a coarser axis within the source's range. Source bins must not straddle target edges."""
    steps = target.width / source.width
    first = (target.low - source.low) / source.width
    if abs(steps - round(steps)) > 1e-9 or abs(first - round(first)) > 1e-9 or first < 0 or target.high > source.high + 1e-9:
        raise ValueError("the target axis must join whole bins of the source")
    k = F.floor((F.col(name) - 1 - round(first)) / round(steps)).cast("int") + 1
    to = F.when(F.col(name) < 1 + round(first), 0).otherwise(F.least(k, F.lit(target.bins + 1)))
    keys = [c for c in hist.columns if c not in (name, "n", "sumw", "sumw2")]
    return hist.withColumn(name, to).groupBy(*keys, name).agg(*[F.sum(c).alias(c) for c in ("n", "sumw", "sumw2")])


def merged(*hists: DataFrame) -> DataFrame:
    """Sum of histograms of one shape."""
    total = hists[0]
    for h in hists[1:]:
        total = total.unionByName(h)
    keys = [c for c in total.columns if c not in ("n", "sumw", "sumw2")]
    return total.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "sumw", "sumw2")])


def added(a: DataFrame, b: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """a + scale * b bin by bin, errors in quadrature."""
    other = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in ("n", "sumw", "sumw2")])
    both = a.join(other, keys, "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(*keys, (z("n") + z("n_b")).alias("n"), (z("sumw") + scale * z("sumw_b")).alias("sumw"), (z("sumw2") + scale * scale * z("sumw2_b")).alias("sumw2"))


def renormalised(hist: DataFrame, keys: list[str], norm: float = 1.0) -> DataFrame:
    """Scaled so that the bins of each key sum to norm; null where they sum to 0."""
    total = F.sum("sumw").over(Window.partitionBy(*keys))
    factor = F.try_divide(F.lit(norm), total)
    return hist.withColumns({"sumw": F.col("sumw") * factor, "sumw2": F.col("sumw2") * factor * factor})


def integral(hist: DataFrame, keys: list[str], bins: dict[str, Axis] | None = None) -> DataFrame:
    """Sum and error by key; bins leaves out what lies outside these axes."""
    for name, axis in (bins or {}).items():
        hist = hist.where(F.col(name).between(1, axis.bins))
    return hist.groupBy(*keys).agg(F.sum("sumw").alias("value"), F.sqrt(F.sum("sumw2")).alias("error"))


def acceptance(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Chance of keeping a row of each bin so that all bins of a key come out alike: 1 for the emptiest bin."""
    w = Window.partitionBy(*keys)
    raw = F.try_divide(F.lit(1.0), F.col("sumw"))
    return hist.withColumn("probability", raw / F.max(raw).over(w))


def look_up(df: DataFrame, table: DataFrame, keys: list[str], axes: dict[str, tuple[Column, Axis]], value: str, default: float) -> DataFrame:
    """df with the table's value for each row's bin, or the default: an equi join on bin numbers, not on ranges."""
    placed = df.withColumns({name: axis.bin(x) for name, (x, axis) in axes.items()})
    return placed.join(table.select(*keys, *axes, value), [*keys, *axes], "left").withColumn(value, F.coalesce(value, F.lit(default)))


def same_bins(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Bins that only one of two histograms has, with the side that has it."""
    x = a.select(*keys).exceptAll(b.select(*keys)).withColumn("side", F.lit("a"))
    return x.unionByName(b.select(*keys).exceptAll(a.select(*keys)).withColumn("side", F.lit("b")))


def ratio_with_errors(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a / b with relative errors in quadrature: sqrt(n) of counts in a, sqrt(sum of squared weights) in b."""
    both = a.select(*keys, F.col("n").alias("n_a")).join(b.select(*keys, F.col("sumw").alias("w_b"), F.col("sumw2").alias("w2_b")), keys)
    r = F.try_divide(F.col("n_a").cast("double"), F.col("w_b"))
    error = F.sqrt(F.try_divide(F.lit(1.0), F.col("n_a").cast("double")) + F.try_divide(F.col("w2_b"), F.col("w_b") * F.col("w_b")))
    return both.select(*keys, r.alias("ratio"), (r * error).alias("error"))


def blinded(hist: DataFrame, name: str, axis: Axis, ranges: list[Interval]) -> DataFrame:
    """Histogram whose contents are null in bins that a blind range touches, with the flag blind."""
    low, high = axis.edge(F.col(name)), axis.edge(F.col(name) + 1)
    touched = F.lit(False)
    for r in ranges:
        touched = touched | ((low <= r.high if r.high_closed else low < r.high) & (high > r.low) & F.col(name).between(1, axis.bins))
    return hist.withColumn("blind", touched).withColumns({c: F.when(~F.col("blind"), F.col(c)) for c in ("n", "sumw", "sumw2")})


def scaled(hist: DataFrame, factor: float, systematic: float = 0.0) -> DataFrame:
    """Histogram times a post-fit factor, with a relative systematic uncertainty added in quadrature."""
    sumw = F.col("sumw") * factor
    return hist.withColumns({"sumw": sumw, "sumw2": F.col("sumw2") * factor * factor + F.pow(sumw * systematic, F.lit(2.0))})


def on_grid(hist: DataFrame, keys: list[str], axes: dict[str, Axis]) -> DataFrame:
    """Histogram with a row for every bin of its axes, without those outside: empty ones have n = sumw = sumw2 = 0."""
    grid = hist.select(*keys).distinct()
    for name, axis in axes.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(axis.bins))))
    return grid.join(hist, [*keys, *axes], "left").fillna(0, ["n", "sumw", "sumw2"])


def acceptance_to_flat(hist: DataFrame, keys: list[str], axes: dict[str, Axis], empty: float | None = None, last: str | None = None, imbalance: float = 1.0) -> DataFrame:
    """Chance of keeping a row of each bin (probability) so that all bins of a key come out alike. Empty bins are an
    error, or get the value of empty. The largest chance is 1; with `last`, all rows of the top two bins of that axis are
    wanted, and the chances are limited to `imbalance` times their number, which must not be 0."""
    whole = on_grid(hist, keys, axes)
    n_bins = 1
    for axis in axes.values():
        n_bins *= axis.bins
    bad = F.raise_error(F.concat(F.lit("empty bin: "), F.concat_ws(", ", *keys, *axes))).cast("double") if empty is None else F.lit(empty)
    ratio = F.when(F.col("sumw") == 0, bad).otherwise(F.lit(1 / n_bins) / F.col("sumw"))
    w = Window.partitionBy(*keys)  # of the bins of one histogram
    rows = whole.withColumn("__r", ratio).withColumn("__m", F.max("__r").over(w))
    scale = F.lit(1.0)
    if last:
        top = F.sum(F.when(F.col(last) >= axes[last].bins - 1, F.col("sumw")).otherwise(0.0)).over(w)
        scale = F.least(F.lit(1.0), F.lit(imbalance) * top * F.col("__m"))
        scale = F.when(scale > 0, scale).otherwise(F.raise_error(F.lit("the last bins are empty")).cast("double"))
    return rows.withColumn("probability", F.col("__r") * scale / F.col("__m")).select(*keys, *axes, "probability")


def class_probabilities(entries: DataFrame, name: str, ratios: dict[str, float]) -> DataFrame:
    """Chance of keeping a row of each class (name, n) so that kept rows stand in given ratios, the largest chance 1; a
    class with ratio -1 is kept whole. A class without rows, or another negative ratio, is an error."""
    if any(r < 0 and r != -1 for r in ratios.values()):
        raise ValueError("a ratio is positive, or -1 for all rows")
    own = {r[0]: r[1] for r in entries.where(F.col(name).isin(list(ratios))).select(name, "n").collect()}  # one row a class
    if missing := [c for c in ratios if not own.get(c)]:
        raise ValueError(f"no rows of {', '.join(missing)}")
    rates = {c: r / own[c] for c, r in ratios.items() if r != -1}
    top = max(rates.values(), default=1.0)
    table = F.create_map(*[F.lit(x) for c in ratios for x in (c, rates[c] / top if c in rates else 1.0)])
    return entries.where(F.col(name).isin(list(ratios))).select(name, F.try_element_at(table, F.col(name)).alias("probability"))


def divided(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a / b bin by bin (ratio); bins that only one of them has are an error."""
    both = a.select(*keys, F.col("sumw").alias("__a")).join(b.select(*keys, F.col("sumw").alias("__b")), keys, "full")
    ratio = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error(F.lit("the histograms have different bins")).cast("double")).otherwise(F.try_divide("__a", "__b"))
    return both.select(*keys, ratio.alias("ratio"))


def expanded(hist: DataFrame, edges: dict[int, list[float]], values: list[str]) -> DataFrame:
    """A histogram (iy, ix, values) whose bins in x differ with iy, on equal bins as fine as its finest one: each of these
    (fx, from 1) has the values of the bin that holds its middle."""
    step = min(b - a for e in edges.values() for a, b in zip(e, e[1:], strict=False))
    low, high = min(e[0] for e in edges.values()), max(e[-1] for e in edges.values())
    n = round((high - low) / step)
    of = [(y, k + 1, sum(e <= low + (k + 0.5) * step for e in own)) for y, own in edges.items() for k in range(n)]
    grid = hist.sparkSession.createDataFrame(of, "iy int, fx int, ix int")
    return grid.join(hist, ["iy", "ix"]).select("iy", "fx", *values)
