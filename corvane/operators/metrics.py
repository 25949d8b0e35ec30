"""Evaluation metrics: ROC curves, working points, efficiencies with exact intervals, thresholds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import order, stats
from corvane.sources import shared


def roc(df: DataFrame, keys: list[str], score: str, truth: Column, weight: Column | None = None) -> DataFrame:
    """Weighted false and true positive rates at each distinct score, from the highest down, and those before it. Rows of
    one score are summed first, and running sums take no window over all scores."""
    w = F.lit(1.0) if weight is None else weight
    sums = df.groupBy(*keys, score).agg(F.sum(F.when(truth, w).otherwise(0.0)).alias("p"), F.sum(F.when(truth, 0.0).otherwise(w)).alias("q"))
    placed = order.running(sums, keys, [F.desc(score)], {"cp": "p", "cq": "q"})
    share = lambda c, n: F.try_divide(c, F.col(f"{n}_total"))
    rates = [share(F.col(f"c{c}"), f"c{c}").alias(n) for c, n in (("q", "fpr"), ("p", "tpr"))]
    before = [share(F.col(f"c{c}") - F.col(c), f"c{c}").alias(n) for c, n in (("q", "fpr_before"), ("p", "tpr_before"))]
    return placed.select(*keys, F.col(score).alias("threshold"), *rates, *before)


def auc(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Area under a curve of roc() by trapezia, from (0, 0)."""
    area = (F.col("fpr") - F.col("fpr_before")) * (F.col("tpr") + F.col("tpr_before")) / 2
    return curve.groupBy(*keys).agg(F.sum(area).alias("auc"))


def pruned(curve: DataFrame, keys: list[str], digits: int) -> DataFrame:
    """The first point, from the highest threshold, of each rounded true positive rate."""
    rest = [c for c in curve.columns if c not in keys]
    first = F.max(F.struct("threshold", *[c for c in rest if c != "threshold"])).alias("__p")
    return curve.groupBy(*keys, F.round("tpr", digits).alias("__t")).agg(first).select(*keys, *[F.col(f"__p.{c}").alias(c) for c in rest])


def threshold_at(curve: DataFrame, keys: list[str], efficiency: float) -> DataFrame:
    """Highest threshold whose true positive rate reaches the efficiency."""
    return curve.where(F.col("tpr") >= efficiency).groupBy(*keys).agg(F.max("threshold").alias("threshold"))


def pass_counts(df: DataFrame, keys: list[str], score: str, thresholds: list[float]) -> DataFrame:
    """Rows over each threshold and all rows, one row for each key and threshold."""
    points = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return df.select(*keys, score, points).groupBy(*keys, "threshold").agg(F.count_if(F.col(score) > F.col("threshold")).alias("passed"), F.count("*").alias("total"))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def _beta_quantile(share: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _incomplete_beta(a, b, middle) < share else (low, middle)
    return (low + high) / 2


def exact_interval(passed: int, total: int, alpha: float = 0.317311) -> tuple[float, float]:
    """Clopper-Pearson interval of a binomial share; (0, 1) without trials."""
    low = _beta_quantile(alpha / 2, passed, total - passed + 1) if passed > 0 else 0.0
    high = _beta_quantile(1 - alpha / 2, passed + 1, total - passed) if passed < total else 1.0
    return low, high


def with_interval(counts: DataFrame, alpha: float = 0.317311) -> DataFrame:
    """counts (passed, total, ...) with efficiency, low and high. The rows are working points and bins, which are few."""

    @F.pandas_udf("struct<low:double,high:double>")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([exact_interval(int(a), int(b), alpha) for a, b in zip(k, n, strict=True)], columns=["low", "high"])

    out = counts.withColumn("__i", interval("passed", "total"))
    return out.withColumns({"efficiency": F.try_divide(F.col("passed").cast("double"), F.col("total").cast("double")), "low": F.col("__i.low"), "high": F.col("__i.high")}).drop("__i")


def at_common_points(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Curve b's y at a's x by linear interpolation within b's range: (x, y of a, y of b)."""
    both = a.select(F.col(x).alias("x"), F.col(y).alias("ya"), F.lit(None).cast("double").alias("yb")).unionAll(b.select(F.col(x).alias("x"), F.lit(None).cast("double").alias("ya"), F.col(y).alias("yb")))
    point = F.when(F.col("yb").isNotNull(), F.struct("x", F.col("yb").alias("y")))
    placed = order.between(both, [F.col("x"), F.col("yb").isNull()], point, "l", "r")
    slope = F.try_divide(F.col("r.y") - F.col("l.y"), F.col("r.x") - F.col("l.x"))
    value = F.col("l.y") + F.coalesce(slope, F.lit(0.0)) * (F.col("x") - F.col("l.x"))
    inside = "ya is not null and l is not null and (r is not null or l.x = x)"
    return placed.where(inside).select("x", "ya", value.alias("yb"))


def derivative(curve: DataFrame, x: str, y: str, window: int = 1, relative: bool = False) -> DataFrame:
    """Slope dy/dx between points of a curve in order of x: from each point to the first one at least `window` on at which
    y has changed, from there on again. Rows: x in the middle, slope (over the mean of y if relative). y must not fall.
    The chain of steps is found by doubling, so it takes as many joins as the number of points has binary digits."""
    placed = order.numbered(curve.select(F.col(x).alias("x"), F.col(y).alias("y")), [F.col("x"), F.col("y")], "n")
    runs = placed.groupBy("y").agg((F.max("n") + 1).alias("end"))
    steps = shared.written(placed.join(runs, "y").select("n", F.greatest(F.col("n") + window, F.col("end")).alias("next")), "steps")
    reached = steps.where("n = 0").select("n")
    jumps = steps
    for _ in range(steps.count().bit_length()):
        reached = shared.written(reached.union(reached.join(jumps, "n").select(F.col("next").alias("n"))).distinct(), "reached")
        further = jumps.join(jumps.select(F.col("n").alias("next"), F.col("next").alias("after")), "next")
        jumps = shared.written(further.select("n", F.col("after").alias("next")), "jumps")
    at = placed.select(F.col("n").alias("next"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    ends = steps.join(reached, "n").join(placed, "n").join(at, "next").where("y2 <> y")
    slope = F.try_divide(F.col("y2") - F.col("y"), F.col("x2") - F.col("x"))
    return ends.select(((F.col("x") + F.col("x2")) / 2).alias("x"), (F.try_divide(slope, (F.col("y") + F.col("y2")) / 2) if relative else slope).alias("slope"))


def converged_thresholds(df: DataFrame, classes: list[str], truth: str, efficiency: dict[str, float], epsilon: float = 1e-5, most: int = 100, weight: str | None = None) -> dict[str, float]:
    """Thresholds of each class's score at which that share of true rows' weight passes, given that they pass the
    thresholds of all other classes: repeated until no threshold moves by epsilon. Only the thresholds come to the driver.
    Thresholds that still move after `most` rounds are an error; a class without rows keeps its last one."""
    now = dict.fromkeys(classes, float("-inf"))
    true = shared.written(df.where(truth).select(*classes, (F.lit(1.0) if weight is None else F.col(weight)).alias("__w")), "true")
    for _ in range(most):
        found = {}
        for c in classes:
            rows = true
            for o in classes:
                if o != c:
                    rows = rows.where(F.col(o) > now[o])
            at = stats.weighted_quantile(rows, [], c, "__w", 1 - efficiency[c]).first()
            found[c] = now[c] if at is None or at[0] is None else at[0]
        moved = [c for c in classes if not abs(found[c] - now[c]) < epsilon]
        now = found
        if not moved:
            return now
    raise ValueError(f"thresholds of {', '.join(moved)} still move after {most} rounds")


def rate_curve(rate: DataFrame, event: list[str], signal: DataFrame, score: str, efficiencies: list[float]) -> DataFrame:
    """(efficiency, threshold, rate): thresholds that let a share of the signal's rows pass, and the share of events whose
    highest score passes each."""
    names = {f"e{k}": 1 - e for k, e in enumerate(efficiencies)}
    at = stats.quantiles(signal.select(score), [], score, names)
    points = at.select(F.explode(F.array(*[F.struct(F.lit(e).alias("efficiency"), F.col(n).alias("threshold")) for n, e in zip(names, efficiencies, strict=True)])).alias("p")).select("p.*")
    best = rate.groupBy(*event).agg(F.max(score).alias("__m"))
    return best.join(F.broadcast(points)).groupBy("efficiency", "threshold").agg(F.try_divide(F.count_if(F.col("__m") > F.col("threshold")).cast("double"), F.count("*").cast("double")).alias("rate"))


def nearest_to(curve: DataFrame, efficiency: float, tolerance: float = 0.01) -> DataFrame:
    """Threshold of the point whose true positive rate is nearest to the efficiency; null if it is off by more than the
    tolerance."""
    gap = F.abs(F.col("tpr") - efficiency)
    found = curve.agg(F.min(F.struct(gap.alias("gap"), "threshold")).alias("b"))
    return found.select(F.when(F.col("b.gap") <= tolerance, F.col("b.threshold")).alias("threshold"))
