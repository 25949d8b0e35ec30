"""Gaussian kernel densities and their bandwidth, by moments of grid cells instead of pairs of rows.

In units of the bandwidth, a kernel between two cells is a Taylor series in the places inside them, so all that a cell's
values add to a density is in their first moments, which are sums that merge. Cells pass their moments to the cells within
REACH of them, which turns them into one polynomial for each cell, and a point evaluates the polynomial of its own cell. The
series is cut after ORDER terms, which leaves out less than 1e-12 of a kernel's peak, as is what lies beyond REACH.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a bandwidth (a half each), terms of the series, and bandwidths beyond which a kernel is nothing.
CELL, ORDER, REACH = 0.5, 17, 8.5
#: Most cells of one group of a bandwidth's estimate, which are held in one task.
BANDWIDTH_CELLS = 200_000


def derivatives(z: np.ndarray, most: int) -> np.ndarray:
    """Derivatives of the normal density at z: one row for each order up to `most`."""
    he = [np.ones_like(z), z]
    for n in range(1, most):
        he.append(z * he[n] - n * he[n - 1])
    front = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return np.stack([(-1) ** n * he[n] * front for n in range(most + 1)])


@lru_cache(maxsize=1)
def passages() -> dict[int, np.ndarray]:
    """Matrix from a cell's moments to the polynomial of the cell so many cells up, for each number of cells in reach."""
    far = math.ceil(REACH / CELL)
    k = np.arange(ORDER)
    factorial = np.asarray([math.factorial(i) for i in k], float)
    found = {}
    for d in range(-far, far + 1):
        at = derivatives(np.asarray([d * CELL]), 2 * ORDER)[:, 0]
        found[d] = at[k[:, None] + k[None, :]] * (-1.0) ** k[None, :] / factorial[:, None] / factorial[None, :]
    return found


def placed(x: Column) -> tuple[Column, Column]:
    """Cell of a value in units of the bandwidth, and its place from the middle."""
    cell = F.floor(x / CELL).cast("long")
    return cell, x - (cell.cast("double") + 0.5) * CELL


def moments(df: DataFrame, keys: list[str], x: Column, order: int) -> DataFrame:
    """(keys, cell, moments) of values in units of the bandwidth: sums of the powers of their places."""
    cell, at = placed(x)
    rows = df.select(*keys, cell.alias("cell"), at.alias("__v"))
    return rows.groupBy(*keys, "cell").agg(F.array(*[F.sum(F.pow("__v", F.lit(float(k)))) for k in range(order)]).alias("moments"))


def polynomials(cells: DataFrame) -> DataFrame:
    """(cell, coefficients) of the sum of all kernels in each cell that one reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                m, cell = np.stack(batch["moments"].to_list()), batch["cell"].to_numpy()
                for d, matrix in passages().items():
                    yield pd.DataFrame({"cell": cell + d, "c": list(m @ matrix.T)})

    spread = cells.mapInPandas(run, "cell bigint, c array<double>")
    return spread.groupBy("cell").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(ORDER)]).alias("coefficients"))


def kde(sample: DataFrame, points: DataFrame, x: str, bandwidth: float) -> DataFrame:
    """points with the Gaussian density of a sample there, whatever the number of its values. Null values count for
    nothing and have none. What is left out is less than 1e-12 of the peak of one kernel for each value; a point farther
    than REACH bandwidths from all values has a density of 0. A sample without values is an error."""
    if bandwidth <= 0:
        raise ValueError("the bandwidth must be positive")
    value = F.col(x).cast("double")
    known = sample.where(value.isNotNull())
    total = known.count()
    if not total:
        raise ValueError("a density needs a sample")
    sums = polynomials(moments(known, [], value / bandwidth, ORDER)).withColumnRenamed("cell", "__cell")
    cell, at = placed(value / bandwidth)
    found = points.withColumns({"__cell": cell, "__at": at}).join(sums, "__cell", "left")
    series = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda a, c: a * F.col("__at") + c)
    density = F.when(value.isNotNull(), F.greatest(F.coalesce(series, F.lit(0.0)), F.lit(0.0)) / (total * bandwidth))
    return found.withColumn("density", density).drop("__cell", "__at", "coefficients")


def kde_2d(sample: DataFrame, points: DataFrame, x: str, y: str, bandwidths: tuple[float, float], correlation: float = 0.0) -> DataFrame:
    """points with the density of pairs there, with a Gaussian kernel of a correlation: an equi join on cells of REACH
    bandwidths, so that a point meets the distinct pairs of its own and the eight cells around, and the sum for each
    distinct point. What lies farther is less than exp(-REACH^2 / 2) of a kernel's peak. Nulls count for nothing and have
    none."""
    free = 1 - correlation * correlation
    if free <= 0:
        raise ValueError("the kernel's correlation must be between -1 and 1")
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    # Along these axes the kernel is round, of width 1.
    u, v = a / bandwidths[0], (b / bandwidths[1] - correlation * a / bandwidths[0]) / math.sqrt(free)
    pairs = sample.where(a.isNotNull() & b.isNotNull()).groupBy(u.alias("__u"), v.alias("__v")).agg(F.count("*").alias("__c"))
    total = sample.where(a.isNotNull() & b.isNotNull()).count()
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    of = lambda c: F.floor(F.col(c) / REACH).cast("long")
    values = pairs.withColumn("__n", F.explode(near)).select((of("__u") + F.col("__n.i")).alias("__i"), (of("__v") + F.col("__n.j")).alias("__j"), F.col("__u").alias("__su"), F.col("__v").alias("__sv"), "__c")
    wanted = points.select(x, y, u.alias("__u"), v.alias("__v")).where("__u is not null and __v is not null").distinct()
    met = wanted.withColumns({"__i": of("__u"), "__j": of("__v")}).join(values, ["__i", "__j"])
    du, dv = F.col("__u") - F.col("__su"), F.col("__v") - F.col("__sv")
    norm = 2 * math.pi * bandwidths[0] * bandwidths[1] * math.sqrt(free) * max(total, 1)
    sums = met.groupBy(x, y).agg((F.sum(F.col("__c") * F.exp(-(du * du + dv * dv) / 2)) / norm).alias("density"))
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    return points.join(sums, [x, y], "left").withColumn("density", F.when(known, F.coalesce("density", F.lit(0.0))))


class Functionals:
    """Sums over all pairs of a group's values, from the moments of its cells of a width."""

    def __init__(self, cell: np.ndarray, moments: np.ndarray, width: float):
        order = np.argsort(cell)
        self.cell, self.width, self.order = cell[order], width, moments.shape[1]
        self.moments = moments[order] * width ** np.arange(self.order)  # places in units of the values
        self.total = float(self.moments[:, 0].sum())

    def psi(self, order: int, g: float) -> float:
        """Mean over all pairs (each with itself included, divided by n(n - 1)) of the derivative of an order of a normal
        density of width g."""
        ratio = self.width / g
        scaled = self.moments / g ** np.arange(self.order)
        far = math.ceil(REACH * 1.5 / ratio) + 1
        k = np.arange(self.order)
        over = np.asarray([math.factorial(i) for i in k], float)
        found = 0.0
        where = {}
        for d in range(0, far + 1):
            at = np.searchsorted(self.cell, self.cell + d)
            hit = np.flatnonzero((at < len(self.cell)) & (self.cell[np.minimum(at, len(self.cell) - 1)] == self.cell + d))
            if len(hit):
                where[d] = hit, at[hit]
        for d, (low, high) in where.items():
            at = derivatives(np.asarray([d * ratio]), order + 2 * self.order)[:, 0]
            # Sum over i in the upper cell and j in the lower one of f(z + u - v).
            matrix = at[order + k[:, None] + k[None, :]] * (-1.0) ** k[None, :] / over[:, None] / over[None, :]
            matrix = np.where(k[:, None] + k[None, :] < self.order, matrix, 0.0)
            part = float(np.einsum("ck,km,cm->", scaled[high], matrix, scaled[low]))
            found += part if d == 0 else 2 * part  # even orders are the same both ways
        return found / (g ** (order + 1) * self.total * (self.total - 1))


#: Terms of the series of a bandwidth's functionals, and the largest width of a cell over that of a kernel.
FUNCTIONAL_ORDER, FUNCTIONAL_RATIO = 24, 0.5


class Narrower(Exception):
    """Cells are too wide for a kernel that an estimate needs."""


def plug_in(sums: Functionals, spread: float, tolerance: float) -> float:
    """Bandwidth h by the solve-the-equation plug-in rule of Sheather and Jones (1991): h^5 = 1 / (2 sqrt(pi) n
    psi4(gamma(h))), psi_r being the density functional of order r, with pilot widths from a normal density."""
    n = sums.total

    def psi(order: int, g: float) -> float:
        if sums.width > FUNCTIONAL_RATIO * g:
            raise Narrower
        return sums.psi(order, g)

    def pilot(order: int) -> float:
        at_zero = (-1) ** (order // 2) * math.prod(range(1, order, 2)) / math.sqrt(2 * math.pi)
        k = order + 2
        normal = (-1) ** (k // 2) * math.factorial(k) / (math.factorial(k // 2) * math.sqrt(math.pi) * (2 * spread) ** (k + 1))
        return (-2 * at_zero / (normal * n)) ** (1 / (order + 3))

    of_pilot = (-6 * math.sqrt(2) * psi(4, pilot(4)) / psi(6, pilot(6))) ** (1 / 7)
    implied = lambda h: (2 * math.sqrt(math.pi) * psi(4, of_pilot * h ** (5 / 7)) * n) ** -0.2
    low = high = 1.06 * spread * n**-0.2
    for _ in range(40):
        if implied(low) >= low:
            break
        low /= 1.3
    for _ in range(40):
        if implied(high) <= high:
            break
        high *= 1.3
    if implied(low) < low or implied(high) > high:
        raise ValueError("no bandwidth solves the equation")
    while high - low > tolerance * low:
        middle = math.sqrt(low * high)
        low, high = (middle, high) if implied(middle) > middle else (low, middle)
    return math.sqrt(low * high)


def bandwidths(df: DataFrame, keys: list[str], x: str, tolerance: float = 1e-6) -> DataFrame:
    """(keys, bandwidth): the plug-in bandwidth of each group's values, from sums over all pairs of them that are exact to
    about 1e-8: cells' moments are summed over all rows, in cells of a width that suits the group's deviation and number,
    halved until it suits the kernels that the rule asks for. Groups of fewer than two values, or of equal ones, have
    none. More than BANDWIDTH_CELLS cells of one group are an error. Nulls are left out."""
    value = F.col(x).cast("double")
    rows = df.select(*keys, value.alias("__x")).where("__x is not null")
    facts = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.stddev_samp("__x").alias("__s"), F.avg("__x").alias("__mean"))
    facts = facts.select(*keys, "__n", "__s", "__mean").where("__n > 1 and __s > 0")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    named = facts.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    together = rows.join(named, on).drop(*[f"__k_{k}" for k in keys]) if keys else rows.crossJoin(F.broadcast(facts))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema], "bandwidth double, step int"])

    def attempt(rows: DataFrame, halvings: int) -> DataFrame:
        # The narrowest kernel is about a tenth of the normal rule's.
        width = F.col("__s") * F.pow(F.col("__n"), F.lit(-0.2)) * F.lit(0.1 / 2**halvings)
        cell = F.floor((F.col("__x") - F.col("__mean")) / width).cast("long")
        at = (F.col("__x") - F.col("__mean")) / width - (cell.cast("double") + 0.5)
        cells = rows.select(*keys, "__s", width.alias("__w"), cell.alias("cell"), at.alias("__v")).groupBy(*keys, "cell")
        cells = cells.agg(F.first("__s").alias("__s"), F.first("__w").alias("__w"), F.array(*[F.sum(F.pow("__v", F.lit(float(k)))) for k in range(FUNCTIONAL_ORDER)]).alias("moments"))

        def run(g: pd.DataFrame) -> pd.DataFrame:
            if len(g) > BANDWIDTH_CELLS:
                raise ValueError(f"more than {BANDWIDTH_CELLS} cells in one group")
            sums = Functionals(g["cell"].to_numpy(), np.stack(g["moments"].to_list()), float(g["__w"].iloc[0]))
            try:
                found = plug_in(sums, float(g["__s"].iloc[0]), tolerance)
            except Narrower:
                found = None
            return g[keys].iloc[:1].assign(bandwidth=found, step=halvings)

        return cells.groupBy(*keys).applyInPandas(run, schema)

    from corvane.sources import shared

    found = shared.written(attempt(together, 0), "bandwidths")
    for halvings in range(1, 12):
        again = found.where("bandwidth is null")
        if again.isEmpty():
            break
        marked = again.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
        left = together.join(marked, on, "left_semi") if keys else together
        found = shared.written(found.where("bandwidth is not null").unionByName(attempt(left, halvings)), "bandwidths")
    return found.drop("step")
