"""Features for training: cells, sequences, one-hot labels and batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geometry import delta_phi, signal_cone
from corvane.operators import order


def cell_index(x: Column, size: float, cells: int) -> Column:
    """0-based cell of a grid centred on 0; an odd number of cells has one around 0. Null outside."""
    half = cells // 2
    if cells % 2:
        k = (F.floor(F.abs(x) / size + 0.5) * F.signum(x)).cast("int") + half
    else:
        k = F.floor(x / size).cast("int") + half
    return F.when((k >= 0) & (k < cells), k)


def flat_cell(eta: Column, phi: Column, cells: int) -> Column:
    return eta * cells + phi


def top_of_cell(items: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """First item of each cell by the order."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return items.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Cells on a side, and the size of one, of the grid inside the signal cone and of that around it, and the
#: radius up to which objects enter.
INNER, OUTER, ISOLATION_CONE = (11, 0.02), (21, 0.05), 0.5


def in_cells(objects: DataFrame, remove_inner: bool = False, inner: tuple[int, float] = INNER, outer: tuple[int, float] = OUTER) -> DataFrame:
    """Rows of grids() before the choice of the first: each object once for every grid that it enters, with inner and
    cell."""
    deta, dphi = F.col("eta") - F.col("tau_eta"), delta_phi(F.col("phi"), F.col("tau_phi"))
    placed = objects.withColumns({"__x": deta, "__y": dphi, "__r": F.hypot(deta, dphi)})
    signal = F.col("__r") < signal_cone(F.col("tau_pt"))
    around = (F.col("__r") < ISOLATION_CONE) & (~signal if remove_inner else F.lit(True))

    def cells(inside: Column, flag: bool, grid: tuple[int, float]) -> Column:
        n, size = grid
        at = flat_cell(cell_index(F.col("__x"), size, n), cell_index(F.col("__y"), size, n), n)
        return F.when(inside & at.isNotNull(), F.struct(F.lit(flag).alias("inner"), at.cast("int").alias("cell")))

    entries = F.explode(F.filter(F.array(cells(signal, True, inner), cells(around, False, outer)), lambda e: e.isNotNull()))
    return placed.withColumn("__e", entries).select(*objects.columns, "__e.inner", "__e.cell")


def grids(objects: DataFrame, candidate: list[str], by: list[Column], kind: str = "type", remove_inner: bool = False, inner: tuple[int, float] = INNER, outer: tuple[int, float] = OUTER) -> DataFrame:
    """First object of each kind and cell, by the order, with the number n of objects there: objects inside the signal
    cone in the inner grid (column inner), those inside the isolation cone in the outer one, which may leave out the
    signal cone. objects: candidate keys, kind, pt, eta, phi, and the candidate's tau_pt, tau_eta and tau_phi."""
    rows = in_cells(objects, remove_inner, inner, outer)
    w = Window.partitionBy(*candidate, kind, "inner", "cell").orderBy(*by)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # counted in the order of the choice, so rows are sorted once
    return rows.withColumns({"n": F.count("*").over(whole), "__k": F.row_number().over(w)}).where("__k = 1").drop("__k")


def padded(values: Column, length: int, fill: float = 0.0) -> Column:
    """The first `length` values, filled up."""
    cut = F.slice(values, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(fill), F.lit(length) - F.size(cut)))


def one_hot(value: Column, classes: list) -> Column:
    return F.array(*[F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for c in classes])


def numbered_batches(df: DataFrame, by: list[Column], size: int, keys: list[str] | None = None) -> DataFrame:
    """Batch number of each row in order, within keys if given."""
    return order.numbered(df, by, "__n", keys).withColumn("batch", F.floor(F.col("__n") / size).cast("long")).drop("__n")


def spread_batches(df: DataFrame, buckets: int, key: Column, by: list[Column], size: int) -> DataFrame:
    """Batches of at most size rows within hash buckets of a key: no window over all rows is needed."""
    bucket = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(buckets)).alias("bucket")
    w = Window.partitionBy("bucket").orderBy(*by)
    return df.select("*", bucket).withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def has_padding(values: Column) -> Column:
    return ~F.exists(values, lambda x: x != 0)


def differences(a: Column, b: Column, epsilon: float = 1e-5) -> Column:
    """Indices at which two arrays differ by more than epsilon, or of which only one is NaN or null; arrays of unequal
    length are an error."""
    same = lambda x, y: (F.abs(x - y) <= epsilon) | (x.isNull() & y.isNull()) | (F.isnan(x) & F.isnan(y))
    pairs = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p, i: F.when(~F.coalesce(same(p["a"], p["b"]), F.lit(False)), i))
    found = F.filter(pairs, lambda i: i.isNotNull())
    return F.when(F.size(a) == F.size(b), found).otherwise(F.raise_error(F.lit("arrays of unequal length")).cast("array<int>"))


def without_inner(outer: DataFrame, candidate: list[str], kind: str = "type", inner: tuple[int, float] = INNER, grid: tuple[int, float] = OUTER) -> DataFrame:
    """Cells of grids() without those of the outer grid whose middle lies under the inner grid."""
    (n, size), (m, step) = inner, grid
    middle = lambda k: F.abs((k - m // 2) * step)
    under = (middle(F.floor(F.col("cell") / m)) < n * size / 2) & (middle(F.col("cell") % m) < n * size / 2)
    return outer.where(F.col("inner") | ~under)


def sequence_blocks(items: Column, length: int, blocks: dict[str, Callable[[Column], list[Column]]]) -> dict[str, Column]:
    """Flat blocks of features of the first `length` items, filled up with zeros; items are in order."""
    first = F.slice(items, 1, length)

    def flat(made: Callable[[Column], list[Column]]) -> Column:
        rows = F.transform(first, lambda x: F.array(*made(x)))
        width = len(made(F.struct().alias("x"))) * length
        return F.concat(F.flatten(rows), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(F.flatten(rows))))

    return {name: flat(made) for name, made in blocks.items()}


def regression_targets(charged: Column, neutral: Column, pt: Column, mass2: Column) -> Column:
    return F.array(*[c.cast("double") for c in (charged, neutral, pt, mass2)])


def adversarial(regular: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both tables by their batch number, those of the second with weight 0; batches that only one has are left
    out."""
    both = regular.select("batch").distinct().join(other.select("batch").distinct(), "batch")
    rows = regular.withColumn("weight", F.lit(1.0)).unionByName(other.withColumn("weight", F.lit(0.0)), allowMissingColumns=True)
    return rows.join(both, "batch", "left_semi")


def split_by_file(df: DataFrame, file: str, share: float) -> DataFrame:
    """df with the flag training: whether its file is among the first share of all files, by name."""
    files = order.numbered(df.select(file).distinct(), [F.col(file)], "__k", total="__n")
    flags = files.select(file, (F.col("__k") < F.floor(F.col("__n") * share)).alias("training"))
    return df.join(flags, file)


def cell_vectors(objects: DataFrame, candidate: list[str], index: str, of: Callable[[str, Column, Column], Column], whole: Callable[[Column], Column], kinds: list[str], remove_inner: bool = False, inner: tuple[int, float] = INNER, outer: tuple[int, float] = OUTER) -> DataFrame:
    """One row for each cell that holds an object: (candidate, inner, cell, global, and for each kind the features of its
    object with the highest pt, the smaller index of equals, null where the cell has none; kinds: how many it has). objects
    has the columns of grids(), `kind`, an index and the struct `object`; of(kind, object, inner) makes the features of an
    object, whole(inner) those that every cell has. Features are made before the grouping, whose partial results hold one
    object a kind. Each kind has its own expression, so a kind that is not asked for is not computed."""
    rows = in_cells(objects, remove_inner, inner, outer)
    made = [F.when(F.col("kind") == k, of(k, F.col("object"), F.col("inner"))).alias(f"__f_{k}") for k in kinds]
    rows = rows.select(*candidate, "inner", "cell", "kind", F.struct("pt", (-F.col(index)).alias("i")).alias("__o"), *made, whole(F.col("inner")).alias("__g"))
    best = [F.max_by(f"__f_{k}", F.when(F.col("kind") == k, F.col("__o"))).alias(k) for k in kinds]
    held = sum((F.max(F.when(F.col("kind") == k, 1).otherwise(0)) for k in kinds), F.lit(0))
    return rows.groupBy(*candidate, "inner", "cell").agg(F.any_value("__g").alias("global"), *best, held.alias("kinds"))


def dense(cells: DataFrame, candidate: list[str], widths: dict[str, int], inner: tuple[int, float] = INNER, outer: tuple[int, float] = OUTER) -> DataFrame:
    """One row for each candidate and grid with an object: for each column of features, of so many numbers, the whole grid
    as one array (cells in order of eta, then phi, then features), zeros where there is nothing. A grid has at most the
    square of its side's cells, so a row is bounded."""
    n = F.when(F.col("inner"), F.lit(inner[0] ** 2)).otherwise(F.lit(outer[0] ** 2))
    found = cells.groupBy(*candidate, "inner").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct(*widths).alias("v")))).alias("__m"))

    def column(name: str, width: int) -> Column:
        zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
        return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.coalesce(F.try_element_at(F.col("__m"), c)[name], zeros))).alias(name)

    return found.select(*candidate, "inner", *[column(*w) for w in widths.items()])
