"""Geometric matching inside an event, cone semi-joins, transitive closure, first-wins merging and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geometry import delta_phi, delta_r
from corvane.operators.graph import components
from corvane.operators.order import numbered, same
from corvane.sources import shared


def near_pairs(a: DataFrame, b: DataFrame, event: list[str], radius: float, eta: str = "eta", phi: str = "phi") -> DataFrame:
    """Pairs of a and b of one event within a distance: an equi join on event and grid cell, since each row of b enters
    the nine cells around its own, followed by the exact test. Columns of b get the suffix _b; dr is the distance. Cells
    in phi are a whole number around the circle, so the seam at pi needs no case of its own."""
    around = max(1, int(6.283185307179586 / radius))
    step = 6.283185307179586 / around
    cells = lambda df, e, p: df.withColumns({"__e": F.floor(F.col(e) / radius).cast("long"), "__p": F.pmod(F.floor(F.col(p) / step).cast("long"), F.lit(around))})
    other = b.withColumnsRenamed({c: f"{c}_b" for c in b.columns if c not in event})
    near = cells(other, f"{eta}_b", f"{phi}_b")
    near = near.withColumn("__de", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("__dp", F.explode(F.array_distinct(F.array(*[F.pmod(F.lit(d), F.lit(around)) for d in (-1, 0, 1)]))))
    near = near.withColumns({"__e": F.col("__e") + F.col("__de"), "__p": F.pmod(F.col("__p") + F.col("__dp"), F.lit(around))}).drop("__de", "__dp")
    both = cells(a, eta, phi).join(near, [*event, "__e", "__p"])
    dr = delta_r(F.col(eta), F.col(phi), F.col(f"{eta}_b"), F.col(f"{phi}_b"))
    return both.withColumn("dr", dr).where(F.col("dr") < radius).drop("__e", "__p")


def nearest(pairs: DataFrame, candidate: list[str], order: list[Column]) -> DataFrame:
    """Best partner of each candidate; one partner may serve several candidates."""
    w = Window.partitionBy(*candidate).orderBy(*order)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def priority_match(candidates: DataFrame, objects: DataFrame, event: list[str], candidate: str, index: str, anchors: list[tuple[str, str, float]]) -> DataFrame:
    """(event, candidate, object, dr_1, dr_2, ...): the object that each candidate takes. A candidate has several axes,
    the anchors (eta column, phi column, radius), in order of priority; a distance counts only inside its radius. The
    object nearest to the first axis wins, then to the second, and so on; one without a distance comes after any with
    one, and the lower index decides between equals. An object may serve several candidates."""
    found = []
    for k, (eta, phi, radius) in enumerate(anchors):
        axis = candidates.select(*event, candidate, F.col(eta).alias("eta"), F.col(phi).alias("phi")).dropna()
        pairs = near_pairs(axis, objects.select(*event, index, "eta", "phi"), event, radius)
        found.append(pairs.select(*event, candidate, F.col(f"{index}_b").alias("object"), F.lit(k).alias("anchor"), "dr"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    names = [f"dr_{k + 1}" for k in range(len(anchors))]
    rows = every.groupBy(*event, candidate, "object").agg(*[F.min(F.when(F.col("anchor") == k, F.col("dr"))).alias(n) for k, n in enumerate(names)])
    return nearest(rows, [*event, candidate], [*[F.asc_nulls_last(n) for n in names], F.col("object")])


def candidate_pool(collections: list[tuple[str, DataFrame, dict[str, float]]], event: list[str], complete: bool = True) -> DataFrame:
    """Candidates that collections of one event build up, in their order: (event, and for each collection its name with
    _idx, _eta and _phi, null where a candidate has no such object). The first collection's objects (idx, eta, phi) are
    the first candidates. Of each later one every candidate takes the object that priority_match gives it, by the
    distances to the objects that it has, each within the radius that the collection's table gives for that earlier
    name; several candidates may take one object. Objects that none has taken become candidates, if complete."""
    names: list[str] = []
    pool = None
    for name, objects, radii in collections:
        own = objects.select(*event, F.col("idx").alias(f"{name}_idx"), F.col("eta").alias(f"{name}_eta"), F.col("phi").alias(f"{name}_phi"))
        made = own.withColumn("candidate", F.concat(F.lit(f"{name}:"), f"{name}_idx"))
        if pool is None:
            pool = made
        else:
            anchors = [(f"{n}_eta", f"{n}_phi", radii[n]) for n in names if n in radii]
            found = priority_match(pool, objects.select(*event, "idx", "eta", "phi"), event, "candidate", "idx", anchors)
            taken = found.select(*event, "candidate", F.col("object").alias(f"{name}_idx")).join(own, [*event, f"{name}_idx"])
            after = pool.join(taken, [*event, "candidate"], "left")
            if complete:
                after = after.unionByName(made.join(taken.select(*event, f"{name}_idx").distinct(), [*event, f"{name}_idx"], "left_anti"), allowMissingColumns=True)
            pool = shared.written(after, "pool")
        names.append(name)
    return pool.drop("candidate")


def completed(matched: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """matched, and the rows of others that no match used, as candidates of their own."""
    return matched.unionByName(others.join(matched.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def cone_filter(items: Column, references: Column, radius: float) -> Column:
    """Items (structs with eta and phi) within radius of any reference."""
    close = lambda x, r: F.hypot(x["eta"] - r["eta"], delta_phi(x["phi"], r["phi"])) < radius
    return F.filter(items, lambda x: F.exists(references, lambda r: close(x, r)))


def near_any(a: DataFrame, b: DataFrame, event: list[str], key: list[str], radius: float) -> DataFrame:
    """(event, key) of rows of a with a row of b within a distance."""
    return near_pairs(a, b, event, radius).select(*event, *key).distinct()


def near_any_of(a: DataFrame, references: list[tuple[DataFrame, float]], event: list[str], key: list[str]) -> DataFrame:
    """(event, key) of rows of a within the cone of a row of any collection, each of which has its radius."""
    found = None
    for b, radius in references:
        own = near_any(a, b, event, key, radius)
        found = own if found is None else found.unionAll(own)
    return found.distinct()


def closure(start: DataFrame, links: DataFrame) -> DataFrame:
    """(root, node) of all nodes that can be reached from start (root, node) over links (a, b) in both directions: those
    of the start's component. A node without links reaches itself."""
    labels = components(links)
    named = start.select("root", "node").distinct().join(labels, "node", "left")
    alone = named.where("label is null").select("root", "node")
    reached = named.where("label is not null").select("root", "label").distinct().join(labels, "label").select("root", "node")
    return reached.unionAll(alone)


def merge_first_wins(rows: DataFrame, event: str, radius: float = 0.01, tolerance: float = 0.01) -> DataFrame:
    """Objects of several inputs (event, source, idx, eta, phi, pt) merged in order of source and idx: (event, eta, phi, pt,
    bits) of those kept. A row that lies near one already kept, in direction and pt, is not kept but sets its source's bit
    in the first such row. Near rows are found by grid cells, and the order is followed in rounds: a row is decided once one
    of its earlier neighbours is kept, or none of them is. Rows of one place are one from the start."""
    first = rows.groupBy(event, "eta", "phi", "pt").agg(F.min(F.struct("source", "idx")).alias("o"), F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("source").cast("int"))).alias("bits"))
    named = shared.written(first.withColumn("id", F.monotonically_increasing_id()), "objects")
    near = near_pairs(named.drop("bits"), named.drop("bits"), [event], radius).where((F.abs(F.col("pt") - F.col("pt_b")) < tolerance) & (F.col("o_b") < F.col("o")))
    links = shared.written(near.select(F.col("id").alias("a"), F.col("id_b").alias("b"), F.col("o_b").alias("first")), "links")
    later = links.select(F.col("a").alias("id")).distinct()
    states = shared.written(named.join(later.withColumn("__l", F.lit(True)), "id", "left").select("id", F.when(F.col("__l").isNull(), True).alias("kept")), "kept")
    while not states.where("kept is null").isEmpty():
        heard = links.join(states.select(F.col("id").alias("b"), F.col("kept").alias("k")), "b").groupBy(F.col("a").alias("id")).agg(F.bool_or("k").alias("any"), F.count_if(F.col("k").isNull()).alias("open"))
        decided = F.when(F.col("any"), False).when(F.col("open") == 0, True)
        states = shared.written(states.join(heard, "id", "left").select("id", F.coalesce("kept", decided).alias("kept")), "kept")
    kept = states.where("kept").select("id")
    owners = links.join(kept.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min_by("b", "first").alias("owner"))
    owned = named.join(owners, "id", "left").join(kept.withColumn("__k", F.lit(True)), "id", "left")
    bits = owned.groupBy(F.when(F.col("__k"), F.col("id")).otherwise(F.col("owner")).alias("id")).agg(F.bit_or("bits").alias("bits"))
    return named.drop("bits").join(bits, "id").select(event, "eta", "phi", "pt", "bits")


def pair_matrix(df: DataFrame, keys: list[str], items: Column, scores: Column, most: int, fields: list[str]) -> DataFrame:
    """(keys, head, i, j, fields of i as a_..., of j as b_..., score): all ordered pairs of one row's items (structs), the
    item with itself included, beside the score matrix of each head (head, i, j). A row of more than `most` items, which
    would make most * most pairs, is an error, as is a matrix of another size. Rows without items have no pairs."""
    n = F.size(items)
    square = F.forall(scores, lambda m: (F.size(m) == n) & F.forall(m, lambda row: F.size(row) == n))
    checked = F.when(n > most, F.raise_error(F.concat(F.lit(f"a row has more than {most} items: "), n.cast("string"))).cast("boolean")).when(~square, F.raise_error(F.lit("scores and items differ in size")).cast("boolean")).otherwise(True)
    rows = df.select(*keys, items.alias("__items"), scores.alias("__scores")).where(checked)
    heads = rows.select(*keys, "__items", F.posexplode("__scores").alias("head", "__m"))
    first = heads.select(*keys, "head", "__items", F.posexplode(F.arrays_zip("__items", "__m")).alias("i", "__a"))
    pairs = first.select(*keys, "head", "i", F.col("__a")["__items"].alias("__x"), F.posexplode(F.arrays_zip("__items", F.col("__a")["__m"].alias("s"))).alias("j", "__b"))
    ends = [F.col(x)[f].alias(f"{name}_{f}") for name, x in (("a", "__x"), ("b", "__b.__items")) for f in fields]
    return pairs.select(*keys, "head", "i", "j", *ends, F.col("__b")["s"].alias("score"))


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points inside [low, high): an equi join on cells of the given width, then the exact test."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    both = points.withColumn("__cell", cell(at)).join(spread, [*(keys or []), "__cell"])
    return both.where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], width: float | None = None) -> DataFrame:
    """left with the values of right's latest row at or before each row: one union and one window instead of a join. With
    a width (seconds, where `at` is a time), a key's rows are cut into stretches of it, so that one key may hold any share
    of all rows: a stretch has its own window, and takes the last row of those before it from one row for each stretch."""
    side = lambda df, k: df.withColumn("__side", F.lit(k))
    r = side(right.select(*keys, at, F.struct(*values).alias("__v")), 0)
    both = side(left, 1).unionByName(r, allowMissingColumns=True)
    stretch = [] if width is None else ["__stretch"]
    if stretch:
        plain = dict(both.dtypes)[at] == "timestamp_ntz"  # no zone, so no clock change
        x = F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01', `{at}`)") if plain else F.col(at)
        both = both.withColumn("__stretch", F.floor(x.cast("double") / width).cast("long"))
    w = Window.partitionBy(*keys, *stretch).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__v", F.last("__v", True).over(w)).where("__side = 1")
    if stretch:
        ends = both.groupBy(*keys, "__stretch").agg(F.max_by(F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"))), F.when(F.col("__side") == 0, F.struct(F.col(at).isNotNull(), F.col(at)))).alias("__end"))
        up = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
        before = ends.select(*keys, "__stretch", F.last("__end.v", True).over(up).alias("__before"))
        out = same(out, before, [*keys, "__stretch"]).withColumn("__v", F.coalesce("__v", "__before"))
    return out.select(*left.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def by_position(frames: list[tuple[DataFrame, list[Column]]]) -> DataFrame:
    """Frames side by side: the rows that have one place in each frame's own order. Frames of unequal length are an
    error. The place, from 0, is the column row."""
    placed = [numbered(df, order, "row") for df, order in frames]
    sizes = [df.count() for df in placed]
    if len(set(sizes)) > 1:
        raise ValueError(f"tables of {sizes} rows cannot stand side by side")
    out = placed[0]
    for df in placed[1:]:
        out = out.join(df, "row")
    return out


def nearest_axis(reco: DataFrame, truth: DataFrame, event: list[str], key: str, index: str, axes: list[tuple[str, str]], radius: float) -> DataFrame:
    """(event, key, object, dr): the nearest true object of each reconstructed one, by the smallest of the distances to its
    axes (eta and phi columns), within a radius; the lower index decides between equals."""
    found = None
    for eta, phi in axes:
        axis = truth.select(*event, index, F.col(eta).alias("eta"), F.col(phi).alias("phi"))
        pairs = near_pairs(reco.select(*event, key, "eta", "phi"), axis, event, radius).select(*event, F.col(key), F.col(f"{index}_b").alias("object"), "dr")
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy(*event, key).agg(F.min(F.struct("dr", "object")).alias("__b"))
    return best.select(*event, key, F.col("__b.object").alias("object"), F.col("__b.dr").alias("dr"))
