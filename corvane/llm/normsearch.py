"""Exact search for the largest inner products, over buckets of vectors of like length.

Candidates are grouped by length: a class holds lengths within a factor, and a class of many vectors is dealt over several
buckets by a hash, so every bucket is bounded. The longest vectors come first: they give each query a threshold, the k-th
largest score so far. With it a query passes over the classes that are too short to reach it, and in every other bucket
the local cosine threshold (threshold / (length of the query * longest length of the bucket)) chooses how to prune. Near
one, few directions are left, and the query's largest coordinates bound what the same coordinates of a unit vector can
be: coordinate pruning. Farther off, those bounds hold nothing back, and only the vectors that are long enough are
taken: length pruning. What is left is verified by exact products of whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import vectors
from corvane.llm.common import Scratch

#: Ratio of the squared lengths of neighbouring classes; classes are at most 63 / log2(RATIO), about 200.
RATIO = 1.25
#: Vectors of a bucket, queries of a block, and the vectors that give the first thresholds, all about.
BUCKET, BLOCK, AHEAD = 4096, 4096, 1024
#: Cosine threshold from which coordinates prune, and how many of a query's largest coordinates do.
COORDINATES_FROM, FOCUS = 0.8, 3
#: Queries whose products are held at a time.
SLICE = 256
FOUND = {"query": np.int64, "query_id": np.int64, "no_id": np.bool_, "vec_id": np.int64, "score": np.int64}
FOUND_DDL = "query bigint, query_id bigint, no_id boolean, vec_id bigint, score bigint"
#: Rounding that the bounds allow for.
SLACK = 1e-9


def feasible(unit: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value that each coordinate of a unit vector can have whose product with `unit` is `cosine` or
    more: with angles, |a - b| <= acos(cosine) for the angles a, b of both to the axis."""
    angle, reach = np.arccos(np.clip(unit, -1, 1)), math.acos(min(1.0, cosine))
    return np.cos(np.minimum(np.pi, angle + reach)) - SLACK, np.cos(np.maximum(0, angle - reach)) + SLACK


class Bucket:
    """Vectors of like length, the longest first."""

    def __init__(self, rows: pd.DataFrame, width: int):
        rows = rows.sort_values(["square", "row"], ascending=[False, True], kind="stable")
        self.row, self.vec_id, self.no_id = (rows[c].to_numpy() for c in ("row", "vec_id", "no_id"))
        self.points = vectors.matrix(list(rows["components"]), width)
        self.length = np.sqrt(rows["square"].to_numpy().astype(np.float64))
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by_coordinate(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of one coordinate of the unit vectors, and its values in that order."""
        if i not in self.sorted:
            values = self.points[:, i] / np.maximum(self.length, 1)
            order = np.argsort(values, kind="stable")
            self.sorted[i] = order, values[order]
        return self.sorted[i]

    def long_enough(self, query_length: float, threshold: float) -> int:
        """How many vectors, from the longest, can reach the threshold."""
        if threshold <= 0 or not query_length:
            return len(self.length)
        return int(np.searchsorted(-self.length, -(threshold / query_length) * (1 - SLACK), side="right"))

    def within(self, query: np.ndarray, length: float, cosine: float) -> np.ndarray:
        """Places of the vectors that are feasible in each of the query's largest coordinates."""
        unit = query / length
        low, high = feasible(unit, cosine)
        found = None
        for i in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            order, values = self.by_coordinate(int(i))
            own = np.zeros(len(order), bool)
            own[order[np.searchsorted(values, low[i]) : np.searchsorted(values, high[i], side="right")]] = True
            found = own if found is None else found & own
        return np.flatnonzero(found)


def best(bucket: Bucket, places: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Indexes into places of the k largest scores, equal ones by vec_id (null last), without the query's own row."""
    left = np.flatnonzero(bucket.row[places] != own)
    if len(left) > k:
        left = left[scores[left] >= np.partition(scores[left], len(left) - k)[len(left) - k]]
    order = np.lexsort((bucket.vec_id[places[left]], bucket.no_id[places[left]], -scores[left]))
    return left[order[:k]]


def searched(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k rows of one bucket for each query of one block: the columns of FOUND."""
    columns: list[list] = [[], [], [], [], []]
    if len(queries) and len(candidates):
        width = max(map(len, [*queries["components"], *candidates["components"]])) // 8
        bucket, asking = Bucket(candidates, width), vectors.matrix(list(queries["components"]), width)
        length = np.sqrt(queries["square"].to_numpy().astype(np.float64))
        threshold = queries["threshold"].astype("float64").fillna(-np.inf).to_numpy()
        most = length * bucket.length[0]
        cosine = np.divide(threshold, most, out=np.zeros(len(most)), where=most > 0)
        cosine[(most == 0) & (threshold > 0)] = 2  # a product of zero cannot reach it
        numbers, ids = queries["row"].to_numpy(), queries["vec_id"].to_numpy()

        def keep(i: int, places: np.ndarray, scores: np.ndarray) -> None:
            at = best(bucket, places, scores, numbers[i], k)
            for column, values in zip(columns, ([numbers[i]] * len(at), [ids[i]] * len(at), bucket.no_id[places[at]], bucket.vec_id[places[at]], scores[at]), strict=True):
                column.extend(values)

        by_length = np.flatnonzero(cosine < COORDINATES_FROM)
        for start in range(0, len(by_length), SLICE):
            at = by_length[start : start + SLICE]
            counts = [bucket.long_enough(length[i], threshold[i]) for i in at]
            scores = vectors.products(asking[at], bucket.points[: max(counts)])
            for i, n, own in zip(at, counts, scores, strict=True):
                keep(i, np.arange(n), own[:n])
        for i in np.flatnonzero((cosine >= COORDINATES_FROM) & (cosine <= 1 + SLACK)):
            places = bucket.within(asking[i], length[i], cosine[i])
            keep(i, places, vectors.products(asking[i : i + 1], bucket.points[places])[0])
    return pd.DataFrame({name: np.asarray(values, kind) for (name, kind), values in zip(FOUND.items(), columns, strict=True)})


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query's rows, with their rank."""
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "no_id", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top(table: DataFrame, k: int = 5, scale: int = 256, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows with the largest inner
    product of floor(scale * x), of all rows but its own; equal scores by the smaller vec_id.

    Vectors that are null or hold a null or non-finite component take no part; a vector of fewer components than another
    counts as filled with zeros. A row with a null id asks nothing but is found, after all ids of an equal score. Each of
    repeated rows asks for itself and finds the others, so their results are repeated. Other columns are not read. An
    empty table gives an empty table."""
    spark = table.sparkSession
    scratch = Scratch(spark, "normsearch")
    # A null would make pandas turn the ids to doubles.
    whole = vectors.quantised(table, scale, key, vector).select(F.col("vec_id").isNull().alias("no_id"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "components", "square")
    # The class of a length is the number of times that RATIO goes into its square; zero vectors have their own.
    of = F.when(F.col("square") > 0, F.floor(F.log(F.col("square").cast("double")) / math.log(RATIO)).cast("int")).otherwise(-1)
    rows = scratch.write(whole.withColumns({"row": F.monotonically_increasing_id(), "class": of}), "rows")
    asks = ~F.col("no_id") & (F.pmod("vec_id", F.lit(every)) == 0)
    classes = rows.groupBy("class").agg(F.count("*").alias("n"), F.max("square").alias("longest"), F.sum(asks.cast("long")).alias("asking")).orderBy(F.col("class").desc()).collect()
    blocks = max(1, -(-sum(r["asking"] or 0 for r in classes) // BLOCK))
    parts = {r["class"]: -(-r["n"] // BUCKET) for r in classes}
    ahead: list[int] = []
    for r in classes:
        ahead.append(r["class"])
        if sum(x["n"] for x in classes[: len(ahead)]) >= AHEAD:
            break
    last = ahead[-1] if ahead else -1
    layout = spark.createDataFrame([(r["class"], parts[r["class"]], math.sqrt(r["longest"])) for r in classes], "class int, parts int, longest double")
    dealt = lambda n: F.pmod(F.xxhash64("row", F.lit(3)), n).cast("int")
    candidates = rows.join(F.broadcast(layout), "class").withColumn("part", dealt(F.col("parts")))
    first = (F.col("class") > last) | (F.col("class") == last) & (F.col("part") == 0)
    queries = rows.where(asks).drop("class").withColumn("block", dealt(F.lit(blocks)))

    def search(visits: DataFrame, among: DataFrame, wanted: Column) -> DataFrame:
        """visits: queries with their threshold and each class that they visit; wanted: its buckets that they search."""
        keys, vector_of = ["class", "part", "block"], ["row", "no_id", "vec_id", "components", "square"]
        own = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(wanted).select(*keys, *vector_of, "threshold").toDF(*keys, *vector_of, "threshold")
        spread = among.where(wanted).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*keys, *vector_of)
        run = lambda a, b: searched(a, b, k)
        return own.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(run, FOUND_DDL)

    early = queries.withColumn("threshold", F.lit(None).cast("long")).join(F.broadcast(layout), F.col("class") >= last)
    led = scratch.write(search(early, candidates, first), "led")
    least = ranked(led, k).groupBy("query").agg(F.when(F.count("*") == k, F.min("score")).alias("threshold"))
    reached = F.col("threshold").isNull() | (F.sqrt("square") * F.col("longest") * (1 + SLACK) >= F.col("threshold"))
    later = queries.join(least, F.col("row") == F.col("query"), "left").join(F.broadcast(layout.where(F.col("class") <= last)), reached)
    visited = [r["class"] for r in later.select("class").distinct().collect()]
    found = scratch.write(search(later, candidates.where(F.col("class").isin(visited)), ~first).unionByName(led), "found")
    scratch.keep_only("found")
    return ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "score")
