"""Plain Lloyd clustering of whole-number vectors: every round broadcasts the centroids, each task sums its own vectors
by nearest centroid, and a grouping merges the tasks' sums. All arithmetic is on integers, so neither partitions nor
retries change a result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import vectors
from corvane.llm.common import Scratch


def nearest(centroids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point, the smaller one of equals, and the squared distance to it."""
    distances = np.empty((len(points), len(centroids)), np.int64)
    for k, centroid in enumerate(centroids):
        difference = points - centroid
        distances[:, k] = np.einsum("ij,ij->i", difference, difference)
    found = distances.argmin(axis=1)
    return found, distances[np.arange(len(points)), found]


def sums(points: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Of each centroid that has vectors: how many, and the sums of their components. A task emits one row for each
    centroid; the driver gets one for each centroid of all."""
    sent, size = points.sparkSession.sparkContext.broadcast(centroids), centroids.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        n, total = np.zeros(len(own), np.int64), np.zeros(own.shape, np.int64)
        for batch in batches:
            if len(batch):
                rows = vectors.matrix(list(batch["components"]))
                found, _ = nearest(own, rows)
                for k in np.unique(found):
                    n[k] += (found == k).sum()
                    total[k] += rows[found == k].sum(axis=0)
        at = np.flatnonzero(n)
        if len(at):
            yield pd.DataFrame({"cluster": at.astype(np.int32), "n": n[at], "total": [total[k].tolist() for k in at]})

    parts = points.select("components").mapInPandas(run, "cluster int, n bigint, total array<bigint>")
    merged = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))
    return {r["cluster"]: (r["n"], r["total"]) for r in merged.collect()}


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    sent = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found, distance = nearest(sent.value, vectors.matrix(list(batch["components"])))
                yield pd.DataFrame({"no_id": batch["no_id"], "vec_id": batch["vec_id"], "cluster": found.astype(np.int32), "distance": distance})

    # A null would make pandas turn the ids to doubles.
    rows = points.select(F.col("vec_id").isNull().alias("no_id"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "components")
    found = rows.mapInPandas(run, "no_id boolean, vec_id bigint, cluster int, distance bigint")
    return found.select(F.when(~F.col("no_id"), F.col("vec_id")).alias("vec_id"), "cluster", "distance")


def cluster(table: DataFrame, clusters: int = 8, rounds: int = 10, scale: int = 1024, size: int = 64, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each vector of exactly `size` components, none of them null or non-finite: vec_id, cluster, distance
    (squared, of floor(scale * x)), cluster_inertia, inertia and centroid_sha256.

    The first centroids are the vectors with the smallest sha256 of `seed:vec_id`, in that order; rows of one id in the
    order of their components' bytes, a null id last. With fewer vectors than clusters there are as many clusters as vectors. A centroid that has no vectors stays as it is. Repeated rows are points of their own and get equal
    results; rows with a null id take part. Other columns are not read. An empty table gives an empty table."""
    spark = table.sparkSession
    scratch = Scratch(spark, "lloyd")
    points = scratch.write(vectors.quantised(table, scale, key, vector, size).select("vec_id", "components"), "points")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    ahead = points.select(name.alias("name"), "components").orderBy(F.col("name").asc_nulls_last(), "components").limit(clusters).collect()
    centroids = vectors.matrix([bytes(r["components"]) for r in ahead], size).copy()
    for _ in range(rounds if len(centroids) else 0):
        for k, (n, total) in sums(points, centroids).items():
            centroids[k] = [x // n for x in total]
    placed = scratch.write(assigned(points, centroids), "placed")
    scratch.keep_only("placed")
    inertia = {r["cluster"]: r["inertia"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids.tolist()]
    facts = spark.createDataFrame([(k, v, sum(inertia.values()), digests[k]) for k, v in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
