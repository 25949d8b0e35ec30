"""Queries whose results SQL cannot express, or that pass through files."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import geometry, spin
from corvane.operators import density
from corvane.plans import histograms
from corvane.queries import query, table
from corvane.sources import io, shared


@query("io_roundtrip", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice / 2), 2) AS half FROM orders GROUP BY 1")
def io_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared.place(spark, "roundtrip")
    o = table(spark, sf_dir, "orders")
    io.snapshot(o, f"{root}/parquet", ["o_orderkey", "o_totalprice", "o_orderstatus"], by=["o_orderstatus"], rows_per_file=100_000)
    io.snapshot(io.scan(spark, [f"{root}/parquet"], ["o_orderstatus", "half"], aliases={"half": "o_totalprice / 2"}), f"{root}/json", kind="json", compression="gzip")
    back = spark.read.schema("o_orderstatus string, half double").json(f"{root}/json")
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("half"), 2).alias("half"))


#: Size that a merged file should just reach.
MERGED_BYTES = 200_000


@query("files_merged", "SELECT count(*) AS rows, round(sum(o_totalprice), 2) AS total, true AS one_file_each, true AS all_in_size FROM orders")
def files_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by many small files, merged to a size: the rows, whether every batch is one file, and whether the files of
    each batch just reach the size."""
    root = shared.place(spark, "merged")
    table(spark, sf_dir, "orders").repartition(40).write.parquet(f"{root}/small")
    files = sorted((r["path"], r["size"]) for r in io.discovered(spark, f"{root}/small", r".*\.parquet").collect())
    n = io.merged_files(spark, files, MERGED_BYTES, f"{root}/large")
    size = dict(files)
    batches = [[size[f] for f in own] for own in io.size_batches(files, MERGED_BYTES)]
    right = all(sum(own[:-1]) < MERGED_BYTES for own in batches) and all(sum(own) >= MERGED_BYTES for own in batches[:-1])
    made = io.discovered(spark, f"{root}/large", r".*\.parquet").count()
    back = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/large")
    return back.agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.lit(made == n).alias("one_file_each"), F.lit(right).alias("all_in_size"))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        t = -i * (i - a)
        b += 2
        d = 1 / (t * d + b or 1e-300)
        c = b + t / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def kolmogorov(x: float) -> float:
    """Chance of a larger scaled distance."""
    return 1.0 if x < 0.2 else min(1.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)))


@query("chunk_pvalue")
def chunk_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a larger chi-square than each chunk has against the first; 99 where there is nothing to compare."""

    @F.pandas_udf("double")
    def p_value(chi2: pd.Series, bins: pd.Series) -> pd.Series:
        return pd.Series([upper_gamma((n - 1) / 2, x / 2) if n > 1 else 99.0 for x, n in zip(chi2, bins, strict=True)])

    return histograms.chunk_chi2(spark, sf_dir).withColumn("p", F.round(p_value("chi2", "bins"), 6))


@query("kde_bandwidth")
def kde_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of prices by status, from all pairs of them."""
    found = density.bandwidths(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")
    return found.select("o_orderstatus", F.round("bandwidth", 2).alias("bandwidth"))


@query("boost_acoplanarity")
def boost_acoplanarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acoplanarity of pairs of a one-pion and a two-pion decay, made of embedding components."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")

    def p(k: int, scale: float, mass: float):
        return geometry.p4(F.lit(scale) * (1 + F.abs(e(k))), 2 * e(k + 1), 4 * e(k + 2), F.lit(mass))

    rows = table(spark, sf_dir, "embeddings").select("vec_id", p(0, 40.0, geometry.TAU_MASS).alias("t1"), p(3, 35.0, geometry.TAU_MASS).alias("t2"), p(6, 20.0, 0.1396).alias("a"), p(9, 10.0, 0.1396).alias("b"), p(12, 12.0, 0.135).alias("c"))
    angle = spin.pair_acoplanarity(*map(F.col, ("t1", "t2", "a", "b", "c")))
    return rows.select("vec_id", F.round(angle, 6).alias("angle"))
