"""Queries on decays to three pions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import geometry as geo
from corvane.functions import polarimetry
from corvane.queries import query, table


def decays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, tau, p1, p2, p3): three pions made of each vector, and the tau that a neutrino of the fitting energy makes
    of them. Vectors whose pions are heavier than a tau decay to none."""
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    pion = lambda k: geo.p4(F.lit(8.0) * (1 + F.abs(e(k))), 1 + F.lit(0.25) * e(k + 1), F.lit(0.25) * e(k + 2), F.lit(polarimetry.PION))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", pion(0).alias("p1"), pion(3).alias("p2"), pion(6).alias("p3"), (1 + F.lit(0.25) * e(9)).alias("eta"), (F.lit(0.25) * e(10)).alias("phi"))
    h = geo.p4_sum(geo.p4_sum(F.col("p1"), F.col("p2")), F.col("p3"))
    rows = rows.withColumn("h", h).withColumn("d", geo.p4(F.lit(1.0), F.col("eta"), F.col("phi"), F.lit(0.0)))
    mass2 = F.pow(geo.invariant_mass(F.col("h")), F.lit(2.0))
    room: Column = F.lit(polarimetry.TAU**2) - mass2
    # (h + x d)^2 = h^2 + 2 x (h d) is the tau's squared mass.
    hd = F.col("h.e") * F.col("d.e") - F.col("h.px") * F.col("d.px") - F.col("h.py") * F.col("d.py") - F.col("h.pz") * F.col("d.pz")
    x = F.try_divide(room, 2 * hd)
    neutrino = F.struct(*[(x * F.col("d")[c]).alias(c) for c in ("px", "py", "pz", "e")])
    return rows.where(room > 0).withColumn("tau", geo.p4_sum(F.col("h"), neutrino)).select("vec_id", "tau", "p1", "p2", "p3")


@query("polarimetry_a1")
def polarimetry_a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarimetric vector, angles and structure functions of each decay, with the charged amplitudes, and the vector with
    those of two neutral pions beside it."""
    four = [F.col(c) for c in ("tau", "p1", "p2", "p3")]
    found = decays(spark, sf_dir).select("vec_id", polarimetry.three_pions(*four, neutral=False).alias("r"), polarimetry.three_pions(*four).alias("n"))
    names = ("hx", "hy", "hz", *polarimetry.ANGLES, *polarimetry.STRUCTURES)
    return found.select("vec_id", *[F.round(F.col("r")[c], 6).alias(c) for c in names], *[F.round(F.col("n")[c], 6).alias(f"neutral_{c}") for c in names[:3]])
