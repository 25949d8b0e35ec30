"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, neardup, packing, quality, secrets
from corvane.llm.common import Scratch, fresh
from corvane.llm.registry import tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    verdict = fresh(docs, "verdict")
    return quality.assess(docs, result=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that with the smallest doc_id. Rows are told apart by a number that is
    written beside them, so null and repeated ids take no other rows along; a null doc_id stays only where its group has
    no other. Texts without words are groups of their own."""
    row, scratch = fresh(docs, "row"), Scratch(spark, "distinct")
    docs = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = neardup.groups(docs, key=row, size=5, percent=80).select(F.col("doc_id").alias(row), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    kept = found.join(docs.select(row, "doc_id"), row).groupBy("component_id").agg(first[row].alias(row)).select(row)
    return docs.join(kept, row, "left_semi").drop(row)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = fresh(docs, "leaks")
    return decontam.scan(docs, benchmark, result=leaks).where(F.size(leaks) == 0).drop(leaks)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars to match."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", uncontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Tokenizer ids cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet in the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), str(k))
    return docs
