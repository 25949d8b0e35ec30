"""Helpers shared by the training-data operators: scratch tables in the cluster's shared folder and small expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.shared import place

#: ASCII white space, as a character class of Java, DuckDB and Python regular expressions.
SPACE = r"\x20\x09-\x0D"


class Scratch:
    """Tables written to the shared folder, which survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, place(spark, name)
        self.tags: set[str] = set()

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(tag))
        self.tags.add(tag)
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, tag: str) -> None:
        """Free a table that no later plan reads."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(tag))
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self.tags.discard(tag)

    def keep_only(self, *tags: str) -> None:
        """Free all tables but these."""
        for tag in sorted(self.tags - set(tags)):
            self.drop(tag)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a lambda variable, so that body evaluates it once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words are runs without ASCII white space; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name
