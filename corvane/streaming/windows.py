"""Structured Streaming: windowed counts with late rows, cumulative statistics by batch, windows of rows of like length, and
values paired with the row before. These are extensions: what they compute over a finished stream equals the batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.order import numbered
from corvane.operators.stats import combined, partial


def source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows of each key and time window; rows later than `late` are dropped, and a window is emitted when it closes."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def session_counts(stream: DataFrame, ts: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Rows of each key's sessions, which end after a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def snapshots(stream: DataFrame, keys: list[str], x: str, path: str, checkpoint: str):
    """Start a query that appends the partial sums of each batch to a table; read_snapshot() merges them. A batch that
    runs again replaces its own part, so each row counts once."""

    def keep(batch: DataFrame, number: int) -> None:
        partial(batch, keys, F.col(x)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_snapshot(spark: SparkSession, path: str, keys: list[str], up_to: int | None = None) -> DataFrame:
    """Mean and deviation over all batches, or over those up to one."""
    parts = spark.read.parquet(path)
    return combined(parts if up_to is None else parts.where(F.col("batch") <= up_to), keys)


def paired_with_previous(stream: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """(key, order, x, previous x): the state of a key is its last value. Rows of one batch are taken in order."""
    kinds = dict(stream.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {x} double, previous double"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order)
        before = state.get[0] if state.exists else None
        values = rows[x].astype(float)
        yield pd.DataFrame({key: rows[key], order: rows[order], x: values, "previous": [before, *values.iloc[:-1]]})
        state.update((float(values.iloc[-1]),))

    return stream.groupBy(key).applyInPandasWithState(run, out, "last double", "append", "NoTimeout")


def length_bucket(length: Column, boundaries: list[int]) -> Column:
    """Number of the bucket of a length: bucket 0 lies under the first boundary, and a length at a boundary is above it. A
    null length is in bucket 0."""
    return sum((F.when(length >= b, 1).otherwise(0) for b in boundaries), F.lit(0))


def length_windows(stream: DataFrame, length: Column, boundaries: list[int], sizes: list[int], by: list[str], path: str, checkpoint: str):
    """Start a query that collects rows of like length into windows of a fixed size, for batches with little padding: sizes
    gives that of each bucket of length_bucket(). A window is written when it is full, so it holds rows of one or more
    batches, in the order of batches and within them of `by`, which tells rows apart. Rows that fill no window wait, with
    the number of windows so far, in tables beside the windows: at most size - 1 rows for each bucket. A batch reads what
    the batch before left and replaces its own parts, so one that runs again changes nothing; a path belongs to one
    checkpoint. Rows are numbered over partitions, so no bucket has to fit into one task."""
    if len(sizes) != len(boundaries) + 1:
        raise ValueError(f"{len(boundaries)} boundaries need {len(boundaries) + 1} sizes")
    if min(sizes) < 1 or sorted(set(boundaries)) != list(boundaries):
        raise ValueError("sizes are positive, boundaries ascend")

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"bucket": length_bucket(length, boundaries), "arrival": F.lit(number).cast("long")})
        done = spark.createDataFrame([(b, 0) for b in range(len(sizes))], "bucket int, windows long")
        if number > 0:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/held/batch={number - 1}"))
            done = spark.read.schema(done.schema).parquet(f"{path}/done/batch={number - 1}")
        placed = numbered(rows, [F.col("arrival"), *map(F.col, by)], "place", ["bucket"], total="__t")
        size = F.element_at(F.array(*map(F.lit, sizes)), F.col("bucket") + 1)
        whole = F.floor(F.col("__t") / size) * size
        full = placed.where(F.col("place") < whole).join(done, "bucket")
        full = full.withColumns({"window": F.col("windows") + F.floor(F.col("place") / size), "place": F.pmod("place", size)})
        parts = {"windows": full.drop("__t", "windows"), "held": placed.where(F.col("place") >= whole).drop("__t", "place")}
        parts["done"] = done.join(placed.groupBy("bucket").agg(F.max(F.floor(F.col("__t") / size)).alias("__w")), "bucket", "left").select("bucket", (F.col("windows") + F.coalesce("__w", F.lit(0))).alias("windows"))
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_length_windows(spark: SparkSession, path: str, by: list[str], flush: bool = False) -> DataFrame:
    """Rows of all full windows, with bucket, window (from 0 in each bucket) and place in it. flush adds those that still
    wait, as one short last window of each bucket."""
    full = spark.read.parquet(f"{path}/windows").drop("batch", "arrival")
    if not flush:
        return full
    done = spark.read.parquet(f"{path}/done")
    last = done.agg(F.max("batch")).first()[0]
    held = spark.read.parquet(f"{path}/held").where(F.col("batch") == last).join(done.where(F.col("batch") == last).drop("batch"), "bucket")
    w = Window.partitionBy("bucket").orderBy("arrival", *by)  # under one window's rows for each bucket
    rest = held.withColumn("place", (F.row_number().over(w) - 1).cast("long")).withColumnRenamed("windows", "window")
    return full.unionByName(rest.select(*full.columns))
