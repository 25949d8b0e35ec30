"""Streams against the batch results over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators.stats import combined, partial
from corvane.streaming import windows

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def written(spark, sf, path, n=3):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    for k in range(n):
        rows.where(F.col("event_id") % n == k).coalesce(1).write.mode("append").parquet(path)
    return rows


def finished(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    rows = written(spark, sf, path)
    stream = windows.source(spark, path, SCHEMA, 10)
    got = finished(windows.windowed_counts(stream, "ts", ["event_type"], "6 hours", late="60 days"), "tumbling", "complete")
    expect = rows.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").count().select(F.col("w.start"), "event_type", "count")
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == sorted(map(tuple, expect.collect()))


def test_snapshots_merge_to_the_whole(spark, sf, tmp_path):
    path = str(tmp_path / "events")
    rows = written(spark, sf, path)
    windows.snapshots(windows.source(spark, path, SCHEMA), ["event_type"], "value", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    shown = lambda df: sorted((r.event_type, r.n, round(r["mean"], 9), round(r["std"], 9)) for r in df.collect())
    assert shown(windows.read_snapshot(spark, str(tmp_path / "out"), ["event_type"])) == shown(combined(partial(rows, ["event_type"], F.col("value")), ["event_type"]))
    assert windows.read_snapshot(spark, str(tmp_path / "out"), ["event_type"], 0).agg(F.sum("n")).first()[0] < rows.count()


def test_previous_value_is_kept_across_batches(spark, tmp_path):
    path = str(tmp_path / "rows")
    for part in ([(1, 1, 1.0), (2, 1, 9.0)], [(1, 3, 3.0), (1, 2, 2.0)]):
        spark.createDataFrame(part, "k long, t long, x double").coalesce(1).write.mode("append").parquet(path)
    stream = windows.source(spark, path, "k long, t long, x double")
    got = finished(windows.paired_with_previous(stream, "k", "t", "x"), "pairs", "append")
    assert sorted(((r.k, r.t, r.x, r.previous) for r in got.collect()), key=str) == [(1, 1, 1.0, None), (1, 2, 2.0, 1.0), (1, 3, 3.0, 2.0), (2, 1, 9.0, None)]


def test_windows_by_length_equal_the_batch_query(spark, sf, tmp_path):
    path, rows = str(tmp_path / "docs"), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars")
    edge = rows.approxQuantile("doc_id", [0.2, 0.5, 0.9], 0.0)
    part = sum((F.when(F.col("doc_id") > e, 1).otherwise(0) for e in edge), F.lit(0))
    for k in range(4):  # files arrive in the order of doc_id
        rows.where(part == k).coalesce(1).write.mode("append").parquet(path)
    boundaries, sizes, out = [200, 1000, 4000], [7, 16, 5, 3], str(tmp_path / "out")
    kinds = dict(rows.dtypes)
    start = lambda: windows.length_windows(windows.source(spark, path, f"doc_id {kinds['doc_id']}, n_chars {kinds['n_chars']}"), F.col("n_chars"), boundaries, sizes, ["doc_id"], out, str(tmp_path / "check")).awaitTermination(180)
    start()
    seen = {}
    for r in sorted(rows.collect()):
        seen.setdefault(sum(r.n_chars >= b for b in boundaries), []).append(r.doc_id)
    expect = sorted((b, k // sizes[b], k % sizes[b], d) for b, ids in seen.items() for k, d in enumerate(ids))
    shown = lambda df: sorted((r.bucket, r.window, r.place, r.doc_id) for r in df.collect())
    assert shown(windows.read_length_windows(spark, out, ["doc_id"], flush=True)) == expect
    whole = {b: len(ids) // sizes[b] * sizes[b] for b, ids in seen.items()}
    assert shown(windows.read_length_windows(spark, out, ["doc_id"])) == [e for e in expect if e[1] * sizes[e[0]] + e[2] < whole[e[0]]]
    start()  # nothing new arrives, nothing changes
    assert shown(windows.read_length_windows(spark, out, ["doc_id"], flush=True)) == expect


def test_windows_by_length_need_a_size_for_each_bucket(spark):
    import pytest

    with pytest.raises(ValueError):
        windows.length_windows(None, F.col("n"), [10], [4], ["n"], "", "")
    with pytest.raises(ValueError):
        windows.length_windows(None, F.col("n"), [10, 5], [4, 4, 4], ["n"], "", "")
    got = spark.createDataFrame([(None,), (9,), (10,), (99,)], "n int").select(windows.length_bucket(F.col("n"), [10, 50])).collect()
    assert [r[0] for r in got] == [0, 0, 1, 2]
