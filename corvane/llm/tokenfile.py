"""Token-id output: binary shards in ascending key order, with a minimal perfect hash index from keys to offsets.

A store is a folder. Each shard file holds the raw ids of its documents (16 bits each where the vocabulary allows it,
else 32), then flat arrays: keys, offsets, and the index with a fingerprint and a row for each slot, then a JSON footer
with their places. `manifest.parquet` has a row for each shard. Texts are range-partitioned by key, so each task
encodes and writes one shard as a stream and never holds more than its offsets and the open batch. Files are written
beside their place and moved there, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import hashindex
from corvane.llm.tokens import encoder

MAGIC = b"CVTOK001"
#: Bytes of raw ids that a reader takes at once.
READ_BYTES = 8 << 20

MANIFEST = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
MANIFEST_DDL = "shard int, file string, first_key bigint, last_key bigint, n_docs bigint, n_tokens bigint, n_bytes bigint"
ROWS = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
ROWS_DDL = "key bigint, start bigint, n_tokens bigint, ids binary"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a URI or a local path."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class ShardWriter:
    """Appends documents in key order; close() adds keys, offsets, index and footer. A null key is stored as a row
    without an index entry; of rows with one key the index has the first, the others follow it."""

    def __init__(self, out: pa.NativeFile, dtype: str):
        self.out, self.dtype = out, dtype
        self.keys: list[int | None] = []
        self.offsets = [0]

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.dtype).tobytes())
        self.keys.append(key)
        self.offsets.append(self.offsets[-1] + len(ids))

    def close(self) -> None:
        null = np.asarray([k is None for k in self.keys], bool)
        keys = np.asarray([0 if k is None else k for k in self.keys], np.int64)
        distinct, row = np.unique(keys[~null], return_index=True)
        row = np.flatnonzero(~null)[row]
        index = hashindex.build(distinct)
        slot = hashindex.slots(index, distinct)
        by_slot, prints = np.zeros(len(distinct), np.uint32), np.zeros(len(distinct), np.uint32)
        by_slot[slot], prints[slot] = row, hashindex.fingerprints(distinct)
        parts = {"keys": keys, "null": null.astype(np.uint8), "offsets": np.asarray(self.offsets, np.uint64), "row": by_slot, "fingerprint": prints} | index
        at, places = self.offsets[-1] * np.dtype(self.dtype).itemsize, {}
        for name, values in parts.items():
            data = values.astype(values.dtype.newbyteorder("<")).tobytes()
            self.out.write(data)
            places[name] = [at, len(values), values.dtype.newbyteorder("<").str]
            at += len(data)
        footer = json.dumps({"dtype": self.dtype, "parts": places}).encode()
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Shard:
    """One shard file. find() and ids() give keyed access in constant time for each key."""

    def __init__(self, path: str):
        system, place = filesystem(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a shard of token ids")
        n = int.from_bytes(tail[:8], "little")
        footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.dtype = np.dtype(footer["dtype"])
        self.parts = {k: np.frombuffer(self.file.read_at(count * np.dtype(kind).itemsize, at), kind) for k, (at, count, kind) in footer["parts"].items()}
        self.keys, self.offsets = self.parts["keys"], self.parts["offsets"].astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 for keys that are not there: perfect hash, then fingerprint, then the stored key."""
        keys = np.asarray(keys, np.int64)
        slot = hashindex.slots(self.parts, keys)
        rows = np.full(len(keys), -1, np.int64)
        if len(self.parts["row"]):
            safe = np.clip(slot, 0, None)
            row = self.parts["row"][safe].astype(np.int64)
            good = (slot >= 0) & (self.parts["fingerprint"][safe] == hashindex.fingerprints(keys)) & (self.keys[row] == keys)
            rows[good] = row[good]
        return rows

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        """Ids of `rows` documents that follow each other."""
        a, b = int(self.offsets[row]), int(self.offsets[row + rows])
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype).astype("<u4")


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append end_id to each document, and write a store in ascending order of an integer key.
    Returns its manifest. Null texts count as empty and so have end_id alone; null keys come first; rows with one key
    are ordered by their text's hash and then text, and a key with very many rows is spread over shards by that hash.
    An empty table gives a store without documents. Other columns are not read."""
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        end = np.asarray([end_id], np.uint32)
        shard = TaskContext.get().partitionId()
        system, folder = filesystem(path)
        name = f"shard-{shard:06d}.tok"
        draft = f"{folder}/_draft-{name}-{uuid.uuid4().hex}"
        writer = None
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    out = system.open_output_stream(draft)
                    writer = ShardWriter(out, "<u2" if max(encode.vocabulary - 1, end_id) < 1 << 16 else "<u4")
                writer.add(k, np.concatenate([np.frombuffer(encode.ids(t), "<u4"), end]))
        if writer is not None:
            writer.close()
            size = out.tell()
            out.close()
            system.move(draft, f"{folder}/{name}")
            known = [k for k in writer.keys if k is not None]
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "first_key": known[0] if known else None, "last_key": known[-1] if known else None, "n_docs": len(writer.keys), "n_tokens": writer.offsets[-1], "n_bytes": size}], MANIFEST)

    filesystem(path)[0].create_dir(filesystem(path)[1], recursive=True)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie, "text")
    ordered.mapInArrow(write, MANIFEST_DDL).write.mode("overwrite").parquet(f"{path}/manifest.parquet")
    return spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest.parquet")


def shards(spark: SparkSession, path: str) -> list:
    """Manifest rows in shard order, with `base`, the ids of all shards before. One small row for each file."""
    rows = sorted(spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest.parquet").collect(), key=lambda r: r["shard"])
    bases = accumulate((r["n_tokens"] for r in rows), initial=0)
    return [r.asDict() | {"base": b} for r, b in zip(rows, bases, strict=False)]


def indexed_rows(shard: Shard) -> np.ndarray:
    """Row of every document, in order of its key, as the index has it: the first row of a key comes from the perfect
    hash and fingerprint, rows that repeat a key follow their first, and rows of null keys, which no index holds, are
    where they stand."""
    n, null = len(shard.keys), shard.parts["null"] == 1
    first = shard.find(shard.keys)
    if (first[~null] < 0).any():
        raise ValueError("the index does not know a key that the shard holds")
    at = np.arange(n)
    fresh = np.concatenate([[True], (shard.keys[1:] != shard.keys[:-1]) | (null[1:] != null[:-1])])[:n]
    repeat = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return np.where(null, at, first + repeat)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store: key, start (ids of all documents before it), n_tokens and ids (little-endian unsigned
    32-bit numbers). A task reads one shard, and takes the place of each document's ids from the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from _documents(Shard(f"{path}/{file}"), base)

    rows = [(r["file"], r["base"]) for r in shards(spark, path)]
    found = spark.createDataFrame(rows, "file string, base bigint")
    return found.repartition(max(1, len(rows))).mapInArrow(read, ROWS_DDL)


def _documents(shard: Shard, base: int) -> Iterator[pa.RecordBatch]:
    """Documents at the rows that the index gives; rows that follow each other in the file are read together."""
    rows, null = indexed_rows(shard), shard.parts["null"] == 1
    breaks = np.append(np.flatnonzero(np.diff(rows) != 1) + 1, len(rows))
    at = 0
    while at < len(rows):
        row = int(rows[at])
        together = int(breaks[np.searchsorted(breaks, at, side="right")]) - at
        limit = shard.offsets[row] + READ_BYTES // 4
        stop = min(row + together, max(row + 1, int(np.searchsorted(shard.offsets, limit, side="right")) - 1))
        ids, start = shard.ids(row, stop - row), shard.offsets[row]
        ends = (shard.offsets[row : stop + 1] - start).astype(np.int32) * 4
        data = pa.Array.from_buffers(pa.binary(), stop - row, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())])
        own = slice(at, at + stop - row)
        starts = pa.array(shard.offsets[row:stop] + base, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(shard.keys[own], pa.int64(), mask=null[own]), starts, pa.array(np.diff(shard.offsets[row : stop + 1]), pa.int64()), data], schema=ROWS)
        at += stop - row


def look_up(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Documents of a store by key: one row (key, start, n_tokens, ids) for each row of keys that the store has; of
    documents with one key, the first. Keys go to the task that holds their shard; null and unknown keys give no row."""
    spark = keys.sparkSession
    held = [r for r in shards(spark, path) if r["first_key"] is not None]
    last = np.asarray([r["last_key"] for r in held], np.int64)

    @F.arrow_udf("int")
    def shard_of(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(last, values.to_numpy(zero_copy_only=False)), pa.int32())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Shard | None] = (-1, None)
        for batch in batches:
            at, wanted = batch.column("shard").to_numpy(), batch.column("key").to_numpy()
            for s in np.unique(at):
                if s >= len(held):
                    continue
                if opened[0] != s:
                    opened = (s, Shard(f"{path}/{held[s]['file']}"))
                shard = opened[1]
                asked = wanted[at == s]
                rows = shard.find(asked)
                good = rows >= 0
                out = [{"key": int(k), "start": int(shard.offsets[r]) + held[s]["base"], "n_tokens": int(shard.offsets[r + 1] - shard.offsets[r]), "ids": shard.ids(int(r)).tobytes()} for k, r in zip(asked[good], rows[good], strict=True)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, ROWS)

    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key is not null")
    if not held:
        return spark.createDataFrame([], ROWS_DDL)
    placed = wanted.withColumn("shard", shard_of("key"))
    spread = F.pmod(F.xxhash64("key"), F.lit(8))
    return placed.repartition("shard", spread).sortWithinPartitions("shard").mapInArrow(find, ROWS_DDL)
