"""Vectors as rows of whole numbers: quantised, checked, and kept as bytes for numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = pa.schema([("vec_id", pa.int64()), ("components", pa.binary()), ("size", pa.int32()), ("square", pa.int64())])
DDL = "vec_id bigint, components binary, size int, square bigint"


def quantised(vectors: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding", size: int | None = None) -> DataFrame:
    """(vec_id, components, size, square) of every vector (with `size` components, if given) that is not null and has no
    null or non-finite component: components are floor(scale * x) as little-endian 64-bit integers, square is the sum of
    their squares. Repeated rows stay, a null vec_id too. Raises where squared differences would not fit 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy()
            raw = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become nan
            row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
            keep = (length >= 0) & (np.bincount(row[~np.isfinite(raw)], minlength=len(length)) == 0)
            keep &= True if size is None else length == size
            length, values = length[keep], np.floor(scale * raw[keep[row]])
            if len(values) and not 4.0 * length.max() * np.abs(values).max() ** 2 < 2.0**63:
                raise ValueError("a component is too large for 64-bit products")
            whole, ends = values.astype("<i8"), np.cumsum([0, *length])
            squares = np.cumsum(np.concatenate([[0], whole * whole]))  # may wrap around; differences do not
            components = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(whole)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), components, pa.array(length, pa.int32()), pa.array(squares[ends[1:]] - squares[ends[:-1]], pa.int64())], schema=SCHEMA)

    return vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, DDL)


def matrix(rows: list[bytes], width: int | None = None) -> np.ndarray:
    """Rows of components as one array of 64-bit integers; shorter rows are filled with zeros."""
    sizes = [len(r) // 8 for r in rows]
    width = max(sizes, default=0) if width is None else width
    if all(n == width for n in sizes):
        return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)
    found = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        found[i, : sizes[i]] = np.frombuffer(r, "<i8")
    return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with the rows of b, exactly: in doubles where no sum can pass 2**53."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
