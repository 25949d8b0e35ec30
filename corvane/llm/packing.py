"""Packing by minimum bin slack: documents are encoded, cut at the window where they are longer, and their remaining
lengths fill windows one after another.

Each window takes the longest remaining length and then the multiset of others whose sum comes closest to the rest of
the window: a bit set holds all sums that can be reached, added lengths shift it, and the counts are found by going
back over the shifts. A task packs its own documents block by block, so nothing is shuffled; only a block's last
windows have slack.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import encoder

WINDOW = 4096
#: Ids that a task gathers before it packs them; memory of a task is a few times 4 bytes of this.
BLOCK_TOKENS = 4_000_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def closest_counts(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most counts[length] of each, whose sum is the largest that capacity allows."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, many = min(counts[length], capacity // length), 1
        while left and not reach >> capacity:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= (reach << (length * many)) & full
            left -= many
            many *= 2
        if reach >> capacity:
            break
    total, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, many, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] += many
            total -= length * many
    return dict(chosen)


def windows(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Positions of lengths (each from 1 to capacity) window by window; of equal lengths the first come first."""
    waiting: dict[int, list[int]] = defaultdict(list)
    for i in reversed(range(len(lengths))):
        waiting[lengths[i]].append(i)
    counts = {k: len(v) for k, v in waiting.items()}
    found = []

    def take(length: int, many: int) -> list[int]:
        counts[length] -= many
        if not counts[length]:
            del counts[length]
        return [waiting[length].pop() for _ in range(many)]

    while counts:
        longest = max(counts)
        window = take(longest, 1)
        for length, many in closest_counts(counts, capacity - longest).items():
            window += take(length, many)
        found.append(window)
    return found


def pieces(documents: list[tuple[int | None, bytes]], first_sequence: int, capacity: int = WINDOW) -> Iterator[dict]:
    """Pieces of documents (id, ids as 4 bytes each), with sequences numbered from first_sequence."""
    sequence, rests = first_sequence, []

    def piece(d: int, start: int, length: int, offset: int) -> dict:
        key, ids = documents[d]
        return {"doc_id": key, "start": start, "length": length, "doc_tokens": len(ids) // 4, "sequence_id": sequence, "offset": offset, "ids": ids[4 * start : 4 * (start + length)]}

    for d, (_, ids) in enumerate(documents):
        n = len(ids) // 4
        for start in range(0, n - n % capacity, capacity):
            yield piece(d, start, capacity, 0)
            sequence += 1
        if n % capacity:
            rests.append((d, n - n % capacity, n % capacity))
    for window in windows([r[2] for r in rests], capacity):
        offset = 0
        for i in window:
            d, start, length = rests[i]
            yield piece(d, start, length, offset)
            offset += length
        sequence += 1


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, key: str = "doc_id", text: str = "text", capacity: int = WINDOW) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned
    32-bit numbers). Each document is its text's ids and then end_id; a null or empty text has end_id alone. Repeated
    rows and null keys are packed like others. Sequence ids are unique but not dense. Other columns are not read,
    and an empty table gives no piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_file), end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        block, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, block, size
            rows = list(pieces(block, sequence, capacity))
            if rows:
                sequence = rows[-1]["sequence_id"] + 1
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_pylist(rows[i : i + 2000], PIECES)
            block, size = [], 0

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.ids(t) + end
                block.append((k, ids))
                size += len(ids) // 4
                if size >= BLOCK_TOKENS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES_DDL)


def padding(lengths: list[int], capacity: int = WINDOW) -> int:
    """Padding of sequences of these total lengths, which are filled up to capacity except at a power of two."""
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)
