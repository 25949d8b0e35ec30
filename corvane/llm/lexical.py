"""Ranked lexical search over an inverted index, by variable-block-max WAND.

The index is a table of shards: a shard is a bounded number of words of consecutive documents of one task, with one row
for its documents and one for each of its terms. A search takes from it only the terms that the items ask for. In each
shard, a term's postings are cut into blocks of variable length: dynamic programming chooses the boundaries that minimise
the bound error (by how much the block's largest score is above the scores in it, summed) plus a price for each block.
The block maxima of an item's terms add up to a bound for every document. Documents are taken from the highest bound
downwards, and only the blocks that reach one of them are opened, until the next bound is below the k-th best score. WAND
moves its pivot past documents whose bounds cannot reach that score; here the pivots of a whole shard are found at
once, as an array. Shards yield their best k, which a grouping merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import Scratch

#: Words at which a shard is closed; a document is never cut, so one shard can hold more.
SHARD_WORDS = 2_000_000
#: Items that are searched together.
ITEMS = 256
#: Most postings of a block, and the price of a block in postings of mean score.
MOST, PRICE = 64, 4
#: Lists whose boundaries are chosen together, and documents that are scored first; each turn takes twice as many.
LISTS, TURN = 8192, 64

#: Bytes of ASCII: letters in lower case, digits, and a space for all else. Bytes of other characters stay.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("at", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
INDEX_DDL = "shard bigint, term string, df bigint, at array<int>, counts array<bigint>, keys array<bigint>"


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a whole text, as UTF-8: runs of ASCII letters, digits and characters beyond ASCII; A-Z lower-cased."""
    return (text or b"").translate(PLAIN).split()


class Numbers(dict):
    """Term -> its number, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


class Shard:
    """Documents of one shard while they are read."""

    def __init__(self) -> None:
        self.numbers, self.keys, self.lengths, self.found = Numbers(), [], [], []
        self.words = 0

    def add(self, key: int | None, text: bytes | None) -> None:
        words = terms(text)
        if words:
            own = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            self.keys.append(key)
            self.lengths.append(len(own))
            self.found.append(own)
            self.words += len(own)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """One row for the documents, without a term (their keys, their lengths, and in `at` which have no key), and one
        for each term."""
        n = len(self.keys)
        if not n:
            return
        cell, count = np.unique(np.concatenate(self.found) * n + np.repeat(np.arange(n), self.lengths), return_counts=True)
        term, at = cell // n, (cell % n).astype(np.int32)
        df = np.bincount(term, minlength=len(self.numbers))
        names = [None, *(t.decode() for t in self.numbers)]
        ends = np.cumsum([0, n, *df])
        no_key = np.asarray([k is None for k in self.keys], np.int32)
        keys = pa.array([[k or 0 for k in self.keys], *[None] * len(df)], pa.list_(pa.int64()))
        counts = lists(np.concatenate([self.lengths, count]), ends, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(df) + 1, shard)), pa.array(names, pa.string()), pa.array([n, *df.tolist()], pa.int64()), lists(np.concatenate([no_key, at]), ends, pa.int32()), counts, keys], schema=INDEX)


def indexed(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows of the index. Nothing is shuffled: a task makes shards of the documents that it reads. Documents without
    terms are left out; repeated rows and rows with a null key are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_ = TaskContext.get().partitionId() << 32, Shard()
        for batch in batches:
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                open_.add(k, t.as_py())
                if open_.words >= shard_words:
                    yield from open_.rows(number)
                    number, open_ = number + 1, Shard()
        yield from open_.rows(number)

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text")).mapInArrow(run, INDEX_DDL)


def boundaries(scores: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """True where a block begins: of every list (scores[start : start + length]) the cut into blocks of at most MOST that
    minimises the sum of the blocks' largest scores times their lengths plus a price for each block. (The scores
    themselves add up to the same in every cut.) All lists advance together, one posting at a time."""
    begins = np.zeros(len(scores), bool)
    back = np.zeros(len(scores), np.int32)
    by_length, dear = np.argsort(-length, kind="stable"), PRICE * np.maximum(1, np.add.reduceat(scores, start) // length)
    for chunk in np.array_split(by_length, -(-len(by_length) // LISTS)):
        first, n = start[chunk], length[chunk]
        price = dear[chunk]
        width = min(MOST, int(n[0]))
        cost = np.full((len(n), width), np.iinfo(np.int64).max // 4)  # cheapest cut of all before a block's begin, by begin modulo width
        most = np.zeros((len(n), width), np.int64)  # largest score since then
        own, begin = np.zeros(len(n), np.int64), np.zeros(width, np.int64)
        active = len(n)
        for j in range(int(n[0])):
            active = int(np.searchsorted(-n[:active], -j, side="left")) if n[active - 1] <= j else active
            slot = j % width
            begin[slot], cost[:active, slot], most[:active, slot] = j, own[:active], 0
            score = scores[first[:active] + j]
            np.maximum(most[:active], score[:, None], out=most[:active])
            total = most[:active] * (j + 1 - begin) + cost[:active]
            best = total.argmin(axis=1)
            own[:active] = total[np.arange(active), best] + price[:active]
            back[first[:active] + j] = begin[best]
        # From the last posting of each list back to the begin of its block, and so on.
        end, at = n - 1, first
        while len(at):
            begin_of = back[at + end]
            begins[at + begin_of] = True
            left = begin_of > 0
            at, end = at[left], begin_of[left] - 1
    return begins


class Blocks(NamedTuple):
    """Blocks of a shard's postings: the postings of each (from, to), its first and last document, its largest score."""

    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray
    last: np.ndarray
    most: np.ndarray


def blocked(at: np.ndarray, scores: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[Blocks, np.ndarray]:
    """Blocks of all lists, and of each list its first block."""
    begins = np.flatnonzero(boundaries(scores, start, length))
    stop = np.append(begins[1:], len(scores))
    return Blocks(begins, stop, at[begins], at[stop - 1], np.maximum.reduceat(scores, begins)), np.searchsorted(begins, np.append(start, len(scores)))


def spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = stop - start
    return np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)


def walk(blocks: Blocks, own: np.ndarray, times: np.ndarray, at: np.ndarray, scores: np.ndarray, documents: int, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a shard with the k best scores above 0 and these, for an item whose terms have the blocks `own`, each
    `times` over. keys gives the order of equal scores."""
    most = blocks.most[own] * times
    change = np.zeros(documents + 1, np.int64)
    np.add.at(change, blocks.first[own], most)
    np.subtract.at(change, blocks.last[own] + 1, most)
    bound = np.cumsum(change[:-1])
    order = np.argsort(-bound, kind="stable")
    order = order[: np.searchsorted(-bound[order], 0, side="left")]
    found, score_of, done, turn, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(TURN, k), 1
    while done < len(order) and bound[order[done]] >= least:
        now = order[done : done + turn]
        now = now[bound[now] >= least]
        done, turn = done + turn, 2 * turn
        wanted = np.zeros(documents + 1, np.int64)
        wanted[now + 1] = 1
        before = np.cumsum(wanted)
        opened = before[blocks.last[own] + 1] > before[blocks.first[own]]
        rows = spans(blocks.start[own[opened]], blocks.stop[own[opened]])
        exact = np.zeros(documents, np.int64)
        np.add.at(exact, at[rows], scores[rows] * np.repeat(times[opened], (blocks.stop - blocks.start)[own[opened]]))
        found, score_of = np.concatenate([found, now]), np.concatenate([score_of, exact[now]])
        best = np.lexsort((keys[found], -score_of))[:k]
        best = best[score_of[best] > 0]
        found, score_of = found[best], score_of[best]
        least = score_of[-1] if len(found) == k else 1
    return found, score_of


def searched(rows: pd.DataFrame, k: int, n_documents: int, n_words: int) -> pd.DataFrame:
    """The best k documents of one shard for each item of one part. rows: the shard's documents (no term) and its terms,
    with their weight and the items that ask for them, each so many times."""
    columns: dict[str, list] = {"item": [], "no_key": [], "doc_id": [], "score": []}
    is_term = rows["term"].notna().to_numpy()
    own = rows[is_term]
    if len(own):
        documents = rows[~is_term].iloc[0]
        ids, lengths, none = (np.asarray(documents[c], kind) for c, kind in (("keys", np.int64), ("counts", np.int64), ("at", bool)))
        keys = np.empty(len(ids), np.int64)
        keys[np.lexsort((ids, none))] = np.arange(len(ids))
        length = own["df"].to_numpy(np.int64)
        start = np.cumsum(length) - length
        at, tf = np.concatenate(own["at"].to_list()).astype(np.int64), np.concatenate(own["counts"].to_list()).astype(np.int64)
        m = 75 + (25 * lengths * n_documents) // n_words
        scores = np.repeat(own["weight"].to_numpy(np.int64), length) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[at]))
        blocks, first = blocked(at, scores, start, length)
        asked = np.concatenate(own["items"].to_list()).astype(np.int64)
        times = np.concatenate(own["times"].to_list()).astype(np.int64)
        term = np.repeat(np.arange(len(own)), [len(x) for x in own["items"]])
        by_item = np.argsort(asked, kind="stable")
        for own_terms in np.split(by_item, np.flatnonzero(np.diff(asked[by_item])) + 1):
            a, b = first[term[own_terms]], first[term[own_terms] + 1]
            found, score = walk(blocks, spans(a, b), np.repeat(times[own_terms], b - a), at, scores, len(ids), keys, k)
            columns["item"] += [asked[own_terms[0]]] * len(found)
            columns["no_key"] += none[found].tolist()
            columns["doc_id"] += ids[found].tolist()
            columns["score"] += score.tolist()
    return pd.DataFrame({c: np.asarray(v, bool if c == "no_key" else np.int64) for c, v in columns.items()})


def asked(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, item_id, term, times) of every row of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[t.decode() for t in terms(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(own, pa.list_(pa.string()))], names=["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).cast("long").alias("item_id"), F.col(text).cast("string").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "item bigint, item_id bigint, terms array<string>")
    return found.select("item", "item_id", F.explode("terms").alias("term")).groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def search(spark: SparkSession, index: DataFrame, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of an index with the highest scores above 0 for every item, equal
    scores by the smaller doc_id (null last). index is a written table of `indexed`."""
    scratch = scratch or Scratch(spark, "search")
    of_docs = index.where("term is null")
    n_documents, n_words = of_docs.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()
    queries = scratch.write(asked(items, key, text), "queries")
    parts = max(1, -(-queries.select("item").distinct().count() // ITEMS))
    frequency = index.where("term is not null").join(queries.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("frequency"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * n_documents + 2) / (2 * F.col("frequency") + 1)).cast("double")))
    part = F.pmod(F.xxhash64("item", F.lit(11)), F.lit(parts)).cast("int").alias("part")
    users = queries.join(frequency, "term").select(part, "term", weight.alias("weight"), "item", "times")
    users = users.groupBy("part", "term").agg(F.max("weight").alias("weight"), F.collect_list("item").alias("items"), F.collect_list("times").alias("times"))
    columns = ["part", "shard", "term", "df", "at", "counts", "keys", "weight", "items", "times"]
    none = F.lit(None).cast("array<bigint>")
    every = of_docs.withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "weight": F.lit(None).cast("bigint"), "items": none, "times": none})
    together = index.where("term is not null").join(users, "term").select(*columns).unionByName(every.select(*columns))
    run = lambda rows: searched(rows, k, n_documents, n_words)
    found = together.groupBy("part", "shard").applyInPandas(run, "item bigint, no_key boolean, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "no_key", "doc_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(queries.select("item", "item_id").distinct(), "item")
    return named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("no_key"), F.col("doc_id")).alias("doc_id"), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Index docs (doc_id, text) and rank them for every item (item_id, text): item_id, rank, doc_id, score.

    Null and empty texts have no terms: such a document is not found and does not count, such an item finds nothing.
    Repeated documents and those with a null doc_id are documents of their own; repeated items give repeated rows, and an
    item with a null id is searched like others. Ranks are unique. Other columns are not read. An empty table on either
    side gives an empty table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexical")
    return search(spark, scratch.write(indexed(docs, shard_words=shard_words), "index"), items, k, scratch=scratch)
