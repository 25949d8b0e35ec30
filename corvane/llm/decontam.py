"""Benchmark decontamination: every passage of every document queries a BM25 index of test items by block-max WAND.

Items are indexed by their words; an item's score is a share of what its own text scores against it, so one threshold
holds for short and long items. A passage is a window of words; windows overlap by half. Windows are as long as the items
they are for: items are classed by length, each class has twice the stride of the one before, and two strides hold any
item of the class, so one of the windows over an exact copy has half of its score. Items lie in blocks, short ones
together, and each word has its largest score in each block. A window whose words cannot reach the threshold together in
any block is passed over without a query: the block-max bound, taken for all windows of a text at once. A query takes
the bounds again over its distinct words, skips the postings of blocks that stay below the threshold, and scores those
of the others. An item that a window retrieves is verified: of the word 5-grams of its question (all but the last sentence) and of its answer (the last sentence), enough must occur in
the window and its neighbours.

The index is broadcast, so it holds at most INDEX_ITEMS items; a larger benchmark is dealt over several indexes, and each
is one more pass over the documents' words. Word frequencies and the mean length are those of all items, so the dealing
changes no score. Each document is judged in its own row: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Words from one window to the next for the shortest class of items; a window is two strides long.
STRIDE = 64
#: Share of an item's own score at which a window retrieves it.
RETRIEVE_AT = 0.5
#: Share of the 5-grams of question and of answer that a window must have.
OVERLAP = 0.6
GRAM = 5
#: Blocks of an index, and items of one index; both bound the memory of a task.
BLOCKS = 128
INDEX_ITEMS = 2_000
#: Rounding that the bounds allow for.
SLACK = 1e-4
MEMO_ENTRIES = 500_000

WORD = re.compile(r"[a-z0-9ß-öø-ɏͰ-\U0010ffff]+")
SENTENCE = re.compile(r"(?<=[.!?])[\x20\t-\r]+|\n+")


def normal_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; whatever else stands between them separates."""
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last; an item of one sentence is both."""
    sentences = [w for w in map(normal_words, SENTENCE.split(text)) if w]
    if len(sentences) < 2:
        own = sentences[0] if sentences else []
        return own, own
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def grams(words: list) -> set[tuple]:
    """Distinct 5-grams; a shorter text is one gram."""
    n = min(GRAM, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


class Item(NamedTuple):
    item_id: int
    question: list[str]
    answer: list[str]

    @property
    def words(self) -> list[str]:
        return self.question if self.question is self.answer else self.question + self.answer

    @property
    def stride(self) -> int:
        """Stride of the item's class: the smallest doubling of STRIDE of which two hold all its words."""
        stride = STRIDE
        while 2 * stride < len(self.words):
            stride *= 2
        return stride


class Statistics(NamedTuple):
    """Of all items of a benchmark, however many indexes they are dealt over."""

    items: int
    mean_words: float
    frequency: dict[str, int]

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Statistics:
        words = [w for w in (normal_words(t or "") for _, t in items) if w]
        return Statistics(len(words), sum(map(len, words)) / max(1, len(words)), Counter(x for w in words for x in set(w)))


class Index:
    """Inverted index with BM25 scores as shares of each item's own score, and the largest score of each block. Without
    statistics the items are the whole benchmark."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        every = statistics or Statistics.of(items)
        self.items = [Item(k, *question_and_answer(t or "")) for k, t in items]
        self.items = sorted((x for x in self.items if x.question), key=lambda x: (x.stride, len(set(x.words))))
        counts = [Counter(x.words) for x in self.items]
        length = [sum(c.values()) for c in counts]
        self.terms = {w: i for i, w in enumerate(sorted({w for c in counts for w in c}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, c in enumerate(counts):
            score = {w: math.log(1 + (every.items - every.frequency[w] + 0.5) / (every.frequency[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * length[i] / every.mean_words)) for w, n in c.items()}
            own = math.fsum(score.values())
            for w, s in score.items():
                postings[self.terms[w]].append((i, s / own))
        self.first = np.cumsum([0, *map(len, postings)])  # of each word's postings
        self.docs = np.asarray([i for x in postings for i, _ in x], np.int64)
        self.scores = np.asarray([v for x in postings for _, v in x])
        self.block = max(1, -(-len(counts) // BLOCKS))
        self.block_most = np.zeros((len(postings) + 1, BLOCKS), np.float32)  # the last row is for words that no item has
        for term, own in enumerate(postings):
            for i, score in own:
                self.block_most[term, i // self.block] = max(self.block_most[term, i // self.block], score)
        self.classes: dict[int, range] = {}  # stride -> its items
        for i, x in enumerate(self.items):
            self.classes[x.stride] = range(self.classes.get(x.stride, range(i, i)).start, i + 1)


def block_max_wand(index: Index, terms: np.ndarray, threshold: float, within: range | None = None) -> list[tuple[int, float]]:
    """All (item, score) with a score of threshold or more, of all items or those within a range, in order of item; terms
    are distinct."""
    within = range(len(index.items)) if within is None else within
    open_ = index.block_most[terms].sum(0) >= threshold - SLACK
    open_[: within.start // index.block] = False
    open_[-(-within.stop // index.block) :] = False
    if not open_.any():
        return []
    first, count = index.first[terms], index.first[terms + 1] - index.first[terms]
    at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
    at = at[open_[index.docs[at] // index.block]]
    score = np.bincount(index.docs[at], index.scores[at], len(index.items))
    return [(int(i), float(score[i])) for i in np.flatnonzero(score >= threshold - 1e-9) if i in within]


class Memo(dict):
    """White-space-separated piece -> number of its word, -1 for a word that no item has; pieces of no word or several
    have a number under -1 that stands for a tuple in `several`."""

    def __init__(self, terms: dict[str, int]):
        self.terms, self.several = terms, []

    def __missing__(self, piece: str) -> int:
        own = [self.terms.get(w, -1) for w in normal_words(piece)]
        if len(own) == 1:
            number = own[0]
        else:
            number = -2 - len(self.several)
            self.several.append(own)
        self[piece] = number
        return number

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of all words of a text."""
        if len(self) >= MEMO_ENTRIES:
            self.clear()
            self.several.clear()
        pieces = text.split()
        found = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        odd = np.flatnonzero(found < -1)
        if not len(odd):
            return found
        parts = np.split(found, odd)
        return np.concatenate([parts[0], *(x for p in parts[1:] for x in (np.asarray(self.several[-2 - p[0]], np.int64), p[1:]))])


class Scanner:
    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        self.index = Index(items, statistics)
        self.memo = Memo(self.index.terms)

    def leaks(self, text: str | None) -> list[dict]:
        """Items that a whole text holds, by item_id, each with its best window."""
        ids = self.memo.numbers(text or "")
        if not len(ids) or not len(self.index.items):
            return []
        best: dict[int, dict] = {}
        for stride, own in self.index.classes.items():
            for k in self.windows(ids, stride, own):
                start = stride * int(k)
                known = np.unique(ids[start : start + 2 * stride])
                known = known[known >= 0]
                retrieved = block_max_wand(self.index, known, RETRIEVE_AT, own)
                if not retrieved:
                    continue
                near = ids[max(0, start - stride) : start + 3 * stride].tolist()
                for i, score in retrieved:
                    found = self.verified(self.index.items[i], near)
                    if found and (i not in best or (-score, start) < (-best[i]["score"], best[i]["start_word"])):
                        best[i] = {"item_id": self.index.items[i].item_id, "score": score, "question_overlap": found[0], "answer_overlap": found[1], "start_word": start}
        return sorted(best.values(), key=lambda r: r["item_id"])

    def windows(self, ids: np.ndarray, stride: int, own: range) -> np.ndarray:
        """Windows of a class whose bound reaches the threshold in some block of its items. A word counts once for each
        half of a window."""
        most = self.index.block_most[:, own.start // self.index.block : -(-own.stop // self.index.block)]
        halves = -(-len(ids) // stride)
        at = np.flatnonzero(ids >= 0)
        cell = np.unique(at // stride * len(most) + ids[at])
        half, term = cell // len(most), cell % len(most)
        bound = np.zeros((halves + 1, most.shape[1]), np.float32)
        if len(cell):
            first = np.flatnonzero(np.diff(half, prepend=-1))
            bound[half[first]] = np.add.reduceat(most[term], first, axis=0)
        return np.flatnonzero((bound[:-1] + bound[1:]).max(1) >= RETRIEVE_AT - SLACK)

    def verified(self, item: Item, near: list[int]) -> tuple[float, float] | None:
        """Overlap of question and answer with the words near a window, if both are enough."""
        terms, shares = self.index.terms, []
        for own in (item.question, item.answer):
            words = [terms[w] for w in own]
            n = min(GRAM, len(words))
            window = {tuple(near[i : i + n]) for i in range(len(near) - n + 1)}
            wanted = grams(words)
            shares.append(len(wanted & window) / len(wanted))
        return (shares[0], shares[1]) if min(shares) >= OVERLAP else None


LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start_word", pa.int64())])
LEAKS_DDL = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,start_word:bigint>>"


def scanned(text: Column, rows: list[tuple[int, str]], statistics: Statistics) -> Column:
    """Leaks of each whole text for the items (item_id, text) of one index."""
    sent = SparkSession.active().sparkContext.broadcast((rows, statistics))
    made: list[Scanner] = []

    @F.arrow_udf(LEAKS_DDL)
    def _scan(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Scanner(*sent.value))
        return pa.array([made[0].leaks(t) for t in texts.to_pylist()], pa.list_(LEAK))

    return _scan(text)


def dealt(items: DataFrame, parts: int) -> list[tuple[list[tuple[int, str]], Statistics]]:
    """Items of each index with the statistics of all items, as far as the index's own words go."""

    @F.arrow_udf("array<string>")
    def words_of(texts: pa.Array) -> pa.Array:
        return pa.array([normal_words(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))

    known = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).alias("part"), words_of("text").alias("words"))
    n, mean = known.where(F.size("words") > 0).agg(F.count("*"), F.coalesce(F.avg(F.size("words")), F.lit(0.0))).first()
    own = known.select("part", F.explode(F.array_distinct("words")).alias("word"))
    frequency = own.groupBy("word").agg(F.count("*").alias("n"))
    of_parts = own.distinct().join(frequency, "word")
    found = []
    for p in range(parts):
        rows = sorted((tuple(r) for r in known.where(F.col("part") == p).select("item_id", "text").collect()), key=lambda r: (r[0], r[1] or ""))
        found.append((rows, Statistics(n, mean, {r["word"]: r["n"] for r in of_parts.where(F.col("part") == p).collect()})))
    return found


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", result: str = "leaks", item: str = "item_id", item_text: str = "text", index_items: int = INDEX_ITEMS) -> DataFrame:
    """docs with an array column `result` of leaked items (item_id, score, question_overlap, answer_overlap, start_word),
    in order of item_id; an input column of that name is replaced. Null and empty texts leak nothing. Items without a
    word or with a null id are left out, and of items with one id the results are kept apart. Repeated rows are judged
    alike. Without items every array is empty, and an empty table gives an empty table. index_items bounds an index, not
    the benchmark, and changes no result: the statistics are those of all items."""
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("item_id is not null").distinct()
    parts = max(1, -(-items.count() // index_items))
    found = [scanned(F.col(text), *part) for part in dealt(items, parts)]
    return docs.withColumn(result, F.array_sort(F.concat(*found)) if parts > 1 else found[0])
