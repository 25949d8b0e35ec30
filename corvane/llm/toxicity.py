"""Toxicity: class-conditional Kneser-Ney models of expressions, compared by length-normalised log-likelihood.

An expression is a word without its outer punctuation, lower-cased; a text counts each of its expressions once. Each
class has a Kneser-Ney model: discounted counts of its own, and what the discounts free goes by continuation counts that
both classes share (after how many different expressions one comes, in either class). So a rare expression is smoothed
by what both classes know of it.

A toxic text is mostly made of ordinary expressions, so its likelihood draws a share TOXIC_SHARE of its expressions from
the toxic model and the others from the ordinary one. A text's ratio is the sum of log(likelihood in a toxic text /
likelihood in an ordinary one) of all its expressions over their number. Two things keep it steady: a class with less
text frees more of its counts, so the toxic model is scaled to give expressions that neither class knows the likelihood
of the ordinary one; and a ratio counts from that of an average ordinary text, which is also what unknown expressions and
PRIOR_LENGTH further ones have. So 0 stands for a text of which nothing is known.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch

#: Labelled documents of each class that the models are fitted on, at most; chosen by a hash of their key. This bounds
#: the models, which hold every expression of the sample.
SAMPLE_DOCS = 20_000
DISCOUNT = 0.95
#: Share of a toxic text's expressions that the toxic model draws.
TOXIC_SHARE = 0.01
#: Expressions of an average ordinary text that every text's length is raised by.
PRIOR_LENGTH = 10
#: One in so many texts of the sample, by a hash of the text, sets the slope and offset of the score.
CALIBRATION_SHARE = 4
MEMO_ENTRIES = 500_000

EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127), 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2010, 0x2028), 0x2026]))


class Model(NamedTuple):
    """Hashes of known expressions in order, the log ratio toxic : ordinary of each, and the calibration."""

    known: np.ndarray
    ratio: np.ndarray
    slope: float
    offset: float


def pieces(text: str | None) -> list[bytes]:
    """Runs without ASCII white space."""
    return (text or "").encode().split()


def expression(piece: bytes) -> str:
    return piece.decode().strip(EDGES).lower()


def hashed(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode())


class Memo(dict):
    """Piece of a text -> log ratio of its expression, NaN where nothing is left of it."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, piece: bytes) -> float:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        word, m, found = expression(piece), self.model, math.nan
        if word:
            key = np.uint64(hashed(word))
            at = int(np.searchsorted(m.known, key))
            found = float(m.ratio[at]) if at < len(m.known) and m.known[at] == key else 0.0
        self[piece] = found
        return found


def normalised(memo: Memo, text: str | None) -> float:
    """Length-normalised log-likelihood ratio of a whole text; 0 without any expression."""
    own = pieces(text)
    found = np.fromiter(map(memo.__getitem__, own), np.float64, len(own))
    found = found[~np.isnan(found)]
    return float(found.sum() / (len(found) + PRIOR_LENGTH))


def shared_backoff(contexts: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Likelihood of each expression by the number of those it comes after, and last that of an unknown one."""
    total, n = max(float(contexts.sum()), 1.0), len(contexts)
    held = np.maximum(np.append(contexts, 0.0) - discount, 0) / total
    return held + (1 - held.sum()) / (n + 1)


def kneser_ney(counts: np.ndarray, contexts: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Likelihood of each expression, and last of an unknown one, in each class. counts: a row for each expression and a
    column for each class."""
    held = np.maximum(np.vstack([counts, np.zeros((1, counts.shape[1]))]) - discount, 0) / np.maximum(counts.sum(0), 1)
    return held + (1 - held.sum(0)) * shared_backoff(contexts, discount)[:, None]


def log_ratios(counts: np.ndarray, contexts: np.ndarray, share: float = TOXIC_SHARE, discount: float = DISCOUNT) -> np.ndarray:
    """Log ratio of each expression's likelihood in a toxic text to that in an ordinary one, less its mean over ordinary
    texts that the model does not know: each occurrence counts as if it had not been seen. Columns of counts are the
    ordinary class and the toxic one."""
    p = kneser_ney(counts, contexts, discount)
    even = p[-1, 0] / p[-1, 1]
    ratio = lambda ordinary: np.log1p(share * (even * p[:-1, 1] / ordinary - 1))
    ordinary, once_less = counts[:, 0], np.maximum(counts[:, 0] - 1, 0)
    held = lambda c: np.maximum(c - discount, 0) / max(float(ordinary.sum()), 1.0)
    still_known = ordinary * (counts.sum(1) > 1)
    mean = (still_known * ratio(p[:-1, 0] - held(ordinary) + held(once_less))).sum() / max(float(still_known.sum()), 1.0)
    return ratio(p[:-1, 0]) - mean


def fitted(words: np.ndarray, counts: np.ndarray, contexts: np.ndarray, slope: float = 1.0, offset: float = 0.0) -> Model:
    """Model of expressions (hashes, in any order), without those that no text has."""
    seen = np.flatnonzero(counts.sum(1) > 0)
    ratio = log_ratios(counts[seen].astype(np.float64), contexts[seen].astype(np.float64))
    known = words[seen].view(np.uint64)
    order = np.argsort(known)
    return Model(known[order], ratio[order], slope, offset)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of x for labels y, classes weighted alike, with a weak pull of the slope
    to what it was scaled to."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    scale = max(float(np.std(x)), 1e-9)
    z, w = x / scale, np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p) + 1e-12
        grad = np.asarray([(g * z).sum() + 1e-4 * a, g.sum()])
        hess = np.asarray([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum()]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a / scale), float(b)


def occurrences(sample: DataFrame) -> DataFrame:
    """(word, before, y, held) of each expression of each text of sample (text, y, held): hashes of the expression and of
    the one before it, 0 at the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, y, held in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "held")), strict=True):
                own = dict.fromkeys(w for w in map(expression, pieces(text)) if w)
                words = np.fromiter(map(hashed, own), np.uint64, len(own)).view(np.int64)
                before = np.concatenate([np.zeros(min(1, len(words)), np.int64), words[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(before), pa.array(np.full(len(words), y, np.int32)), pa.array(np.full(len(words), held))], names=["word", "before", "y", "held"])

    return sample.mapInArrow(run, "word bigint, before bigint, y int, held boolean")


def counted(sample: DataFrame) -> pa.Table:
    """(word, fit0, fit1, fit_contexts, all0, all1, all_contexts): texts of each class, and different expressions that
    come before, without the calibrating texts and with them."""
    of = {f"{name}{y}": (F.col("y") == y) & part for name, part in (("fit", ~F.col("held")), ("all", F.lit(True))) for y in (0, 1)}
    pairs = occurrences(sample).groupBy("word", "before").agg(*[F.count_if(test).alias(n) for n, test in of.items()])
    sums = [F.sum(n).cast("int").alias(n) for n in of]
    contexts = [F.count_if(F.col(f"{n}0") + F.col(f"{n}1") > 0).cast("int").alias(f"{n}_contexts") for n in ("fit", "all")]
    return pairs.groupBy("word").agg(*sums, *contexts).toArrow()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Models from the rows of labels (key, label 0 or 1; others are left out, as are keys without a document). Each
    class takes at most sample_docs documents; a text that the sample repeats counts once. Without both classes, and so
    from an empty table, no expression is known and every score is a half. Where the calibrating texts are of one class,
    all texts of the sample calibrate."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null").distinct()
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 0.0)
    if len(known.select("y").distinct().collect()) < 2:
        return nothing
    order = F.xxhash64(F.col("key").cast("string"))
    chosen = known.where("y = 1").orderBy(order, "key").limit(sample_docs).unionAll(known.where("y = 0").orderBy(order, "key").limit(sample_docs))
    texts = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    held = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION_SHARE)) == 0
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.write(texts.join(F.broadcast(chosen), "key").groupBy("text", "y").agg(F.first(held).alias("held")), "sample")
    counts = counted(sample)
    take = lambda *names: np.stack([counts.column(n).to_numpy() for n in names], 1)
    words = counts.column("word").to_numpy()
    first = fitted(words, take("fit0", "fit1"), counts.column("fit_contexts").to_numpy())
    for tried in (sample.where("held"), sample):
        ratios = tried.select("y", ratio(F.col("text"), first).alias("x")).toArrow()
        y = ratios.column("y").to_numpy()
        if len(np.unique(y)) == 2:
            break
    scratch.keep_only()
    slope, offset = calibrate(ratios.column("x").to_numpy(), y)
    return fitted(words, take("all0", "all1"), counts.column("all_contexts").to_numpy(), slope, offset)


def ratio(text: Column, model: Model) -> Column:
    """Length-normalised log-likelihood ratio toxic : ordinary of each whole text; 0 for null and empty texts."""
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(tuple(model))
    memo: list[Memo] = []

    @F.arrow_udf("double")
    def _ratio(texts: pa.Array) -> pa.Array:
        if not memo:
            memo.append(Memo(Model(*sent.value)))
        return pa.array([normalised(memo[0], t) for t in texts.to_pylist()], pa.float64())

    return _ratio(text)


def score(docs: DataFrame, model: Model, text: str = "text", result: str = "toxicity") -> DataFrame:
    """docs with a struct column `result` of ratio, score (0 to 1) and predicted (1 from a half on); an input column of
    that name is replaced. Null and empty texts have ratio 0 and the score of the offset. Repeated rows score alike, and
    an empty table gives an empty table."""
    x = ratio(F.col(text), model)
    bounded = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * F.col(result) + F.lit(model.offset)))
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded))
    out = docs.withColumn(result, x)
    return out.withColumn(result, F.struct(F.col(result).alias("ratio"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted")))
