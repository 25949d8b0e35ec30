"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is a Column over the row's own text, so the whole operator is one narrow projection: no shuffle, no
Python. Windows of three words are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import SPACE, let, words

#: Frequent words of the four languages.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "was", "as", "at", "by", "an", "or", "this", "from", "are"],
    "de": ["der", "die", "das", "und", "ist", "von", "mit", "den", "des", "nicht", "ein", "eine", "zu", "im", "dem", "auf", "für", "sich"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "pour", "par", "est", "sur", "avec"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "que", "un", "una", "en", "es", "por", "con", "para", "se", "no", "su"],
}
ALL_STOP_WORDS = sorted({w for group in STOP_WORDS.values() for w in group})


class Rule(NamedTuple):
    """A text fails when its measure lies outside [low, high]; None leaves an end open."""

    name: str
    measure: str
    low: float | None
    high: float | None


THRESHOLDS = [
    Rule("length", "n_words", 50, 1_000_000),
    Rule("mean_word_length", "mean_word_chars", 2.0, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("alphabetic_words", "alpha_ratio", 0.6, None),
    Rule("capitals", "upper_ratio", None, 0.6),
    Rule("bullet_lines", "bullet_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", None, 0.3),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("repeated_words", "repeat_ratio", None, 0.5),
]


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def window_hashes(w: Column) -> Column:
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))


def covered_words(hashes: Column) -> Column:
    """Words inside three-word windows that occur twice or more. Sorting pairs (hash, position) brings equal windows
    together; the sorted positions of repeated windows then give the union of their three words each."""

    def positions(pairs: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(pairs, i)["x"] == F.get(pairs, j)["x"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.sort_array(F.transform(twice, lambda i: F.get(pairs, i)["i"]))

    def union(p: Column) -> Column:
        gap = lambda j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(3)))
        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda a, j: a + gap(j))

    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    return F.when(repeated, let(let(pairs, positions), union)).otherwise(F.lit(0).cast("long"))


def repeat_words(w: Column) -> Column:
    return F.coalesce(F.when(F.size(w) >= 3, let(window_hashes(w), covered_words)), F.lit(0).cast("long"))


def counts(text: Column) -> Column:
    """Struct of all raw counts of one text."""
    stop, longest = F.array(*[F.lit(w) for w in ALL_STOP_WORDS]), max(map(len, ALL_STOP_WORDS))

    def from_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_intersect(F.transform(F.filter(w, lambda x: F.length(x) <= longest), F.lower), stop)).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        )

    def from_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda y: y.rlike(rf"^[{SPACE}]*[-*•]"))).cast("long").alias("n_bullets"),
            F.size(F.filter(x, lambda y: y.rlike(rf"(\.\.\.|…)[{SPACE}]*$"))).cast("long").alias("n_ellipses"),
        )

    return F.struct(
        let(words(text), from_words).alias("w"),
        let(lines_with_words(text), from_lines).alias("l"),
        F.length(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), " \t\n\x0b\x0c\r", text)).cast("long").alias("word_chars"),
        symbol_count(text).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
    )


def measures(c: Column) -> dict[str, Column]:
    """Named measures of the threshold table; ratios of nothing are 0."""
    part = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "n_words": c["w"]["n_words"],
        "mean_word_chars": part(c["word_chars"], c["w"]["n_words"]),
        "symbol_ratio": part(c["n_symbols"], c["word_chars"]),
        "n_stop_words": c["w"]["n_stop_words"],
        "alpha_ratio": part(c["w"]["n_alpha_words"], c["w"]["n_words"]),
        "upper_ratio": part(c["n_upper"], c["n_letters"]),
        "bullet_ratio": part(c["l"]["n_bullets"], c["l"]["n_lines"]),
        "ellipsis_ratio": part(c["l"]["n_ellipses"], c["l"]["n_lines"]),
        "dup_line_ratio": part(c["l"]["n_dup_lines"], c["l"]["n_lines"]),
        "repeat_ratio": part(c["w"]["n_repeat_words"], c["w"]["n_words"]),
    }


def compile_rules(c: Column, rules: list[Rule]) -> Column:
    """The threshold table as one array column of the names of broken rules."""
    have = measures(c)

    def broken(rule: Rule) -> Column:
        x, tests = have[rule.measure], []
        if rule.low is not None:
            tests.append(x < F.lit(rule.low))
        if rule.high is not None:
            tests.append(x > F.lit(rule.high))
        return tests[0] if len(tests) == 1 else tests[0] | tests[1]

    return F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))


def assess(docs: DataFrame, text: str = "text", result: str = "quality", rules: list[Rule] | None = None) -> DataFrame:
    """docs with a struct column `result` of counts, broken rules, base_failed and kept; an input column of that name is
    replaced, all others stay. Null and empty texts have no words and fail. Repeated rows are judged alike, and
    an empty table gives an empty table."""
    body = F.coalesce(F.col(text), F.lit(""))

    def judged(c: Column) -> Column:
        n, repeated = c["w"]["n_words"], c["w"]["n_repeat_words"]
        failed = (n < 50) | (F.lit(100) * repeated > F.lit(50) * n)
        broken = compile_rules(c, THRESHOLDS if rules is None else rules)
        return F.struct(
            n.alias("n_words"),
            c["word_chars"].alias("word_chars"),
            c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            failed.alias("base_failed"),
            broken.alias("broken"),
            (~failed & (F.size(broken) == 0)).alias("kept"),
        )

    return docs.withColumn(result, let(counts(body), judged))
