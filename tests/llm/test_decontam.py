"""Decontamination against exhaustive scoring and plain containment."""

from __future__ import annotations

import random

import numpy as np

from corvane.llm import decontam, registry
from corvane.llm.decontam import OVERLAP, RETRIEVE_AT, Index, Scanner, block_max_wand, grams, normal_words, question_and_answer


def items_of(n, rng):
    vocabulary = [f"w{i}" for i in range(300)]
    return [(i, " ".join(rng.choice(vocabulary[: rng.choice((30, 300))]) for _ in range(rng.randint(3, 60))) + ". " + " ".join(rng.choice(vocabulary) for _ in range(8)) + ".") for i in range(n)]


def test_block_max_wand_finds_what_exhaustive_scoring_finds():
    rng = random.Random(2)
    index = Index(items_of(150, rng))
    for _ in range(300):
        terms = np.unique(np.asarray(rng.sample(range(len(index.terms)), rng.randint(1, 90))))
        score = [0.0] * len(index.items)
        for t in terms:
            for k in range(index.first[t], index.first[t + 1]):
                score[index.docs[k]] += index.scores[k]
        for threshold in (0.2, 0.5):
            assert [i for i, _ in block_max_wand(index, terms, threshold)] == [i for i, s in enumerate(score) if s >= threshold - 1e-9]


def brute(text, items):
    """Every item against every window, without an index."""
    words, found = normal_words(text or ""), set()
    for start in range(0, max(1, len(words)), decontam.STRIDE):
        near = words[max(0, start - decontam.STRIDE) : start + 3 * decontam.STRIDE]
        for k, t in items:
            q, a = question_and_answer(t)
            if q and all(len(grams(x) & {tuple(near[i : i + min(5, len(x))]) for i in range(len(near))}) >= OVERLAP * len(grams(x)) for x in (q, a)):
                found.add(k)
    return sorted(found)


def test_scanner_against_every_window():
    rng = random.Random(3)
    items = items_of(40, rng)
    scanner = Scanner(items)
    for n in range(60):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(0, 400))]
        at = rng.randint(0, len(words))
        passage = items[rng.randrange(40)][1].split()
        if n % 3 == 0:
            passage[rng.randrange(len(passage))] = "changed"
        text = " ".join(words[:at] + passage * (n % 2) + words[at:])
        assert [x["item_id"] for x in scanner.leaks(text)] == brute(text, items)


def test_op7_finds_every_whole_item(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in registry.op7_decontam(spark, sf).collect()}
    assert got == {(d, i) for d, t in docs for i in brute(t, items)}
    assert {(d, i) for d, t in docs for i, x in items if x in t} <= got and got


def test_exact_copies_of_long_items_are_found_wherever_they_lie():
    rng = random.Random(4)
    made = lambda n: " ".join(f"v{rng.randrange(4000)}" for _ in range(n))
    items = items_of(30, rng) + [(100 + n, made(n - 20) + ". " + made(20) + ".") for n in (128, 129, 300, 700, 1100, 2000)]
    items += [(200, made(500) + "."), (201, made(20) + ". " + made(1500) + ".")]
    scanner = Scanner(items)
    for k, text in items[30:]:
        for before in (0, 1, 63, 200, 511, 1500):
            found = scanner.leaks(f"{made(before)} {text} {made(300)}")
            assert [(x["item_id"], x["question_overlap"], x["answer_overlap"]) for x in found] == [(k, 1.0, 1.0)]
    assert scanner.leaks(made(6000)) == []


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "Was it red? It was a red fox.", 1), (None, "was it RED? it was a red fox", 1), (5, "x " * 40000, 1)], "doc_id long, text string, leaks int")
    bench = spark.createDataFrame([(1, "Was it red? It was a red fox."), (1, "Was it red? It was a red fox."), (2, None), (None, "x x x"), (3, "...")], "item_id long, text string")
    out = {r.doc_id: [x.item_id for x in r.leaks] for r in decontam.scan(docs, bench).collect()}
    assert out == {1: [], 2: [], 3: [1], None: [1], 5: []}
    assert RETRIEVE_AT < 1 and {r.doc_id: [x.item_id for x in r.leaks] for r in decontam.scan(docs, bench, index_items=1).collect()} == out
    assert [r.leaks for r in decontam.scan(docs, bench.limit(0)).collect()] == [[]] * 5
    assert decontam.scan(docs.limit(0), bench).count() == 0


def test_dealing_items_over_several_indexes_changes_nothing(spark):
    rng = random.Random(6)
    items = items_of(60, rng) + [(60, None), (61, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join([f"w{rng.randrange(300)}" for _ in range(90)] + items[rng.randrange(60)][1].split()[rng.randrange(3) :] * (n % 4 > 0)) for n in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = ({r.doc_id: [x.asDict() for x in r.leaks] for r in decontam.scan(docs, bench, index_items=k).collect()} for k in (2000, 5))
    assert one == many and sum(map(len, one.values())) > 40
    assert one == {k: decontam.Scanner(items).leaks(t) for k, t in enumerate(texts)}
