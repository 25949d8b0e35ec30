"""The corpus pipeline stage by stage against brute force, and over odd rows."""

from __future__ import annotations

import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from corvane.llm import decontam, packing, quality, registry, secrets  # noqa: E402
from corvane.llm.tokens import Encoder  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept_copies(rows):
    """Smallest doc_id of each group of texts with a 5-word Jaccard similarity of 0.8 or more."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def test_stages(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    (_, good), (_, distinct), (_, clean), (_, safe), (_, packed) = corpus_pipeline.STAGES
    verdict = {r.doc_id for r in quality.assess(source).where("quality.kept").collect()}
    a = good(spark, source, sf)
    assert a.columns == COLUMNS and {r.doc_id for r in a.collect()} == verdict
    b = distinct(spark, a, sf)
    expect = kept_copies([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == COLUMNS and {r.doc_id for r in b.collect()} == expect
    scanner = decontam.Scanner([(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    c = clean(spark, b, sf)
    assert c.columns == COLUMNS and {r.doc_id for r in c.collect()} == {r.doc_id for r in b.collect() if not scanner.leaks(r.text)}
    d = safe(spark, c, sf)
    before = {r.doc_id: r for r in c.collect()}
    after = d.collect()
    assert d.columns == COLUMNS and len(after) == len(before)
    for r in after:
        assert r.text == secrets.redacted_text(before[r.doc_id].text, "[SECRET]") and r.n_chars == len(r.text)
    encode = Encoder(registry.tokenizer_path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: r.start):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + r.ids
    assert ids == {r.doc_id: encode.ids(r.text) + np.asarray([2], "<u4").tobytes() for r in after}
    assert max(r.offset + r.length for r in rows) <= packing.WINDOW


def test_odd_tables(spark, sf):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "the of and to " * 30, None, None, 1), (3, "the of and to " * 30, None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() >= 2 or name == "quality rules"
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_distinct_keeps_one_row_of_each_group_with_null_and_repeated_ids(spark, sf):
    text = " ".join(f"word{i}" for i in range(100))
    other, third, fourth = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, text), (None, text + " more"), (None, other), (None, "clean and alone"), (5, third), (5, fourth), (4, third), (2, text), (1, text), (None, other), (7, "twice the same row"), (7, "twice the same row"), (8, None), (8, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = corpus_pipeline.distinct(spark, docs, sf)
    got = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
    assert found.columns == COLUMNS
    assert got == sorted([(1, text), (None, other), (None, "clean and alone"), (4, third), (5, fourth), (7, "twice the same row"), (8, None), (8, None)], key=str)
