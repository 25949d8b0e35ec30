"""Near-duplicates against all pairs, odd rows, and the Bayesian pruning."""

from __future__ import annotations

import random
import re

import numpy as np

from corvane.llm import neardup, registry


def shingle_set(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size=4, percent=80):
    """component id by row position, from all pairs."""
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for own in groups.values():
        ids = [rows[i][0] for i in own if rows[i][0] is not None]
        for i in own:
            out[i] = (rows[i][0], len(sets[i]), min(ids) if ids else None)
    return sorted(out.values(), key=str)


def result(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def test_op10_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(registry.op10_neardup(spark, sf)) == brute(rows)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Many different near copies of one text, over more than one block, with strays that few others reach."""
    monkeypatch.setattr(neardup, "ASKING", 8)
    monkeypatch.setattr(neardup, "ASKED", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.groups(df)) == brute(rows)


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (None, text), (7, text.upper()), (7, text), (9, text + " more"), (None, "alone here"), (11, "a " * 30000), (12, "a " * 30001), (13, "É b c d e"), (14, "é b c d e")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, node string, component_id int")
    assert result(neardup.groups(df)) == brute(rows)
    assert neardup.groups(df.limit(0)).count() == 0
    assert result(neardup.groups(df, size=5, percent=80)) == brute(rows, 5)


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    least = neardup.fewest_matches(80)
    lost = 0
    for _ in range(4000):
        equal = np.cumsum(rng.random(neardup.BANDS * neardup.ROWS) < 0.8)[neardup.BATCH - 1 :: neardup.BATCH]
        lost += bool((equal < least).any())
    assert lost <= 2 and least[-1] > 0.6 * neardup.BANDS * neardup.ROWS


def test_rows_repeated_thousands_of_times(spark, monkeypatch):
    """Two near texts that many rows repeat are two nodes and two sets, and no block holds a node twice."""
    words = [f"w{i}" for i in range(60)]
    one, two, three = " ".join(words), " ".join([*words[:59], "x"]), " ".join([*words[:58], "y", "z"])
    rows = [(1, one)] * 4000 + [(2, two)] * 4000 + [(None, three)] * 500 + [(3, "something else altogether")] * 3
    written = {}
    write = neardup.Scratch.write
    monkeypatch.setattr(neardup.Scratch, "write", lambda self, df, tag: written.setdefault(tag, write(self, df, tag)) if tag == "sets" else write(self, df, tag))
    monkeypatch.setattr(neardup.Scratch, "keep_only", lambda self, *tags: None)
    found = result(neardup.groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)))
    assert written["sets"].count() == 3
    assert {(r[0], r[2]) for r in found} == {(1, 1), (2, 1), (None, 1), (3, 3)} and len(found) == len(rows)
