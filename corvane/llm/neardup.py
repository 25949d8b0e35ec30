"""MinHash near-dedup with sequential Bayesian verification.

Sketches: each text's set of word shingles gives one minimum for each of BANDS x ROWS hash functions. Texts with equal
sets are one node. A bucket is the nodes that agree on a whole band.

Within a bucket, first one leader is compared with all others, and then, once the components of those links are known,
every node outside the bucket's largest component with all nodes of other components. (Pairs within one component
need no look: a link there changes nothing.) Both comparisons run in blocks of bounded size and in two passes. The
first compares signatures batch by batch and drops a pair as soon as the posterior chance of its similarity reaching
the threshold falls under MISS; it emits only which nodes have a pair left. The second brings those nodes' full sets
and verifies each pair left exactly. The second comparison looks at a pair in the first band that it shares and in no
other. So all that is shuffled or emitted grows with the rows, however large a group of copies is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch
from corvane.llm.components import components

BANDS, ROWS = 38, 6
#: Values of a signature that are compared at a time, one byte each.
BATCH = 38
#: Chance, at each batch, of dropping a pair whose similarity reaches the threshold.
MISS = 1e-5
#: Nodes of a block: those that ask, and those that are asked.
ASKING, ASKED = 256, 1024

SKETCH = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
SKETCH_DDL = "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary"

U = np.uint64


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and offsets of the hash functions, and multipliers of word positions."""
    rng = np.random.default_rng(20_240_229)
    odd = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64) * U(2) + U(1)
    return odd(BANDS * ROWS), odd(BANDS * ROWS), odd(64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: runs of `size` words (of the whole text if it has fewer), A-Z
    lower-cased, words being runs without ASCII white space."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, size)
    at = constants()[2]
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += w[i : n - k + 1 + i] * at[i]
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over a set, as 32-bit numbers."""
    a, b, _ = constants()
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(low, (found[i : i + 1024, None] * a + b).min(0), out=low)
    return (low >> U(32)).astype(np.uint32)


def band_keys(values: np.ndarray) -> np.ndarray:
    at = constants()[2]
    total = (values.reshape(BANDS, ROWS).astype(np.uint64) * at[:ROWS]).sum(1) + np.arange(BANDS, dtype=np.uint64) * at[ROWS]
    return mixed(total).view(np.int64)


@lru_cache(maxsize=8)
def fewest_matches(percent: int) -> list[int]:
    """For each batch, the fewest equal values so far with which a pair stays: with an even prior, the chance that the
    similarity reaches the threshold is that of a binomial count of n + 1 draws at the threshold not passing the number
    of matches. One byte also agrees by chance, once in 256."""
    t = percent / 100 + (1 - percent / 100) / 256
    found = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= MISS:
                break
        found.append(m)
    return found


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """Sketch of every row of docs (doc_id, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                if not len(found):
                    out.append((0, None, None, None))
                    continue
                values = signature(found)
                out.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(values), (values & 0xFF).astype(np.uint8).tobytes()))
            n, digest, bands, small = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(small, pa.binary())], schema=SKETCH)

    return docs.mapInArrow(run, SKETCH_DDL)


def sets(docs: DataFrame, size: int) -> DataFrame:
    """Full set of every row of docs (node, text), as sorted unsigned 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t, size).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(run, "node bigint, shingles binary")


class Block:
    """Rows of one block, asking ones apart from asked ones."""

    def __init__(self, rows: list[dict]):
        self.sides = [[r for r in rows if r["asked"] == side] for side in (0, 1)]

    def column(self, side: int, name: str, kind: type) -> np.ndarray:
        own = self.sides[side]
        return np.frombuffer(b"".join(r[name] for r in own), kind).reshape(len(own), -1)

    def left(self, percent: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asking, asked) of different components that survive all batches; once: and are first met here."""
        if not all(self.sides):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, t = self.column(0, "signature", np.uint8), self.column(1, "signature", np.uint8)
        b, d = (np.asarray([r["bands"] for r in own], np.int64) for own in self.sides)
        of = [np.asarray([r["component"] for r in own], np.int64) for own in self.sides]
        found = []
        for i in range(len(s)):
            j = np.flatnonzero(of[1] != of[0][i])
            for k, least in enumerate(fewest_matches(percent)):
                j = j[(t[j, : BATCH * (k + 1)] == s[i, : BATCH * (k + 1)]).sum(1) >= least]
            if once and len(j):
                j = j[(d[j] == b[i]).argmax(1) == self.sides[0][i]["band"]]
            found.append((np.full(len(j), i), j))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def links(self, percent: int, once: bool) -> Iterator[dict]:
        """One exactly verified link for each asking node and component that it has a link to."""
        asking, asked = self.left(percent, once)
        for i in np.unique(asking):
            me = self.sides[0][i]
            own = np.frombuffer(me["shingles"], np.uint64)
            others = [self.sides[1][j] for j in asked[asking == i]]
            done = set()
            for k in range(0, len(others), 64):
                rows = [r for r in others[k : k + 64] if r["component"] not in done]
                if not rows:
                    continue
                data = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
                sizes = np.asarray([len(x) for x in data])
                flat = np.concatenate(data)
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                for r, good in zip(rows, 100 * common >= percent * (len(own) + sizes - common), strict=True):
                    if good and r["component"] not in done:
                        done.add(r["component"])
                        yield {"a": me["node"], "b": r["node"]}


BLOCK_KEYS = ["band", "bucket", "asking_block", "asked_block"]


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows (band, bucket, node, component, asks, n_asking, n_nodes, ...) once for each block that it takes part in."""
    parts = lambda n, most: F.greatest(F.lit(1), F.ceil(n / F.lit(most))).cast("int")
    asking, asked = parts(F.col("n_asking"), ASKING), parts(F.col("n_nodes"), ASKED)
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    ask = rows.where("asks").withColumns({"asked": F.lit(0), "asking_block": own(asking), "asked_block": F.explode(every(asked))})
    hear = rows.withColumns({"asked": F.lit(1), "asked_block": own(asked), "asking_block": F.explode(every(asking))})
    return ask.unionByName(hear)


def compared(rows: DataFrame, percent: int, once: bool, exact: bool) -> DataFrame:
    """Run every block: (band, bucket, node) of nodes with a pair left, or exactly verified links (a, b)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())] if exact else [("band", pa.int32()), ("bucket", pa.int64()), ("node", pa.int64())])

    def finish(rows: list[dict]) -> list[dict]:
        block = Block(rows)
        if exact:
            return list(block.links(percent, once))
        ends = zip(block.sides, block.left(percent, once), strict=True)
        return [{"band": r["band"], "bucket": r["bucket"], "node": r["node"]} for own, at in ends for r in map(own.__getitem__, np.unique(at))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = tuple(r[k] for k in BLOCK_KEYS)
                if own != key:
                    out += finish(rows) if rows else []
                    key, rows = own, []
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if rows and (out := finish(rows)):
            yield pa.RecordBatch.from_pylist(out, schema)

    dealt = rows.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS)
    return dealt.mapInArrow(run, "a bigint, b bigint" if exact else "band int, bucket bigint, node bigint")


def verified(rows: DataFrame, nodes: DataFrame, full: DataFrame, percent: int, once: bool, scratch: Scratch, tag: str) -> DataFrame:
    """Links between nodes that ask in rows (band, bucket, node, component, asks, n_asking, n_nodes) and others of their
    bucket. nodes has bands and signature, full has shingles."""
    light = nodes.select("node", "bands", "signature")
    left = scratch.write(compared(in_blocks(rows.join(light, "node")), percent, once, exact=False), f"{tag}-left").distinct()
    heavy = rows.join(left, ["band", "bucket", "node"], "left_semi").join(light, "node").join(full, "node")
    return scratch.write(compared(in_blocks(heavy), percent, once, exact=True), f"{tag}-links")


def led_once(shared: DataFrame) -> DataFrame:
    """Rows that compare every leader with every node of its buckets (band, bucket, node, n_nodes, leader), each pair in
    the first bucket that it shares under that leader."""
    first = F.min(F.struct("band", "bucket", "n_nodes")).alias("at")
    pairs = shared.where("node <> leader").groupBy("leader", "node").agg(first).select("leader", "node", "at.*")
    row = lambda node, asks: [F.col("band"), F.col("bucket"), F.col(node).alias("node"), F.col(node).alias("component"), F.lit(asks).alias("asks"), F.lit(1).cast("long").alias("n_asking"), F.col("n_nodes")]
    return pairs.select(row("node", False)).unionAll(pairs.select(row("leader", True)).distinct())


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 80) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links of texts
    whose shingle sets have 100 * intersection >= percent * union) and kept (doc_id = component_id).

    Texts without words, null or empty, link with nothing, so component_id is their doc_id and they are kept. Rows with
    equal sets are always in one component. A null doc_id is no component_id while another row of the component has
    one; repeated rows get equal results, so a row that repeats the smallest doc_id is kept too. Columns other than key
    and text are not read. An empty table gives an empty table."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = scratch.write(sketch(source, size), "sketches")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("digest").agg(first, F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    node = F.monotonically_increasing_id().alias("node")
    nodes = scratch.write(classes.select(node, "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "bands", "signature"), "nodes")

    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = members.groupBy("band", "bucket").agg(F.count("*").alias("n_nodes"), F.min_by("node", F.xxhash64("node")).alias("leader")).where("n_nodes > 1")
    shared = scratch.write(members.join(buckets, ["band", "bucket"]), "buckets")

    near = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("of"), F.col("text_hash").alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("hash"))
    repeated = scratch.write(rows.where("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if repeated.isEmpty():
        texts = source.join(near, same).select("node", "text")
    else:
        # One text for each node, however many rows repeat it: only theirs are shuffled once more.
        often = near.join(repeated, same, "left_semi")
        once = near.join(often.select("node"), "node", "left_anti")
        texts = source.join(once, same).select("node", "text").unionByName(source.join(often, same).select("node", "text").dropDuplicates(["node"]))
    full = scratch.write(sets(texts, size), "sets")

    led = led_once(shared)
    links = verified(led, nodes, full, percent, False, scratch, "led")
    labels = components(links, scratch, "led-parts")

    placed = shared.select("band", "bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    sizes = placed.groupBy("band", "bucket", "component").agg(F.count("*").alias("n"))
    split = sizes.groupBy("band", "bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("n_nodes")).where("most < n_nodes")
    outside = placed.join(split, ["band", "bucket"]).select("band", "bucket", "node", "component", (F.col("component") != F.col("largest")).alias("asks"), (F.col("n_nodes") - F.col("most")).alias("n_asking"), "n_nodes")
    outside = scratch.write(outside, "outside")
    more = verified(outside, nodes, full, percent, True, scratch, "outside")
    labels = components(links.unionAll(more), scratch, "parts")

    named = nodes.select("node", "digest", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = scratch.write(named.join(smallest, "label").select("digest", "component_id"), "components")
    scratch.keep_only("sketches", "components")
    found = rows.select("doc_id", "n_shingles", "digest").join(of, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
