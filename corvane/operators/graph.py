"""Decay graphs: encoded mothers, terminal copies and final states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources import shared

#: Mothers that one number holds, three decimal digits each.
DIGITS, MOST = 1000, 6


def encoded_mothers(mothers: Column) -> Column:
    """Mother indices as one number, the first lowest; each is stored plus one, so 0 ends the list."""
    return F.aggregate(F.reverse(mothers), F.lit(0).cast("long"), lambda a, m: a * DIGITS + m + 1)


def decoded_mothers(code: Column) -> Column:
    """The indices of encoded_mothers(), exactly: each group of digits is a difference of two remainders, and a quotient of
    at most three digits is right after rounding however large both are."""

    def part(i: int) -> Column:
        low, high = F.lit(DIGITS**i).cast("long"), F.lit(DIGITS ** (i + 1)).cast("long")
        return F.round((code % high - code % low) / low).cast("long") - 1

    return F.filter(F.array(*map(part, range(MOST))), lambda m: m >= 0)


def edges(nodes: DataFrame, key: list[str], index: str, mothers: str) -> DataFrame:
    """(key, mother, daughter) of nodes with arrays of mothers."""
    return nodes.select(*key, F.explode(mothers).alias("mother"), F.col(index).alias("daughter"))


def terminal_copies(nodes: DataFrame, parent: str = "parent", node: str = "node", kind: str | None = None) -> DataFrame:
    """(node, last): the end of each node's chain of parents, by pointer jumping, so a chain of length n takes log2(n)
    rounds, and more never help. With a kind column, the chain ends before a parent of another kind. Nodes whose chain
    ends in a cycle, or at a parent that is not in the table, are left out."""
    rows = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), *([F.col(kind).alias("kind")] if kind else []))
    if kind:
        above = rows.select(F.col("node").alias("parent"), F.col("kind").alias("kind_above"))
        rows = rows.join(above, "parent", "left").withColumn("parent", F.when(F.col("kind_above").isNull() | (F.col("kind_above") == F.col("kind")), F.col("parent")))
    rows = shared.written(rows.select("node", "parent"), "chains")
    at = rows.select("node", F.coalesce("parent", "node").alias("last"))
    for _ in range(rows.count().bit_length() + 1):
        step = at.select(F.col("node").alias("last"), F.col("last").alias("next"))
        found = at.join(step, "last").select("node", F.col("next").alias("last"), (F.col("next") != F.col("last")).alias("moved"))
        found = shared.written(found, "chains")
        at = found.select("node", "last")
        if found.where("moved").isEmpty():
            break
    roots = rows.where("parent is null").select(F.col("node").alias("last"))
    return at.join(roots, "last", "left_semi").select("node", "last")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of links (a, b), label being the smallest node that can be reached in both directions.
    Each round takes the smallest label of a node and its neighbours, and then that label's label, until none changes.

    Links are dealt by one end once, are never sorted, and meet labels that are looked up: a task holds the labels of its
    own links only, also where most nodes have one label. A link given twice changes nothing, so none is looked for."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = shared.written(both.hint("rebalance", "b"), "edges")
    labels = shared.written(edges.groupBy(F.col("b").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        heard = edges.join(labels.withColumnRenamed("node", "b").hint("shuffle_hash"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        roots = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("root"))
        found = shared.written(lower.join(roots.hint("shuffle_hash"), "label", "left").select("node", "was", F.least("label", "root").alias("label")), "labels")
        labels = found.select("node", "label")
        if found.where("label <> was").isEmpty():
            return labels


def final_state(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Nodes (key, node, parent) that no other has as a parent."""
    parents = nodes.where("parent is not null").select(*key, F.col("parent").alias("node")).distinct()
    return nodes.join(parents, [*key, "node"], "left_anti")


def final_daughters(starts: DataFrame, links: DataFrame, codes: DataFrame, without: list[int], closed: DataFrame | None = None) -> DataFrame:
    """(root, node, code) of the particles without daughters that each start (root, node) decays to, each once however many
    ways lead there. links: (mother, daughter); codes: (node, code). Particles of the codes `without`, absolute, are left
    out of the result but not of the way; the particles of `closed` (node) and all below them are not entered. One round
    for each level: a node that was seen from a root is not walked again."""
    links = shared.written(links.select("mother", "daughter").where("mother is not null").distinct(), "links")
    free = (lambda df: df.join(closed.select("node").distinct(), "node", "left_anti")) if closed is not None else (lambda df: df)
    level = shared.written(free(starts.select("root", "node")).distinct(), "level")
    seen = level
    while not level.isEmpty():
        below = level.join(links, F.col("node") == F.col("mother")).select("root", F.col("daughter").alias("node")).distinct()
        level = shared.written(free(below).join(seen, ["root", "node"], "left_anti"), "level")
        seen = seen.unionByName(level)
    mothers = links.select(F.col("mother").alias("node")).distinct()
    ends = seen.join(mothers, "node", "left_anti").join(codes.select("node", "code"), "node")
    return ends.where(~F.abs("code").isin(without) if without else F.lit(True)).select("root", "node", "code")


#: Particle codes, absolute.
CHARGED_LEPTONS, NEUTRAL_LEPTONS, PHOTON, ELECTRON, MUON, TAU = [11, 13, 15], [12, 14, 16], 22, 11, 13, 15
CHARGED_HADRONS = [211, 213, 321, 323, 411, 431, 521, 10211, 10213, 20213]
NEUTRAL_HADRONS = [111, 113, 130, 223, 221, 310, 311, 313, 331, 333, 421, 10111, 10113]


def lepton_decays(particles: DataFrame, event: list[str]) -> DataFrame:
    """One row for each prompt first copy of a charged lepton: (event, lepton, last_copy, kind, n_neutrinos, n_electrons,
    n_muons, n_charged, n_neutral, visible px, py, pz and e of what its last copy decays to, and radiated px, py, pz, e
    of what its earlier copies radiate).

    particles: event, idx, mother (null for none), pdg, prompt, first, last, px, py, pz, e. Each particle counts once.
    Hadrons that decay to others than leptons and photons are intermediate and not counted. kind is 1 and 2 for an
    electron and a muon, and 3, 4 and 5 for a tau by what it decays to, 6 if to nothing known. A final particle that is
    no last copy is an error. The tree is walked level by level, so the number of joins is its depth."""
    edge = [*event, "node"]
    rows = shared.written(particles.withColumn("pdg", F.abs("pdg")), "particles")
    children = rows.where("mother is not null").select(*event, F.col("mother").alias("node"), F.col("idx").alias("child"), F.col("pdg").alias("child_pdg"), F.col("last").alias("child_last"))
    soft = F.col("child_pdg").isin([*CHARGED_LEPTONS, *NEUTRAL_LEPTONS, PHOTON])
    nodes = rows.withColumnRenamed("idx", "node").join(children.groupBy(*edge).agg(F.count_if(~soft).alias("hard"), F.count("*").alias("daughters")), edge, "left").fillna(0, ["hard", "daughters"])
    start = rows.where(F.col("prompt") & F.col("first") & F.col("pdg").isin(CHARGED_LEPTONS))
    level = start.select(*event, F.col("idx").alias("lepton"), F.col("idx").alias("node"), F.col("pdg").alias("lepton_pdg"), F.col("last").alias("decayed"))
    level = seen = shared.written(level, "level")
    while True:
        down = level.join(children, edge)
        copy = ~F.col("decayed") & (F.col("child_pdg") == F.col("lepton_pdg")) & F.col("child_last")
        level = shared.written(down.select(*event, "lepton", F.col("child").alias("node"), "lepton_pdg", (F.col("decayed") | copy).alias("decayed")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    found = seen.join(nodes, edge)
    final, after = F.col("daughters") == 0, F.col("decayed")
    bad = F.when(final & ~F.col("last"), F.raise_error(F.lit("a final particle is no last copy")).cast("boolean"))
    one = lambda test: F.count_if(test & F.col("last"))
    hadron = lambda codes: one(after & F.col("pdg").isin(codes) & (F.col("hard") == 0))
    momentum = lambda name, test: [F.sum(F.when(final & test, F.col(c)).otherwise(0.0)).alias(f"{name}_{c}") for c in ("px", "py", "pz", "e")]
    out = found.where(F.coalesce(bad, F.lit(True))).groupBy(*event, "lepton", "lepton_pdg").agg(
        F.max(F.when(after & (F.col("pdg") == F.col("lepton_pdg")) & F.col("last"), -F.col("node"))).alias("__last"),
        one(final & after & F.col("pdg").isin(NEUTRAL_LEPTONS)).alias("n_neutrinos"), one(final & after & (F.col("pdg") == ELECTRON)).alias("n_electrons"), one(final & after & (F.col("pdg") == MUON)).alias("n_muons"),
        hadron(CHARGED_HADRONS).alias("n_charged"), hadron(NEUTRAL_HADRONS).alias("n_neutral"), *momentum("visible", after & ~F.col("pdg").isin(NEUTRAL_LEPTONS)), *momentum("radiated", ~after),
    )
    tau = F.when(F.col("n_electrons") > 0, 3).when(F.col("n_muons") > 0, 4).when(F.col("n_charged") + F.col("n_neutral") > 0, 5).otherwise(6)
    kind = F.when(F.col("lepton_pdg") == ELECTRON, 1).when(F.col("lepton_pdg") == MUON, 2).otherwise(tau)
    return out.withColumns({"last_copy": -F.col("__last"), "kind": kind}).drop("__last", "lepton_pdg")


def pile_up(infos: Column) -> Column:
    """Interactions of the first record (crossing, interactions) of bunch crossing 0, else the lowest number there is."""
    own = F.filter(infos, lambda p: p["crossing"] == 0)
    return F.coalesce(F.get(own, F.lit(0))["interactions"].cast("double"), F.lit(-3.4028234663852886e38))
