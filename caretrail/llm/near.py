"""MinHash near-dedup on bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles; documents of equal sets are one node. A node's sketch is its ``K``
smallest hashes. Two sets of similarity 0.75 share ``SHARED`` of ``K`` retained values at least (save for about one pair
in 700,000 at that very similarity, fewer above), so a node need only be listed under its rarest retained values, those
that remain when ``SHARED`` - 1 are left out: values that many unlike documents share make no lists. In an inverted list

1. every node is paired with the list's pivots; the pivot it meets most often is estimated on the sketch of the union and,
   if the estimate allows 0.75, verified on the full sets. A few rounds with other pivots join most of each group;
2. of what lists then still hold of different components, sketches are compared in blocks of ``BLOCK`` nodes, so that a
   list of any length is worked on by many tasks and no pair of equal components is looked at. Nodes of pairs whose
   sketches share enough for the estimate, each pair in the list of its smallest common value only, are then compared on
   the full sets in these blocks; only their texts are exchanged.

Only links between components leave a block, so a group of copies never turns into all its pairs, and no link between
different components is missed.

Defined results: null and empty texts and texts of white space have an empty set, are linked with nothing and kept; rows
that repeat an id belong to their texts' components, and the smallest id of a component is kept in each row that has it;
null ids are the largest. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import checkpointed, map_texts, row_keys, stored
from caretrail.llm.graphs import components
from caretrail.llm.shingles import Shingler, mixed

K = 32
SHARED = 12
LEAST_ESTIMATE = 0.4  # of 32 values: 4.5 standard deviations below 0.75
ROUNDS = 3
BLOCK = 1024


def alike(common: int | np.ndarray, a: int, b: int | np.ndarray):
    return 100 * common >= 75 * (a + b - common)


def _sketches():
    import pyarrow as pa

    shingler = Shingler()

    def work(texts: list[str | None]) -> list[pa.Array]:
        n, node, sketch = [], [], []
        for s in shingler.sets(texts):
            n.append(len(s))
            node.append(mixed(np.array([mixed(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
            sketch.append(s[:K].view(np.int64))
        return [pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))]

    return work


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, _k, _h, n_shingles, node (a hash of the set), sketch of every row."""
    rows = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), "text")
    return map_texts(rows, ("doc_id", "_k", "_h"), "text", _sketches,
                     "n_shingles bigint, node bigint, sketch array<bigint>")


def inverted_lists(nodes: DataFrame) -> DataFrame:
    """value, node, size (of the list): each node under its rarest retained values, as far as others are there too, and
    each set of nodes once."""
    entries = nodes.select("node", "n", F.explode_outer("sketch").alias("value"))
    counts = entries.groupBy("value").agg(F.count(F.lit(1)).alias("size"))
    ranked = entries.join(counts, "value").groupBy("node", "n").agg(
        F.array_sort(F.collect_list(F.struct("size", "value"))).alias("values"))
    shared = F.least(F.lit(SHARED), F.ceil(F.col("n") * 3 / 4)).cast("int")
    rarest = F.slice("values", F.lit(1), F.size("values") - shared + 1)
    listed = ranked.select("node", F.explode_outer(rarest).alias("x")).select("node", "x.*").where("size > 1")
    # Near copies share most values: of lists with the same members one is enough, as its pairs are theirs.
    members = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    sizes = listed.groupBy("value").agg(F.count(F.lit(1)).alias("size"), *members).where("size > 1")
    once = sizes.groupBy("size", "x", "y").agg(F.min("value").alias("value")).select("value", "size")
    return listed.drop("size").join(once, "value").select("value", "node", "size")


def union_estimate(a: Column, b: Column) -> Column:
    """Part of the union's sketch that both sketches have."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def _pair_check(batches):
    shingler = Shingler()
    for batch in batches:
        left, right = shingler.sets(list(batch["x"])), Shingler().sets(list(batch["y"]))
        ok = [bool(alike(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
              for s, t in zip(left, right, strict=True)]
        yield batch.loc[ok, ["a", "b"]]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; ``texts``: node, text."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInPandas(_pair_check, "a bigint, b bigint")


def _block_nodes(block: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a block that must be compared there: those of a pair of different labels whose sketches share what the
    estimate needs, and that has no smaller value in common (which is where else it is compared).

    The union's sketch has min(K, union) values, no fewer than min(K, larger set), and the two share no more of it than of
    their own sketches.
    """
    value, i_, j_ = block["value"].iloc[0], block["i"].iloc[0], block["j"].iloc[0]
    block = block.drop_duplicates("node").reset_index(drop=True)
    labels, sizes = block["label"].to_numpy(), block["n"].to_numpy()
    names, counts = np.unique(labels, return_counts=True)
    needed = np.zeros(len(block), bool)
    if len(names) > 1:
        lengths = block["sketch"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(block)), lengths)
        values, code = np.unique(np.concatenate(list(block["sketch"])), return_inverse=True)
        order = np.argsort(code, kind="stable")
        owners, starts = owner[order], np.r_[0, np.cumsum(np.bincount(code, minlength=len(values)))]
        codes = np.split(code, np.cumsum(lengths)[:-1])
        smaller: dict[int, list[int]] = {}
        listed = [[v for v in vs.tolist() if v < value] for vs in block["listed"]]
        for k, vs in enumerate(listed):
            for v in vs:
                smaller.setdefault(v, []).append(k)
        major = names[np.argmax(counts)]
        for k in np.flatnonzero(labels != major):  # two of the largest component need no look
            common = np.bincount(
                np.concatenate([owners[starts[c]:starts[c + 1]] for c in codes[k]]), minlength=len(block))
            least, most = np.minimum(sizes, sizes[k]), np.maximum(sizes, sizes[k])
            there = (common >= LEAST_ESTIMATE * np.minimum(K, most)) & (100 * least >= 75 * most) & (labels != labels[k])
            for v in listed[k]:
                there[smaller[v]] = False
            if there.any():
                needed |= there
                needed[k] = True
    nodes = block["node"].to_numpy()[needed]
    return pd.DataFrame({"value": value, "i": i_, "j": j_, "node": nodes, "label": labels[needed]}).astype(
        {"value": "int64", "i": "int32", "j": "int32", "node": "int64", "label": "int64"})


def _block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links between nodes of different labels in a block: one for each two labels at most."""
    block = block.drop_duplicates("node").reset_index(drop=True)
    labels = block["label"].to_numpy()
    names, counts = np.unique(labels, return_counts=True)
    out = []
    if len(names) > 1:
        sets = list(Shingler().sets(list(block["text"])))
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        owners, starts = owner[order], np.r_[0, np.cumsum(np.bincount(code, minlength=len(values)))]
        codes = np.split(code, np.cumsum(sizes)[:-1])
        parent = {x: x for x in names.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        major = names[np.argmax(counts)]
        for i in np.flatnonzero(labels != major):  # two of the largest component need no look
            common = np.bincount(
                np.concatenate([owners[starts[c]:starts[c + 1]] for c in codes[i]]), minlength=len(sets))
            for j in np.flatnonzero(alike(common, sizes[i], sizes) & (labels != labels[i])):
                x, y = root(int(labels[i])), root(int(labels[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(labels[i]), int(labels[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("label", F.col("node"))
    return lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def links(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, label: the components of the nodes that are linked. ``nodes``: node, n, sketch, _k, _h (a row with the set)."""
    lists = checkpointed(inverted_lists(nodes))
    listed = lists.select("node").distinct().join(nodes.select("node", "_k", "_h"), "node")
    rows = docs.select(*row_keys(F.col("doc_id"), F.col("text")), F.col("text").cast("string").alias("text"))
    texts = stored(rows.join(listed, ["_k", "_h"]).select("node", "text").dropDuplicates(["node"]), "near-texts")
    sketches = nodes.select("node", "n", "sketch")
    edges, labels = None, None
    for turn in range(ROUNDS):
        now = _labelled(lists, labels)
        pick = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("pivot"), F.col("label").alias("to"))
        pivots = now.groupBy("value").agg(F.min(pick).alias("p")).select("value", "p.pivot", "p.to")
        met = now.join(pivots, "value").where("label <> to").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c"))
        best = met.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("m")).select(
            F.least("node", "m.pivot").alias("a"), F.greatest("node", "m.pivot").alias("b")).distinct()
        sized = best.join(sketches.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("s")), "a")
        sized = sized.join(sketches.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t")), "b")
        hopeful = sized.where(
            (F.least("n", "m") * 100 >= F.greatest("n", "m") * 75)
            & (union_estimate(F.col("s"), F.col("t")) >= LEAST_ESTIMATE)).select("a", "b")
        new = checkpointed(verified(hopeful, texts))
        if new.isEmpty():
            break
        edges = new if edges is None else edges.unionByName(new)
        labels = components(edges)
    now = _labelled(lists, labels)
    mixed_lists = now.groupBy("value").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    parts = now.join(mixed_lists.select("value"), "value").select(
        "value", "node", "label", mine.alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j")).select(
        "value", "node", "label", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    listed = lists.groupBy("node").agg(F.collect_list("value").alias("listed"))
    needed = stored(parts.join(sketches, "node").join(listed, "node").groupBy("value", "i", "j").applyInPandas(
        _block_nodes, "value bigint, i int, j int, node bigint, label bigint"), "near-blocks")
    found = needed.join(texts, "node").groupBy("value", "i", "j").applyInPandas(_block_links, "a bigint, b bigint")
    found = checkpointed(found.distinct())
    if not found.isEmpty():
        edges = found if edges is None else edges.unionByName(found)
        labels = components(edges)
    return labels if labels is not None else lists.select("node", F.col("node").alias("label")).limit(0)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, _k, _h of every row."""
    rows = stored(sketched(docs), "near-sketches")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(
        F.min(F.struct("_k", "_h", F.col("n_shingles").alias("n"), "sketch")).alias("x"), F.min("doc_id").alias("first"))
    nodes = nodes.select("node", "x.*", "first")
    labels = links(nodes, docs)
    grouped = nodes.select("node", "first").join(labels, "node", "left").select(
        "node", "first", F.coalesce("label", "node").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    known = grouped.join(smallest, "label").select("node", "component_id")
    linked = rows.where("n_shingles > 0").join(known, "node").select("doc_id", "n_shingles", "component_id", "_k", "_h")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "_k", "_h")
    return linked.unionByName(alone).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "_k", "_h")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component; rows without words stay. Columns are those of ``docs``."""
    kept = near_duplicates(docs).where("kept").groupBy("_k", "_h").agg(
        F.max("n_shingles").alias("n"), F.min("component_id").alias("c"))
    rows = docs.select(F.struct("*").alias("row"), *row_keys(F.col("doc_id"), F.col("text")))
    joined = rows.join(kept, ["_k", "_h"])
    once = joined.where("n > 0").dropDuplicates(["_k", "_h"]).select("row.*")
    return once.unionByName(joined.where("n = 0").select("row.*"))
