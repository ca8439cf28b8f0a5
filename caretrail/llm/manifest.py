"""A Merkle manifest of a table, with folds that resume SHA-256 in the middle.

A row is a leaf, eight leaves make a parent, and so on to one node for each group; the nodes of the groups, in group
order, make the root in the same way. Digests are hashed as hexadecimal text, so a child is one 64-byte block of SHA-256.
Each parent keeps a copy of its hash state before each child slot. Replacing a child then costs the rest of the run only:
take the state before its slot, add the new digest and the siblings to the right, and go on with the parent's slot.

Rows get their places by ``ranks.numbered``, so a group that holds any share of the table is cut by range. The tree is
cut into subtrees of ``HEIGHT`` levels (512 leaves): one row each, worked on by one task, whatever group they are of. The
tops of the subtrees are the leaves of the next round; as many rounds as the largest group needs (the driver reads one
number a round). What a subtree's rows need of the levels above is its siblings there, at most seven a level, which are
joined to the subtree; the states before its own slots are made once and copied for each of its rows.

Defined results: null, empty and very long values are told apart by their length mark; a null group comes first; rows
with a null key come first in their group and are never tampered with; rows alike in group and key stand in the order of
their digests, rows alike in all have different places and the same digest; an empty table has no root and an empty
result; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import ascii_lower, ship, stored
from caretrail.llm.ranks import numbered

FANOUT = 8
HEIGHT = 3

PATH = "array<struct<left: string, right: string>>"


def marked_value(column: Column) -> Column:
    """A value as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and its text."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[marked_value(c) for c in columns]), 256))


def levels_of(n: int, height: int) -> int:
    """How many levels of a tree over ``n`` nodes lie in one subtree of at most ``height``."""
    levels, reach = 0, 1
    while reach < n and levels < height:
        levels, reach = levels + 1, reach * FANOUT
    return levels


class Subtree:
    """Nodes (hexadecimal digests as bytes) with ``levels`` of parents, each of which keeps its states before each slot."""

    def __init__(self, nodes: list[bytes], levels: int):
        self.levels: list[list[tuple[list[bytes], list]]] = []
        for _ in range(levels):
            parents, runs = [], []
            for low in range(0, len(nodes), FANOUT):
                run, state, states = nodes[low:low + FANOUT], hashlib.sha256(), []
                for child in run:
                    states.append(state.copy())
                    state.update(child)
                parents.append(state.hexdigest().encode())
                runs.append((run, states))
            self.levels.append(runs)
            nodes = parents
        self.top = nodes[0]

    def folded(self, slot: int, digest: bytes) -> bytes:
        """The top if the node at ``slot`` were ``digest``."""
        for runs in self.levels:
            run, states = runs[slot // FANOUT]
            state = states[slot % FANOUT].copy()
            state.update(digest + b"".join(run[slot % FANOUT + 1:]))
            digest, slot = state.hexdigest().encode(), slot // FANOUT
        return digest

    def path(self, slot: int) -> list[tuple[bytes, bytes]]:
        """The siblings to the left and to the right of ``slot`` and of its parents."""
        out = []
        for runs in self.levels:
            run = runs[slot // FANOUT][0]
            out.append((b"".join(run[:slot % FANOUT]), b"".join(run[slot % FANOUT + 1:])))
            slot //= FANOUT
        return out


def _climb(height: int):
    """Subtrees of nodes to their tops and the paths of their nodes."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("g", pa.int64()), ("n", pa.int64()), ("idx", pa.int64()), ("top", pa.string()), (
            "paths", pa.list_(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                nodes = [d.encode() for d in row["digests"]]
                tree = Subtree(nodes, levels_of(row["n"], height))
                paths = [[{"left": a.decode(), "right": b.decode()} for a, b in tree.path(i)] for i in range(len(nodes))]
                out.append({"g": row["g"], "n": -(-row["n"] // FANOUT ** height), "idx": row["chunk"],
                            "top": tree.top.decode(), "paths": paths})
            yield from pa.Table.from_pylist(out, schema).to_batches()

    return run


def climbed(nodes: DataFrame, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """Of the trees over nodes (g, n: how many nodes g has, idx: from 0, digest): (g, idx, path) and (g, top)."""
    ship(nodes.sparkSession)
    width, rounds = FANOUT ** height, []
    chunk = F.expr(f"idx div {width}")
    while True:
        rows = nodes.groupBy("g", "n", chunk.alias("chunk")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("digests"))
        rounds.append(stored(rows.mapInArrow(
            _climb(height), f"g long, n long, idx long, top string, paths array<{PATH}>"), "manifest-round"))
        if (rounds[-1].agg(F.max("n")).first()[0] or 1) == 1:
            break
        nodes = rounds[-1].select("g", "n", "idx", F.col("top").alias("digest"))
    tops, paths = rounds[-1].select("g", "top"), None
    for tier in reversed(rounds):
        own = tier.select("g", F.col("idx").alias("chunk"), F.posexplode("paths").alias("at", "path")).select(
            "g", "chunk", (F.col("chunk") * width + F.col("at")).alias("idx"), "path")
        paths = own.select("g", "idx", "path") if paths is None else own.join(
            paths.select("g", F.col("idx").alias("chunk"), F.col("path").alias("above")), ["g", "chunk"]).select(
            "g", "idx", F.concat("path", "above").alias("path"))
    return paths, tops


def _fold(schema: list[str], height: int):
    """Subtrees of rows to one row each: digests, proof, and the root that the changed leaf would give."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                docs = row.column("docs").flatten()
                n, path, subroot, root = (row.column(c)[0].as_py() for c in ("n", "path", "subroot", "root"))
                leaves = [d.hex().encode() for d in docs.field("leaf").to_pylist()]
                tree, above = Subtree(leaves, levels_of(n, height)), []
                for level in path:
                    state = hashlib.sha256(level["left"].encode())
                    above.append((state, level["right"].encode()))
                rest = "".join(x["left"] + x["right"] for x in path).encode()
                proofs, folded = [], []
                for slot, (own, changed) in enumerate(zip(leaves, docs.field("changed").to_pylist(), strict=True)):
                    proofs.append(hashlib.sha256(b"".join(a + b for a, b in tree.path(slot)) + rest).hexdigest())
                    digest = tree.folded(slot, changed.hex().encode() if changed is not None else own)
                    for before, right in above:
                        state = before.copy()
                        state.update(digest + right)
                        digest = state.hexdigest().encode()
                    folded.append(digest.decode())
                m = len(leaves)
                yield pa.RecordBatch.from_arrays([
                    docs.field("key"), pa.array([x.decode() for x in leaves]), pa.array([subroot] * m), pa.array([root] * m),
                    pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], schema)

    return run


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of each of the rows (group, key, leaf, changed).

    ``leaf`` is a digest of 32 bytes, ``changed`` another one to fold in, or null to fold the leaf itself.
    """
    ship(rows.sparkSession)
    kind, width = rows.schema["key"].dataType, FANOUT ** height
    placed = stored(numbered(stored(rows.select("group", "key", "leaf", "changed", F.monotonically_increasing_id().alias(
        "_row")), "manifest-leaves"), ["group", "key", "leaf", "_row"]), "manifest-places")
    groups = stored(placed.groupBy("group").agg(F.min("_pos").alias("g"), F.count("*").alias("n")), "manifest-groups")
    subtrees = stored(placed.join(groups, placed["group"].eqNullSafe(groups["group"])).select(
        "g", "n", (F.col("_pos") - F.col("g")).alias("idx"), "key", "leaf", "changed").groupBy(
        "g", "n", F.expr(f"idx div {width}").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "key", "leaf", "changed"))).alias("docs")), "manifest-subtrees")

    def top(batches):
        import pyarrow as pa

        for batch in batches:
            tops = [Subtree([x["leaf"].hex().encode() for x in r["docs"]], levels_of(r["n"], height)).top.decode()
                    for r in batch.select(["n", "docs"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("g"), pa.array([-(-n // width) for n in batch.column("n").to_pylist()], pa.int64()),
                batch.column("chunk"), pa.array(tops, pa.string())], ["g", "n", "idx", "digest"])

    nodes = subtrees.select("g", "n", "chunk", F.transform("docs", lambda x: F.struct(x["leaf"].alias("leaf"))).alias(
        "docs")).mapInArrow(top, "g long, n long, idx long, digest string")
    paths, subroots = climbed(stored(nodes, "manifest-tops"), height)
    ordered = numbered(groups.select("g").join(subroots, "g"), ["g"])
    ordered = stored(ordered.select("g", F.col("top").alias("subroot"), F.col("_pos").alias("idx")), "manifest-subroots")
    count = ordered.count()
    upper, roots = climbed(ordered.select(
        F.lit(0).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), "idx", F.col("subroot").alias("digest")), height)
    root = roots.first()
    lasting = ordered.join(upper.select("idx", F.col("path").alias("above")), "idx").select("g", "subroot", "above")
    whole = subtrees.join(paths.select("g", F.col("idx").alias("chunk"), "path"), ["g", "chunk"]).join(lasting, "g").select(
        "n", "docs", F.concat("path", "above").alias("path"), "subroot",
        F.lit(root["top"] if root else None).cast("string").alias("root"))
    fields = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    schema = whole.select(F.lit(None).cast(kind).alias("key"), *[F.lit("").alias(f) for f in fields[1:-1]], F.lit(
        True).alias("verified")).schema
    return whole.mapInArrow(_fold(fields, height), schema)


def digests(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document, by lang.

    The rows whose ``crc32`` of the decimal doc_id 3 divides are tampered with: their text in lower case (A-Z only).
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = leaf([*fields[:-1], ascii_lower(F.col("text"))])
    rows = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf(fields).alias("leaf"), F.when(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered).alias("changed"))
    return manifest(rows, height).withColumnRenamed("key", "doc_id")
