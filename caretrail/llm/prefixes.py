"""The prefix trie of conversations, by vertical bitmaps.

A shard holds some conversations in ascending order of their ids. Its index maps (position, turn) to the bitset of the
conversations that have this turn there. From a node's bitset the lowest conversation not yet dealt with names a turn;
the intersection with that turn's bitset is a child, which leaves the rest for the next one. So there are as many
intersections as nodes. Popcounts give the members, lowest bits the smallest id, and the bitset of conversations that
stop at a depth the end lists.

Nodes of several shards are one node if their turns are: a node's key is a hash (blake2b, 128 bits) along its turns. What
of a trie adds up over conversations is summed over shards; what counts distinct nodes is made to add up: each node
belongs to its smallest member, which is known once members are merged, and a conversation then hands to every node on
its way one leaf, if it owns one below, and the words of all its turns from there on but those of nodes it owns. So
two passes over the shards do, whatever the depth of the trie.

Sizes are bounded for any data: shards are cut by the number of turns (``SHARD``), and conversations into segments of
``SEGMENT`` turns, so that one that holds a third of all turns is spread over tasks; the keys at the edges of its segments
are chained in a stream over segments. End lists come out of the shards as texts in order and are hashed in a stream, one
row a shard, as SHA-256 can't be split.

Defined results: rows without a conversation id belong to no conversation; a null role or text is empty; turns of equal
number come in the order of a digest of role and text, repeated rows are repeated turns; an empty table has no node;
other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import ship, stored
from caretrail.llm.ranks import numbered

SHARD = 4096
SEGMENT = 1024
KEY = 16
BLANK = r"\x20\x09-\x0D"


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=KEY).digest()


class Shard:
    """Conversations (ascending ids) with the turns they have in one segment, and the index over them."""

    def __init__(self, turns: list[list[bytes]], edges: list[bytes], lasting: list[bool]):
        self.turns, self.edges = turns, edges
        depth = max(map(len, turns), default=0)
        self.postings: list[dict[bytes, int]] = [{} for _ in range(depth)]
        self.going, self.ended = [0] * (depth + 1), [0] * (depth + 1)
        for i, own in enumerate(turns):
            bit = 1 << i
            for at, turn in enumerate(own):
                posting = self.postings[at]
                posting[turn] = posting.get(turn, 0) | bit
                self.going[at] |= bit
            if not lasting[i]:
                self.ended[len(own)] |= bit

    def walk(self) -> Iterator[tuple[int, bytes, bytes | None, int, int]]:
        """(turns into the segment, key, parent's key, members, members that end here) of all nodes, depth first.

        Nodes at 0 have no parent's key: they stand for the edge that the segment starts from.
        """
        roots: dict[bytes, int] = {}
        for i, edge in enumerate(self.edges):
            roots[edge] = roots.get(edge, 0) | 1 << i
        stack = [(0, edge, None, b"", edge, members) for edge, members in roots.items()]
        while stack:
            at, key, parent, way, edge, members = stack.pop()
            yield at, key, parent, members, members & self.ended[at]
            left = members & self.going[at]
            while left:
                turn = self.turns[(left & -left).bit_length() - 1][at]
                child = members & self.postings[at][turn]
                left &= ~child
                further = _hash(way, turn)
                stack.append((at + 1, _hash(edge, further), key, further, edge, child))


def bits(bitset: int) -> Iterator[int]:
    while bitset:
        low = bitset & -bitset
        yield low.bit_length() - 1
        bitset ^= low


def _shard(rows: list[dict], segment: int) -> Shard:
    return Shard([[t["hash"] for t in r["turns"]] for r in rows], [r["edge"] for r in rows],
                 [r["length"] > (r["segment"] + 1) * segment for r in rows])


def _nodes(segment: int):
    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["conv_id"])
        shard, first, out = _shard(rows, segment), rows[0]["segment"] * segment, []
        for at, key, parent, members, ends in shard.walk():
            low = (members & -members).bit_length() - 1
            if at or not first:
                out.append((key, parent, first + at, members.bit_count(), rows[low]["conv_id"],
                            rows[low]["turns"][at - 1]["words"] if at else 0, rows[0]["shard"],
                            ",".join(str(rows[i]["conv_id"]) for i in bits(ends)) or None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, (
            pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
            names=["key", "parent", "depth", "n_convs", "conv_id", "words", "shard", "ends"])

    return run


def _sums(segment: int):
    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["conv_id"])
        shard, first, out = _shard(rows, segment), rows[0]["segment"] * segment, []
        after = []
        for r in rows:
            left = [r["total"] - r["words_before"]]
            for t in r["turns"]:
                left.append(left[-1] - t["words"])
            after.append(left)
        for at, key, _, members, _ in shard.walk():
            if at or not first:
                depth, leaves, saved = first + at, 0, 0
                for i in bits(members):
                    r = rows[i]
                    leaves += r["leaf"]
                    if depth <= r["first_owned"]:
                        saved += after[i][max(at - 1, 0)] - r["owned"]
                out.append((key, leaves, saved))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, (
            pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["key", "n_leaves", "saved_tokens"])

    return run


def _ways(batches):
    """Segments to the hash along their turns and the sum of their words."""
    import pyarrow as pa

    for batch in batches:
        ways, words = [], []
        for turns in batch.column("turns").to_pylist():
            way = b""
            for t in turns:
                way = _hash(way, t["hash"])
            ways.append(way)
            words.append(sum(t["words"] for t in turns))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(ways, pa.binary()),
                                          pa.array(words, pa.int64())], ["conv_id", "segment", "way", "words"])


def _edges(batches):
    """Segments in order to the keys of the nodes they start from, and the words before them."""
    import pyarrow as pa

    last, edge, before = None, b"", 0
    for batch in batches:
        edges, words = [], []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "way", "words")]
        for conv, way, n in zip(*columns, strict=True):
            if conv != last:
                last, edge, before = conv, b"", 0
            edges.append(edge)
            words.append(before)
            edge, before = _hash(edge, way), before + n
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(edges, pa.binary()),
                                          pa.array(words, pa.int64())], ["conv_id", "segment", "edge", "words_before"])


def _digest_lists(batches):
    """Pieces of lists, in order, to the SHA-256 of each key's whole list."""
    import pyarrow as pa

    last, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    for batch in batches:
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != last or state is None:
                if state is not None:
                    yield done()
                last, state = key, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
    if state is not None:
        yield done()


def pieces_of(turns: DataFrame, shard: int, segment: int) -> DataFrame:
    """segment, shard, conv_id, length, total (words), turns, edge, words_before: a row for each segment of each conversation."""
    rows = numbered(turns.select("conv_id", "pos", "hash", "words"), ["conv_id", "pos"])
    rows = stored(rows, "trie-turns")
    convs = stored(rows.groupBy("conv_id").agg(
        F.min("_pos").alias("start"), (F.max("pos") + 1).alias("length"), F.sum("words").alias("total")), "trie-convs")
    turn = F.when(F.col("pos") >= 0, F.struct("pos", "hash", "words"))
    pieces = stored(rows.join(convs, "conv_id").groupBy(
        F.expr(f"greatest(pos, 0) div {segment}").alias("segment"), F.expr(f"start div {shard}").alias("shard"), "conv_id",
        "length", "total").agg(F.sort_array(F.collect_list(turn)).alias("turns")), "trie-pieces")
    long = pieces.where(F.col("length") > segment)
    ways = stored(long.select("conv_id", "segment", "turns").mapInArrow(
        _ways, "conv_id long, segment long, way binary, words long"), "trie-ways")
    edges = stored(ways.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(
        _edges, "conv_id long, segment long, edge binary, words_before long"), "trie-edges")
    short = pieces.where(F.col("length") <= segment).select(
        "*", F.lit(b"").alias("edge"), F.lit(0).cast("long").alias("words_before"))
    return short.unionByName(long.join(edges, ["conv_id", "segment"]))


def prefix_trie(turns: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id long, pos long from 0, gapless; hash binary; words long).

    Each conversation also has a row of pos -1 with words 0, so that those without turns are there. A row for each node:
    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    ship(turns.sparkSession)
    pieces = pieces_of(turns, shard, segment)
    found = stored(pieces.groupBy("segment", "shard").applyInArrow(
        _nodes(segment), "key binary, parent binary, depth long, n_convs long, conv_id long, words long, shard long, ends string"),
        "trie-found")
    nodes = stored(found.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.min("words").alias("words")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-families")
    owners = stored(nodes.groupBy("conv_id").agg(
        F.min("depth").alias("first_owned"), F.sum("words").alias("owned"),
        F.max((F.col("n_children") == 0).cast("int")).alias("leaf")), "trie-owners")
    none = F.lit((1 << 63) - 1)
    sums = pieces.join(owners, "conv_id", "left").select(
        *pieces.columns, F.coalesce("first_owned", none).alias("first_owned"),
        F.coalesce("owned", F.lit(0).cast("long")).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = sums.groupBy("segment", "shard").applyInArrow(_sums(segment), "key binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = found.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions(
        "key", "shard").mapInArrow(_digest_lists, "key binary, ends string")
    full = stored(nodes.join(sums, "key").join(ends, "key", "left"), "trie-full")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256")]
    below = full.where("depth > 0").join(parents, "parent").select(*columns)
    return below.unionByName(full.where("depth = 0").withColumn(
        "parent_conv_id", F.lit(None).cast("long")).select(*columns))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 in each conversation), hash (of role and text), words of all turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("hash"),
        F.regexp_count(text, F.lit(f"[^{BLANK}]+")).cast("long").alias("words"))
    return numbered(stored(rows, "turns"), ["conv_id", "turn", "hash"])


def rebuilt(conversations: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """The turns of conversations that take their first turns from the first one of their family, as ``prefix_trie`` takes them.

    Conversation c starts with the first h turns of c - c % ``family`` and goes on with its own after its first h, where h
    is crc32 of the decimal c, modulo ``most``.
    """
    turns = stored(turns_of(conversations), "turns-placed")
    own = stored(turns.groupBy("conv_id").agg(F.min("_pos").alias("start"), F.count("*").alias("n")).select(
        "conv_id", "start", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % most).alias("head")), "turns-convs")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(own.join(bases, "base", "left").select(
        "conv_id", "start", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken")), "turns-heads")
    placed = turns.join(convs.select("conv_id", "start", "head", "taken"), "conv_id").withColumn(
        "pos", F.col("_pos") - F.col("start"))
    kept = placed.where("pos >= head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "hash", "words")
    heads = placed.where((F.col("pos") < most - 1) & (F.col("conv_id") % family == 0)).select(
        F.col("conv_id").alias("base"), "pos", "hash", "words")
    lent = convs.join(heads, "base").where("pos < head").select("conv_id", "pos", "hash", "words")
    marks = convs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("hash"), F.lit(
        0).cast("long").alias("words"))
    return kept.unionByName(lent).unionByName(marks)


def trie(conversations: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations."""
    return prefix_trie(stored(rebuilt(conversations), "turns-rebuilt"), shard, segment)
