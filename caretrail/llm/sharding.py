"""Sharding along a Hilbert curve.

Metadata dimensions are quantised into equally full steps, the steps of a row give its place on the curve, and the rows
sorted by that place are cut into runs of equal count. Rows alike in several dimensions so land in the same files, and
the files' minima and maxima prune on each of the dimensions.

A rank over all rows needs no single task: rows are range-partitioned by (place, a hash of the row, the id), which splits
a place that holds a third of the table; numbers within the partitions are fixed by a checkpoint and offset by the
partitions' counts. The curve itself is a table of at most ``MAX_CELLS`` places, made once and broadcast.

Defined results: a null in a dimension is the lowest step; a null text has size 1 and the checksum of the empty text;
rows that repeat are each placed; more shards than rows leave some empty; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrail.llm.common import checkpointed, stored, whole_text
from caretrail.llm.ranks import numbered

BITS = 4
MAX_CELLS = 1 << 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (one a row) on the Hilbert curve of ``bits`` bits a dimension, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> b) & 1)
    return place


def is_text(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column] in ("string", "binary")


def text_starts(df: DataFrame, column: str, key: str) -> DataFrame:
    """_value, _start: how many rows of ``df`` have a smaller value, for each distinct whole value of a text column."""
    placed = numbered(df.select(F.col(column).alias("_value"), F.xxhash64(key).alias("_mix")), ["_value", "_mix"])
    return stored(placed.groupBy("_value").agg(F.min("_pos").alias("_start")), "text-starts")


def with_steps(df: DataFrame, dimensions: list[str], key: str, bits: int = BITS) -> DataFrame:
    """``df`` with _step<i> of each dimension: in which of 2^bits equally full parts of the table the row's value starts.

    Numbers are cut at approximate quantiles. Texts are ranked by their whole values, so that a prefix that all share
    makes no difference; a value's rank is joined to its rows, which adaptive execution can split.
    """
    parts, columns = 1 << bits, df.columns
    cuts = [i / parts for i in range(1, parts)]
    numbers = [c for c in dimensions if not is_text(df, c)]
    bounds = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile_approx(F.col(c).cast("double"), cuts, 10_000).alias(f"_{i}") for i, c in enumerate(numbers)]).first()
    out = df
    for i, c in enumerate(dimensions):
        if c in numbers:
            value, step = F.col(c).cast("double"), F.lit(0)
            for bound in sorted(set(bounds[f"_{numbers.index(c)}"] or ())):
                step = step + F.coalesce(value >= bound, F.lit(False)).cast("int")
            out = out.withColumn(f"_step{i}", step)
        else:
            starts = text_starts(df, c, key)
            out = out.join(starts, out[c].eqNullSafe(starts["_value"]), "left").withColumn(
                f"_step{i}", F.expr(f"int(_start * {parts} div {max(1, bounds['_n'])})")).drop("_value", "_start")
    return out.select(*columns, *[f"_step{i}" for i in range(len(dimensions))])


def hilbert_shards(df: DataFrame, dimensions: list[str], shards: int, key: str, bits: int = BITS) -> DataFrame:
    """``df`` with place (on the curve), shard (0 to shards - 1) and slot (gapless from 0 within the shard).

    Shards are runs along the curve whose counts are at most one apart.
    """
    n = len(dimensions)
    if 1 << (bits * n) > MAX_CELLS:
        raise ValueError(f"{n} dimensions of {bits} bits have more than {MAX_CELLS} cells")
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    spark = df.sparkSession
    curve = spark.createDataFrame(
        [(i, int(h)) for i, h in enumerate(hilbert_index(points, bits))], "_cell int, place int")
    columns = df.columns
    stepped = with_steps(df, dimensions, key, bits)
    cell = sum((F.col(f"_step{i}") * (1 << (bits * (n - 1 - i))) for i in range(n)), F.lit(0)).cast("int")
    placed = stepped.select(*columns, cell.alias("_cell")).join(F.broadcast(curve), "_cell").drop("_cell")
    ordered = placed.withColumn("_mix", F.xxhash64(key)).repartitionByRange("place", "_mix", key).sortWithinPartitions(
        "place", "_mix", key)
    numbered = checkpointed(ordered.withColumn("_id", F.monotonically_increasing_id()).drop("_mix"))
    numbered = numbered.withColumn("_part", F.shiftright("_id", 33)).withColumn(
        "_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = numbered.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))  # a row for each partition
    total = F.sum("_n").over(Window.partitionBy())
    offsets = counts.select(
        "_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_offset"), total.alias("_total"))
    rank = F.col("_offset") + F.col("_row")
    ranked = numbered.join(F.broadcast(offsets), "_part").select(
        *columns, "place", rank.alias("_rank"), F.expr(f"int((_offset + _row) * {shards} div _total)").alias("shard"),
        "_total")
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return ranked.select(*columns, "place", "shard", (F.col("_rank") - first).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, place of every document, by lang, source and size."""
    text = whole_text(F.col("text"))
    rows = docs.select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    placed = hilbert_shards(rows, ["lang", "source", "size"], shards, "doc_id")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "place")
