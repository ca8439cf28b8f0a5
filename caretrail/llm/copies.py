"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a hash of everything.

Texts are equal when they are the same without ASCII blanks. The first scan counts lengths. The second hashes the first
``PREFIX`` characters of rows whose length another row shares. The third hashes the whole text of rows that share both.
Rows that fall out on the way are alone in their group.

What a scan has found reaches the next one as a bitmap of ``SLOTS`` bits over hashed keys, built by Spark's bitmap
functions and broadcast in pieces of 4 KB: its size is fixed (``SLOTS`` / 8 bytes) at any size of the table, so texts are
never exchanged. Slots that two keys share let a row through in vain, and the next hash settles it; were all slots full,
every text would be hashed whole, and nothing else would change. Only the last hash makes groups. Hot groups are counted
in every task first, and joined back to their rows, which adaptive execution can split.

Defined results: null counts as empty; empty and blank texts are equal to one another; of rows alike in length and id
exactly one stays, a row with an id before one without; an empty table gives an empty result; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import stored, whole_text

BLANKS = " \t\n\x0b\x0c\r"
PREFIX = 64
SLOTS = 1 << 25


def normalised(text: Column) -> Column:
    """A text without ASCII blanks; null becomes empty."""
    return F.translate(whole_text(text), BLANKS, "")


def _slot(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)) + 1


def shared_keys(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """The bitmap of all keys that stand in several rows: _bucket, _bits, at most slots / 32768 rows of 4 KB."""
    several = df.groupBy(*keys).count().where("count > 1").select(_slot(keys, slots).alias("_slot"))
    return stored(several.select(F.bitmap_bucket_number("_slot").alias("_bucket"), F.bitmap_bit_position("_slot").alias(
        "_bit")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "shared-keys")


def with_mark(df: DataFrame, keys: list[str], bitmap: DataFrame, slots: int, mark: str) -> DataFrame:
    """``df`` with the boolean ``mark``: whether the row's keys may stand in several rows; false is certain."""
    columns = df.columns
    slotted = df.withColumn("_slot", _slot(keys, slots)).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    bit = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(bitmap_bit_position(_slot) div 8 + 1 as int), 1)")), 16, 10)
    hit = F.getbit(byte.cast("int"), (bit % 8).cast("int")) == 1
    return slotted.join(F.broadcast(bitmap), "_bucket", "left").select(
        *columns, F.coalesce(hit, F.lit(False)).alias(mark))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", carried: list[Column] | None = None,
                 slots: int = SLOTS) -> DataFrame:
    """A row for each row of ``df``: ``carried`` (the key if none), keep_id, group_size, kept.

    ``keep_id`` is the key of the row that stays: the one with most characters in the original text, then the smallest key.
    """
    rows = df.select(F.struct(*(carried or [F.col(key)])).alias("_carried"), F.col(key).alias("_id"), whole_text(
        F.col(text)).alias("_text")).withColumn("_norm", F.translate("_text", BLANKS, "")).withColumn(
        "_size", F.octet_length("_norm"))
    sizes = shared_keys(rows.select("_size"), ["_size"], slots)
    head = F.xxhash64(F.substring("_norm", 1, PREFIX)).alias("_head")
    alike = with_mark(rows.select("_norm", "_size"), ["_size"], sizes, slots, "_maybe").where("_maybe")
    heads = shared_keys(alike.select("_size", head), ["_size", "_head"], slots)
    last = with_mark(rows.select("*", head), ["_size", "_head"], heads, slots, "_maybe")
    hashed = stored(last.select(
        "_carried", "_id", F.char_length("_text").alias("_chars"), F.monotonically_increasing_id().alias("_row"),
        F.when(F.col("_maybe"), F.unhex(F.sha2("_norm", 256))).alias("_full")), "exact-hashes")
    first = F.struct((-F.col("_chars")).alias("chars"), F.col("_id").isNull().alias("none"), F.col("_id").alias("id"),
                     F.col("_row").alias("row"))
    repeated = stored(hashed.where("_full is not null").groupBy("_full").agg(
        F.count("*").alias("group_size"), F.min(first).alias("_first")), "exact-groups")
    together = hashed.where("_full is not null").join(repeated, "_full").select(
        "_carried.*", F.col("_first.id").alias("keep_id"), "group_size", (F.col("_first.row") == F.col("_row")).alias("kept"))
    alone = hashed.where("_full is null").select(
        "_carried.*", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return together.unionByName(alone)


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay."""
    return exact_groups(df, key, text, [F.struct("*").alias("_whole")]).where("kept").select("_whole.*")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_groups(docs, carried=[F.col("doc_id"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256")])
