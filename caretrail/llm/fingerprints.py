"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of a five-word shingle that lies below a fixed fraction of the hash range, so its size follows
the document's, sketches merge by union, and containment of a short text in a long one can be estimated. A text without
a hash below the threshold keeps its smallest one; merging drops that again when the other side has hashes below. A text
of one to four words has one shingle, all its words.

All work is done on arrays within a row, nothing is shuffled: words are hashed once and shingle hashes are combined from
word hashes in three steps. Defined results: null and empty texts and texts of white space have an empty sketch; two
empty sketches are alike (1.0), an empty one and another are not (0.0). Rows that repeat are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caretrail.llm.common import split_words, whole_text

SEPARATORS = r"[\x20\x09-\x0D]"
SHINGLE = 5
ONE_IN = 8
CELL = 2000  # documents in a cell of neighbouring ids, about
MAX_CELLS = 1 << 16  # bounds the table of the cells' first rows, which is broadcast; beyond it cells grow instead


def with_sketch(df: DataFrame, text: str, name: str, one_in: int = ONE_IN) -> DataFrame:
    """``df`` with the sketch of column ``text``: its hashes in order. Five-word shingles, hence the steps 2, 4, 5."""
    rest = [F.col(c) for c in df.columns]
    below = -(1 << 63) + (1 << 64) // one_in

    def shifted(column: str, by: int) -> Column:
        return F.slice(column, by + 1, F.greatest(F.size(column) - by, F.lit(0)))

    def both(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b)

    # each step is a projection of its own: a column used twice by the next one is then computed once
    df = df.select(*rest, F.transform(split_words(F.col(text), SEPARATORS), lambda x: F.xxhash64(x)).alias("_w"))
    df = df.select(*rest, "_w", F.zip_with("_w", shifted("_w", 1), both).alias("_2"))
    df = df.select(*rest, "_w", F.zip_with("_2", shifted("_2", 2), both).alias("_4"))
    df = df.select(*rest, "_w", F.zip_with("_4", shifted("_w", 4), both).alias("_5"))
    shingles = F.when(F.size("_w") >= SHINGLE, F.slice("_5", 1, F.greatest(F.size("_w") - SHINGLE + 1, F.lit(1)))).when(
        F.size("_w") > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*rest, shingles.alias("_s"))
    df = df.select(*rest, "_s", F.array_sort(F.array_distinct(F.filter("_s", lambda h: h < below))).alias("_f"))
    least = F.when(F.size("_s") > 0, F.array(F.array_min("_s"))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*rest, F.when(F.size("_f") > 0, F.col("_f")).otherwise(least).alias(name))


def merged(a: Column, b: Column, one_in: int = ONE_IN) -> Column:
    """The sketch of two texts' shingles together."""
    below = -(1 << 63) + (1 << 64) // one_in
    both = F.array_sort(F.array_union(a, b))
    kept = F.filter(both, lambda h: h < below)
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(both, 1, 1))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated part of the first text's shingles that the second has."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.hex(h)), ",")


def with_next(df: DataFrame, key: str, carried: list[str], cell: int = CELL) -> DataFrame:
    """``df`` with next_<column>: the value in the next row by descending ``key`` (nulls last), after the last the first.

    Rows are dealt into cells of neighbouring keys, about ``cell`` rows each; a window runs within each cell. The first
    row of a cell is also a guest at the end of the cell before, so no order over all rows is needed.
    """
    lowest, highest, rows = df.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    cells = min(MAX_CELLS, max(1, rows // cell))
    width = 1 if lowest is None else -(-(highest - lowest + 1) // cells)
    number = F.coalesce(F.floor((F.col(key).cast("decimal(38,0)") - F.lit(lowest or 0)) / width), F.lit(-1)).cast("long")
    placed = df.withColumn("_cell", number)
    tops = placed.groupBy("_cell").agg(F.max(key).alias("_top"))
    order = Window.orderBy("_cell")  # over one row for each cell
    before = F.coalesce(F.lead("_cell").over(order), F.min("_cell").over(Window.partitionBy()))
    guests = placed.join(
        F.broadcast(tops.select("_cell", "_top", before.alias("_host"))),
        (placed["_cell"] == tops["_cell"]) & placed[key].eqNullSafe(F.col("_top"))
    ).select(*df.columns, F.col("_host").alias("_cell"), F.lit(1).alias("_guest"))
    within = Window.partitionBy("_cell").orderBy("_guest", F.col(key).desc_nulls_last(), *carried[:1])
    following = [F.lead(c).over(within).alias(f"next_{c}") for c in carried]
    return placed.withColumn("_guest", F.lit(0)).unionByName(guests).select(
        *df.columns, "_guest", *following).where("_guest = 0").drop("_guest")


def fingerprints(docs: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by the beginning of the next document's text.
    """
    base = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    pairs = with_next(with_sketch(base, "text", "sketch", one_in), "doc_id", ["text", "sketch"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    pairs = with_sketch(
        pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch"),
        "edited", "edited_sketch", one_in)
    return pairs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
