"""Benchmark decontamination: windows of test items found in training documents.

The benchmark's windows (ten consecutive normalised words; a shorter item is one window) are hashed into a broadcast
table. Documents are cut into words once per row; every window is hashed inside the generated code of the scan and
probes that table, so no window is shuffled. A hit is verified word by word. The broadcast is bounded: a benchmark of
more than ``MAX_WINDOWS`` windows is searched in several passes of at most that many.

Defined results: a null or empty text and a text of separators have no words and are never hit; an item without words
has no window; an item id that is null counts as an item with the name ''. Rows that repeat each get their result, rows
that share an id but not the text are judged apart; columns besides doc_id and text are passed on or ignored. An empty
benchmark hits nothing, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import row_keys, split_words, whole_text

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # the same before A-Z are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WINDOW = 10
MAX_WINDOWS = 500_000


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, m (its words), hash and window (words with a blank between) of every window of every item."""
    words = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        split_words(whole_text(F.col("text")), SEPARATORS).alias("w"))
    starts = F.explode(F.sequence(F.lit(0), F.size("w") - F.least(F.size("w"), F.lit(window))))
    return (
        words.where(F.size("w") > 0).select("item", "w", starts.alias("p"))
        .select("item", F.slice("w", F.col("p") + 1, window).alias("g"))
        .select("item", F.size("g").alias("m"), F.xxhash64("g").alias("hash"), F.concat_ws(" ", "g").alias("window"))
        .distinct()
    )


def _probe(docs: DataFrame, benchmark: DataFrame, window: int, max_windows: int) -> DataFrame:
    """_k, _h, doc_id, n (words), p, m, item: each occurrence of a window of an item, and for each row one with p = -1."""
    windows = benchmark_windows(benchmark, window)
    sizes = windows.groupBy("m").count().orderBy("m").collect()  # a row for each length, ``window`` at most
    passes = -(-sum(r["count"] for r in sizes) // max_windows) or 1
    words = docs.select(
        *row_keys(F.col("doc_id"), F.col("text")), "doc_id",
        split_words(whole_text(F.col("text")), SEPARATORS).alias("w"))
    found = None
    for m in [r.m for r in sizes] or [window]:
        for i in range(passes):
            first = -1 if found is None else 0
            last = F.greatest(F.size("w") - m, F.lit(-1))
            starts = F.when(last >= first, F.sequence(F.lit(first), last))
            # outer: else the optimizer tests the exploded array in a filter, which cuts the text into words once more
            grams = words.select("_k", "_h", "doc_id", F.size("w").alias("n"), "w", F.explode_outer(starts).alias("p"))
            p, text = F.col("p"), F.concat_ws(" ", F.slice("w", F.greatest(F.col("p") + 1, F.lit(1)), m))
            part = windows.where(F.col("m") == m)
            if passes > 1:
                part = part.where(F.pmod(F.col("hash"), F.lit(passes)) == i)
            inside = (p >= 0) & (p + m <= F.size("w"))
            keyed = grams.withColumn("hash", F.when(inside, F.xxhash64(*[F.get("w", p + j) for j in range(m)])))
            # not written as an equality, which would be taken for a join key and built for each window
            same = (F.instr(text, F.col("window")) == 1) & (F.length(text) == F.length("window"))
            hit = (
                keyed.join(F.broadcast(part.select(F.col("hash").alias("g"), "window", "item")),
                           (F.col("hash") == F.col("g")) & same, "left")
                .where(F.col("item").isNotNull() | (p == -1))
                .select("_k", "_h", "doc_id", "n", "p", F.lit(m).alias("m"), "item")
            )
            found = hit if found is None else found.unionByName(hit)
    return found


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """_k, _h (the row), p (word position), m (words), item: one row for each occurrence of a window of an item."""
    return _probe(docs, benchmark, window, max_windows).where("p >= 0").select("_k", "_h", "p", "m", "item")


def _covered() -> Column:
    """The word positions that the occurrences of a group cover."""
    return F.array_distinct(F.flatten(F.collect_set(F.when(
        F.col("p") >= 0, F.sequence(F.col("p"), F.col("p") + F.col("m") - 1)))))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS,
                  ) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of ``docs``, in one pass over it."""
    rows = _probe(docs, benchmark, window, max_windows).groupBy("_k", "_h", "doc_id").agg(
        F.count_if(F.col("p") == -1).alias("copies"), F.max("n").cast("long").alias("n_words"),
        F.size(_covered()).cast("long").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """``docs`` without its contaminated documents, or (``remove="spans"``) without the words that are hit.

    A removed word takes the separators behind it along; columns are those of ``docs``.
    """
    rows = docs.select(F.struct("*").alias("row"), *row_keys(F.col("doc_id"), F.col("text")))
    found = hits(docs, benchmark, window)
    if remove == "documents":
        return rows.join(found.select("_k", "_h").distinct(), ["_k", "_h"], "left_anti").select("row.*")
    text = F.col("row.text").cast("string")
    pieces = F.regexp_extract_all(text, F.lit(f"({WORD}+{BETWEEN}*)"), 1)
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("words", i)), "")
    head = F.regexp_extract(text, f"^({BETWEEN}*)", 1)
    joined = rows.join(found.groupBy("_k", "_h").agg(_covered().alias("words")), ["_k", "_h"], "left")
    cleaned = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.concat(head, kept))
    return joined.select(F.col("row").withField("text", cleaned).alias("row")).select("row.*")
