"""Line dedup: lines that repeat an earlier line up to a few edits are removed.

Exact repeats are found on hashes of 128 bits. For near repeats every distinct line is cut into ``EDITS + 1`` segments of
sizes that lines of nearly its length share; of a line within ``EDITS`` edits one segment at least is untouched, moved by
the edits on one side of it at most. So each line has a few keys (content of a segment, or of the pieces of it that a
moved one still has in common), the same kind for both ends of a link. Only lines that meet another one of fitting length
at a key are read again, and of these each is tried against earlier ones until the first within ``EDITS`` edits: letter
parities settle most pairs, the built-in distance with a threshold most others, banded bit-parallel edit distance confirms.
No step makes a row of a pair, so a crowd at one key gives as many rows as it has lines, however many are alike.

The rule: rows are ordered by (doc_id, hash of the row), null ids as -1. A line of ``LEAST`` bytes or more is kept where
it comes first, and only if no other line with an earlier first row (in one row: the smaller bytes first) is within
``EDITS`` byte edits. Shorter lines (headings, blank lines) are left alone. Rows of equal id and text are cleaned alike.

Defined results: a null text stays null and has no lines; an empty one stays empty; a row whose lines all go has ''.
Nothing but text changes, whatever the other columns' names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import row_keys

EDITS = 2
LEAST = 24  # bytes
WIDTH = 16  # lengths whose segments are of one size
COUNTED = "etaoinsrhldcumpg"  # of whose counts the parities are compared: an edit changes two of them at most


def edit_distance(longer: Column, shorter: Column, edits: int) -> Column:
    """The byte edit distance of two binaries if it is at most ``edits``, else something larger.

    A band of 2 * edits + 1 cells moves down the diagonal as bits of vertical differences (Hyyro, 2003). The distance is
    followed along the band's last row down to the last byte of ``longer``, then along that row.
    """
    band = 2 * edits + 1
    mask, top = (1 << band) - 1, band - 1
    n1, n2 = F.octet_length(longer), F.octet_length(shorter)

    def matches(i: Column) -> Column:
        """Bit k: does byte i of the shorter text equal byte i - edits + k of the longer one?"""
        bits = F.lit(0).cast("long")
        for k in range(band):
            at = i + (k - edits + 1)
            same = (at >= 1) & (F.substring(longer, F.greatest(at, F.lit(1)), F.lit(1)) == F.substring(shorter, i + 1, F.lit(1)))
            bits = bits.bitwiseOR(F.when(same, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        return bits

    def bit(x: Column, k: Column | int) -> Column:
        return F.call_function("shiftrightunsigned", x, k if isinstance(k, Column) else F.lit(k)).bitwiseAND(F.lit(1))

    def let(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def inverted(x: Column) -> Column:
        return F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def step(a: Column, x: Column) -> Column:
        vp, vn, i, d = a["vp"], a["vn"], a["i"], a["d"]
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask))

        def with_d0(d0: Column) -> Column:
            hn, down = d0.bitwiseAND(vp), F.shiftright(d0, 1)

            def with_hp(hp: Column) -> Column:
                along = F.lit(top - 1) - (i - (n1 - edits))
                change = F.when(i < n1 - edits, F.lit(1) - bit(d0, top)).otherwise(bit(hp, along) - bit(hn, along))
                return F.struct(
                    hn.bitwiseOR(inverted(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                    (i + 1).alias("i"), (d + change).alias("d"))

            return let(vn.bitwiseOR(inverted(d0.bitwiseOR(vp))), with_hp)

        return let(d0, with_d0)

    start = F.struct(
        F.lit(mask & ~((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(0).alias("i"),
        F.lit(edits).cast("long").alias("d"))
    masks = F.transform(F.sequence(F.lit(0), n2 - 1), matches)
    return F.aggregate(masks, start, step, lambda a: a["d"])


def _cells(n: Column, edits: int) -> Column:
    """Cells of ``WIDTH`` lengths, one mostly or two; lengths that differ by ``edits`` at most have one in common."""
    own, below = (F.floor((n - less) / WIDTH).cast("int") for less in (0, edits))
    return F.when(own == below, F.array(own)).otherwise(F.array(own, below))


def _segment_keys(line: Column, cell: Column, edits: int, least: int) -> list[Column]:
    """Keys of a line's segments, whose sizes are those of the shortest line of its cell.

    Segments of the first half are counted from the line's start, the others from its end, so that one with ``moved``
    segments before (after) it has moved by that many bytes at most, if it is the untouched one. Two lines' pieces of it,
    each begun at 0 to ``moved`` bytes into it, then have one in common.
    """
    parts, n, out = edits + 1, F.octet_length(line), []
    shortest = F.greatest(cell * WIDTH, F.lit(least))
    for i in range(parts):
        moved = min(i, edits - i)
        start, end = (F.floor(shortest * k / parts).cast("int") for k in (i, i + 1))
        at = start if moved == i else n - shortest + start
        size = F.greatest(end - start - moved, F.lit(0))
        out += [F.xxhash64(F.substring(line, at + shift + 1, size), cell, F.lit(i)) for shift in range(moved + 1)]
    return out


def letter_parities(line: Column) -> Column:
    """Bit i: is the count of letter i of ``COUNTED`` odd?"""
    n, packed = F.octet_length(line), F.lit(0)
    for i, c in enumerate(COUNTED):
        odd = (n - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).bitwiseAND(F.lit(1))
        packed = packed.bitwiseOR(F.shiftleft(odd, i))
    return packed


def _row_lines(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*row_keys(F.col("doc_id"), F.col("text")), text.alias("text"))


def first_rows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """h1, h2 (a distinct line), _k, _h, pos: the first row that has it and its place there. Narrow, combined per task."""
    exploded = _row_lines(docs).select("_k", "_h", F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    return exploded.where(F.octet_length("line") >= least).select(
        F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit("line")).alias("h2"),
        F.struct("_k", "_h", "pos").alias("at")).groupBy("h1", "h2").agg(F.min("at").alias("at")).select(
        "h1", "h2", "at.*")


def lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (_k, _h, pos, more columns) with their line, once for each row that repeats. Texts are exchanged by row."""
    more = [c for c in places.columns if c not in ("_k", "_h")]
    at = places.groupBy("_k", "_h").agg(F.collect_set(F.struct(*more)).alias("at"))
    cut = _row_lines(docs).join(at, ["_k", "_h"]).select("_k", "_h", "at", F.split("text", "\n").alias("all"))
    picked = F.transform("at", lambda p: F.struct(*(p[c].alias(c) for c in more), F.get("all", p["pos"]).alias("line")))
    return cut.select("_k", "_h", F.explode_outer(picked).alias("x")).select("_k", "_h", "x.*")


def meeting_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """_k, _h, pos, key: places of distinct lines and those keys at which they meet another line of fitting length."""
    lines = lines_at(docs, firsts.select("_k", "_h", "pos")).select(
        "_k", "_h", "pos", F.col("line").cast("binary").alias("b"))
    n = F.octet_length("b")
    celled = lines.select("*", n.alias("n"), F.explode_outer(_cells(n, edits)).alias("cell"))
    keyed = celled.select("_k", "_h", "pos", "n", F.explode_outer(
        F.array(*_segment_keys(F.col("b"), F.col("cell"), edits, least))).alias("key"))
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    other = (x("_h") != y("_h")) | (x("pos") != y("pos")) | (x("_k") != y("_k"))
    return keyed.alias("y").join(
        keyed.alias("x"), (x("key") == y("key")) & other & (F.abs(x("n") - y("n")) <= edits), "left_semi").select(
        "_k", "_h", "pos", "key")


def near_lines(docs: DataFrame, firsts: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """_k, _h, pos: places of the distinct lines that are within ``edits`` of an earlier one; some come repeatedly."""
    tried = lines_at(docs, meeting_lines(docs, firsts, edits, least)).select(
        "_k", "_h", "pos", "key", letter_parities(F.col("line")).alias("odd"), F.octet_length("line").alias("n"),
        F.decode(F.col("line").cast("binary"), "ISO-8859-1").alias("line"))  # a character a byte, in their order
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    longer = F.when(x("n") >= y("n"), x("line")).otherwise(y("line"))
    shorter = F.when(x("n") >= y("n"), y("line")).otherwise(x("line"))
    ends = (F.encode(c, "ISO-8859-1") for c in (longer, shorter))
    # In the order of their costs: a later condition is tried only if those before it hold.
    return tried.alias("y").join(
        tried.alias("x"), (x("key") == y("key")) & (F.abs(x("n") - y("n")) <= edits)
        & (F.bit_count(x("odd").bitwiseXOR(y("odd"))) <= 2 * edits)
        & (F.struct(x("_k"), x("_h"), x("line")) < F.struct(y("_k"), y("_h"), y("line")))
        & (F.levenshtein(x("line"), y("line"), edits) >= 0) & (edit_distance(*ends, edits) <= edits), "left_semi").select(
        "_k", "_h", "pos")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """_k, _h (the row), text (cleaned), n_lines, n_repeats (exact), n_near of every different row of ``docs``."""
    firsts = first_rows(docs, least)
    near = near_lines(docs, firsts, edits, least).groupBy("_k", "_h").agg(F.collect_set("pos").alias("near"))
    first = firsts.groupBy("_k", "_h").agg(F.collect_set(F.struct("pos")).alias("first"))
    none = F.array().cast("array<int>")
    cut = _row_lines(docs).join(first, ["_k", "_h"], "left").join(near, ["_k", "_h"], "left").select(
        "_k", "_h", F.size(F.coalesce("near", none)).cast("long").alias("n_near"),
        F.array_except(F.coalesce("first.pos", none), F.coalesce("near", none)).alias("kept"),
        F.split("text", "\n").alias("all"))
    places = F.sequence(F.lit(0), F.size("all") - 1)
    short = F.filter(places, lambda p: F.octet_length(F.get("all", p)) < least)
    cut = cut.select("*", F.when(F.col("all").isNotNull(), F.array_sort(F.array_union(short, "kept"))).alias("at"))
    n_near = F.col("n_near")
    n_lines = F.when(F.col("all").isNull(), 0).otherwise(F.size("all")).cast("long")
    n_kept = F.when(F.col("all").isNull(), 0).otherwise(F.size("at")).cast("long")
    return cut.select(
        "_k", "_h", F.array_join(F.transform("at", lambda p: F.get("all", p)), "\n").alias("text"),
        n_lines.alias("n_lines"), (n_lines - n_kept - n_near).alias("n_repeats"), n_near)


def without_repeats(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``docs`` with cleaned texts."""
    rows = docs.select(F.struct("*").alias("row"), *row_keys(F.col("doc_id"), F.col("text")))
    cleaned = dedup_lines(docs, edits, least).select("_k", "_h", "text").dropDuplicates(["_k", "_h"])
    return rows.join(cleaned, ["_k", "_h"]).select(
        F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")
