"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Texts are not compared whole. Each 100-byte window belongs to the smallest hash among its 32-byte grams, so equal windows
belong to equal grams wherever they are; windows next to each other that share their gram form a run.

1. Texts that repeat a whole earlier text go whole. Each task leaves out the runs of later copies that it has seen, so
   a text with any number of copies makes no more rows below than there are tasks.
2. Runs are sorted by (gram, content). A run whose content came earlier is removed whole; of a gram with several contents,
   the first run of each is left to look at. This streams over sorted rows and keeps one row in memory.
3. The runs left over are cut from their texts and meet in shards by gram. A shard's suffix array is made by
   Larsson-Sadakane refinement (groups that are still tied are sorted by the group that follows), neighbours' common
   prefixes by Kasai's walk, in step for all runs; windows that share 100 bytes with an earlier one are marked.
4. A gram with very many different runs is cut into shards of ``CROWD`` runs; sorted windows of each two of them are then
   merged by binary search, so no group need fit into one task.

Order is that of (doc_id, hash of the row, place), null ids as -1. Defined results: null and empty texts have no bytes and
nothing is removed; rows of equal id and text count as one place and are cut alike. Other columns are ignored. Kept bytes
are binary, as a cut may fall within a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caretrail.llm.common import checkpointed, row_keys, ship, stored, whole_text
from caretrail.llm.shingles import _BASE, _INVERSE, _powers, mixed

LENGTH = 100
GRAM = 32
SHARD = 2_000_000  # bytes
CROWD = 4000  # runs
COPIES = 500_000  # texts a task remembers to leave out their later copies; the result is the same without


def runs_of(data: np.ndarray, up: np.ndarray, down: np.ndarray):
    """gram, content, start, count of the runs of windows of one text (bytes)."""
    n = len(data) - LENGTH + 1
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)]
    grams = len(data) - GRAM + 1
    value = mixed((sums[GRAM:] - sums[:-GRAM]) * down[:grams])
    best, at, width, span = value, np.arange(grams), 1, LENGTH - GRAM + 1
    while width < span:  # smallest gram (the first of equal ones) of longer and longer stretches
        step = min(width, span - width)
        left, right, far = best[:len(best) - step], best[step:], at[step:]
        take = right < left
        best, at = np.where(take, right, left), np.where(take, far, at[:len(at) - step])
        width += step
    starts = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
    counts = np.diff(np.r_[starts, n])
    ends = starts + counts - 1 + LENGTH
    content = mixed((sums[ends] - sums[starts]) * down[starts])
    content = mixed(content + (at[starts] - starts).astype(np.uint64) * np.uint64(1 << 20) + counts.astype(np.uint64))
    return best[starts], content, starts, counts


def _runs(batches):
    import pyarrow as pa

    up, down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)
    names = ["gram", "content", "_k", "_h", "start", "count"]
    seen: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        out, sizes, used = [], [], []
        for row, (*key, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            raw = (text or "").encode()
            if len(raw) < LENGTH:
                continue
            digest = hashlib.blake2b(raw, digest_size=16).digest()
            if digest in seen and seen[digest] <= tuple(key):
                continue  # a later copy, which goes whole, or the same row again
            if len(seen) < COPIES:
                seen[digest] = tuple(key)
            data = np.frombuffer(raw, np.uint8)
            if len(data) > len(up):
                up, down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
            out.append(runs_of(data, up, down))
            sizes.append(len(out[-1][0]))
            used.append(row)
        if out:
            gram, content, start, count = (np.concatenate(x) for x in zip(*out, strict=True))
            keys = [np.repeat(batch.column(i).to_numpy()[used], sizes) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (gram.view(np.int64), content.view(np.int64), *keys, start.astype(np.int32),
                                       count.astype(np.int32))], names)


def _sorted_runs(batches):
    """Of runs sorted by gram, content and order: repeats (open = false), and first ones of grams with several contents."""
    import pyarrow as pa

    held = None  # the last row, not yet given out: (columns, is it a repeat, is it known to have company)
    names = ["gram", "_k", "_h", "start", "count", "open"]

    def given(cols: list[np.ndarray], repeat: np.ndarray, company: np.ndarray):
        keep = repeat | company
        gram, _, k, h, start, count = (c[keep] for c in cols)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, k, h, start, count, ~repeat[keep])], names)

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        repeat0, company0 = False, False
        if held:
            cols = [np.r_[h, c] for h, c in zip(held[0], cols, strict=True)]
            repeat0, company0 = held[1:]
        again = np.all([c[1:] == c[:-1] for c in cols[:5]], axis=0)  # a run of a row that repeats
        cols = [c[np.r_[True, ~again]] for c in cols]
        same_gram = cols[0][1:] == cols[0][:-1]
        same = same_gram & (cols[1][1:] == cols[1][:-1])
        repeat = np.r_[repeat0, same]
        # a first run has company if another content of its gram precedes it or follows the repeats of its own
        new = np.flatnonzero(~repeat)
        company = np.zeros(len(repeat), bool)
        if repeat0:  # the held row repeats an earlier content: what follows in the gram has company
            company[0] = True
        gram_start = np.r_[True, ~same_gram]
        has_before = ~gram_start & ~repeat
        has_before[0] = company0
        company |= has_before
        followed = np.zeros(len(repeat), bool)
        followed[new[:-1]] = cols[0][new[:-1]] == cols[0][new[1:]]
        company |= followed
        yield given([c[:-1] for c in cols], repeat[:-1], company[:-1])
        held = ([c[-1:] for c in cols], bool(repeat[-1]), bool(company[-1]))
    if held:
        yield given(held[0], np.array([held[1]]), np.array([held[2]]))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order. Sorted to the end, as Kasai's walk relies on it; after the first rounds few are still tied."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j:j + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    h = 8
    group = np.empty(n + 1, np.int64)
    group[n] = -1
    while True:
        number = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # a group's number: where it begins
        group[order] = number
        tied = ~first | np.r_[~first[1:], False]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        following = group[np.minimum(who + h, n)]
        inside = np.lexsort((following, number[at]))
        order[at] = who[inside]
        following, own = following[inside], number[at]
        first[at] = np.r_[True, (own[1:] != own[:-1]) | (following[1:] != following[:-1])]
        h *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bytes (``LENGTH`` at most) that each suffix of ``order`` shares with the one before it: Kasai's walk.

    From one byte to the next a prefix shrinks by one at most; all pieces (starts, sizes) walk in step.
    """
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.where(rank > 0, order[rank - 1], n)
    padded = np.r_[text.astype(np.int16), np.full(LENGTH + 1, -1, np.int16)]
    out = np.zeros(n, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    known = np.zeros(len(starts), np.int64)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        alive = int(np.searchsorted(-sizes, -j, side="left"))
        i = starts[:alive] + j
        h = np.maximum(known[:alive] - 1, 0)
        p = before[i]
        h[p == n] = 0
        go = np.flatnonzero((p < n) & (h < LENGTH))
        while len(go):
            a, b = i[go] + h[go], p[go] + h[go]
            go = go[(a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])]
            h[go] += 1
            go = go[h[go] < LENGTH]
        known[:alive] = h
        out[rank[i]] = h
    return out


def _marked(block: pd.DataFrame, marks: np.ndarray, piece: np.ndarray, offset: np.ndarray) -> pd.DataFrame:
    """Byte intervals of marked windows; ``piece`` and ``offset`` of each window, in order."""
    p, o = piece[marks], offset[marks]
    cut = np.r_[True, (p[1:] != p[:-1]) | (o[1:] != o[:-1] + 1)] if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(cut)
    last = np.r_[at[1:], len(p)] - 1 if len(at) else at
    base = block["start"].to_numpy()[p[at]]
    return pd.DataFrame({
        "_k": block["_k"].to_numpy()[p[at]], "_h": block["_h"].to_numpy()[p[at]],
        "s": (base + o[at]).astype(np.int32), "e": (base + o[last] + LENGTH).astype(np.int32)})


def _windows(block: pd.DataFrame):
    counts = block["count"].to_numpy().astype(np.int64)
    piece = np.repeat(np.arange(len(block)), counts)
    return piece, np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)


def _ordered(block: pd.DataFrame) -> pd.DataFrame:
    """Runs in order, those of rows that repeat once."""
    place = ["_k", "_h", "start"]
    return block.drop_duplicates(place).sort_values(place, kind="stable").reset_index(drop=True)


def shard_repeats(block: pd.DataFrame) -> pd.DataFrame:
    """Intervals of the windows of a shard's runs that share all bytes with an earlier one of the shard."""
    block = _ordered(block)
    pieces = [np.frombuffer(b, np.uint8) for b in block["bytes"]]
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.concatenate(pieces)
    order = suffix_array(text)
    shared = common_prefixes(text, order, starts, sizes)
    label = np.empty(len(text), np.int64)
    label[order] = np.cumsum(shared < LENGTH)
    piece, offset = _windows(block)
    _, earliest, which = np.unique(label[starts[piece] + offset], return_index=True, return_inverse=True)
    return _marked(block, np.flatnonzero(earliest[which] != np.arange(len(piece))), piece, offset)


def merged_repeats(block: pd.DataFrame) -> pd.DataFrame:
    """Intervals of windows of two shards of one gram that the other shard has earlier, by binary search."""
    block = _ordered(block)
    piece, offset = _windows(block)
    joined = np.frombuffer(b"".join(block["bytes"]), np.uint8)
    sizes = block["bytes"].map(len).to_numpy(np.int64)
    at = (np.cumsum(sizes) - sizes)[piece] + offset
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(joined, LENGTH)[at]).view(f"S{LENGTH}").ravel()
    side = block["side"].to_numpy()[piece]
    marks = []
    for mine in (0, 1):
        here, there = np.flatnonzero(side == mine), np.flatnonzero(side != mine)
        if not len(here) or not len(there):
            continue
        order = np.argsort(windows[there], kind="stable")  # the earliest of equal ones comes first
        ordered = windows[there][order]
        found = np.minimum(np.searchsorted(ordered, windows[here]), len(ordered) - 1)
        hit = (ordered[found] == windows[here]) & (there[order[found]] < here)
        marks.append(here[hit])
    return _marked(block, np.sort(np.concatenate([np.zeros(0, np.int64), *marks])), piece, offset)


def _pieces(batches):
    import pyarrow as pa

    names = ["gram", "_k", "_h", "start", "count", "bytes"]
    for batch in batches:
        rows = []
        for k, h, text, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = text.encode()
            rows += [(c["gram"], k, h, c["start"], c["count"], data[c["start"]:c["start"] + c["count"] - 1 + LENGTH])
                     for c in cuts]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def _cut(batches):
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        rows = []
        for text, whole, cuts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data, spans = (text or "").encode(), []
            for s, e in [(0, len(data))] if whole else sorted((c["s"], c["e"]) for c in cuts or ()):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            edges = [0, *(x for span in spans for x in span), len(data)]
            kept = b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2))
            rows.append((len(data), len(data) - len(kept), len(spans), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*rows, strict=True) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True))], names)


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    ship(docs.sparkSession)
    text = whole_text(F.col("text"))
    rows = docs.select("doc_id", *row_keys(F.col("doc_id"), F.col("text")), text.alias("text"))
    # 1: the first row of each text, over narrow rows
    whole = rows.select("_k", "_h", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit("t")).alias("u"),
                        F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH)
    firsts = whole.groupBy("t", "u").agg(F.min(F.struct("_k", "_h")).alias("f")).select("f._k", "f._h")
    texts = rows.select("_k", "_h", "text")
    runs = texts.mapInArrow(_runs, "gram long, content long, _k long, _h long, start int, count int")
    keys = ["gram", "content", "_k", "_h", "start"]
    judged = stored(
        runs.repartition("gram").sortWithinPartitions(*keys).select(*keys, "count").mapInArrow(
            _sorted_runs, "gram long, _k long, _h long, start int, count int, open boolean"), "suffix-runs")
    # 3: shards of whole grams, crowded grams in parts
    left = judged.where("open")
    total = left.agg(F.sum(F.col("count") + LENGTH)).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    crowded = checkpointed(left.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("parts")).where(
        "parts > 1"))
    cuts = left.groupBy("_k", "_h").agg(F.collect_list(F.struct("gram", "start", "count")).alias("cuts"))
    pieces = texts.join(cuts, ["_k", "_h"]).select("_k", "_h", "text", "cuts").mapInArrow(
        _pieces, "gram long, _k long, _h long, start int, count int, bytes binary")
    if not crowded.isEmpty():
        pieces = pieces.join(crowded, "gram", "left")
    else:
        pieces = pieces.withColumn("parts", F.lit(None).cast("int"))
    part = F.pmod(F.xxhash64("_k", "_h", "start"), F.col("parts")).cast("int")
    shard = F.when(F.col("parts").isNull(), F.pmod("gram", F.lit(shards))).otherwise(F.col("gram"))
    pieces = pieces.withColumn("part", F.coalesce(part, F.lit(-1))).withColumn("shard", shard)
    interval = T.StructType.fromDDL("_k long, _h long, s int, e int")
    found = pieces.select("shard", "part", "_k", "_h", "start", "count", "bytes").groupBy("shard", "part").applyInPandas(
        shard_repeats, interval)
    if not crowded.isEmpty():
        crowd = pieces.where("part >= 0").select(
            "gram", "part", "_k", "_h", "start", "count", "bytes",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).where("part <> other")
        crowd = crowd.select("gram", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
                             (F.col("part") > F.col("other")).cast("int").alias("side"), "_k", "_h", "start", "count", "bytes")
        found = found.unionByName(crowd.groupBy("gram", "i", "j").applyInPandas(merged_repeats, interval))
    # 4: all cuts of a row together
    repeated = judged.where("not open").select(
        "_k", "_h", F.col("start").alias("s"), (F.col("start") + F.col("count") - 1 + LENGTH).alias("e"))
    cut = repeated.unionByName(found).groupBy("_k", "_h").agg(F.collect_list(F.struct("s", "e")).alias("cuts"))
    first = firsts.withColumn("first", F.lit(True))
    marked = rows.join(cut, ["_k", "_h"], "left").join(first, ["_k", "_h"], "left")
    whole_repeat = F.col("first").isNull() & (F.octet_length("text") >= LENGTH)
    return marked.select("doc_id", "text", whole_repeat.alias("whole"), "cuts").mapInArrow(
        _cut, T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(
            "n_bytes long, n_removed long, n_spans long, kept binary").fields]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return without_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
