"""License scans by conditional compression.

Candidate blocks are the words around a cue, a wording that speaks of a license: as many on both sides as a template may
take up, rounded up to a power of two, so a block's size depends on the template and not on the text. Every block is
compressed alone and with each template of its width as a zstandard raw-content dictionary, with the same parameters. The
pairs of block and template are ranked by the bytes saved, and in this order the wordings are compared, until nothing is
saved any more: the template's words must appear in order, with few missing and few foreign ones between. Of wordings
that overlap, the one with the fewest differences wins, then the one of higher rank. A text may so carry notices within
other text, in lines of any length, and two notices are told apart by the words in which they differ.

A second name in a list of licenses ("... and the Apache License, Version 2.0") counts as a notice, also where the text
only mentions it.

Defined results: null and empty texts and texts without cues have no license; pairs that save the same rank in template
order, then in text order; n_candidates counts the lines in which a cue begins; words longer than every template's count
as one letter in the compressed block; rows that repeat are judged each; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caretrail.llm.common import map_texts, whole_text

GAP = r"[\s!-/:-@\[-`{-~]+"  # between two words, over line ends and comment marks
CUES = (rf"(?i)licen[sc]e|copyright|(?<![a-z0-9_])spdx(?![a-z0-9_])|public{GAP}domain|permission{GAP}is{GAP}hereby"
        rf"|hereby{GAP}granted|permission{GAP}to{GAP}use{GAP}copy|(?<![a-z0-9_])cc{GAP}(by|0)|redistribution{GAP}and{GAP}use")
MAX_MISSING = 0.1  # of the template's words
MAX_FOREIGN = 0.25  # words between, as a part of the template's
LEAST_SAVED = 1  # bytes: the ranking is used up below
KNOWN_BLOCKS = 4_096
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")

# The notices' public wordings, names and identifiers.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TITLES = (
    ("MIT", "MIT License. Copyright (c)"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License, Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License, Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License, Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License, Version 3, 19 November 2007"),
)
NAMES = (
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
)
HEADERS = (
    ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"),
    ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"),
)
HEADER = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} Public "
          "License as published by the Free Software Foundation; either version {1} of the License, or (at your option) "
          "any later version")
IDENTIFIERS = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-3-Clause",
    "BSD-2-Clause", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0", "Unlicense",
)

TEMPLATES = (
    *NOTICES,
    *TITLES,
    *[(name, f"{word} the {full}") for name, full in NAMES for word in ("and", "or")],
    *[(name, HEADER.format(kind, version)) for name, kind, version in HEADERS],
    *[(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS],
)


@dataclass(frozen=True)
class Match:
    license: str
    saved: int
    missing: str
    foreign: str


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class Alignment:
    """A template within a list of words: words start to end (excluded), and the places of the matched words in both."""
    template: int
    start: int
    end: int
    pairs: tuple[tuple[int, int], ...]


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import zstandard

        self.names = [name for name, _ in templates]
        self.templates = [words_of(text) for _, text in templates]
        self.longest = max(len(w) for t in self.templates for w in t)
        self.cues = re.compile(CUES, re.ASCII)
        self.widths: dict[int, list[int]] = {}  # templates by the words that they may take up
        for number, t in enumerate(self.templates):
            self.widths.setdefault(1 << (len(t) + int(MAX_FOREIGN * len(t)) - 1).bit_length(), []).append(number)
        # the optimal parser: the lazy ones pass over matches at a dictionary's start
        same = zstandard.ZstdCompressionParameters.from_level(19, source_size=1 << 14, write_content_size=False)
        self.alone = zstandard.ZstdCompressor(compression_params=same)
        self.given = [
            zstandard.ZstdCompressor(compression_params=same, dict_data=zstandard.ZstdCompressionDict(
                f" {' '.join(t)} ".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in self.templates]
        self.saved = lru_cache(KNOWN_BLOCKS)(self._saved)

    def _saved(self, block: str, numbers: tuple[int, ...]) -> tuple[int, ...]:
        """Bytes that each of the templates saves on a block of words."""
        data = f"{block} ".encode()  # a last word that differs costs its blank, too
        alone = len(self.alone.compress(data))
        return tuple(alone - len(self.given[i].compress(data)) for i in numbers)

    def ranking(self, block: str) -> list[tuple[int, int]]:
        """(bytes saved, template) of all templates on one block, from the best on."""
        numbers = tuple(range(len(self.templates)))
        saved = self.saved(" ".join(words_of(block)), numbers)
        return sorted(zip(saved, numbers, strict=True), key=lambda x: (-x[0], x[1]))

    def alignments(self, number: int, words: list[str]) -> Iterator[Alignment]:
        """Every end at which the template is found within its bounds, with the fewest foreign words for it.

        A state is (template words passed, of these missing); it keeps the foreign words so far, the first word and the
        matched ones as a linked list. Numbers can't be missing: another version is another license.
        """
        template = self.templates[number]
        n, most_missing, most_foreign = len(template), int(MAX_MISSING * len(template)), int(MAX_FOREIGN * len(template))
        vital = [any(c.isdigit() for c in w) for w in template]
        known, lack = set(words), 0
        for word, needed in zip(template, vital, strict=True):
            lack += 0 if word in known else most_missing + 1 if needed else 1
        if lack > most_missing:
            return
        states: dict[tuple[int, int], tuple] = {}
        for j, word in enumerate(words):
            after: dict[tuple[int, int], tuple] = {}
            for (i, m), (foreign, start, pairs) in [*states.items(), ((0, 0), (0, j, None))]:
                if pairs and foreign < most_foreign:
                    _keep(after, (i, m), (foreign + 1, start, pairs))
                while m <= most_missing and i < n:
                    if template[i] == word:
                        _keep(after, (i + 1, m), (foreign, start, (pairs, i, j)))
                    if vital[i]:
                        break
                    i, m = i + 1, m + 1
            states = after
            for (i, m), (_, start, pairs) in states.items():
                if pairs[2] == j and m + n - i <= most_missing and not any(vital[i:]):
                    yield Alignment(number, start, j + 1, _path(pairs))

    def ranked(self, words: list[str], cues: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(bytes saved, template, start, end) of all blocks and templates that save any, from the best on."""
        short = [w if len(w) <= self.longest else "_" for w in words]
        found = []
        for width, numbers in self.widths.items():
            for start, end in blocks(cues, width, len(words)):
                saved = self.saved(" ".join(short[start:end]), tuple(numbers))
                found += [(n, i, start, end) for n, i in zip(saved, numbers, strict=True) if n >= LEAST_SAVED]
        return sorted(found, key=lambda x: (-x[0], *x[1:]))

    def confirmed(self, words: list[str], ranked: list[tuple[int, int, int, int]]) -> dict[tuple, tuple[int, int, Match]]:
        """The wordings found in the ranked blocks: (template, start, end) with differences, place in the ranking, match."""
        found = {}
        for rank, (saved, number, start, end) in enumerate(ranked):
            block = words[start:end]
            for a in self.alignments(number, block):
                key = (number, start + a.start, start + a.end)
                if key in found:  # in a block of higher rank
                    continue
                there, here = {i for i, _ in a.pairs}, {j for _, j in a.pairs}
                missing = [w for i, w in enumerate(self.templates[number]) if i not in there]
                foreign = [block[j] for j in range(a.start, a.end) if j not in here]
                match = Match(self.names[number], saved, " ".join(missing), " ".join(foreign))
                found[key] = len(missing) + len(foreign), rank, match
        return found

    def match(self, text: str) -> Match | None:
        """The first of the notices of a text in the order in which they win."""
        return next(iter(self.scan(text)[1]), None)

    def words_and_cues(self, text: str) -> tuple[int, list[str], list[tuple[int, int]]]:
        """The number of lines in which a cue begins, the words, and the words (first, end) that each cue touches."""
        cues = list(self.cues.finditer(text))
        spans = [m.span() for m in WORD.finditer(text)] if cues else []
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        at, line, lines = 0, 0, set()
        for cue in cues:
            line += text.count("\n", at, cue.start())
            at = cue.start()
            lines.add(line)
        touched = [(bisect_right(ends, c.start()), bisect_left(starts, c.end())) for c in cues]
        return len(lines), [text[a:b] for a, b in spans], touched

    def scan(self, text: str) -> tuple[int, list[Match]]:
        """The number of candidate lines and the confirmed notices, which don't overlap."""
        candidates, words, cues = self.words_and_cues(text.lower())
        return candidates, self.winners(self.confirmed(words, self.ranked(words, cues)))

    def winners(self, found: dict[tuple, tuple[int, int, Match]]) -> list[Match]:
        won: list[Match] = []
        starts: list[int] = []  # of what is taken, in order
        ends: list[int] = []
        for (_, start, end), (_, _, match) in sorted(found.items(), key=lambda x: (*x[1][:2], x[0])):
            at = bisect_left(starts, end)
            if at and ends[at - 1] > start:
                continue
            starts.insert(at, start)
            ends.insert(at, end)
            won.append(match)
        return won


def blocks(cues: list[tuple[int, int]], width: int, n_words: int) -> Iterator[tuple[int, int]]:
    """Words (start, end) around the cues, ``width`` on both sides; cues within ``width`` words share a block."""
    first = last = None
    for start, end in cues:
        if first is not None and end - first > width:
            yield max(0, first - width), min(n_words, last + width)
            first = None
        first, last = start if first is None else first, end
    if first is not None:
        yield max(0, first - width), min(n_words, last + width)


def _keep(states: dict[tuple[int, int], tuple], key: tuple[int, int], new: tuple) -> None:
    if key not in states or new[0] < states[key][0]:
        states[key] = new


def _path(pairs: tuple | None) -> tuple[tuple[int, int], ...]:
    out = []
    while pairs:
        pairs, i, j = pairs
        out.append((i, j))
    return tuple(reversed(out))


def _scans(templates: tuple[tuple[str, str], ...]):
    import pyarrow as pa

    scanner = Scanner(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.int32()), ("missing", pa.string()),
                               ("foreign", pa.string())]))

    def work(texts: list[str | None]) -> list[pa.Array]:
        out = [scanner.scan(t) if t else (0, []) for t in texts]
        return [pa.array([n for n, _ in out], pa.int64()), pa.array([[vars(m) for m in found] for _, found in out], kind)]

    return work


def license_notices(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_candidates and notices (license, saved, missing, foreign of each) of every row.

    Texts without a cue are told inside the JVM and not handed out.
    """
    text = whole_text(F.col("text"))
    rows = docs.select("doc_id", F.when(text.rlike(CUES), text).alias("text"))
    return map_texts(rows, ("doc_id",), "text", lambda: _scans(templates), "n_candidates long, "
                     "notices array<struct<license:string,saved:int,missing:string,foreign:string>>")


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_candidates, n_confirmed, licenses (sorted, comma-joined), differences of every row."""
    def joined(column, separator):
        return F.array_join(F.array_sort(F.array_distinct(column)), separator)

    differ = F.filter("notices", lambda x: (F.length(x["missing"]) > 0) | (F.length(x["foreign"]) > 0))
    return license_notices(docs, templates).select(
        "doc_id", "n_candidates", F.size("notices").cast("long").alias("n_confirmed"),
        joined(F.col("notices.license"), ",").alias("licenses"),
        joined(F.transform(differ, lambda x: F.concat(x["license"], F.lit(" -"), x["missing"], F.lit(" +"), x["foreign"])),
               ";").alias("differences"))
