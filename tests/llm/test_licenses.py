import random
import re
import textwrap

import pytest

from caretrail.llm import licenses as m
from caretrail.llm.queries import op3_license_scans

# by the wording alone, without compression
NOTICES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}


def test_whole_table(spark, sf_dir, texts):
    rows = op3_license_scans(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    want = {i: ",".join(sorted({x for n, x in NOTICES.items() if n in t})) for i, t in texts.items()}
    assert {r.doc_id: r.licenses for r in rows} == want and any(want.values())


@pytest.mark.parametrize("name, notice", m.TEMPLATES)
def test_templates_find_themselves(name, notice):
    found = m.Scanner().match(f"Some words before. {notice} And after, a little more.")
    assert found.license == name and not found.missing and not found.foreign


def test_ranking_is_the_best_compression():
    scanner = m.Scanner()
    for notice in NOTICES:
        saved = scanner.ranking(notice)
        assert saved == sorted(saved, key=lambda x: (-x[0], x[1])) and len(saved) == len(m.TEMPLATES)
        assert m.TEMPLATES[saved[0][1]][0] == NOTICES[notice]


def test_wording_decides():
    match = m.Scanner().match
    assert match("Licensed under the Apache License, Version 1.1.") is None
    assert match("a license to drive a car in the city") is None
    assert match("This work is licensed under the GNU General Public License, version 2.").license == "GPL-2.0"
    near = match("This work is hereby licensed under the GNU General Public License, version 3.")
    assert (near.license, near.foreign) == ("GPL-3.0", "hereby")


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "no notice"), (4, "copyright me"), (5, "x " * 40_000 + "Released under the MIT License."),
            (None, "Licensed under CC BY 4.0."), (6, "Licensed under CC BY 4.0.\nReleased under the MIT License.\n"),
            (7, "Released under the MIT License."), (7, "Released under the MIT License.")]
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, license string, line int")
    got = [(r.doc_id, r.licenses, r.n_candidates, r.n_confirmed) for r in m.licenses(df).collect()]
    assert sorted(got, key=repr) == sorted(
        [(1, "", 0, 0), (2, "", 0, 0), (3, "", 0, 0), (4, "", 1, 0), (5, "MIT", 1, 1), (None, "CC-BY-4.0", 1, 1),
         (6, "CC-BY-4.0,MIT", 2, 2), (7, "MIT", 1, 1), (7, "MIT", 1, 1)], key=repr)
    assert m.licenses(df.limit(0)).count() == 0


def _licenses(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, (r.licenses, r.n_confirmed, r.differences)) for r in m.licenses(df).collect())]


@pytest.mark.parametrize("size", [1_000, 8_000, 40_000, 200_000])
def test_notice_within_a_long_line_of_real_words(spark, texts, size):
    words = " ".join(t for t in texts.values() if not re.search(m.CUES, t)).split()
    while sum(map(len, words)) + len(words) < size:
        words += words
    line = " ".join(words)[:size].split()
    half = len(line) // 2
    got = _licenses(spark, [" ".join([*line[:half], notice, *line[half:]]) for _, notice in m.TEMPLATES])
    assert [(names, differ) for names, _, differ in got] == [(name, "") for name, _ in m.TEMPLATES]


def test_several_notices(spark):
    mit, apache = "Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = [f"{mit} {apache}", f"{mit} {mit}", " ".join(x for _, x in m.TEMPLATES), f"{mit}\n{apache}",
             f"This work is hereby licensed under the GNU General Public License, version 3. {mit}"]
    everything = ",".join(sorted({x for x, _ in m.TEMPLATES}))
    assert _licenses(spark, texts) == [
        ("Apache-2.0,MIT", 2, ""), ("MIT", 2, ""), (everything, len(m.TEMPLATES), ""), ("Apache-2.0,MIT", 2, ""),
        ("GPL-3.0,MIT", 2, "GPL-3.0 - +hereby")]


def test_the_query_finds_every_template(spark):
    assert _licenses(spark, [x for _, x in m.TEMPLATES]) == [(name, 1, "") for name, _ in m.TEMPLATES]


def test_alignments_against_brute_force():
    """Which templates are found at all, against all ways to leave words out of the template and of the text."""
    rng = random.Random(5)
    template = "permission to use copy and change this for any end is free 2".split()
    scanner = m.Scanner((("x", " ".join(template)),))
    most_missing, most_foreign = int(m.MAX_MISSING * len(template)), int(m.MAX_FOREIGN * len(template))

    def shared(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *(max(row[j + 1], row[j] + 1) if x == y else row[j + 1] for j, y in enumerate(b))]
            for j in range(1, len(row)):
                row[j] = max(row[j], row[j - 1])
        return row[-1]

    found = 0
    for _ in range(300):
        words = [w for w in template if rng.random() > 0.06]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(["foreign", "to", "2", "use"]))
        words = ["a", "to", *words, "b", "2"]
        spans = [words[i:j] for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
        want = any("2" in x and x[-1] == "2" and len(template) - shared(template, x) <= most_missing
                   and len(x) - shared(template, x) <= most_foreign for x in spans)
        got = list(scanner.alignments(0, words))
        assert bool(got) == want
        found += want
        for a in got:
            assert [template[i] for i, _ in a.pairs] == [words[j] for _, j in a.pairs]
            assert a.pairs == tuple(sorted(a.pairs)) and (a.pairs[0][1], a.pairs[-1][1] + 1) == (a.start, a.end)
    assert 30 < found < 270


@pytest.mark.parametrize("width, mark", [(20, ""), (40, "# "), (72, " * "), (80, "// ")])
def test_notice_wrapped_over_lines(spark, width, mark):
    wrapped = ["\n".join(mark + x for x in textwrap.wrap(f"Some words before that. {notice} And some after.", width))
               for _, notice in m.TEMPLATES]
    assert sum("\n" in x for x in wrapped) > 3
    assert _licenses(spark, wrapped) == [(name, 1, "") for name, _ in m.TEMPLATES]


def test_every_break_between_two_words(spark):
    name, notice = m.TEMPLATES[5]
    words = notice.split()
    broken = [" ".join(words[:i]) + "\n" + " ".join(words[i:]) for i in range(1, len(words))]
    assert _licenses(spark, broken) == [(name, 1, "")] * len(broken)


def test_headers_titles_lists_and_identifiers(spark):
    gpl = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
           "option) any later version.")
    texts = {
        "SPDX-License-Identifier: MIT": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later\n": "GPL-2.0",
        "/* SPDX-License-Identifier: CC-BY-SA-4.0 */": "CC-BY-SA-4.0", "SPDX-License-Identifier: GPL-9.0": "",
        gpl: "GPL-2.0", "\n".join("# " + x for x in textwrap.wrap(gpl.replace("version 2", "version 3"), 60)): "GPL-3.0",
        gpl.replace("General", "Lesser General").replace("program", "library").replace("version 2", "version 2.1"): "LGPL-2.1",
        gpl.replace("General", "Affero General").replace("version 2", "version 3"): "AGPL-3.0",
        "MIT License\n\nCopyright (c) 2020 A Name": "MIT", "Apache License\nVersion 2.0, January 2004": "Apache-2.0",
        "Dual licensed under the MIT License and the Apache License, Version 2.0.": "Apache-2.0,MIT",
        "Licensed under the Apache License, Version 2.0 or the MIT License, or the BSD 3-Clause License":
            "Apache-2.0,BSD-3-Clause,MIT"}
    assert [names for names, _, _ in _licenses(spark, texts)] == list(texts.values())


def test_ranking_decides_which_wording_is_compared_first(monkeypatch):
    scanner, compared = m.Scanner(), []
    alignments = scanner.alignments
    monkeypatch.setattr(scanner, "alignments", lambda i, words: compared.append(i) or alignments(i, words))
    for notice, name in NOTICES.items():
        compared.clear()
        scanner.scan(f"Some words before. {notice} And some after.")
        assert m.TEMPLATES[compared[0]][0] == name
    words = m.words_of("Licensed under the Apache License, Version 2.0.")
    ranked = scanner.ranked(words, [(0, 1), (4, 5)])
    assert ranked == sorted(ranked, key=lambda x: (-x[0], *x[1:]))
    compared.clear()
    scanner.confirmed(words, ranked)
    assert compared == [i for _, i, _, _ in ranked]


def test_the_ranking_loses_nothing(texts):
    """Every wording that touches a cue, by alignment of all templates with all words, is in the ranked blocks too."""
    rng, scanner, found = random.Random(9), m.Scanner(), 0
    prose = [w for t in list(texts.values())[:200] for w in t.split()]
    for _ in range(120):
        text = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(prose))
            text += prose[at:at + rng.choice([0, 3, 40, 300])]
            _, notice = rng.choice(m.TEMPLATES)
            for word in notice.split():
                if rng.random() > 0.03:
                    text.append(word)
                if rng.random() < 0.05:
                    text.append(rng.choice([rng.choice(prose), "license", "x" * 5_000]))
        _, words, cues = scanner.words_and_cues(" ".join(text).lower())
        got = scanner.confirmed(words, scanner.ranked(words, cues))
        touched = {j for a, b in cues for j in range(a, b)}
        for i in range(len(m.TEMPLATES)):
            for a in scanner.alignments(i, words):
                if touched & set(range(a.start, a.end)):
                    assert (i, a.start, a.end) in got, (m.TEMPLATES[i], words[a.start:a.end])
                    found += 1
    assert found > 150


def test_a_text_of_cues_only():
    scanner = m.Scanner()
    lines, notices = scanner.scan("license " * 20_000 + "Released under the MIT License. " + "copyright\n" * 20_000)
    assert lines == 20_000 and [n.license for n in notices] == ["MIT"]
