import re

import pytest

from tidemark.llm.licenses import TEMPLATES, THRESHOLD, scan


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return set(w) if len(w) == 1 else {" ".join(p) for p in zip(w, w[1:])}


def plain(text):
    """All segments against all templates."""
    paragraphs = [[]]
    for line in (text or "").split("\n"):
        if grams(line):
            paragraphs[-1].append(line)
        else:
            paragraphs.append([])
    paragraphs = [p for p in paragraphs if p]
    parts = [line for p in paragraphs for line in p] + [" ".join(p) for p in paragraphs if len(p) > 1]
    parts += [text] if len(paragraphs) > 1 else []
    found = []
    for part in parts:
        a = grams(part)
        dices = [(name, round(2 * len(a & b) / (len(a) + len(b)), 6)) for name, b in ((n, grams(w)) for n, w in TEMPLATES)]
        best = max(d for _, d in dices)
        found += [(name, dice) for name, dice in dices if dice >= THRESHOLD and dice == best]
    return sorted(found)


MIT = next(w for n, w in TEMPLATES if n == "MIT" and len(w) > 200)
TEXTS = [
    "Some text.\nReleased under the MIT License.\nMore text.", "released under the mit license", "Released under the very MIT License today.",
    MIT, MIT.replace("Software", "Work", 2), "Header\n\n" + MIT.replace(". ", ".\n") + "\n\nFooter of a file", "All rights reserved.", "rights", "",
    None, "words " * 30000, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "\n\n\n",
]


def found(table, **options):
    return [(r["doc_id"], sorted((m["license"], m["dice"]) for m in r["matches"])) for r in scan(table, **options).collect()]


def test_against_all_templates(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(3, MIT, "x", [1]), (None, MIT, "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, license string, matches array<int>")
    assert sorted(found(table), key=str) == sorted(((i, plain(t)) for i, t, _, _ in rows), key=str)


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_bounds_lose_nothing(spark, threshold, monkeypatch):
    monkeypatch.setattr("test_licenses.THRESHOLD", threshold)
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    assert dict(found(table, threshold=threshold)) == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_places(spark):
    text = "one two three four\nReleased under the MIT License.\n\n" + MIT
    row = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(m["license"], m["segment"], m["first_word"], m["words"]) for m in row["matches"]] == [
        ("MIT", "line", 4, 5), ("MIT", "line", 9, len(re.findall(r"[a-z]+", MIT.lower()))), ("MIT", "text", 0, 9 + len(re.findall(r"[a-z]+", MIT.lower())))
    ]


def test_empty_table(nothing):
    assert scan(nothing).collect() == []


ISC = (
    'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above '
    'copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
    "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
CODE = "\n\n".join(f"def function_{i}(value_{i}):\n    return value_{i} + {i}" for i in range(40))
PARAGRAPHS = MIT.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")


@pytest.mark.parametrize(
    "text, want",
    [
        (f"Copyright 2020 A. Author\n\n{PARAGRAPHS}\n\n{CODE}", [("MIT", 1.0)]),
        (f"{CODE}\n\n{ISC}\n\n{CODE}", [("ISC", 1.0)]),
        ("It has been there for long. It is released under the MIT License. It goes on and on.", [("MIT", 1.0)]),
        ("It was released under the MIT License and then under CC BY 4.0 by them, and all rights reserved.", [("CC-BY-4.0", 0.888889), ("MIT", 1.0), ("all-rights-reserved", 1.0)]),
        (f"a line before {'x ' * 500} all rights reserved {'y ' * 500} all rights reserved", [("all-rights-reserved", 1.0)] * 2),
        ("the end: all rights", []),
    ],
)
def test_windows(spark, text, want):
    table = spark.createDataFrame([(1, text), (2, "reserved. Some text")], "doc_id long, text string")
    assert dict(found(table)) == {1: want, 2: []}
    row = scan(table).filter("doc_id = 1").first()
    spelled = re.findall(r"[a-z0-9]+", text.lower())
    wordings = [" ".join(re.findall(r"[a-z0-9]+", w.lower())) for _, w in TEMPLATES]
    assert all(m["segment"] == "window" for m in row["matches"])
    assert all(" ".join(spelled[m["first_word"] : m["first_word"] + m["words"]]) in wordings for m in row["matches"] if m["dice"] == 1)


NOTICES = {
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
    "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT": "# SPDX-License-Identifier: MIT",
    "GPL-3.0": "SPDX-License-Identifier: GPL-3.0-or-later",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
    "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
}


@pytest.mark.parametrize("frame", ["{}", "some words before it {} and some words after it", "A header\n\n{}\n\ndef function():\n    return 1"])
def test_related_licenses_are_told_apart(spark, frame):
    """As a line, inside a line, and cut over several lines."""
    rows = [(i, frame.format(t)) for i, t in enumerate(NOTICES.values())]
    rows += [(100 + i, frame.format(t.replace(", ", ",\n"))) for i, t in enumerate(NOTICES.values())]
    got = {i: {n for n, _ in m} for i, m in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    for i, name in enumerate(NOTICES):
        assert got[i] == {name} and got[100 + i] == {name}, name
