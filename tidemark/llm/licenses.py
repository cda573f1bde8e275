"""Licence scans: segments of text against licence templates by the Dice coefficient of their word bigrams.

Texts are normalised to lower-case words. Segments are the lines of a text, its paragraphs and the text as a
whole, so that a notice of one line and a licence of many paragraphs are both found. Where no segment matches a licence,
windows of words are compared that begin and end with a bigram of the template: a notice inside a longer line, and
a licence of some of a text's paragraphs. The Dice coefficient of two sets of a
and b bigrams is at most 2 min(a, b) / (a + b): templates outside those size bounds are not compared.

Two cheap tests come first, and neither can lose a match: a segment needs some bigrams that occur in a template at
all, and one with too many different bigrams for the largest template is left at the first that are too many. Documents are not shuffled.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import with_arrays

THRESHOLD = 0.8
MADE = "matches array<struct<license: string, dice: double, segment: string, first_word: bigint, words: bigint>>"
# A-Z become lower-case, digits, line ends and bytes above 127 stay, and all other ASCII bytes part words.
_SPELLING = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 or b == 10 else 32 for b in range(256)
)
_LINE, _TEXT = b"\x01", b"\x02"
_MIX = np.uint64(0x9E3779B97F4A7C15)

# Identifiers with the wording of their notices and licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means.",
    ),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
# The line that names a licence by its identifier, for every licence that has one.
TEMPLATES += tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in TEMPLATES) if name != "all-rights-reserved")


def _tokens(text: str | None) -> list[bytes]:
    """Words, with a mark after every line."""
    return text.encode("utf-8", "surrogatepass").translate(_SPELLING).replace(b"\n", b" \x01 ").split() if text else []


def bigrams(words: Sequence[bytes]) -> frozenset:
    """The different pairs of neighbouring words; a segment of one word has that word, one of none has nothing."""
    return frozenset(words) if len(words) == 1 else frozenset(zip(words, words[1:]))


class Scanner:
    """Compares slices of texts with the templates."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, bigrams(_tokens(wording))) for name, wording in templates]
        sizes = [len(grams) for _, grams in self.templates]
        # From 2 |A and B| >= t (a + b) follow bounds on a segment's bigrams a and on those it shares with a template.
        self.most = math.floor(max(sizes, default=0) * (2 - threshold) / threshold + 1e-9)
        self.least = max(1, math.ceil(min(sizes, default=1) * threshold / (2 - threshold) - 1e-9))
        codes = [[self._code(g) for g in grams] for _, grams in self.templates]
        self.codes = np.unique(np.array([c for of in codes for c in of], dtype=np.uint64))
        self.codes_of = [np.array(of, dtype=np.uint64) for of in codes]

    @staticmethod
    def _code(gram: tuple[bytes, bytes] | bytes) -> int:
        """A number for a bigram (or for a single word): equal ones have equal numbers."""
        if isinstance(gram, bytes):
            return hash(gram) % 2**64
        return (hash(gram[0]) * int(_MIX) + hash(gram[1])) % 2**64

    def _candidates(self, pair_known: np.ndarray, word_known: np.ndarray, pair: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[int]:
        """Segments (ranges of words) that pass the cheap tests."""
        before = np.r_[0, np.cumsum(pair_known)]
        known = before[np.maximum(ends - 1, begins)] - before[begins]
        size = ends - begins
        single = (size == 1) & word_known[np.minimum(begins, len(word_known) - 1)]
        for s in np.flatnonzero((known >= self.least) | single).tolist():
            first, last = int(begins[s]), int(ends[s]) - 1
            if last - first <= self.most or len(np.unique(pair[first : min(last, first + 4 * self.most)])) <= self.most:
                yield s

    def _windows(self, words: list[bytes], places: np.ndarray, text_of: np.ndarray, template: frozenset) -> Iterator[tuple[float, int, int]]:
        """(dice, first word, words) of the best window from each place, if it matches; `places` are sorted and hold all bigrams of the template."""
        least = max(1, math.ceil(len(template) * self.threshold / (2 - self.threshold) - 1e-9))
        most = math.floor(len(template) * (2 - self.threshold) / self.threshold + 1e-9)
        last = places[least - 1 :]
        first = places[: len(last)]
        for i in np.flatnonzero((last - first < most) & (text_of[first] == text_of[last])).tolist():
            begin, best = int(first[i]), (0.0, 0, 0)
            seen, shared = set(), 0
            for at in range(begin, min(begin + most, len(words) - 1)):
                if text_of[at + 1] != text_of[begin]:
                    break
                gram = (words[at], words[at + 1])
                new = gram not in seen
                seen.add(gram)
                if gram in template:
                    shared += new
                    dice = round(2 * shared / (len(seen) + len(template)), 6)
                    if dice >= best[0]:
                        best = (dice, begin, at + 2 - begin)
            if best[0] >= self.threshold:
                yield best

    @staticmethod
    def _apart(windows: list[tuple[float, int, int, str]]) -> Iterator[tuple[float, int, int, str]]:
        """The best windows first, with their licences: one that overlaps a better one is left."""
        begins: list[int] = []
        ends: list[int] = []
        for dice, begin, count, name in sorted(set(windows), key=lambda w: (-w[0], w[1], -w[2], w[3])):
            k = bisect.bisect_left(begins, begin)
            if (k == 0 or ends[k - 1] <= begin) and (k == len(begins) or begins[k] >= begin + count):
                begins.insert(k, begin)
                ends.insert(k, begin + count)
                yield dice, begin, count, name

    def __call__(self, texts: list[str | None]) -> list[list[tuple[str, float, str, int, int]]]:
        found: list[list[tuple[str, float, str, int, int]]] = [[] for _ in texts]
        flat: list[bytes] = []
        for text in texts:
            flat += _tokens(text)
            flat.append(_TEXT)
        numbers = np.fromiter(map(hash, flat), dtype=np.int64, count=len(flat)).view(np.uint64)
        ends_text = numbers == np.uint64(hash(_TEXT) % 2**64)
        ends_line = ends_text | (numbers == np.uint64(hash(_LINE) % 2**64))
        is_word = ~ends_line
        words = [w for w, keep in zip(flat, is_word.tolist()) if keep]
        if not words:
            return found
        # Segments as ranges of word numbers; `text_of` the text of each line.
        line_ends = np.cumsum(is_word)[ends_line]
        line_begins = np.r_[0, line_ends[:-1]]
        text_of = (np.cumsum(ends_text) - ends_text)[ends_line]
        last_line = ends_text[ends_line]
        levels = {"line": (line_begins, line_ends, text_of)}
        # A paragraph ends at a line without words and at the end of its text.
        stop = (line_begins == line_ends) | last_line
        stops = np.flatnonzero(stop)
        levels["paragraph"] = (np.r_[0, line_ends[stops[:-1]]], line_ends[stops], text_of[stops])
        lasts = np.flatnonzero(last_line)
        levels["text"] = (np.r_[0, line_ends[lasts[:-1]]], line_ends[lasts], text_of[lasts])
        # A paragraph of one line and a text of one paragraph are not segments of their own.
        filled = np.r_[0, np.cumsum(line_begins < line_ends)]
        lines_in = {"paragraph": filled[stops + 1] - filled[np.r_[0, stops[:-1] + 1]]}
        begins, ends, _ = levels["paragraph"]
        full = np.r_[0, np.cumsum(begins < ends)]
        of_text = np.searchsorted(stops, lasts)
        lines_in["text"] = full[of_text + 1] - full[np.r_[0, of_text[:-1] + 1]]

        values = numbers[is_word]
        pair = values[:-1] * _MIX + values[1:]
        pair_known, word_known = np.isin(pair, self.codes), np.isin(values, self.codes)
        whole: dict[int, list[tuple[frozenset, float, int, int]]] = {}
        for level, (begins, ends, owner) in levels.items():
            use = ends > begins if level == "line" else lines_in[level] > 1
            begins, ends, owner = begins[use], ends[use], owner[use]
            for s in self._candidates(pair_known, word_known, pair, begins, ends):
                grams = bigrams(words[begins[s] : ends[s]])
                matching = []
                for name, template in self.templates:
                    least, most = sorted((len(grams), len(template)))
                    if 2 * least >= self.threshold * (least + most) - 1e-9:
                        dice = round(2 * len(grams & template) / (least + most), 6)
                        if dice >= self.threshold:
                            matching.append((dice, name, template))
                # Of related licences the nearest one is meant; equal ones are all reported.
                best = max((dice for dice, _, _ in matching), default=None)
                for dice, name, template in matching:
                    if dice == best:
                        found[owner[s]].append((name, dice, level, int(begins[s]), int(ends[s] - begins[s])))
                        whole.setdefault(int(owner[s]), []).append((template, dice, int(begins[s]), int(ends[s] - begins[s])))
        first_words = np.r_[0, line_ends[lasts]]
        owner_of = np.repeat(np.arange(len(texts)), np.diff(first_words))
        covered: dict[str, np.ndarray] = {}
        for rows in found:
            for name, _, _, begin, count in rows:
                covered.setdefault(name, np.zeros(len(words), dtype=bool))[begin : begin + count] = True
        windows: list[tuple[float, int, int, str]] = []
        places = np.flatnonzero(pair_known)
        for (name, template), codes in zip(self.templates, self.codes_of):
            own = places[np.isin(pair[places], codes)]
            own = own[owner_of[own] == owner_of[own + 1]]
            if name in covered:
                own = own[~covered[name][own] & ~covered[name][own + 1]]
            # A window around a matched segment is that segment's match.
            for w in self._windows(words, own, owner_of, template):
                if name not in covered or not covered[name][w[1] : w[1] + w[2]].any():
                    windows.append((*w, name))
        for dice, begin, count, name in self._apart(windows):
            # A window of most of a matched segment has been compared with it, and words that a better segment around
            # them has from its own template are no notice of another licence.
            grams = bigrams(words[begin : begin + count])
            around = [(t, d, c) for t, d, b, c in whole.get(int(owner_of[begin]), ()) if b <= begin and begin + count <= b + c]
            if any(2 * count > c or (d >= dice and grams <= template) for template, d, c in around):
                continue
            found[owner_of[begin]].append((name, dice, "window", begin, count))
        return [[(n, d, level, at - int(first_words[i]), count) for n, d, level, at, count in rows] for i, rows in enumerate(found)]


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    text_column: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """`docs` with `matches`: for each matching segment the licence of the nearest template (of equally near ones, each), the
    coefficient and the words it covers.

    Segments are lines, paragraphs of several lines (parted by lines without words) and texts of several paragraphs, and
    windows of words in what no other segment matches of a licence, of any licences the best of those that overlap, at most of the most bigrams
    that a match can have; templates of one word have no windows. A
    null or empty text has no match. Repeated lines and rows count each time; a column named `matches` is replaced.
    """
    templates = list(templates)

    def start() -> Callable:
        scanner = Scanner(templates, threshold)
        fields = ("license", "dice", "segment", "first_word", "words")
        kind = pa.list_(pa.struct([pa.field(f, t) for f, t in zip(fields, (pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64()))]))
        return lambda texts: [pa.array([[dict(zip(fields, m)) for m in rows] for rows in scanner(texts)], kind)]

    return with_arrays(docs, text_column, start, MADE, keep)
