"""Licence scans: word-bigram Dice coefficients against licence templates.

A text is cut into lines and sentences; every run of consecutive ones is
compared with the templates whose size allows the wanted coefficient. With
``n`` and ``m`` bigrams a coefficient of ``t`` needs
``n * t / (2 - t) <= m <= n * (2 - t) / t``, which bounds the runs as well, so
a text of any length costs its length times the longest template's.

A passage that reaches ``t`` has to hold one of a template's few *anchor*
words, those without which too many of its bigrams are gone; rare words are
taken first. Texts without any anchor as a whole word are done after one pass of
a multi-pattern search. The scan is one pass
over the table without a shuffle; the templates are fixed values of this module
or the caller's.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Public licence notices and texts, by SPDX identifier.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

# Words of the templates that many English texts hold.
_COMMON = frozenset(
    "a above all an and any are as at be by can conditions copies copy either following for free from granted in included is it list may must new not "
    "obtain of on one or other permitted person persons program provided public released rights shall software subject terms that the this to under "
    "use version was whom with without work you".split()
)

_WORD = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"[^\n]*?(?:[.!?](?=\s)|(?=\n)|\Z)")


def words(text: str) -> list[str]:
    """Normalised words: lower case, letters and digits only."""
    return _WORD.findall(text.lower())


def _bigrams(found: list[str]) -> list[tuple[str, str]]:
    return list(zip(found, found[1:]))


def units(text: str) -> Iterator[tuple[int, int]]:
    """``(start, end)`` of the lines and sentences of a text that aren't blank."""
    for m in _UNIT.finditer(text):
        if m[0].strip():
            yield m.start(), m.end()


def anchors(template: list[str], least: float) -> set[str]:
    """Words of which any passage with a coefficient of ``least`` holds one: rare ones, long ones first."""
    pairs = _bigrams(template)
    # a passage with fewer of the template's bigrams stays below, whatever its size
    enough = len(pairs) * (2 - 2 * least) / (2 - least) + 1e-9
    chosen: set[str] = set()
    for word in sorted(set(template), key=lambda w: (w in _COMMON or w.isdigit(), -len(w), w)):
        if sum(not chosen.isdisjoint(p) for p in pairs) > enough:
            break
        chosen.add(word)
    return chosen


def settle(candidates: list[tuple[str, tuple[float, int, int]]]) -> dict[str, tuple[float, int, int]]:
    """The best passage of each licence, of passages that don't overlap a better one.

    Better is the greater coefficient, then the earlier and the shorter
    passage, then the licence's name: similar licences don't share a passage.
    """
    taken: list[tuple[int, int]] = []
    best: dict[str, tuple[float, int, int]] = {}
    for name, (dice, start, end) in sorted(candidates, key=lambda c: (-c[1][0], c[1][1], c[1][2], c[0])):
        if all(end <= a or b <= start for a, b in taken):
            taken.append((start, end))
            best.setdefault(name, (dice, start, end))
    return best


class Scanner:
    """The templates, ready to be looked for."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float):
        self._least = least
        self._names, self._sizes, self._at, self._rare = [], [], {}, set()
        self._anchors = ahocorasick.Automaton()
        for name, texts in templates.items():
            for text in texts:
                found = words(text)
                if len(found) < 2:
                    raise ValueError(f"a template of {name} has fewer than two words")
                for pair, n in Counter(_bigrams(found)).items():
                    self._at.setdefault(pair, []).append((len(self._names), n))
                self._names.append(name)
                self._sizes.append(len(found) - 1)
                for word in anchors(found, least):
                    self._anchors.add_word(word, len(word))
                    self._rare.add(word)
        self._anchors.make_automaton()
        # one wider than the exact bounds, which floats may miss; the coefficient itself decides
        self._bounds = [(n * least / (2 - least) - 1, n * (2 - least) / least + 1) for n in self._sizes]
        self._most = max(high for _, high in self._bounds)

    def scan(self, text: str) -> dict[str, tuple[float, int, int]]:
        """Licence: ``(coefficient, start, end)`` of the passage most like one of its templates; see :func:`settle`."""
        if not self._holds_anchor(text.lower()):
            return {}
        spans = list(units(text))
        content = [words(text[a:b]) for a, b in spans]
        before = [0, *accumulate(map(len, content))]
        marked = [i for i, c in enumerate(content) if not self._rare.isdisjoint(c)]
        candidates = []
        for first in range(len(spans)):
            nearest = bisect_left(marked, first)
            if nearest == len(marked):
                break
            if content[first] and before[marked[nearest]] - before[first] <= self._most:
                candidates += self._from(spans, content, first)
        return settle(candidates)

    def _holds_anchor(self, low: str) -> bool:
        """Whether an anchor stands in the text as a whole word."""
        for last, size in self._anchors.iter(low):
            before, behind = low[last - size : last - size + 1] if last >= size else "", low[last + 1 : last + 2]
            if not (_WORD.match(before) or _WORD.match(behind)):
                return True
        return False

    def _from(self, spans, content, first: int) -> Iterator[tuple[str, tuple[float, int, int]]]:
        """Passages that start with unit ``first``."""
        seen: Counter = Counter()
        shared = [0] * len(self._names)
        size, last = 0, None
        for unit in range(first, len(spans)):
            for word in content[unit]:
                if last is not None:
                    pair = (last, word)
                    size += 1
                    seen[pair] += 1
                    for i, n in self._at.get(pair, ()):
                        shared[i] += seen[pair] <= n
                last = word
            if size > self._most:
                return
            if not content[unit]:
                continue
            for i, (low, high) in enumerate(self._bounds):
                if low <= size <= high:
                    dice = 2 * shared[i] / (size + self._sizes[i])
                    if dice >= self._least:
                        yield self._names[i], (dice, spans[first][0], spans[unit][1])


def scan(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    least: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, license, dice, start, end, passage)``: the licences found in each document.

    One row per document and licence, with the passage most like one of the
    licence's templates and its code points in the text; a passage belongs to
    the licence it is most like (:func:`settle`). NULL and empty texts, and those without a licence, give
    no row; repeated rows and NULL ids are scanned like any other. Whole texts
    count. An empty table gives no rows.
    """
    Scanner(templates, least)  # a template that can't be used is told at once

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            rows = [
                (doc_id.as_py(), name, dice, start, end, text[start:end])
                for doc_id, value in zip(batch.column(0), batch.column(1))
                for text in [value.as_py() or ""]
                for name, (dice, start, end) in sorted(scanner.scan(text).items())
            ]
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "license", "dice", "start", "end", "passage"])

    chosen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(compute, "doc_id bigint, license string, dice double, start bigint, end bigint, passage string")
