"""License scans by conditional compression.

Every statement of a template is aligned with the words around the marks, which
are words that license texts are made of: a stretch of the text fits if its
share of equal words in order is ``CONFIRMED`` or more. Of stretches that meet,
the one with most equal words beyond that share is kept. A stretch is compressed
with each template as zstandard raw dictionary and without one; what a template
saves, as a share, ranks the templates, and any that saves enough is confirmed.
Each stretch kept is reported with its span and with the words that it
adds and lacks. A stretch inside a longer sentence or line has to name the
license, if the statement does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.words import slices

# Short public license statements and the opening passages of public license texts.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
}

#: Least share of a stretch's bytes that a template has to save; least share of equal words.
SAVED, CONFIRMED = 0.2, 0.75

_MARK = re.compile(r"(?i)licen[sc]e|copyright|warrant|redistribut|permission is|sublicense|merchantab|\bspdx\b|without modification|source code form|creative commons")
_END = re.compile(r"[.!?:;\n]")
_WORD = re.compile(r"[\w+-]+(?:\.\w+)*")


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    whole = {k: "\n".join(v).encode() for k, v in TEMPLATES.items()}
    with_each = {k: zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in whole.items()}
    return zstandard.ZstdCompressor(level=9, write_content_size=False), with_each


@lru_cache(1024)
def rank(block: str) -> list[tuple[float, str]]:
    """(share of bytes saved, license), the best first; of equals by name."""
    plain, with_each = _compressors()
    data = block.encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / alone, k) for k, c in with_each.items()), key=lambda x: (-x[0], x[1]))


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _unequal(own: list[str], theirs: list[str]) -> tuple[list[str], list[str]]:
    """The words that only the one and only the other has, beside a longest common subsequence."""
    longest = [[0] * (len(theirs) + 1) for _ in range(len(own) + 1)]
    for i in range(len(own) - 1, -1, -1):
        row, below = longest[i], longest[i + 1]
        for k in range(len(theirs) - 1, -1, -1):
            row[k] = below[k + 1] + 1 if own[i] == theirs[k] else max(below[k], row[k + 1])
    added, lacking, i, k = [], [], 0, 0
    while i < len(own) and k < len(theirs):
        if own[i] == theirs[k]:
            i, k = i + 1, k + 1
        elif longest[i + 1][k] >= longest[i][k + 1]:
            added.append(own[i])
            i += 1
        else:
            lacking.append(theirs[k])
            k += 1
    return added + own[i:], lacking + theirs[k:]


@lru_cache(1024)
def differences(stretch: str, license: str) -> tuple[float, list[str], list[str]]:
    """Share of equal words with the nearest statement of the license, the words that the stretch adds, and those that it lacks."""
    own, best = words_of(stretch), (0.0, words_of(stretch), [])
    for statement in TEMPLATES[license]:
        theirs = words_of(statement)
        if 2 * min(len(own), len(theirs)) <= best[0] * (len(own) + len(theirs)):
            continue
        added, lacking = _unequal(own, theirs)
        share = 2 * (len(own) - len(added)) / max(1, len(own) + len(theirs))
        if share > best[0]:
            best = (share, added, lacking)
    return best


#: Scores of an alignment, in hundredths: an equal word, and each word of the stretch. A stretch fits if its score is ``_EACH`` for each word of the statement.
_EQUAL, _EACH, _BITS = 200, round(100 * CONFIRMED), 32


class _Statement:
    def __init__(self, license: str, text: str, numbers: dict[str, int]):
        own = words_of(text)
        self.license, self.words = license, np.array([numbers[w] for w in own])
        self.count = np.bincount(self.words, minlength=len(numbers) + 1)
        parts = set(re.split(r"[-.]", license.lower()))
        self.names = [numbers[w] for w in set(own) if set(re.split(r"[-.]", w)) <= parts]
        # From 2 same >= CONFIRMED (stretch + words), same <= stretch and same <= words: the fewest equal words and the longest stretch.
        self.least = -(-_EACH * len(own) // (_EQUAL - _EACH))
        self.longest = (_EQUAL - _EACH) * len(own) // _EACH
        self.gain = np.full((len(numbers) + 1, len(own)), -1 << 60, np.int64)
        self.gain[self.words, np.arange(len(own))] = (_EQUAL - _EACH) << _BITS

    def align(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(score, begin, end) of the stretches that fit, the best of each begin."""
        best = np.zeros(len(self.words) + 1, np.int64)
        last = np.empty(len(words), np.int64)
        for i, w in enumerate(words.tolist()):  # the lower bits hold where a stretch began
            np.maximum(best, i, out=best)
            new = best - (_EACH << _BITS)
            np.maximum(new[1:], best[:-1] + self.gain[w], out=new[1:])
            best = np.maximum.accumulate(new)
            last[i] = best[-1]
        found: dict[int, tuple[int, int]] = {}
        for end in np.flatnonzero(last >> _BITS >= _EACH * len(self.words)).tolist():
            score, begin = int(last[end]) >> _BITS, int(last[end]) & ((1 << _BITS) - 1)
            if score > found.get(begin, (0, 0))[0]:
                found[begin] = (score, end + 1)
        return [(score, begin, end) for begin, (score, end) in found.items()]


@cache
def _statements() -> tuple[dict[str, int], list[_Statement], np.ndarray]:
    """Numbers of the words of all statements, from 1; the statements; and which word each has."""
    numbers: dict[str, int] = {}
    for v in TEMPLATES.values():
        for text in v:
            for w in words_of(text):
                numbers.setdefault(w, len(numbers) + 1)
    out = [_Statement(k, text, numbers) for k, v in TEMPLATES.items() for text in v]
    return numbers, out, np.stack([x.count > 0 for x in out], axis=1)


def _places(x: _Statement, has: np.ndarray, marks: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of words around the marks with enough words of the statement; ``has`` and ``marks`` are counts up to each word."""
    m = len(words)
    wide = min(x.longest, m)
    enough = (has[wide:] - has[: m + 1 - wide] >= x.least) & (marks[wide:] > marks[: m + 1 - wide])
    at = np.flatnonzero(enough)
    for run in np.split(at, np.flatnonzero(np.diff(at) > wide) + 1) if len(at) else ():
        a, b = int(run[0]), int(run[-1]) + wide
        if np.minimum(np.bincount(words[a:b], minlength=len(x.count)), x.count).sum() >= x.least:
            yield a, b


def _stretches(text: str, spans: list[tuple[int, int]], words: np.ndarray, marks: np.ndarray) -> list[tuple]:
    """(begin, end, license, saved, share, added, lacking) of the confirmed stretches, none meeting another; begin and end count words."""
    _, statements, table = _statements()
    has = np.zeros((len(words) + 1, len(statements)), np.int32)
    np.cumsum(table[words], axis=0, out=has[1:])
    upto = np.concatenate([[0], np.cumsum(marks)])
    taken = np.zeros(len(words), bool)
    ends = lambda k: k in (0, len(spans)) or bool(_END.search(text, spans[k - 1][1], spans[k][0]))
    within = lambda a, b: text[spans[a][0] : spans[b - 1][1]]

    def widened(x: _Statement, a: int, b: int) -> tuple[int, int]:
        """With the words that stand for those that a statement has before or after, as in another version."""
        c, d = a, b
        for _ in range(int(np.flatnonzero(x.words == words[a])[0])):
            c -= not ends(c) and not taken[c - 1]
        for _ in range(int(np.flatnonzero(x.words[::-1] == words[b - 1])[0])):
            d += not ends(d) and not taken[d]
        return (c, d) if differences(within(c, d), x.license)[0] >= CONFIRMED else (a, b)

    fits = []
    for n, x in enumerate(statements):
        for at, to in _places(x, has[:, n], upto, words):
            for score, a, b in x.align(words[at:to]):
                a, b = a + at, b + at
                if upto[a] == upto[b] or x.names and not np.isin(words[a:b], x.names).any() and not all(map(ends, widened(x, a, b))):
                    continue
                saved = next((s for s, k in rank(within(a, b)) if k == x.license), 0.0)
                if saved >= SAVED:
                    fits.append((_EACH * len(x.words) - score, -saved, x.license, a, b, n))
    kept, left = [], []
    for fit in sorted(fits):
        a, b = fit[3:5]
        (left if taken[a:b].any() else kept).append(fit)
        taken[a:b] |= not taken[a:b].any()
    out = []
    for _, saved, license, a, b, n in kept:
        a, b = widened(statements[n], a, b)
        taken[a:b] = True
        out.append((a, b, license, -saved, *differences(within(a, b), license)))
    # What met a better one is looked at again without its words.
    edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if upto[b] > upto[a] and any(f[3] < b and a < f[4] for f in left):
            out += [(a + c, a + d, *more) for c, d, *more in _stretches(text, spans[a:b], words[a:b], marks[a:b])]
    return out


def find_licenses(text: str) -> list[dict]:
    """The confirmed licenses of a text, each with its own span, by place."""
    at = [m.start() for m in _MARK.finditer(text)]
    if not at:
        return []
    found = list(_WORD.finditer(text))
    numbers = _statements()[0]
    words = np.array([numbers.get(m[0].lower(), 0) for m in found], np.int64)
    marks = np.zeros(len(found), bool)
    marks[np.searchsorted([m.start() for m in found], at, "right") - 1] = True
    out = []
    for a, b, license, saved, share, added, lacking in sorted(_stretches(text, [m.span() for m in found], words, marks)):
        end = found[b - 1].end()
        end += text[end : end + 1] in (".", ":")
        out.append({"license": license, "start": found[a].start(), "end": end, "saved": round(saved, 4), "equal_words": round(share, 4), "added": list(added), "lacking": list(lacking)})
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = pa.struct({"license": pa.string(), "start": pa.int64(), "end": pa.int64(), "saved": pa.float64(), "equal_words": pa.float64(), "added": pa.list_(pa.string()), "lacking": pa.list_(pa.string())})
    for rows in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([find_licenses(t or "") for t in rows.column("text").to_pylist()], pa.list_(found))], names=["doc_id", "found"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, found`` for every row of ``docs`` (doc_id, text): an array of license, start, end (code points), saved, equal_words, added, lacking.

    Null, empty and unlicensed texts have an empty array, and all of a long text
    is looked at; of licenses that fit one stretch equally well the one that saves
    more is given, then the first by name. Rows repeat as they do, an empty table
    gives an empty one; other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, found array<struct<license: string, start: long, end: long, saved: double, equal_words: double, added: array<string>, lacking: array<string>>>")


def op8_compression_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.transform("found", lambda x: x["license"]), ",").alias("licenses"), F.to_json("found").alias("found"))


QUERIES: dict[str, Callable] = {"op8_compression_licenses": op8_compression_licenses}
