"""License scans: winnowed fingerprints find where a template may stand; banded alignment says how much of it does."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, ship, text_bytes
from .words import ALNUM, Block, shingle_numbers

SHINGLE = 5
WINDOW = 4
BAND = 24
COVERAGE = 0.8
SHORT = 8  # words of a template that is found by every shingle that damage may leave

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""
_LGPL = _GPL.replace("the GNU General", "the GNU Lesser General")
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""

#: (license, template): public license texts and the one-line notices in common use.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT-warranty", _WARRANTY),
    ("MIT-notice", "Released under the MIT License."),
    ("MIT-notice", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("BSD", _BSD),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", _LGPL),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0-notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0-notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def winnow(numbers: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least number of each window, the last one if several are; all of a sequence shorter than one window give one."""
    if not len(numbers):
        return np.zeros(0, dtype=np.int64)
    w = min(window, len(numbers))
    views = np.lib.stride_tricks.sliding_window_view(numbers, w)[:, ::-1]
    return np.unique(np.arange(len(views)) + w - 1 - views.argmin(axis=1))


class Index:
    """The inverted index by size of shingle: fingerprints, sorted, and for each the templates and places that have it.

    Short templates have all their shingles of as many words as stay together wherever
    words are replaced or missing, while ``coverage`` is left.
    """

    def __init__(self, templates, coverage: float = COVERAGE):
        self.names = [n for n, _ in templates]
        block = Block([t.encode() for _, t in templates], ALNUM)
        self.words = [block.word[a:b] for a, b in zip(block.first[:-1], block.first[1:], strict=True)]
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, words in enumerate(self.words):
            k = SHINGLE
            if self.short(t):
                kept = next((n for n in range(1, len(words)) if n / len(words) >= coverage), len(words))
                k = min(SHINGLE, -(-kept // (len(words) - kept + 1)))
            numbers = shingle_numbers(words, k)
            for p in range(len(numbers)) if self.short(t) else winnow(numbers).tolist():
                found[k][int(numbers[p])].append((t, p))
        self.by_k = {k: (np.array(sorted(x), dtype=np.uint64), [x[m] for m in sorted(x)]) for k, x in found.items()}

    def short(self, t: int) -> bool:
        return len(self.words[t]) <= SHORT


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int = BAND) -> np.ndarray:
    """Places in words of the words of the longest common subsequence with template, with place in words minus
    place in template within ``band`` of shift, in order."""
    m, wide = len(template), 2 * band + 1
    best = np.zeros((m + 1, wide + 2), dtype=np.int32)  # column c: place i + shift + c - band - 1
    for i in range(1, m + 1):
        at = i - 1 + shift + np.arange(-band, band + 1)
        ok = (at >= 0) & (at < len(words))
        same = np.zeros(wide, dtype=bool)
        same[ok] = words[at[ok]] == template[i - 1]
        row = np.maximum(best[i - 1, 2:], best[i - 1, 1:-1] + same)  # skip a template word, or match
        best[i, 1:-1] = np.maximum.accumulate(row)  # skip words of the text
    i, c, out = m, int(best[m, 1:-1].argmax()) + 1, []
    while i and best[i, c]:
        if c > 1 and best[i, c - 1] == best[i, c]:
            c -= 1
            continue
        at = i - 1 + shift + c - 1 - band
        if best[i, c] == best[i - 1, c] + 1 and 0 <= at < len(words) and words[at] == template[i - 1]:
            out.append(at)
            i -= 1
        else:
            i, c = i - 1, c + 1
            if c > wide:
                break
    return np.array(out[::-1], dtype=np.int64)


def _matches(words: np.ndarray, hits: list[tuple[int, int]], template: np.ndarray, coverage: float) -> list[np.ndarray]:
    """Aligned places for each place where enough of the template stands; hits: (place in words, place in template)."""
    found, tried, known = [], set(), bytearray(len(words))
    for at, place in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        shift = at - place
        if shift in tried or known[at]:
            continue  # within one that is found
        tried.add(shift)
        window = words[max(0, shift) : shift + len(template)]
        if shift >= 0 and len(window) == len(template) and (window == template).all():
            places = np.arange(shift, shift + len(template))
        else:
            low = max(0, shift - BAND)
            near = words[low : shift + len(template) + BAND]
            have = set(near.tolist())
            if sum(w in have for w in template.tolist()) < coverage * len(template):
                continue
            places = align(template, near, shift - low) + low
        if len(places) / len(template) >= coverage:
            found.append(places)
            first, last = int(places[0]), int(places[-1])
            known[first : last + 1] = b"\1" * (last + 1 - first)
    return found


class _Stood:
    """The matches in one text, by where they begin."""

    def __init__(self, found: list[tuple[int, np.ndarray]]):
        self.found = sorted(found, key=lambda f: int(f[1][0]))
        self.first = [int(x[0]) for _, x in self.found]
        self.wide = max((int(x[-1] - x[0]) for _, x in found), default=0)

    def other(self, index: Index, t: int, places: np.ndarray) -> bool:
        """Whether a match without an unbroken run of SHINGLE words is another template, of which more words stand there."""
        if (places[SHINGLE - 1 :] - places[: 1 - SHINGLE] == SHINGLE - 1).any() or len(places) == len(index.words[t]) == places[-1] - places[0] + 1:
            return False
        near = self.found[bisect_left(self.first, int(places[0]) - self.wide) : bisect_right(self.first, int(places[-1]))]
        return any(u != t and len(x) > len(places) and x[0] <= places[-1] and places[0] <= x[-1] for u, x in near)


def _scanning(shared, column: str, keys: list[str], coverage: float):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in items:
            texts, rows, out = text_bytes(batch.column(column)), [], []
            for a, b in blocks(texts):
                block = Block(texts[a:b], ALNUM)
                by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for k, (marks, users) in index.by_k.items():
                    numbers, whole = block.shingles(k)
                    at = np.searchsorted(marks, numbers) % len(marks)
                    where = np.flatnonzero(whole & (marks[at] == numbers)) if len(numbers) else []
                    for i in np.asarray(where).tolist():
                        text = int(np.searchsorted(block.first, i, "right")) - 1
                        for t, p in users[at[i]]:
                            by[text, t].append((i - int(block.first[text]), p))
                matches: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
                for (text, t), hits in sorted(by.items()):
                    words = block.word[int(block.first[text]) : int(block.first[text + 1])]
                    matches[text] += [(t, places) for places in _matches(words, hits, index.words[t], coverage)]
                for text, mine in matches.items():
                    first, base = int(block.first[text]), int(block.offset[text])
                    raw = np.frombuffer(texts[a + text], dtype=np.uint8)
                    chars, stood = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)], _Stood(mine)  # code points before each byte
                    for t, places in mine:
                        if index.short(t) and stood.other(index, t, places):
                            continue
                        rows.append(a + text)
                        out.append((index.names[t], t, len(places) / len(index.words[t]), int(chars[block.start[first + places[0]] - base]), int(chars[block.end[first + places[-1]] - base])))
            if rows:
                kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                taken = pa.Table.from_batches([batch.select(keys)]).take(pa.array(rows)).combine_chunks()
                columns = [taken.column(k).combine_chunks() for k in keys]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=[*keys, "license", "template", "coverage", "start", "end"])

    return run


def scan_licenses(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """A row for each place where a template stands: doc_id, license, template (its number), coverage, start, end.

    coverage is the share of the template's words that are aligned, at least
    ``coverage``; start and end (exclusive) count code points from the first to
    past the last of them.  Words are runs of digits, letters and characters beyond ASCII,
    A-Z lower-cased.  Every five words of a text are looked up, so an undamaged
    run of eight words of a template is always found.  Of templates of up to ``SHORT`` words,
    shorter runs are looked up, so that they are found wherever words are replaced or missing; words
    put in between may break all of these runs.  One without five unbroken words gives no row where more words
    of another template stand.

    Null and empty texts and an empty table give no row; repeated rows give theirs each, and rows without an id too.  A text may
    match several templates in one place.  Very long texts are scanned whole, in time that
    grows with their length and matches.  Other columns than id and text are left out, whatever their names.
    """
    ship(spark)
    field = lambda n, t: T.StructField(n, t)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], field("license", T.StringType()), field("template", T.IntegerType()), field("coverage", T.DoubleType()), field("start", T.LongType()), field("end", T.LongType())])
    return docs.mapInArrow(_scanning(spark.sparkContext.broadcast(Index(list(templates), coverage)), "text", ["doc_id"], coverage), schema)
