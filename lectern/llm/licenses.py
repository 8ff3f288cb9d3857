"""License scans: winnowed fingerprints, then banded alignment.

Templates become sequences of words (case folded, outer punctuation
stripped).  Of the hashes of their word triples, winnowing keeps the least of
every WINDOW, and all of templates of fewer words than SHORT; those go into an inverted index, sorted by hash.  A document
position whose triple is in the index votes for a template and a start; starts
near one with more votes that matched are the same candidate.  Around each
candidate a banded alignment of the template with the text counts matched
words.  The best candidates that do not overlap and cover COVERAGE of their
template are reported.

The winnowed triples of a template are sought among all triples of a text, so
an unaltered template is always a candidate.

Cases: null and empty texts match nothing; a template of fewer than three
words is indexed as a whole only if it has three; repeated rows are scanned
one by one; of equal matches at one place the first template by name wins; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import textnum as tn
from lectern.llm.common import frugal

GRAM, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.8
#: Templates of fewer words are indexed by all their triples.
SHORT = 20

#: Fixed texts: public license notices, by name.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of every window, the rightmost of equals."""
    if len(hashes) <= window:
        return np.flatnonzero(hashes == hashes.min())[-1:] if len(hashes) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def _triples(h: np.ndarray) -> np.ndarray:
    if len(h) < GRAM:
        return np.zeros(0, np.uint64)
    n = len(h) - GRAM + 1
    return tn.mix(sum(h[j : j + n] * np.uint64(2 * j + 3) for j in range(GRAM)))


class Index:
    """Inverted index of winnowed template fingerprints."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = sorted(templates)
        self.words = [tn.words_of(pa.array([templates[k]])).bare() for k in self.names]
        rows = [(h[p], t, p) for t, w in enumerate(self.words) for h in [_triples(w)] for p in (range(len(h)) if len(w) < SHORT else winnow(h).tolist())]
        keys = np.array([r[0] for r in rows], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.template, self.place = (np.array([r[i] for r in rows], np.int64)[order] for i in (1, 2))

    def votes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, implied start) for every index entry at every position."""
        lo, hi = np.searchsorted(self.keys, h, side="left"), np.searchsorted(self.keys, h, side="right")
        at = np.flatnonzero(hi > lo)
        n = (hi - lo)[at]
        entry = np.repeat(lo[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.template[entry], np.repeat(at, n) - self.place[entry]


def align(template: np.ndarray, text: np.ndarray, start: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, one past the last) of the best alignment of the
    whole template whose diagonal stays within ``band`` of ``start``.

    Match +2, mismatch and gap -1; the text's ends are free.
    """
    m, exact = len(template), text[start : start + len(template)] if start >= 0 else text[:0]
    if len(exact) == m and (exact == template).all():
        return m, start, start + m
    low = -(1 << 30)
    width = 2 * band + 1
    # Cell d of row i stands for text position start - band + d + i.
    score, count, begin = [0] * width, [0] * width, [start - band + d for d in range(width)]
    for i in range(m):
        new_s, new_c, new_b = [low] * width, [0] * width, [0] * width
        for d in range(width):
            at = start - band + d + i
            same = 0 <= at < len(text) and text[at] == template[i]
            best = (score[d] + (2 if same else -1), count[d] + same, begin[d] if count[d] or not same else at)
            if d + 1 < width and (score[d + 1] - 1, count[d + 1]) > best[:2]:  # a template word without partner
                best = (score[d + 1] - 1, count[d + 1], begin[d + 1])
            if d and (new_s[d - 1] - 1, new_c[d - 1]) > best[:2]:  # a text word without partner
                best = (new_s[d - 1] - 1, new_c[d - 1], new_b[d - 1])
            new_s[d], new_c[d], new_b[d] = best
        score, count, begin = new_s, new_c, new_b
    d = max(range(width), key=lambda x: (score[x], count[x], -x))
    first = max(0, begin[d])
    last = min(len(text), start - band + d + m)
    while last > first and text[last - 1] not in template:
        last -= 1
    return count[d], first, last


def scan_words(h: np.ndarray, index: Index, triples: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """(template, matched, first word, one past the last word) of a text."""
    template, start = index.votes(_triples(h) if triples is None else triples)
    found = []
    for t in np.unique(template):
        values, n = np.unique(start[template == t], return_counts=True)
        near, tried = min(BAND, len(index.words[t])), []
        for v in values[np.lexsort((values, -n))].tolist():
            at = bisect.bisect(tried, v)
            if (at and v - tried[at - 1] < near) or (at < len(tried) and tried[at] - v < near):
                continue  # the same place as one with more votes
            matched, a, b = align(index.words[t], h, v)
            if matched >= COVERAGE * len(index.words[t]):
                found.append((int(t), int(matched), int(a), int(b)))
                tried.insert(at, v)
    kept: list[tuple[int, int, int, int]] = []  # in the order of their places, which do not overlap
    for f in sorted(found, key=lambda f: (-f[1], f[2], index.names[f[0]])):
        at = bisect.bisect(kept, f[2], key=lambda k: k[2])
        if (at == 0 or kept[at - 1][3] <= f[2]) and (at == len(kept) or f[3] <= kept[at][2]):
            kept.insert(at, f)
    return kept


_DDL = "doc_id long, license string, coverage double, matched_words long, start long, end long"


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """One row per license text found: doc_id, license, coverage (share of the
    template's words), matched_words, start and end (characters of the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(TEMPLATES if templates is None else templates))

    def run(batches):
        index = Index(shared.value)
        for piece in tn.pieces(batches):
            words = tn.words_of(piece.column("text"))
            h = words.bare()
            triples = _triples(h)
            hit = np.zeros(len(h) + 1, np.int64)
            np.cumsum(np.isin(triples, index.keys), out=hit[1 : len(triples) + 1])
            hit[len(triples) + 1 :] = hit[len(triples)]
            rows, chars = [], np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            for d in np.flatnonzero(hit[words.first[1:]] > hit[words.first[:-1]]).tolist():
                a, b = words.first[d], words.first[d + 1]
                begin = chars[words.offsets[d]]
                for t, matched, x, y in scan_words(h[a:b], index):
                    lo, hi = words.bare_start[a + x], words.bare_end[a + y - 1]
                    rows.append((piece.column("doc_id")[d].as_py(), index.names[t], matched / len(index.words[t]), matched, int(chars[lo] - begin), int(chars[hi] - begin)))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _DDL.split(", ")])

    return frugal(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _DDL)
