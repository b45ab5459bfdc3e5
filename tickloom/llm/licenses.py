"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matches and where.

Texts and templates are lower-case words of letters and digits (4.0 and by-nc count as two and more). Every run of three
words of a template is posted in an inverted index. Of a document's runs those made of template words alone can match; of
each window of two neighbouring ones the smaller hash is looked up, so that a passage of four words and more that a
template shares is always found. Whoever matches 0.8 of a template shares such a passage, but for templates of a few
lengths; of these the longest runs that are sure to be shared are posted, and all of a document's runs looked up. Hits on
neighbouring diagonals make a candidate, and a local alignment within a band about the diagonal gives the words that match.
Alignments of one template that follow each other, parted by inserted or lost words, are chained, and the chain's words
count together. Where matches overlap, the one of the higher score stays.

Templates travel with the tasks: their number is bounded by who writes them. No row is shuffled.

Defined cases. Null and empty text: no match. Very long texts: scanned whole. Repeated rows: each is scanned. The same template twice in a text: two
matches. Equal scores: the higher coverage, then the earlier place, then the name. An empty table gives an empty table.
Other columns are not looked at. Short templates (fewer than four words) are refused with ValueError.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

RUN, WINDOW, LEAST_COVERAGE = 3, 2, 0.8
#: Diagonals of hits that are no further apart are aligned together, in a band that goes so much beyond them.
NEAR = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that may stand between a chain's alignments, at least; a template's own length if that is more.
INSERTED = 100

# fixed values: public license statements and notices
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]

_WORD = re.compile(rb"[a-z0-9]+")
NOT_KNOWN = -1


def sure_run(words: int, least_coverage: float = LEAST_COVERAGE) -> int:
    """The longest run that a text surely shares with a template of so many words if it matches so much of it."""
    lost = words - math.ceil(least_coverage * words - 1e-9)
    return max(1, -(-(words - lost) // (lost + 1)))


class Index:
    """Templates as word numbers, and where each of their runs stands, by the runs' length and whether they are winnowed."""

    def __init__(self, templates: list[tuple[str, str]], least_coverage: float = LEAST_COVERAGE):
        self.number: dict[bytes, int] = {}
        self.names, self.words = [], []
        self.postings: dict[tuple[int, bool], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for name, text in templates:
            ids = [self.number.setdefault(w, len(self.number)) for w in _WORD.findall(text.encode().lower())]
            if len(ids) < RUN + WINDOW - 1:
                raise ValueError(f"the template {text!r} has fewer than {RUN + WINDOW - 1} words")
            self.names.append(name)
            self.words.append(np.array(ids, dtype=np.int64))
        for t, ids in enumerate(self.words):
            sure = sure_run(len(ids), least_coverage)
            kind = (RUN, True) if sure >= RUN + WINDOW - 1 else (min(RUN, sure), False)
            for at, h in enumerate(self.hashes(ids, kind[0]).tolist()):
                self.postings[kind][h].append((t, at))
        self.known = {kind: np.array(sorted(posted), dtype=np.int64) for kind, posted in self.postings.items()}

    def hashes(self, ids: np.ndarray, run: int = RUN) -> np.ndarray:
        """Of runs, from 1 on; of those with a word that no template has, the largest number."""
        found = np.zeros(max(0, len(ids) - run + 1), dtype=np.int64)
        for k in range(run):
            found = (found * 1_000_003 + ids[k : k + len(found)] + 1) & ((1 << 61) - 1)
        # scattered, lest the smaller of two be the one with the commoner words
        found = ((found * 0x9E3779B97F4A7C1 & ((1 << 62) - 1)) ^ (found >> 29)) + 1
        bad = np.zeros(len(found), dtype=bool)
        for k in range(run):
            bad |= ids[k : k + len(found)] == NOT_KNOWN
        found[bad] = np.iinfo(np.int64).max
        return found

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """By template, (place in the text, place in the template) of looked-up runs that both have."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for (run, winnowed), known in self.known.items():
            if len(ids) < run:
                continue
            h = self.hashes(ids, run)
            chosen = h != np.iinfo(np.int64).max
            if winnowed and len(h) >= WINDOW:
                low = np.minimum(h[:-1], h[1:])
                least = h == np.concatenate([low, low[-1:]])
                least[1:] |= h[1:] == low
                chosen &= least
            for at in np.flatnonzero(chosen & np.isin(h, known)).tolist():
                for t, place in self.postings[run, winnowed][int(h[at])]:
                    out[t].append((at, place))
        return out


def align(text: np.ndarray, template: np.ndarray, band: int) -> tuple[int, int, int, int, int, int]:
    """Best local alignment with places that differ by no more than band from the diagonal: score, words that match,
    the span [start, end) in the text, and that in the template. text begins band words before the diagonal's first."""
    best, width, text = (0, 0, 0, 0, 0, 0), 2 * band + 1, text.tolist()
    # cells of a template word: its partner in the text is at word + k, for k from 0 to 2 * band
    before = [(0, 0, 0, 0)] * width  # score, matches, start, the template's start
    for i, word in enumerate(template.tolist()):
        now: list[tuple[int, int, int, int]] = []
        for k in range(width):
            j = i + k
            if j >= len(text):
                now.append((0, 0, j, i))
                continue
            same = word == text[j]
            score, n, start, first = before[k]
            if score <= 0:
                score, n, start, first = 0, 0, j, i
            cell = (score + (MATCH if same else MISMATCH), n + same, start, first)
            if k and now[k - 1][0] + GAP > cell[0]:
                cell = (now[k - 1][0] + GAP, *now[k - 1][1:])
            if k + 1 < width and before[k + 1][0] + GAP > cell[0]:
                cell = (before[k + 1][0] + GAP, *before[k + 1][1:])
            if cell[0] <= 0:
                cell = (0, 0, j, i)
            now.append(cell)
            if cell[0] > best[0]:
                best = (cell[0], cell[1], cell[2], j + 1, cell[3], i + 1)
        before = now
    return best


def chains(parts: list[tuple[int, int, int, int, int, int]], most_apart: int) -> list[tuple[int, int, int, int]]:
    """Score, matches and span of each chain of alignments (score, matches, start, end, and the template's), which follow each
    other in text and template, words of overlap counting once; every chain's beginnings are chains as well."""
    parts = sorted(set(parts), key=lambda p: (p[2], p[4], p[3], p[5]))
    best: list[tuple[int, int, int]] = []  # score and matches up to a part, and its chain's start
    ends = []
    for i, (score, n, start, _, first, _) in enumerate(parts):
        found = (score, n, start)
        for k in range(i):
            _, m, start_k, end_k, first_k, last_k = parts[k]
            twice = max(0, end_k - start, last_k - first)
            if start_k < start <= end_k + most_apart and first_k < first and twice < min(m, n) and best[k][0] + score - MATCH * twice > found[0]:
                found = (best[k][0] + score - MATCH * twice, best[k][1] + n - twice, best[k][2])
        best.append(found)
        ends.append((found[0], found[1], found[2], parts[i][3]))
    return ends


def scan(text: bytes, index: Index, least_coverage: float = LEAST_COVERAGE) -> list[tuple[str, float, int, int, int, int]]:
    """License, coverage, words matched, the template's number, and the span in bytes, by place."""
    lower = text.lower()
    get = index.number.get
    words = _WORD.findall(lower)
    ids = np.fromiter((get(w, NOT_KNOWN) for w in words), dtype=np.int64, count=len(words))
    candidates = []
    for t, hits in index.hits(ids).items():
        template = index.words[t]
        diagonals = sorted({at - place for at, place in hits})
        groups: list[list[int]] = []
        for d in diagonals:
            if groups and d - groups[-1][-1] <= NEAR:
                groups[-1].append(d)
            else:
                groups.append([d])
        parts = []
        for g in groups:
            middle, band = (g[0] + g[-1]) // 2, (g[-1] - g[0] + 1) // 2 + NEAR
            first = max(0, middle - band)
            part = ids[first : middle + len(template) + band + 1]
            padded = np.concatenate([np.full(first - (middle - band), -2), part])
            score, n, start, end, top, bottom = align(padded, template, band)
            parts.append((score, n, start + middle - band, end + middle - band, top, bottom))
        for score, n, start, end in chains(parts, max(INSERTED, len(template))):
            if n >= least_coverage * len(template) - 1e-9:
                candidates.append((-score, -n / len(template), start, end, index.names[t], n, t))
    taken: list[tuple] = []
    for c in sorted(candidates):
        if all(c[3] <= x[2] or x[3] <= c[2] for x in taken):
            taken.append(c)
    if not taken:
        return []
    spans = [m.span() for m in _WORD.finditer(lower)]
    return [(name, -cover, n, t, spans[a][0], spans[b - 1][1]) for _, cover, a, b, name, n, t in sorted(taken, key=lambda x: x[2])]


SCHEMA = "doc_id bigint, license string, coverage double, matched_words bigint, template bigint, start bigint, end bigint"


def _scan(batches: Iterator[pa.RecordBatch], templates: list[tuple[str, str]], least_coverage: float) -> Iterator[pa.RecordBatch]:
    index = Index(templates, least_coverage)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, value in zip(batch.column(0), batch.column(1).cast(pa.binary())):
            text = value.as_py() or b""
            for name, cover, n, t, a, b in scan(text, index, least_coverage):
                start = len(text[:a].decode("utf-8", "replace"))
                rows.append((doc_id.as_py(), name, cover, n, t, start, start + len(text[a:b].decode("utf-8", "replace"))))
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """A row for each match: doc_id, license, share of the template's words matched, their number, the template's number,
    and the span [start, end) in code points."""
    scanner = partial(_scan, templates=templates or TEMPLATES, least_coverage=least_coverage)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scanner, SCHEMA)
