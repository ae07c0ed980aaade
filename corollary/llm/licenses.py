"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are sets of 3-word shingles. Templates fall into classes by length; a class has
windows of one width, at a stride that lets every run as long as a template of the class lie inside
a window. A window that holds a share `containment` of a template then has Jaccard similarity of at
least j = c m / (w + (1 - c) m) with it, and 2-row bands are added until 1 - (1 - j^2)^bands reaches
`certainty` for the template of the class that makes j least. Retrieved templates are verified by
the exact share of their shingles that the window holds. Windows without a shingle of any template
can't verify and are not sketched.

Of the windows that verify for a template and overlap, the one of highest share (then the first)
stands; its span runs from the first to the last word of template shingles in it. A match whose span
lies inside that of a match with more shingles is left out (a header that quotes a notice).

Defined results: null and empty texts, and texts of fewer than 3 words, match nothing; rows that share
a doc_id are scanned one by one, repeated ones twice; a null doc_id is reported as null; a template of
fewer than 3 words raises; an empty table gives no row; further columns are ignored; texts of any length are
scanned whole; of windows of equal share the first stands, so notices nearer than a window are one match.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text
from .textops import Filter, U, Words, char_at, mix, ngrams, pieces

SHINGLE, CONTAINMENT, CERTAINTY = 3, 0.8, 0.999

_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version."
    )


#: (license, template): notices and the texts that are usually quoted whole.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-2.0-or-later", _gnu("", "2")),
    ("GPL-3.0-or-later", _gnu("", "3")),
    ("LGPL-3.0-or-later", _gnu("Lesser", "3")),
    ("AGPL-3.0-or-later", _gnu("Affero", "3")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
)


class _Class:
    """Templates of one range of lengths: window width and stride in shingles, band keys of the templates."""

    def __init__(self, width: int, stride: int, own: list[tuple[int, np.ndarray]], containment: float, certainty: float):
        self.width, self.stride, self.own = width, stride, own
        least = min(len(g) for _, g in own)
        j = containment * least / (width + (1 - containment) * least)
        self.bands = max(1, math.ceil(math.log(1 - certainty) / math.log(1 - j * j)))
        self.keys = np.stack([self.sketch(g[None, :])[0] for _, g in own])

    def sketch(self, g: np.ndarray) -> np.ndarray:
        """Band keys of rows of shingles; ~0 pads a short row."""
        out = np.empty((len(g), self.bands), U)
        pad = g == ~U(0)
        for b in range(self.bands):
            key = np.full(len(g), U(b + 1))
            for r in range(2):
                x = mix(g ^ mix(np.array([b * 2 + r + 1], U) * U(0x9E3779B97F4A7C15))[0])
                x[pad] = ~U(0)
                key = mix(key * U(0xC2B2AE3D27D4EB4F) + x.min(axis=1))
            out[:, b] = key
        return out


def compile_templates(templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> tuple[list[_Class], np.ndarray]:
    """The classes, and all shingles of all templates."""
    words = Words(pa.array([t for _, t in templates], pa.string()))
    at, g = ngrams(words.h, words.off, SHINGLE)
    row = words.doc()[at] if len(at) else at
    sets = [np.unique(g[row == i]) for i in range(len(templates))]
    sizes = {}
    for i, (name, _) in enumerate(templates):
        m = int((row == i).sum())
        if not m:
            raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
        sizes.setdefault(3 if m <= 3 else max(3, (m - 1).bit_length()), []).append((m, i))
    classes = []
    for own in sizes.values():
        longest = max(m for m, _ in own)
        stride = max(1, longest // 8)
        classes.append(_Class(longest + stride - 1, stride, [(i, sets[i]) for _, i in own], containment, certainty))
    return classes, np.unique(g)


def _windows(words: Words, at: np.ndarray, g: np.ndarray, hits: np.ndarray, c: _Class) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and first shingle of the windows with a hit, and their shingles (~0 beyond the end of the row)."""
    row = np.searchsorted(words.off, at, "right") - 1
    first = np.searchsorted(row, row[hits])  # of the row, as an index of shingles
    last = np.searchsorted(row, row[hits], "right")
    k = (hits - first) // c.stride
    back = c.width // c.stride + 1
    begin = (first[:, None] + (k[:, None] - np.arange(back)[None, :]) * c.stride).ravel()
    edge, end = np.repeat(first, back), np.repeat(last, back)
    begin = np.maximum(begin, edge)
    order = np.unique(begin, return_index=True)[1]
    begin, end = begin[order], end[order]
    place = begin[:, None] + np.arange(c.width)[None, :]
    inside = place < end[:, None]
    shingles = np.where(inside, g[np.minimum(place, len(g) - 1)], ~U(0))
    return row[begin], begin, shingles


def _resolve(found: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """found: (template, first shingle, last, shingles held, share) in one row; the matches that stand."""
    best: list[tuple[int, int, int, int, float]] = []
    for m in sorted(found, key=lambda x: (x[0], -x[4], x[1], x[2])):
        if not any(b[0] == m[0] and m[1] <= b[2] and b[1] <= m[2] for b in best):
            best.append(m)
    return sorted((m[0], m[1], m[2], m[4]) for m in best if not any(o is not m and o[1] <= m[1] and m[2] <= o[2] and (o[3], o[4], -o[0]) > (m[3], m[4], -m[0]) for o in best))


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> DataFrame:
    """(doc_id, license, template, start, end, containment): the matches; template is its place in the list, offsets are code points, end exclusive."""
    if not 0 < containment <= 1 or not 0 < certainty < 1:
        raise ValueError("containment must be in (0, 1] and certainty in (0, 1)")
    compile_templates(templates, containment, certainty)  # raises here, not in a task

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, known = compile_templates(templates, containment, certainty)
        known = Filter(known)
        for b in pieces(batches):
            words = Words(b.column(1))
            at, g = ngrams(words.h, words.off, SHINGLE)
            hits = np.flatnonzero(known(g)) if len(g) else at
            if not len(hits):
                continue
            found: dict[int, list] = {}
            for c in classes:
                row, begin, shingles = _windows(words, at, g, hits, c)
                keys = c.sketch(shingles)
                for t, (i, own) in enumerate(c.own):
                    for w in np.flatnonzero((keys == c.keys[t]).any(axis=1)):
                        held = np.flatnonzero(np.isin(shingles[w], own))
                        share = len(np.unique(shingles[w][held])) / len(own)
                        if share >= containment - 1e-9:
                            found.setdefault(int(row[w]), []).append((i, int(begin[w] + held[0]), int(begin[w] + held[-1]), len(own), share))
            original = Words(b.column(1), fold=False, hashed=False) if found else None
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r in sorted(found):
                lo = original.text_off[r]
                data = original.data[lo : original.text_off[r + 1]]
                for i, first, last, share in _resolve(found[r]):
                    a, e = at[first] - words.off[r] + original.off[r], at[last] + SHINGLE - 1 - words.off[r] + original.off[r]
                    s, f = char_at(data, np.array([original.start[a] - lo, original.end[e] - lo]))
                    for column, v in zip(out, (b.column(0)[r].as_py(), templates[i][0], i, int(s), int(f), share), strict=True):
                        column.append(v)
            if out[1]:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "license", "template", "start", "end", "containment"])

    return id_text(docs).where("text is not null and text <> ''").mapInArrow(scan, "doc_id long, license string, template int, start int, end int, containment double")
