"""License scan: MinHash bands over overlapping windows retrieve templates, containment verifies.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased;
shingles are five words.  A template of fewer words is one shingle of its own
length, and texts are looked through for runs of so many words.  A template of T
shingles is filed under the MinHash bands of all its windows of W shingles,
W = 1, 2, 4 or 8 as T grows (below 8, 16, 64, above).  A text is cut into
windows of each W that overlap by half.  Four hash functions make two bands of
two; windows of similarity J meet with probability 1 - (1 - J*J)**2, those that
hold the same shingles always.  A text's windows are counted from its own
beginning.  A document that contains 75 % of a template in its order mostly
holds an unbroken run of 1.5 W of its shingles, in which one of its windows
equals one of the template's: a changed word breaks five shingles, so T/4 broken
ones leave runs of 15 T / (T + 20) on average.  Changes spread evenly over a long
template can leave shorter runs; then windows that differ in part meet with the
probability above.  A test tries random edits and misses none.

A retrieved template matches if the text's whole set holds at least 75 % of
the template's shingles.  The templates are a parameter, by default a few
thousand windows; the scan is one pass without a shuffle.

Null or blank text matches nothing.  Repeated rows give their rows each; a
null doc_id is carried.  Empty tables give empty results; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm._common import table
from lociq.llm._text import _MULTIPLIERS, SHINGLE, U, mix, pieces, shingles, words

CONTAINMENT = 75  # per cent
#: Names of licenses, as notices write them.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0",),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-clause BSD license"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "ISC": ("ISC License",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
#: How notices begin.
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under the {}", "This work is licensed under {}", "Distributed under the {}", "Available under the {}")
#: Paragraphs of license texts.
TEXTS = {
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
}

#: ASCII punctuation and control characters part words.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20
WIDTHS = (1, 2, 4, 8)
_HASH = np.random.default_rng(17).integers(1, 2**63, 4, dtype=np.int64).astype(U) | U(1)
_TABLE_BITS = 20


def templates() -> list[tuple[str, str, str]]:
    """(license, name of the template, text)."""
    out = [(lic, f"{lic}: {notice.format(name)}", notice.format(name)) for lic, names in NAMES.items() for name in names for notice in NOTICES]
    return out + [(lic, f"{lic}: text {k}", t) for lic, parts in TEXTS.items() for k, t in enumerate(parts, 1)]


def plain_shingles(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for rows, data, off in pieces(column):
        yield rows, *shingles(_PLAIN[data], off)


def short_runs(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of size words within a text, in order, and where each text's begin (and the end)."""
    w, at = words(_PLAIN[data], off)
    n = np.maximum(np.diff(at) - size + 1, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(begin[-1]) - np.repeat(begin[:-1], n) + np.repeat(at[:-1], n)
    out = np.full(begin[-1], _MULTIPLIERS[-1] * U(size))
    for k in range(size):
        out += w[first + k] * _MULTIPLIERS[k]
    return mix(out), begin


def width(n: int) -> int:
    return 1 if n < 8 else 2 if n < 16 else 4 if n < 64 else 8


def window_keys(h: np.ndarray, wanted: tuple[int, ...] = WIDTHS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(width, band, key of the window at each place)."""
    least = [mix(h * a) for a in _HASH]
    for w in WIDTHS:
        if w > 1:
            least = [np.minimum(x[: -w // 2 or None], x[w // 2 :]) for x in least]
        if w in wanted and len(least[0]):
            for band in (0, 1):
                yield w, band, mix(least[2 * band] * U(3) + least[2 * band + 1] + U(8 * w + band))


class Index:
    """Templates' sets, and the templates under each window key."""

    def __init__(self, names: list[tuple[str, str, str]]):
        self.names = names
        self.sets, held = [], []
        for rows, h, begin in plain_shingles(pa.array([t for _, _, t in self.names])):
            for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True), rows.start):
                self.sets.append(np.unique(h[a:b]))
                for _, _, keys in window_keys(h[a:b], (width(b - a),)):
                    held += [(k, i) for k in np.unique(keys)]
        self.keys = np.array([k for k, _ in held], U)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.of = self.keys[order], np.array([i for _, i in held])[order]
        #: By count of words: the one shingle of each shorter template, sorted, and the template of each.
        self.short = {}
        for rows, data, off in pieces(pa.array([t for _, _, t in self.names])):
            n = np.diff(words(_PLAIN[data], off)[1])
            for size in sorted({int(x) for x in n if 0 < x < SHINGLE}):
                of = np.flatnonzero(n == size) + rows.start
                h = np.array([self.sets[i][0] for i in of], U)
                self.short[size] = (h[np.argsort(h)], of[np.argsort(h)])
        self.widths = tuple(sorted({width(len(s)) for s in self.sets}))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.keys >> U(64 - _TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (row, template) pairs that share a window key."""
        found = [np.zeros((0, 2), np.int64)]
        place = np.arange(len(h)) - np.repeat(begin[:-1], np.diff(begin))  # within its text
        for w, _, keys in window_keys(h, self.widths):
            some = np.flatnonzero(place[: len(keys)] % max(1, w // 2) == 0)
            keys = keys[some]
            at = np.flatnonzero(self.table[(keys >> U(64 - _TABLE_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], side="right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if len(at):
                row = np.searchsorted(begin, some[at], side="right") - 1
                of = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.unique(np.stack([np.repeat(row, n), self.of[of]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)


    def short_matches(self, data: np.ndarray, off: np.ndarray) -> set[tuple[int, int]]:
        """(row, template) of templates of fewer words than a shingle that a text holds."""
        found = set()
        for size, (wanted, of) in self.short.items():
            h, begin = short_runs(data, off, size)
            lo, hi = np.searchsorted(wanted, h), np.searchsorted(wanted, h, side="right")
            at = np.flatnonzero(hi > lo)
            for row, a, b in zip(np.searchsorted(begin, at, side="right") - 1, lo[at], hi[at], strict=True):
                found |= {(int(row), int(t)) for t in of[a:b]}
        return found


def _scan(names: list[tuple[str, str, str]]):
    return lambda batches: _found(Index(names), batches)


def _found(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows, data, off in pieces(b.column(1)):
            h, begin = shingles(_PLAIN[data], off)
            short = index.short_matches(data, off)
            out = [(rows.start + row, t, 1, 1) for row, t in sorted(short)]
            for row, t in index.candidates(h, begin).tolist():
                if (row, t) in short:
                    continue
                want = index.sets[t]
                n = int(np.isin(want, h[begin[row] : begin[row + 1]]).sum())
                if 100 * n >= CONTAINMENT * len(want):
                    out.append((rows.start + row, t, n, len(want)))
            at, t, n, of = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())).cast(pa.int64()), pa.array([index.names[k][0] for k in t], pa.string()), pa.array([index.names[k][1] for k in t], pa.string()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], names=["doc_id", "license", "template", "n_matched", "n_template"])


def scan(docs: DataFrame, names: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """(doc_id, license, template, n_matched, n_template) of each template (license, name, text) that a document contains."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(templates() if names is None else names), "doc_id long, license string, template string, n_matched long, n_template long")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    plain = lambda s: "".join(c.lower() if c.isascii() else c for c in ("".join(c if not c.isascii() or c.isalnum() else " " for c in s))).split(" ")
    rows, short = [], set()
    for lic, name, text in templates():
        w = [x for x in plain(text) if x]
        short |= {len(w)} if len(w) < SHINGLE else set()
        for x in sorted({" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)} if len(w) >= SHINGLE else {" ".join(w)}):
            rows.append(f"({quoted(lic)}, {quoted(name)}, {quoted(x)})")
    return rf"""
WITH t(license, template, x) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS sh FROM w, (SELECT unnest([{', '.join(map(str, sorted(short | {SHINGLE})))}]) AS k)),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
n AS (SELECT template, count(*) AS n_template FROM t GROUP BY template)
SELECT doc_id, license, template, count(*) AS n_matched, n_template FROM e JOIN t USING (x) JOIN n USING (template)
GROUP BY doc_id, license, template, n_template HAVING 100 * count(*) >= {CONTAINMENT} * n_template
"""


QUERIES = {"op5_license_scans": op5_license_scans}
SQL = {"op5_license_scans": _sql()}
