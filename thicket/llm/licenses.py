"""Licence scan by Dice coefficient over word bigrams.

A text is normalised (ASCII lower case, punctuation to spaces, so comment marks
go) and compared in units: each line, each paragraph, each run of neighbouring
paragraphs, and the whole. Lines without words part paragraphs. A unit's distinct
word bigrams against a template's give 2 * common / (sum of both sizes).

Templates are short forms, the full texts of licences, each paragraph of short
licences, and notices, joined and by paragraph (``_license_texts.py``). No unit
has more in common with a template than its document has, so the few templates
of which a document holds t / (2 - t) of the bigrams are compared, and in units
whose size lies within t / (2 - t) * size to (2 - t) / t * size. Nothing that
reaches the threshold is left out by either. One narrow pass.

Licences share paragraphs, so a paragraph's template gives way to any other that
matches a unit around it. Null and empty texts match nothing; ties go to the
template first by name. Rows repeat as they come.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._license_texts import NOTICES, TEXTS
from thicket.llm._words import Chunk, Words, chunks, shingles, tidy

THRESHOLD = 0.9
#: Notices as their licences ask for, and short forms in use.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
}
#: Texts longer than this are compared whole; of shorter ones each paragraph as well.
SHORT_TEXT, LEAST_WORDS = 2000, 12


def _all_templates() -> dict[str, str]:
    out = dict(TEMPLATES)

    def paragraphs(name: str, parts: Sequence[str]) -> None:
        for i, part in enumerate(parts, 1):
            if len(parts) > 1 and len(part.split()) >= LEAST_WORDS:
                out[f"{name}-paragraph-{i}"] = part

    for name, text in TEXTS.items():
        out[f"{name}-full"] = text
        if len(text) <= SHORT_TEXT:
            paragraphs(name, text.strip().split("\n\n"))
    for name, parts in NOTICES.items():
        out.setdefault(f"{name}-notice", " ".join(parts))
        if f"{name}-notice" in TEMPLATES:
            out[f"{name}-notice-full"] = " ".join(parts)
        paragraphs(f"{name}-notice", parts)
    return out


ALL_TEMPLATES = _all_templates()

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[[b for b in range(128) if not (chr(b).isalnum() or b == 10)]] = 32


def _bigrams(buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of rows, and the hash of the pair that starts at each word."""
    words = Words(Chunk(0, buf, off))
    if len(words.start) < 2:
        return words, np.zeros(0, np.uint64)
    whole = Words.__new__(Words)
    whole.start, whole._lanes, whole.off = words.start, [words.lane(0), words.lane(1)], np.array([0, len(words.start)])
    return words, shingles(whole, 2)[0]


def compile_templates(templates: Mapping[str, str]) -> list[tuple[str, np.ndarray]]:
    out = []
    for name in sorted(templates):
        raw = _NORMAL[np.frombuffer(templates[name].encode(), np.uint8)]
        raw = np.where(raw == 10, np.uint8(32), raw)
        out.append((name, np.unique(_bigrams(raw, np.array([0, len(raw)]))[1])))
    return out


class Templates:
    """Compiled templates, and which of them hold each bigram of any."""

    def __init__(self, compiled: list[tuple[str, np.ndarray]], threshold: float):
        self.names, self.grams, self.threshold = [n for n, _ in compiled], [g for _, g in compiled], threshold
        size = np.array([len(g) for g in self.grams], np.int64)
        self.low = np.ceil(threshold / (2 - threshold) * size - 1e-9).astype(np.int64)
        self.high = np.floor((2 - threshold) / threshold * size + 1e-9).astype(np.int64)
        flat = np.concatenate([*self.grams, np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(size)), size)
        order = np.argsort(flat, kind="stable")
        self.any, at = np.unique(flat[order], return_index=True)
        self.at, self.of = np.append(at, len(flat)), of[order]

    def near(self, pairs: np.ndarray, off: np.ndarray) -> list[list[int]]:
        """For each row, the templates it has enough bigrams of."""
        n, width = len(off) - 1, len(self.names)
        if not len(self.any) or not len(pairs):
            return [[] for _ in range(n)]
        place = np.minimum(np.searchsorted(self.any, pairs), len(self.any) - 1)
        hit = np.flatnonzero(self.any[place] == pairs)
        row = np.searchsorted(off, hit, side="right") - 1
        inside = hit + 1 < off[row + 1]  # no pair goes on in the next row
        key = np.unique(row[inside] * len(self.any) + place[hit[inside]])
        row, place = key // len(self.any), key % len(self.any)
        many = self.at[place + 1] - self.at[place]
        end = np.cumsum(many)
        of = self.of[np.arange(many.sum()) + np.repeat(self.at[place] - (end - many), many)]
        common = np.bincount(np.repeat(row, many) * width + of, minlength=n * width).reshape(n, width)
        enough = common >= np.maximum(self.low, 1)
        out: list[list[int]] = [[] for _ in range(n)]
        for i, t in zip(*(x.tolist() for x in np.nonzero(enough))):
            out[i].append(t)
        return out


def _runs(pairs: np.ndarray, before: np.ndarray, grams: np.ndarray, low: int, high: int, bounds: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Runs of two paragraphs or more, by word bounds, whose size is within the
    template's, and their Dice. ``before`` is where a pair stood last."""
    inside = np.isin(pairs, grams)
    starts, ends = bounds[:-1], bounds[1:]
    # What is left from a paragraph on must have enough of the template.
    left = np.append(np.cumsum(inside[::-1])[::-1], 0)
    for k in range(len(starts) - 1):
        s = int(starts[k])
        if left[min(s, len(left) - 1)] < low:
            break
        reach = 4 * high
        while True:  # longer while the last run seen is small enough
            stop = min(len(pairs), s + reach)
            fresh = before[s:stop] < s
            own = np.concatenate([[0], np.cumsum(fresh)])
            if stop == len(pairs) or own[-1] > high:
                break
            reach *= 4
        common = np.concatenate([[0], np.cumsum(fresh & inside[s:stop])])
        e = ends[k + 1 :]
        e = e[e - 1 - s < len(own)]
        o, c = own[e - 1 - s], common[e - 1 - s]
        dice = 2 * c / (o + len(grams))
        for j in np.flatnonzero((o >= low) & (o <= high) & (c >= low)).tolist():
            yield s, int(e[j]), float(dice[j])


def scan_chunk(chunk: Chunk, templates: Templates) -> tuple[list[str | None], list[float], list[int]]:
    """For each row: best template, its Dice, and how many units match any."""
    n, threshold = len(chunk), templates.threshold
    best: list[tuple[float, str] | None] = [None] * n
    found = [0] * n
    buf = _NORMAL[chunk.buf]
    words, pairs = _bigrams(buf, chunk.off)
    for i, near in enumerate(templates.near(pairs, words.off)):
        if not near:
            continue
        low, high = min(templates.low[t] for t in near), max(templates.high[t] for t in near)
        a, b = int(words.off[i]), int(words.off[i + 1])
        first, last = chunk.off[i], chunk.off[i + 1]
        breaks = np.flatnonzero(buf[first:last] == 10) + first
        cut = a + np.searchsorted(words.start[a:b], breaks)
        lines = np.concatenate([[a], cut, [b]])
        # Lines without words part paragraphs.
        empty = np.flatnonzero(lines[1:] == lines[:-1])
        paragraphs = np.unique(np.concatenate([[a], lines[empty], [b]]))
        units = {(int(s), int(e)) for s, e in [*zip(lines, lines[1:]), *zip(paragraphs, paragraphs[1:]), (a, b)] if e - s - 1 >= low}
        matches: list[tuple[float, str, int, int]] = []

        def match(s: int, e: int, t: int, dice: float) -> None:
            if dice >= threshold:
                matches.append((-dice, templates.names[t], s, e))

        for s, e in sorted(units):
            own = np.unique(pairs[s : e - 1])
            if low <= len(own) <= high:
                for t in near:
                    if templates.low[t] <= len(own) <= templates.high[t]:
                        match(s, e, t, 2 * len(np.intersect1d(own, templates.grams[t], assume_unique=True)) / (len(own) + len(templates.grams[t])))
        if len(paragraphs) > 2:
            mine = pairs[a : b - 1]
            _, at = np.unique(mine, return_inverse=True)
            order = np.argsort(at, kind="stable")
            before = np.full(len(mine), -1)
            again = at[order[1:]] == at[order[:-1]]
            before[order[1:][again]] = order[:-1][again]
            for t in near:
                for s, e, dice in _runs(mine, before, templates.grams[t], int(templates.low[t]), int(templates.high[t]), paragraphs - a):
                    match(s + a, e + a, t, dice)
        found[i] = len({(s, e) for _, _, s, e in matches})
        for x in sorted(matches):
            if "-paragraph-" not in x[1] or not any("-paragraph-" not in y[1] and y[2] <= x[2] and x[3] <= y[3] for y in matches):
                best[i] = (-x[0], x[1])
                break
    return [b and b[1] for b in best], [b[0] if b else 0.0 for b in best], found


def scan(docs: DataFrame, templates: Mapping[str, str] = ALL_TEMPLATES, threshold: float = THRESHOLD, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``license`` (null: none), ``dice``, ``n_units``."""
    keep, kinds, templates = list(keep), dict(docs.dtypes), dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Templates(compile_templates(templates), threshold)
        for batch in batches:
            for chunk in chunks(batch.column(len(keep))):
                name, dice, units = scan_chunk(chunk, compiled)
                cols = [batch.column(i).slice(chunk.first, len(chunk)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(name, pa.string()), pa.array(dice, pa.float64()), pa.array(units, pa.int64())], [*keep, "license", "dice", "n_units"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "license string, dice double, n_units long"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(tidy(run), schema)
