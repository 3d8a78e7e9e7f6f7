"""License texts and notices inside documents, by MinHash bands over overlapping windows and exact containment.

Windows of every template, at every place, and of every text, a few words apart, get keys of ``BANDS`` bands of ``ROWS`` minima
over their word shingles; equal keys retrieve the template for that part of the text. The retrieved part is then verified: for
each way to lay the template on it, the share of the template's distinct shingles in the text there must reach the limit.

The width of the windows and their distance are derived for each template from what a match can leave of it
(``intact_run``): a text that reaches the limit holds a run of consecutive shingles of the template, and width and distance are
such that any run of that length holds a whole window. That window equals one of the template's, similarity 1, so it collides in
every band: an accepted match is retrieved with probability 1, wherever its edits are and wherever it begins. Windows of
similarity ``s`` that are not equal are retrieved with probability ``1 - (1 - s ** ROWS) ** BANDS``; no match depends on them.

Templates of fewer words than a shingle are one window. Words are runs of letters and digits in lower case. Templates are a
parameter of bounded size and travel with the task; a document is scanned whole by one task in slices, and nothing is moved.

Defined results: null and empty texts hold nothing. Texts of any length are scanned whole; matches of one template that overlap
are one, and of equal ones the first place is reported. Repeated rows are reported once each. Null ids are reported with a
null id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import words

SHINGLE = 5
BANDS, ROWS = 2, 2

_rng = np.random.default_rng(7062024)
#: Odd factors, one ordering of the shingles each.
FACTORS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

# License notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the "
        "name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. The software is "
        'provided "as is" and the author disclaims all warranties with regard to this software including all implied '
        "warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, "
        "indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether "
        "in an action of contract, negligence or other tortious action, arising out of or in connection with the use or "
        "performance of this software.",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        'the Software. The Software is provided "as is", without warranty of any kind, express or implied, including but '
        "not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no "
        "event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an "
        "action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other "
        "dealings in the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "All-rights-reserved": ["All rights reserved"],
}



def intact_run(own: np.ndarray, percent: float) -> int:
    """Length of a run of consecutive shingles that every text reaching ``percent`` of the template's holds.

    Mark one place of the text for each of the ``held`` shingles: there are that many marks among at most as many places as
    verification looks at. Marks next to each other continue the run unless the template goes on in more than one way; else
    a break costs places without a mark: four, or one less for each word that ends one shingle and begins another elsewhere
    in the template. The most breaks that the places allow, cheapest first, give the longest run that is still sure.
    """
    n, size = len(own), min(SHINGLE, len(own))
    tokens = own.tolist()
    grams = {tuple(tokens[k : k + size]) for k in range(n - size + 1)}
    held = next((k for k in range(1, len(grams)) if 100 * k / len(grams) >= percent), len(grams))
    spare = n - size + 1 + 2 * _slack(n) - held
    breaks, cheaper = 0, 0
    for shared in range(size - 1, 0, -1):
        seen = Counter(tuple(tokens[k : k + shared]) for k in range(n - shared + 1))
        several = sum(seen[g[-shared:]] > 1 for g in grams)
        cost = size - 1 - shared
        more = several - cheaper if not cost else min(several - cheaper, spare // cost)
        breaks, cheaper, spare = breaks + more, several, spare - more * cost
    breaks += spare // max(size - 1, 1)
    return -(-held // min(breaks + 1, held))


def _slack(n_words: int) -> int:
    """Words by which a match may be longer than its template, at either end."""
    return n_words // 4 if n_words > SHINGLE else 0


def band_keys(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Keys of all bands for the windows of ``width`` shingles at ``starts``: one row per band."""
    out = np.empty((BANDS, len(starts)), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band, np.uint64)
        for factor in FACTORS[band]:
            ranks = grams * factor
            least = ranks[starts]
            for k in range(1, width):
                least = np.minimum(least, ranks[starts + k])
            key = words.mix(key * np.uint64(31) + least)
        out[band] = key
    return out


@dataclass
class Template:
    number: int
    name: str
    n_words: int
    #: Distinct shingles in order, and for every place the shingle's position among them.
    shingles: np.ndarray
    at_place: np.ndarray


class Index:
    """Band keys of template windows by (shingle length, window width, distance of text windows)."""

    def __init__(self, templates: dict[str, list[str]], percent: float):
        self.templates: list[Template] = []
        entries: dict[tuple[int, int, int], list] = {}
        for name, texts in sorted(templates.items()):
            values, bounds = words.hashed(pa.array(texts, pa.string()), True, words.PLAIN_WORD)
            for k in range(len(texts)):
                own = values[bounds[k] : bounds[k + 1]]
                n, size = len(own), min(SHINGLE, len(own))
                if not n:
                    continue
                grams, _ = words.runs(own, np.array([0, n]), size)
                number = len(self.templates)
                self.templates.append(Template(number, name, n, *np.unique(grams, return_inverse=True)))
                run = intact_run(own, percent)
                width = run // 2 + 1
                keys = band_keys(grams, np.arange(len(grams) - width + 1), width)
                entries.setdefault((size, width, run + 1 - width), []).append((keys, np.full(keys.shape[1], number)))
        self.classes = {}
        for kind, found in entries.items():
            keys, number = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
            order = np.argsort(keys, axis=1)
            self.classes[kind] = np.take_along_axis(keys, order, axis=1), number[order]

    def retrieved(self, kind: tuple[int, int, int], grams: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(text, template, place of the window among all shingles), one row per distinct hit, in order."""
        table, number = self.classes[kind]
        _, width, step = kind
        counts = np.diff(own)
        inside = np.arange(len(grams)) - np.repeat(own[:-1], counts)
        starts = np.flatnonzero((inside % step == 0) & (inside + width <= np.repeat(counts, counts)))
        found = [np.empty((0, 3), np.int64)]
        for band, keys in enumerate(band_keys(grams, starts, width)):
            low = np.searchsorted(table[band], keys, side="left")
            hit = np.flatnonzero(table[band][np.minimum(low, table.shape[1] - 1)] == keys)
            n = np.searchsorted(table[band], keys[hit], side="right") - low[hit]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hit], n)
            at = np.repeat(starts[hit], n)
            found.append(np.stack((np.searchsorted(own, at, side="right") - 1, number[band][entry], at), axis=1))
        return np.unique(np.concatenate(found), axis=0)


def _scan(index: Index, percent: float):
    def run(batches):
        for part in words.slices(batches):
            values, bounds = words.hashed(part.column("text"), True, words.PLAIN_WORD)
            grams_of = {size: words.runs(values, bounds, size) for size in {kind[0] for kind in index.classes}}
            rows: list[tuple] = []
            for kind in index.classes:
                grams, own = grams_of[kind[0]]
                hits = index.retrieved(kind, grams, own)
                edges = np.flatnonzero(np.any(hits[1:, :2] != hits[:-1, :2], axis=1)) + 1
                for group in np.split(hits, edges) if len(hits) else []:
                    t = index.templates[group[0, 1]]
                    for at in _layings(t, group[:, 2], grams, own, group[0, 0]):
                        rows += _verified(t, at, grams, own, group[0, 0], kind[0], percent)
            yield from _reported(part, rows, index.templates)

    return run


def _layings(t: Template, hits: np.ndarray, grams: np.ndarray, own: np.ndarray, d: int) -> np.ndarray:
    """Where the template would begin for every shingle of it that stands near a hit."""
    reach = len(t.at_place) + _slack(t.n_words)
    low, high = np.maximum(hits - reach, own[d]), np.minimum(hits + reach, own[d + 1])
    # Hits are in order, so each looks only at what those before it have not.
    low = np.maximum(low, np.concatenate((low[:1], high[:-1])))
    near = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
    at = np.minimum(np.searchsorted(t.shingles, grams[near]), len(t.shingles) - 1)
    same = t.shingles[at] == grams[near]
    near, at = near[same], at[same]
    # All places of the template that hold the same shingle.
    order = np.argsort(t.at_place, kind="stable")
    first = np.searchsorted(t.at_place[order], at, side="left")
    n = np.searchsorted(t.at_place[order], at, side="right") - first
    place = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    return np.unique(np.repeat(near, n) - place)


def _verified(t: Template, at: int, grams: np.ndarray, own: np.ndarray, d: int, size: int, percent: float) -> list[tuple]:
    """The hit with its containment in the text around it, if that is enough."""
    slack = _slack(t.n_words)
    a, b = max(own[d], at - slack), min(own[d + 1], at + t.n_words - size + 1 + slack)
    held = int(np.isin(t.shingles, grams[a:b]).sum())
    share = 100 * held / len(t.shingles)
    return [(int(d), t.name, t.number, int(max(at - own[d], 0)), share)] if share >= percent else []


def _reported(part: pa.RecordBatch, rows: list[tuple], templates: list[Template]):
    """One row per text and license: hits of one template that overlap are one match."""
    best: dict[tuple[int, str], list] = {}
    last: dict[tuple[int, int], int] = {}
    for d, name, number, at, share in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        entry = best.setdefault((d, name), [0, at, 0.0])
        if (d, number) not in last or last[d, number] + max(3, templates[number].n_words // 2) < at:
            entry[0] += 1
            last[d, number] = at
        entry[1], entry[2] = min(entry[1], at), max(entry[2], share)
    keys = sorted(best)
    ids = part.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64()))
    columns = [pa.array([best[k][j] for k in keys], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
    yield pa.RecordBatch.from_arrays(
        [ids, pa.array([name for _, name in keys], pa.string()), *columns],
        ["doc_id", "license_id", "n_matches", "first_word", "containment"],
    )


def licenses(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, percent: float = 80) -> DataFrame:
    """Licenses named in each document: ``doc_id, license_id, n_matches, first_word, containment`` (percent, the best)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, license_id string, n_matches long, first_word long, containment double"
    return docs.mapInArrow(_scan(Index(templates, percent), percent), schema)
