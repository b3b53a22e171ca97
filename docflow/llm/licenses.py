"""License scans: MinHash bands over overlapping windows of words retrieve templates, then the share of a template's word shingles
that the window holds is computed exactly.

Templates of W / 2 to W shingles form a class. Its windows are 3 blocks of W / 2 shingles and begin at every block, so a template
of m shingles lies whole inside one of them: their Jaccard similarity is m / 1.5W > 0.33, and 0.8m / (1.5W + 0.2m) > 0.25 at the
threshold of 0.8 of the shingles. With 32 bands of one MinHash, such a window shares a band with a probability of
1 - (1 - 0.25)^32 = 0.9999.

The bands alone retrieve. A text without any shingle of a template has no window that shares a band, so `gate` skips its bands; it
saves time and changes no result (tests run without it too). A template of under 5 words has one shingle, of all its words; a set of
one shingle is its own MinHash, so all bands of it are one, the shingle itself.

Templates are a bounded parameter and go to every task; documents are never shuffled. Defined results: a null or empty text, or one
with no match, gives no row; each document and template gives one row, of the window with the greatest containment, then the
earliest; repeated rows give a row each; a template without words is never found; other columns are ignored. A text of any length is
scanned whole in its task, in memory in proportion to it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from docflow.llm.hashing import Cache, shingles
from docflow.llm.license_texts import FULL_TEXTS
from docflow.session import ship

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 32
MAX_TEMPLATES = 10_000
#: Shingles of windows whose bands are computed at once, about.
CHUNK = 100_000

# Short notices by which works state their license; the full texts are in license_texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Apache-2.0-short": "under the Apache License 2.0",
    "BSD-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "BSD-short": "licensed under the BSD license",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-notice": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "ISC-notice": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MIT-short": "licensed under the MIT license",
    "MIT-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "Unlicense-notice": "This is free and unencumbered software released into the public domain.",
} | FULL_TEXTS

WORD = re.compile(r"[\w.]+")


def words_of(text: str) -> list[str]:
    """Lower-case words; full stops only inside them."""
    return [x for w in WORD.findall(text.lower()) if (x := w.strip("._"))]


class Scanner:
    """The templates by classes of length, with their bands."""

    def __init__(self, templates: dict[str, str], shingle: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS, gate: bool = True):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.k, self.least, self.bands, self.gate = shingle, containment, bands, gate
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.hash = Cache(lambda w: xxhash.xxh64_intdigest(w.encode()))
        self.classes: dict[int, dict] = {}
        self.short: dict[int, dict[int, list[str]]] = {}
        for name, text in sorted(templates.items()):
            words = words_of(text)
            found = np.unique(shingles(self.hashes(words), shingle))
            if 0 < len(words) < shingle:
                self.short.setdefault(len(words), {}).setdefault(int(found[0]), []).append(name)
            elif len(found):
                group = self.classes.setdefault(max(1, 1 << (len(found) - 1).bit_length()), {"names": [], "sets": []})
                group["names"].append(name)
                group["sets"].append(found)
        self.every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(s for group in self.classes.values() for s in group["sets"])]))
        for group in self.classes.values():
            keys = [[self.minhash(s, f) for s in group["sets"]] for f in self.factors]
            group["keys"] = np.array(keys, np.uint64)
            group["every"] = np.unique(group["keys"])
            group["owners"] = [{k: [t for t, x in enumerate(row) if x == k] for k in row} for row in keys]

    def hashes(self, words: list[str]) -> np.ndarray:
        of = self.hash
        return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def minhash(found: np.ndarray, factor: np.uint64) -> int:
        return int(((found * factor) ^ (found * factor >> np.uint64(29))).min())

    def held(self, found: np.ndarray) -> np.ndarray:
        """Which of these shingles a template has; self.every is sorted."""
        if not len(self.every):
            return np.zeros(len(found), bool)
        at = np.minimum(np.searchsorted(self.every, found), len(self.every) - 1)
        return self.every[at] == found

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, end word) of the best window of each template found."""
        hashes = self.hashes(words_of(text or ""))
        found = shingles(hashes, self.k)
        n, best = len(found), {}
        for size, names in self.short.items():
            runs = shingles(hashes, size) if len(hashes) >= size else hashes[:0]
            for at in np.flatnonzero(np.isin(runs, np.array(list(names), np.uint64)))[::-1].tolist():
                best |= {name: (1.0, -at, at + size) for name in names[int(runs[at])]}
        held = self.held(found) if self.gate else np.ones(n, bool)
        if held.any():
            self.scan_windows(hashes, found, held, best)
        return [(name, share, -first, end) for name, (share, first, end) in sorted(best.items())]

    def scan_windows(self, hashes: np.ndarray, found: np.ndarray, held: np.ndarray, best: dict[str, tuple[float, int, int]]) -> None:
        """Put the best windows of the templates that are found by bands into best; windows without a held shingle share no band."""
        n = len(found)
        upto = np.concatenate([[0], np.cumsum(held)])
        candidates: set[tuple[int, int, int]] = set()
        for width, group in self.classes.items():
            step = max(1, width // 2)
            begin = np.arange(0, max(1, -(-n // step) - 2)) * step
            end = np.minimum(begin + 3 * step, n)
            windows = np.flatnonzero(upto[end] > upto[begin])
            if not len(windows):
                continue
            for some in np.array_split(windows, -(-len(windows) * 3 * step // CHUNK)):
                sizes = end[some] - begin[some]
                starts = np.cumsum(sizes) - sizes
                inside = found[np.arange(sizes.sum()) - np.repeat(starts - begin[some], sizes)]
                values = self.factors[:, None] * inside
                values ^= values >> np.uint64(29)
                least = np.minimum.reduceat(values, starts, axis=1)
                for i, w in zip(*np.nonzero(np.isin(least, group["every"])), strict=True):
                    candidates.update((width, t, int(some[w])) for t in group["owners"][i].get(int(least[i, w]), ()))
        for width, t, w in candidates:
            group, step = self.classes[width], max(1, width // 2)
            template = group["sets"][t]
            a, b = w * step, min(n, (w + 3) * step)
            inside = np.isin(found[a:b], template)
            share = len(np.unique(found[a:b][inside])) / len(template)
            if share >= self.least:
                at = a + np.flatnonzero(inside)
                hit = (share, -int(at[0]), int(at[-1]) + min(self.k, len(hashes)))
                if hit > best.get(group["names"][t], (0.0, 0, 0)):
                    best[group["names"][t]] = hit


def scan_documents(docs: DataFrame, templates: dict[str, str] = TEMPLATES, shingle: int = SHINGLE, containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """doc_id, license, containment, word_start, word_end: one row for each document and template found in it."""
    ship(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, shingle, containment, bands)
        for b in batches:
            rows = [(i, *hit) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in scanner.scan(text)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "license", "containment", "word_start", "word_end"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, containment double, word_start long, word_end long")
