"""License scans by winnowed fingerprints and banded alignment.

Templates and texts are word sequences (lower-case letters and digits). A template's k-grams
are winnowed: of every ``WINDOW`` neighbours the one with the smallest hash is kept, and an inverted
index leads from it to its places in templates. Of a template below ``SHORT`` words all pairs of
neighbours are kept: a fifth of its words may change without leaving two neighbouring k-grams
whole, while a longer one always has four words in a row left. A text's k-grams are looked up; hits of
one template on neighbouring diagonals are a candidate. In a band around the candidate's diagonal
the words are aligned (longest common subsequence), and a match reports how many of the
template's words it covers and from where to where it runs. Of overlapping matches the one with
more covered words stays.

Defined cases: a null or word-less text has no match; rows that repeat an id are scanned each;
a template repeated in a text is reported each time; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GRAM, WINDOW = 3, 2
SHORT, SHORT_GRAM = 16, 2
BAND = 8
LEAST_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

# Notices of common licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                      "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
                      "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                   "the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}


class Index:
    """Templates as word numbers, and their winnowed k-grams."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        words = [[m[0] for m in WORD.finditer(templates[n].lower())] for n in self.names]
        self.number = {w: i + 1 for i, w in enumerate(sorted(set().union(*words)))}  # 0: any other word
        self.texts = [[self.number[w] for w in t] for t in words]
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {GRAM: defaultdict(list), SHORT_GRAM: defaultdict(list)}
        for t, text in enumerate(self.texts):
            size = SHORT_GRAM if len(text) < SHORT else GRAM
            grams = self.grams(np.array(text, dtype=np.int64), size)
            for i in range(len(grams)) if len(text) < SHORT else winnowed(grams):
                self.places[size][int(grams[i])].append((t, i))
        self.known = {size: np.array(sorted(places), dtype=np.int64) for size, places in self.places.items()}

    def band(self, t: int) -> int:
        """Copies of a template are its length apart, so a band below half of it keeps them apart."""
        return min(BAND, max(1, len(self.texts[t]) // 4))

    def grams(self, ids: np.ndarray, size: int) -> np.ndarray:
        base, out = len(self.number) + 1, np.zeros(max(0, len(ids) - size + 1), dtype=np.int64)
        for k in range(size):
            out = out * base + ids[k:k + len(out)]
        return out

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(template, diagonal): one for each cluster of hits within a band."""
        by: dict[int, list[int]] = defaultdict(list)
        for size, places in self.places.items():
            grams = self.grams(ids, size)
            for i in np.flatnonzero(np.isin(grams, self.known[size])).tolist():
                for t, p in places[int(grams[i])]:
                    by[t].append(i - p)
        for t, diagonals in by.items():
            diagonals.sort()
            band = self.band(t)
            first = last = diagonals[0]
            for d in diagonals[1:]:
                if d - first > band:
                    yield t, (first + last) // 2
                    first = d
                last = d
            yield t, (first + last) // 2


def winnowed(grams: np.ndarray) -> set[int]:
    """Places of the grams with the smallest hash of ``WINDOW`` neighbours, ties to the last."""
    hashed = [zlib.crc32(int(g).to_bytes(8, "little")) for g in grams]
    return {min(range(i, min(i + WINDOW, len(hashed))), key=lambda j: (hashed[j], -j)) for i in range(max(1, len(hashed) - WINDOW + 1)) if hashed}


def apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches (covered, first, last, template) the better ones, by first word."""
    kept: list[tuple[int, int, int, int]] = []
    starts: list[int] = []  # of the kept ones, ascending; no two of them overlap
    for f in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1], f[3])):
        k = bisect(starts, f[2])  # only the last one that starts up to the end of f can reach into f
        if not k or kept[k - 1][2] < f[1]:
            starts.insert(k, f[1])
            kept.insert(k, f)
    return kept


def align(template: list[int], ids: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(covered, first, last): words of the template in the best common subsequence in the
    band around the diagonal, and the places of its first and last word; ties to the
    shortest span."""
    width = 2 * band + 1
    best = [(0, 0, -1, -1)] * width  # covered, minus span, first, last; per place in the band
    for i, w in enumerate(template):
        new: list[tuple[int, int, int, int]] = []
        for k in range(width):
            j = i + diagonal + k - band
            choices = [best[k + 1] if k + 1 < width else (0, 0, -1, -1)]  # word of the template left out
            if k:
                choices.append(new[k - 1])  # word of the text left out
            if 0 <= j < len(ids) and ids[j] == w:
                n, _, first, _ = best[k]
                first = j if first < 0 else first
                choices.append((n + 1, first - j, first, j))
            new.append(max(choices, key=lambda c: (c[0], c[1])))
        best = new
    covered, _, first, last = max(best, key=lambda c: (c[0], c[1]))
    return covered, first, last


def scan(text: str | None, index: Index, least: float = LEAST_COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """(license, first character, character after the last, covered words, coverage)."""
    words = list(WORD.finditer(text.lower())) if text else []
    get = index.number.get
    ids = [get(m[0], 0) for m in words]
    if not any(ids):
        return []
    found = []
    for t, diagonal in index.candidates(np.array(ids, dtype=np.int64)):
        covered, first, last = align(index.texts[t], ids, diagonal, index.band(t))
        if covered >= least * len(index.texts[t]):
            found.append((covered, first, last, t))
    return [(index.names[t], words[a].start(), words[b].end(), n, n / len(index.texts[t])) for n, a, b, t in apart(found)]


def matches(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, span_start, span_end, n_matched, coverage."""
    chosen = templates or TEMPLATES
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "license", "span_start", "span_end", "n_matched", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        for b in batches:
            rows = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for m in scan(t.as_py(), index, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, license string, span_start long, span_end long, n_matched long, coverage double")
