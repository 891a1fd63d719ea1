"""License scans: winnowed fingerprints of templates, confirmed by banded alignment.

Texts and templates are words of letters and digits, lower case. Runs of GRAM words are
hashed; of every WINDOW hashes in a row the smallest is a fingerprint, so any GRAM + WINDOW - 1
words in common share one. The fingerprints of the templates form an inverted index, which is
bounded by the templates and goes to every task. Where a document's fingerprints meet those
of a template on about one diagonal, the words there are aligned within a band of BAND words
around it, and the match is reported if it covers enough of the template.

Defined results: null or empty text has no match; an empty list of templates matches nothing;
repeated rows are scanned each; of matches that overlap in a document the one with more
matched words stays, on a tie the one of higher coverage, then of the first name. Further columns
of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import tokens
from gazette.llm.tables import table

GRAM, WINDOW, BAND = 3, 2, 8
COVERAGE = 0.8
#: The index goes to every task, so templates may hold so many words in all.
MOST_WORDS = 1_000_000

# Public license notices by which licensed text is marked.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a run of words and the word at which each begins."""
    g = tokens.chained(h, GRAM)
    if not len(g):
        return g, np.zeros(0, np.int64)
    padded = np.concatenate([g, np.full(WINDOW - 1, np.iinfo(np.uint64).max, np.uint64)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[: max(1, len(g) - WINDOW + 1)]
    # the rightmost smallest of each window
    at = np.unique(np.arange(len(rows)) + WINDOW - 1 - np.argmin(rows[:, ::-1], axis=1))
    return g[at], at


def aligned(doc: np.ndarray, template: np.ndarray, shift: int) -> tuple[int, int, int]:
    """Words matched, first and last-plus-one matched word of ``doc``.

    Longest common subsequence within BAND words of the diagonal on which word ``i`` of the
    template stands at ``i + shift``; among equal ones the narrowest.
    """
    best: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - BAND), min(len(doc), i + shift + BAND + 1)):
            options = [best.get(j, (0, 0, 0)), row.get(j - 1, (0, 0, 0))]
            if doc[j] == word:
                n, start, _ = best.get(j - 1, (0, 0, 0))
                options.append((n + 1, start if n else j, j + 1))
            row[j] = max(options, key=lambda o: (o[0], o[1] - o[2]))
        best = row
    return max(best.values(), key=lambda o: (o[0], o[1] - o[2]), default=(0, 0, 0))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = list(templates)
        h, at = tokens.hashed(pa.array(list(templates.values()), pa.large_string()), blank=tokens.SIGNS)
        if len(h) > MOST_WORDS:
            raise ValueError(f"{len(h)} words of templates; the limit is {MOST_WORDS}")
        self.words = [h[at[i] : at[i + 1]] for i in range(len(self.names))]
        marks = [(*winnowed(w), i) for i, w in enumerate(self.words)]
        keys = np.concatenate([m[0] for m in marks]) if marks else np.zeros(0, np.uint64)
        by = np.argsort(keys, kind="stable")
        self.keys = keys[by]
        self.template = np.concatenate([np.full(len(m[0]), m[2]) for m in marks])[by] if marks else np.zeros(0, int)
        self.place = np.concatenate([m[1] for m in marks])[by] if marks else np.zeros(0, int)

    def matches(self, h: np.ndarray, coverage: float) -> list[tuple[str, float, int, int, int]]:
        """Name, coverage, matched words, first and last-plus-one word of each match in a text."""
        # every run is looked up at first, which costs one search; only hits are winnowed and aligned
        g = tokens.chained(h, GRAM)
        if not len(g) or not len(self.keys):
            return []
        spot = np.searchsorted(self.keys, g)
        if not (self.keys[np.minimum(spot, len(self.keys) - 1)] == g).any():
            return []
        prints, at = winnowed(h)
        low, high = np.searchsorted(self.keys, prints), np.searchsorted(self.keys, prints, "right")
        found = []
        seen: set[tuple[int, int]] = set()
        for i in np.flatnonzero(high > low):
            for j in range(low[i], high[i]):
                name, shift = int(self.template[j]), int(at[i] - self.place[j])
                if any((name, shift + d) in seen for d in range(-(BAND // 2), BAND // 2 + 1)):
                    continue
                seen.add((name, shift))
                n, a, b = aligned(h, self.words[name], shift)
                if n >= coverage * len(self.words[name]):
                    found.append((self.names[name], n / len(self.words[name]), n, a, b))
        found.sort(key=lambda m: (-m[2], -m[1], m[0], m[3]))
        kept: list[tuple] = []
        for m in found:
            if all(m[4] <= o[3] or m[3] >= o[4] for o in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m[3])


MATCHES = "doc_id long, license string, coverage double, n_matched int, start_word long, end_word long, start_byte long, end_byte long"


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Matches of templates in the whole texts of ``docs`` (doc_id, text), with spans in words and UTF-8 bytes."""
    templates = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            h, at = tokens.hashed(batch.column(1), blank=tokens.SIGNS)
            rows = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                for name, share, n, a, b in index.matches(h[at[i] : at[i + 1]], coverage):
                    data, ends = tokens.raw(batch.column(1).slice(i, 1))
                    starts, stops, _ = tokens.spans(data, ends, tokens.SIGNS)
                    rows.append((doc, name, share, n, a, b, int(starts[a]), int(stops[b - 1])))
            names = [c.split()[0] for c in MATCHES.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), *[pa.int64()] * 4]
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, MATCHES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of a license notice in every document."""
    return scanned(table(spark, sf_dir, "documents"))
