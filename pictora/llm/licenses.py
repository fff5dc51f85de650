"""License scans: winnowed template fingerprints, an inverted index, and banded alignment.

Texts are sequences of lower-cased words of ASCII letters and digits. Each template is cut into ``GRAM``-word grams of which winnowing
keeps one minimum in every ``WINDOW`` consecutive ones; an inverted index maps a kept gram to the templates and places
it stands in. Every gram of a document is looked up, so a passage of ``GRAM + WINDOW - 1`` template words always makes a
candidate. A candidate (template, diagonal) is aligned in a band around its diagonal; the alignment reports how much of the
template is covered, the span of the document's words it covers, and the share of the words within that span that agree.

The templates are a fixed set of short notices, so the index is a constant that goes out with the code.

Defined cases: null and empty texts match nothing; texts of any length are scanned whole; repeated rows are scanned each;
one document may match several templates (of templates that tie each is
reported), and one template several times in disjoint spans, adjoining ones included; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 3
WINDOW = 2
BAND = 12
LEAST_COVERAGE = 0.8

#: Notices by which well-known licenses are applied or named in texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(rb"[a-z0-9]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the rightmost minimum of each window; the only minimum of a sequence that is shorter than a window."""
    if not hashes:
        return []
    kept = set()
    for at in range(max(1, len(hashes) - window + 1)):
        part = hashes[at : at + window]
        kept.add(at + max(k for k, h in enumerate(part) if h == min(part)))
    return sorted(kept)


class Index:
    """The templates, a vocabulary, and the inverted index of winnowed grams."""

    def __init__(self, templates: Mapping[str, str]):
        self.names = list(templates)
        texts = [words_of(t.encode()) for t in templates.values()]
        self.ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.texts = [np.array([self.ids[w] for w in t], np.int64) for t in texts]
        self.base = len(self.ids) + 1
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.texts):
            grams = self.grams(t)
            for at in winnow([hash((int(g), 7)) for g in grams]):
                self.places[int(grams[at])].append((k, at))
        self.known = np.array(sorted(self.places), np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """The number that stands for each gram; negative if a word of it is in no template."""
        n = max(0, len(ids) - GRAM + 1)
        out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in range(GRAM):
            out = out * self.base + ids[k : k + n]
            bad |= ids[k : k + n] < 0
        return np.where(bad, -1, out)

    def scan(self, text: bytes) -> list[tuple[str, float, float, int, int]]:
        """(template, coverage, agreement, first word, end word) of each match."""
        get = self.ids.get
        found = [get(w, -1) for w in words_of(text)]
        ids = np.array(found, np.int64)
        grams = self.grams(ids)
        hits = np.flatnonzero(np.isin(grams, self.known) & (grams >= 0))
        if not len(hits):
            return []
        by_template: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in hits.tolist():
            for template, place in self.places[int(grams[at])]:
                by_template[template].append((at, at - place))
        return [(self.names[template], *match) for template, found in by_template.items() for match in self._matches(self.texts[template], ids, found)]

    @staticmethod
    def _matches(template: np.ndarray, ids: np.ndarray, found: list[tuple[int, int]]) -> Iterator[tuple[float, float, int, int]]:
        """Disjoint matches of one template, from its hits (place in the text, shift) in the order of the text.

        A hit within what is reported is done. Each other one is aligned with the words after that. If the best match in the band doesn't hold
        the hit but lies after it, the words before it are tried as well; that match is then found by its own hits. A diagonal
        near one that gave nothing is not aligned again.
        """
        done, failed = 0, None
        for at, shift in found:
            if at < done or (failed is not None and abs(shift - failed) <= BAND // 2):
                continue
            end = len(ids)
            while (match := align(template, ids[done:end], shift - done)) and match[2] + done > at:
                end = match[2] + done
            if match and match[0] >= LEAST_COVERAGE:
                yield match[0], match[1], match[2] + done, match[3] + done
                done, failed = match[3] + done, None
            elif end == len(ids):
                failed = shift


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[float, float, int, int] | None:
    """Align the whole template with the text's words around ``shift``, leaving words out on either side at a cost.

    Among diagonals shift - band to shift + band; the template's words that agree count 1, a substitution, and each word left out
    in either, costs one. Returns coverage, agreement, and the span of the text.
    """
    m, width = len(template), 2 * band + 1
    low = -(10**6)
    at = np.arange(width) + shift - band
    score = np.zeros(width, np.int64)  # the alignment may begin anywhere in the band
    start, agree = at.copy(), np.zeros(width, np.int64)
    for i in range(m):
        column = at + i
        inside = (column >= 0) & (column < len(text))
        same = inside & (text[np.clip(column, 0, len(text) - 1)] == template[i])
        best = score + np.where(same, 1, -1)
        begin, count = start, agree + same
        # A template word left out: from one diagonal to the right (the text stays where it is).
        skipped = np.r_[score[1:], low] - 1
        take = skipped > best
        best, begin, count = np.where(take, skipped, best), np.where(take, np.r_[start[1:], 0], begin), np.where(take, np.r_[agree[1:], 0], count)
        # Text words left out: runs to the right along the row.
        for k in range(1, width):
            if best[k - 1] - 1 > best[k]:
                best[k], begin[k], count[k] = best[k - 1] - 1, begin[k - 1], count[k - 1]
        score, start, agree = best, begin, count
    k = int(np.lexsort((np.abs(at - shift), -score))[0])
    first, end = max(0, int(start[k])), min(len(text), int(at[k]) + m)
    if end <= first or not agree[k]:
        return None
    return float(agree[k]) / m, float(agree[k]) / max(m, end - first), first, end


def _scanner(templates: Mapping[str, str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) if (text := t.as_py()) for m in index.scan(text)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "license", "coverage", "agreement", "start_word", "end_word"])

    return scan


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """``(doc_id, license, coverage, agreement, start_word, end_word)``: one row for each match in ``docs(doc_id, text)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scanner(dict(templates or TEMPLATES)), "doc_id long, license string, coverage double, agreement double, start_word long, end_word long")
