"""Licence texts and notices in documents: winnowed fingerprints and counted words pick candidates, banded alignment decides.

Every template's three-word fingerprints are winnowed (of each four in a row the smallest stays) into an inverted index.
Fingerprints of a document that are in the index propose a template and a place. Winnowing is only sure to keep one of
six equal words in a row, which a changed notice of few words need not have, and one changed word in the middle of five
leaves no three in a row at all. So a place is also proposed wherever a template's length and ``BAND`` words more hold as
many words of the template as must match. Hits on nearby diagonals are one candidate. A candidate is aligned with its
template, word by word, inside a band around the diagonal, and reported with the share of the template's words that match
and its span if that share is large enough. Whole copies come first, each as its own place; the words of a reported place
are taken, and the candidate is aligned again with what is left until too little is, so copies close by are all reported.

What can still be missed is a place with more than ``BAND`` words put in or taken out after its first matching word, if
no kept fingerprint stands near enough to its middle, and one so broken up that its best local alignment and the words in
place beside that are too few.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from txlake.llm.schema_guard import pick
from txlake.llm.text_hash import chunks, window_owner, windows, words

GRAM = 3
WINNOW = 4
COVERAGE = 0.8
BAND = 8

# Notices and short licence texts as their publishers word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
}

_RESULT = "doc_id long, template string, coverage double, matched long, first_byte long, end_byte long"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("template", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()),
    ("first_byte", pa.int64()), ("end_byte", pa.int64())])
_PLAIN = bytes(0x20 if chr(n) in string.punctuation else ord(chr(n).lower()) if n < 128 else n for n in range(256))


def plain(text: str | None) -> bytes:
    """Lower-case ASCII letters and spaces for punctuation; every byte stays in its place."""
    return (text or "").encode().translate(_PLAIN)


def winnow(fingerprints: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Places of the smallest fingerprint, the last of equals, of every ``window`` in a row; of fewer, of all."""
    if len(fingerprints) <= window:
        return np.array([len(fingerprints) - 1 - np.argmin(fingerprints[::-1])]) if len(fingerprints) else np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(fingerprints, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], 1))


class Index:
    """Winnowed fingerprints of all templates, sorted: of each the template and the place in it. Also all their words, and
    of each template how many must match."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        _, _, hashes, first = words([plain(templates[name]) for name in self.names] or [b""])
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        grams = [windows(w, GRAM) for w in self.words]
        chosen = [winnow(g) for g in grams]
        fingerprints = np.concatenate([g[c] for g, c in zip(grams, chosen)]) if grams else np.zeros(0, np.uint64)
        owners, places = np.repeat(np.arange(len(grams)), [len(c) for c in chosen]), np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        order = np.argsort(fingerprints, kind="stable")
        self.fingerprints, self.owners, self.places = fingerprints[order], owners[order], places[order]
        self.vocabulary = np.unique(hashes)
        self.bags = [Counter(w.tolist()) for w in self.words]
        self.needed = [max(1, math.ceil(coverage * len(w) - 1e-9)) for w in self.words]

    def by_fingerprint(self, hashes: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document, template and word at which the template would start, of every kept fingerprint that is found."""
        if not len(self.fingerprints):
            return []
        places, docs = window_owner(begins, GRAM)
        grams = windows(hashes, GRAM)[places]
        low = np.searchsorted(self.fingerprints, grams)
        hit = np.flatnonzero(self.fingerprints[np.minimum(low, len(self.fingerprints) - 1)] == grams)
        low = low[hit]
        counts = np.searchsorted(self.fingerprints, grams[hit], side="right") - low
        at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return [(np.repeat(docs[hit], counts), self.owners[at], np.repeat(places[hit], counts) - self.places[at])]

    def by_words(self, hashes: np.ndarray, begins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of every word that may be the first to match, as enough words of the template follow soon enough."""
        if not len(self.vocabulary):
            return []
        numbers = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        places = np.flatnonzero(self.vocabulary[numbers] == hashes)
        numbers = numbers[places]
        docs = np.searchsorted(begins, places, side="right") - 1
        found = []
        for owner, (template, needed) in enumerate(zip(self.words, self.needed)):
            if len(template) < GRAM:
                continue
            wanted = np.searchsorted(self.vocabulary, template)
            mine = np.flatnonzero(np.isin(np.arange(len(self.vocabulary)), wanted)[numbers])
            first, last = mine[:max(0, len(mine) - needed + 1)], mine[needed - 1:]
            first = first[(places[last] - places[first] < len(template) + BAND) & (docs[last] == docs[first])]
            for n in range(len(template) - needed + 1 if len(first) else 0):
                at = first[numbers[first] == wanted[n]]
                found.append((docs[at], np.full(len(at), owner), places[at] - n))
        return found

    def candidates(self, hashes: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """Document, template, and the words of the document at which the template may start, for each group of nearby
        diagonals."""
        parts = self.by_fingerprint(hashes, begins) + self.by_words(hashes, begins)
        if not parts:
            return []
        docs, owners, starts = (np.concatenate(p) for p in zip(*parts))
        starts = starts - begins[docs]
        found: list[tuple[int, int, list[int]]] = []
        for n in np.lexsort((starts, owners, docs)):
            doc, owner, start = int(docs[n]), int(owners[n]), int(starts[n])
            if found and found[-1][:2] == (doc, owner) and start - found[-1][2][-1] <= BAND // 2 and start - found[-1][2][0] <= BAND:
                found[-1][2].append(start)
            else:
                found.append((doc, owner, [start]))
        return found


def align(template: np.ndarray, document: list[int | None], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with the document's words, of which the template's first lies between ``low`` and ``high``
    give or take ``BAND``: number of equal words, first word, and the one after the last.

    None in the document equals no word. Equal words score 2, others and gaps -1; of equal scores the one with more equal words wins, then the earliest end.
    Beyond either end, words of the template that stand in place, with no word put in or left out, are equal words too.
    """
    low, high = low - BAND, high + BAND
    width, size = high - low + 1, len(document)
    empty = (0, 0, -1, 0)  # score, equal words, first word, its place in the template
    before, best, end, last = [empty] * (width + 1), empty, 0, 0
    wanted = template.tolist()
    for i, word in enumerate(wanted):
        row = [empty] * (width + 1)
        for k in range(width):
            j = low + i + k
            if j < 0 or j >= size:
                continue
            score, equal, first, place = before[k]
            same = document[j] == word
            cell = (score + 2, equal + 1, *((j, i) if first < 0 else (first, place))) if same else (score - 1, equal, first, place)
            for other in (before[k + 1], row[k - 1] if k else empty):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] > 0:
                row[k] = cell
                if cell[:2] > best[:2]:
                    best, end, last = cell, j + 1, i + 1
        before = row
    _, equal, first, place = best
    if not equal:
        return 0, 0, 0
    start, stop = first, end
    for i in range(place):
        j = start - place + i
        if 0 <= j and document[j] == wanted[i]:
            equal, first = equal + 1, min(first, j)
    for i in range(last, len(wanted)):
        j = stop - last + i
        if j < size and document[j] == wanted[i]:
            equal, end = equal + 1, j + 1
    return equal, first, end


def places(index: Index, hashes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """Document, template, first word, the one after the last, and number of equal words of every place."""
    for (n, owner), group in groupby(index.candidates(hashes, begins), lambda c: c[:2]):
        template, needed, bag = index.words[owner], index.needed[owner], index.bags[owner]
        size, begin, stop = len(template), int(begins[n]), int(begins[n + 1])
        group, free = list(group), np.ones(stop - begin, bool)
        for start in sorted({s for c in group for s in c[2]}):
            if start >= 0 and np.array_equal(hashes[begin + start:min(stop, begin + start + size)], template):
                free[start:start + size] = False
                yield n, owner, begin + start, begin + start + size, size
        for _, _, starts in group:
            left, right = max(0, starts[0] - 2 * BAND), min(stop - begin, starts[-1] + size + 2 * BAND)
            while True:
                there = [w if f else None for w, f in zip(hashes[begin + left:begin + right].tolist(), free[left:right].tolist())]
                if (Counter(there) & bag).total() < needed:
                    break  # no alignment can match more words than there are
                matched, x, y = align(template, there, starts[0] - left, starts[-1] - left)
                if matched < needed:
                    break
                free[left + x:left + y] = False
                yield n, owner, begin + left + x, begin + left + y, matched


def licences(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for every place of a document at which at least ``coverage`` of a template's words stand in order, as far as
    its best alignment tells (see above for what that can miss).

    ``template``, ``coverage``, ``matched`` words, and the span in bytes of the UTF-8 text. Words are runs of other than
    ASCII white space and punctuation, ASCII letters in lower case. Templates are a parameter of fixed size; those of
    fewer than three words match nothing. A shorter template inside a longer one is reported beside it. Null and empty
    texts give no row; null ids are kept; repeated rows repeat; other columns are ignored.
    """
    index = Index(TEMPLATES if templates is None else templates, coverage)

    def work(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, held in chunks(map(plain, batch.column(1).to_pylist())):
                starts, ends, hashes, begins = words(held)
                offsets = np.cumsum([0, *(len(t) + 1 for t in held)])
                for n, owner, x, y, matched in places(index, hashes, begins):
                    out.append((
                        ids[first + n], index.names[owner], matched / len(index.words[owner]), matched,
                        int(starts[x] - offsets[n]), int(ends[y - 1] - offsets[n])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)

    return pick(docs, doc_id="long", text="string").mapInArrow(work, _RESULT)
