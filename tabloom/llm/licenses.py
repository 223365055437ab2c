"""License notices in documents: winnowed fingerprints find candidates, alignment measures them.

Templates are cut into words; of every window of neighbouring word shingles the smallest hash is kept,
and these fingerprints point into an inverted index of (template, place). In a document all shingles
are looked up, so whatever shares ``SHINGLE + WINDOW - 1`` words in a row with a template is a candidate.
Of a template of at most ``SHORT`` words, one word more than a match may lack is indexed by itself, so
every match holds one of them. A banded alignment of the template around the diagonal of a hit gives
the matched words, the coverage of the template and the span in the document; after a match the search
goes on behind it. Short templates are first aligned in a band of a quarter of their length, so that
neighbouring notices do not mix, then what is left between those in the whole band.

Templates are few and short, so the index goes to every task, and documents never shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tabloom.llm.common import map_batches, type_of

SHINGLE = 3
WINDOW = 2
BAND = 8  # words that an alignment may be shifted against its diagonal
COVERAGE = 0.8
SHORT = 12  # words of templates of which single words are indexed
COMMON = frozenset("a and are as at by for in is it of on or that the this to under with work".split())  # indexed last
WORD = re.compile(r"[A-Za-z0-9]+")

# Notices that licenses ask to be put on a work.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "mit-short": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions"
    ),
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"
    ),
}


@dataclass(frozen=True)
class Index:
    names: list[str]
    words: list[list[str]]
    places: dict[int, list[tuple[int, int]]]  # fingerprint -> (template, place)
    vocabulary: frozenset[str]  # words of shingles that are indexed
    single: dict[str, list[tuple[int, int]]]  # word that is indexed by itself -> (template, place)


def _hash(words: list[str]) -> int:
    return xxh64_intdigest(" ".join(words).encode())


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash of each window, the last of equals; of a short list, its smallest."""
    if not hashes:
        return []
    chosen = set()
    for a in range(max(1, len(hashes) - window + 1)):
        part = hashes[a : a + window]
        low = min(part)
        chosen.add(a + max(i for i, h in enumerate(part) if h == low))
    return sorted(chosen)


def build_index(templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> Index:
    names = sorted(templates)
    words = [WORD.findall(templates[n].lower()) for n in names]
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    vocabulary = set()
    single: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for t, w in enumerate(words):
        if len(w) < SHINGLE:
            raise ValueError(f"template {names[t]} has fewer than {SHINGLE} words")
        if len(w) <= SHORT:
            lacks = len(w) - ceil(coverage * len(w) - 1e-9)
            order = sorted(range(len(w)), key=lambda i: (w[i] in COMMON, -len(w[i]), i))
            for i in order[: lacks + 1]:
                single[w[i]].append((t, i))
            continue
        hashes = [_hash(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]
        for i in winnow(hashes):
            places[hashes[i]].append((t, i))
            vocabulary.update(w[i : i + SHINGLE])
    return Index(names, words, dict(places), frozenset(vocabulary), dict(single))


def align(template: list[str], region: list[str], shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most template words matched in order inside the band, and the first and last matched place of the region.

    Place i of the template may meet place i + shift + d of the region for d from -band to band. Of
    equally good alignments the one with the shortest span counts, then the leftmost.
    """
    width = 2 * band + 1
    none = (0, 0, 0)  # matched, minus span, minus first place
    before: list[tuple[int, int, int]] = [none] * (width + 1)
    for i, word in enumerate(template):
        row = [none] * (width + 1)
        left = none
        for d in range(width):
            j = i + shift + d - band
            best = max(left, before[d + 1])  # skip a word of the region, or of the template
            if 0 <= j < len(region) and region[j] == word:
                n, _, first = before[d]
                start = j if n == 0 else -first
                best = max(best, (n + 1, start - j, -start))
            row[d] = left = best
        before = row
    n, span, first = max(before)
    return n, -first, -first - span


class Finder:
    def __init__(self, index: Index, coverage: float, band: int):
        self.index, self.coverage, self.band = index, coverage, band

    def _match(self, words: list[str], t: int, shift: int, band: int, low: int, high: int) -> tuple[int, int, int]:
        """Matched words, first and last place of the best alignment around a diagonal between two places."""
        template = self.index.words[t]
        low, high = max(low, shift - band), min(high, shift + len(template) + band)
        n, first, last = align(template, words[low:high], shift - low, band)
        return n, low + first, low + last

    def _scan(
        self, words: list[str], t: int, hits: list[tuple[int, int]], band: int, low: int, high: int, begin: int = 0
    ) -> list[tuple[int, int, int, int]]:
        """Matches (first, last, n, diagonal) that do not overlap, between two places, around the hits from ``begin``.

        Hits (place, diagonal) are in order of place.
        """
        out, tried, least = [], set(), self.coverage * len(self.index.words[t]) - 1e-9
        for k in range(max(begin, bisect_left(hits, (low,))), bisect_left(hits, (high,))):
            at, shift = hits[k]
            if at < low or shift in tried:
                continue
            n, first, last = self._match(words, t, shift, band, low, high)
            if n < least:
                tried.add(shift)
                continue
            # What stands before the match may be one too; its hits come again.
            if first > at:
                out += self._scan(words, t, hits, band, low, first, k)
            out.append((first, last, n, shift))
            low = last + 1
            tried.clear()
        return out

    def _matches(self, words: list[str], t: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        size = len(self.index.words[t])
        narrow = min(self.band, max(1, size // 4))
        found = self._scan(words, t, hits, narrow, 0, len(words))
        if narrow == self.band:
            return found
        out, low = [], 0
        for k, (first, last, n, shift) in enumerate(found):
            high = found[k + 1][0] if k + 1 < len(found) else len(words)
            if n < size:  # words may have been put in between
                wide = self._match(words, t, shift, self.band, low, high)
                n, first, last = wide if wide[0] > n else (n, first, last)
            out += self._scan(words, t, hits, self.band, low, first)
            out.append((first, last, n, shift))
            low = last + 1
        return out + self._scan(words, t, hits, self.band, low, len(words))

    def find(self, text: str) -> list[dict]:
        """Matches of a text: license, matched words, coverage, start and end (code points, end exclusive)."""
        spans, words = [], []
        for m in WORD.finditer(text):
            spans.append(m.span())
            words.append(m.group().lower())
        known, places, single = self.index.vocabulary, self.index.places, self.index.single
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        run = 0
        for i, w in enumerate(words):
            if w in single:
                for t, place in single[w]:
                    hits[t].append((i, i - place))
            run = run + 1 if w in known else 0
            if run >= SHINGLE:
                at = i - SHINGLE + 1
                for t, place in places.get(_hash(words[at : i + 1]), ()):
                    hits[t].append((at, at - place))
        found = []
        for t, some in hits.items():
            for first, last, n, _ in self._matches(words, t, sorted(some)):
                found.append((spans[first][0], spans[last][1], t, n))
        # A notice inside a longer one that was found too is no finding of its own; of equals the more covered counts.
        found.sort(key=lambda f: (f[0], -f[1], -f[3], len(self.index.words[f[2]]), f[2]))
        out, end = [], -1
        for start, stop, t, n in found:
            if stop > end:
                end = stop
                name = self.index.names[t]
                out.append({"license": name, "start": start, "end": stop, "matched": n, "coverage": n / len(self.index.words[t])})
        return out


def find_licenses(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, band: int = BAND, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_licenses (long), licenses (array of license, start, end, matched, coverage).

    Matches cover at least ``coverage`` of their template and stand in order of their start; words
    compare as letters and digits in any case. Null and empty texts have none. A null or repeated
    doc_id is passed on; other columns are not read. Whole texts are searched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(build_index(templates, coverage))  # the templates' words

    def start():
        finder = Finder(shared.value, coverage, band)

        def each(batch):
            found = [finder.find(t) if t else [] for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "n_licenses": [len(f) for f in found], "licenses": found}

        return each

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = "array<struct<license:string,start:long,end:long,matched:long,coverage:double>>"
    return map_batches(picked, f"doc_id {type_of(picked, 'doc_id')}, n_licenses long, licenses {kind}", start)
