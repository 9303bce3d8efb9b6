"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Templates of about one length share a window size, a quarter longer than the
longest of them. A template is found where a window at any word holds the accepted
share of it. Candidates come from longer stretches, at a step at which any window lies
wholly in some stretch. Bands of one MinHash value each are as many as it takes for a
stretch that holds the least accepted share of a template to collide in some band with
probability RECALL. A candidate is verified in every window of its stretch.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm import common
from tilewright.llm.decontaminate import words_of

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Bound of all templates together, in characters: they are sent to every task.
TEMPLATE_CHARS = 1 << 20

# fixed values: usual license statements and notices, by short name
TEMPLATES: list[tuple[str, str]] = [
    ("afl-3.0", "Licensed under the Academic Free License version 3.0"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("apache-2.0-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0."),
    ("bsd-2-conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd-3-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-disclaimer", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-nd-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0-notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-sa-3.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa-text", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cddl-1.0", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License"). You may not use this file except in compliance with the License.'),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("eupl-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL"),
    ("gfdl-notice", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("gpl-2.0-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("lgpl-2.1-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License."),
    ("mit-conditions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-disclaimer", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-notice", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("mpl-1.1-notice", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.'),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("public-domain", "This work has been released into the public domain."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("wtfpl", "This program is free software. It comes without any warranty, to the extent permitted by applicable law."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-permission", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_size(words: int) -> int:
    return min(SHINGLE, words)


def ladder(words: int) -> int:
    """The longest template length that shares a class with ``words``: steps of a quarter above SHINGLE."""
    top = SHINGLE
    while top < words:
        top = max(top + 1, top * 5 // 4)
    return words if words < SHINGLE else top


def bands_for(shortest: int, window: int, size: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Bands at which a window with the accepted share of the class's shortest template collides with the target probability.

    The worst likeness is the accepted shingles over the window's and the missing ones.
    """
    own, other = shortest - size + 1, window - size + 1
    need = math.ceil(threshold * own - 1e-9)
    likeness = need / (other + own - need)
    return 1 if likeness >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - likeness))


@dataclass
class Class:
    """Templates of about one length: verified at windows ``stride`` apart, sought in stretches of ``reach`` words ``step`` apart."""

    size: int
    window: int
    stride: int
    reach: int
    step: int
    least: int
    bands: int
    seeds: np.ndarray
    members: list[tuple[str, frozenset]]
    buckets: list[dict[int, list[int]]]
    grams: np.ndarray


@dataclass
class Index:
    """Templates by class, and hashes of words seen lately."""

    classes: list[Class]
    grams: dict[int, np.ndarray]
    known: dict[bytes, int]

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str]], threshold: float = THRESHOLD) -> Index:
        if sum(len(t or "") for _, t in templates) > TEMPLATE_CHARS:
            raise ValueError("templates of one index are sent to every task and may not exceed TEMPLATE_CHARS; scan_documents takes them in parts")
        grouped: dict[int, dict[tuple[bytes, ...], str]] = {}
        for name, text in sorted(templates, key=lambda t: (t[0], t[1] or "")):
            words = tuple(words_of(text or ""))
            if words:
                grouped.setdefault(ladder(len(words)), {}).setdefault(words, name)
        classes = []
        for longest, members in sorted(grouped.items()):
            shortest = min(map(len, members))
            size = shingle_size(shortest)
            window = longest + (longest // 4 if longest > SHINGLE else 0)
            # a stretch holds the windows at ``step`` words; longer steps need more bands for fewer stretches
            step = 2 * (window - longest + 1) if window > longest else 1
            reach = window + step - 1
            bands = bands_for(shortest, reach, size, threshold)
            seeds = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            buckets: list[dict[int, list[int]]] = [{} for _ in range(bands)]
            own, grams = [], []
            for number, (words, name) in enumerate(members.items()):
                own.append((name, frozenset(words[i : i + size] for i in range(len(words) - size + 1))))
                grams.append(hashes(words, size))
                for band, value in enumerate(minima(grams[-1], seeds)):
                    buckets[band].setdefault(int(value), []).append(number)
            least = min(math.ceil(threshold * len(t) - 1e-9) for _, t in own)
            classes.append(Class(size, window, 1, reach, step, least, bands, seeds, own, buckets, np.unique(np.concatenate(grams))))
        grams = {size: np.unique(np.concatenate([c.grams for c in classes if c.size == size])) for size in {c.size for c in classes}}
        return cls(classes, grams, {})

    #: Words whose hashes are kept; beyond it they are gathered anew.
    KEPT = 400_000

    def word_hashes(self, words: Sequence[bytes]) -> np.ndarray:
        if len(self.known) > self.KEPT:
            self.known.clear()
        get = self.known.get
        return np.array([get(w) or self._hash(w) for w in words], np.uint64)

    def _hash(self, word: bytes) -> int:
        h = self.known[word] = hash_word(word)
        return h


def parts_of(templates: Sequence[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Templates in runs of at most TEMPLATE_CHARS; at least one run."""
    parts: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, text in templates:
        if parts[-1] and size + len(text or "") > TEMPLATE_CHARS:
            parts.append([])
            size = 0
        parts[-1].append((name, text))
        size += len(text or "")
    return parts


def hashes(words: Sequence[bytes], size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words."""
    return runs_of(np.array([hash_word(w) for w in words], np.uint64), size)


def runs_of(own: np.ndarray, size: int) -> np.ndarray:
    """Hashes of runs of ``size`` words from the words' own."""
    n = max(0, len(own) - size + 1)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mix(total + own[k : k + n])
    return total


def hash_word(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def minima(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    return _mix(shingles[:, None] ^ seeds).min(axis=0)


def verified(words: list[bytes], low: int, high: int, window: int, size: int, template: frozenset, threshold: float) -> list[tuple[int, int, float]]:
    """(first word, end word, containment) of each run of accepted windows that start from ``low`` to ``high``.

    A run counts as its fullest windows, cut to the template's shingles in them.
    """
    shingles = max(1, min(window, len(words)) - size + 1)
    own = [gram if (gram := tuple(words[i : i + size])) in template else None for i in range(low, high + shingles)]
    at = [low + i for i, gram in enumerate(own) if gram is not None]
    counts: dict[tuple[bytes, ...], int] = {}
    for gram in own[: shingles - 1]:
        if gram is not None:
            counts[gram] = counts.get(gram, 0) + 1
    runs: list[tuple[int, list[tuple[int, int]]]] = []
    before = None
    for start in range(low, high + 1):
        gram = own[start - low + shingles - 1]
        if gram is not None:
            counts[gram] = counts.get(gram, 0) + 1
        if len(counts) / len(template) >= threshold:
            a, b = bisect_left(at, start), bisect_left(at, start + shingles)
            span = at[a], at[b - 1] + size
            if before != start - 1:
                runs.append((0, []))
            most, spans = runs[-1]
            if len(counts) > most:
                runs[-1] = len(counts), [span]
            elif len(counts) == most:
                spans.append(span)
            before = start
        gram = own[start - low]
        if gram is not None:
            counts[gram] -= 1
            if not counts[gram]:
                del counts[gram]
    return [(min(a for a, _ in spans), max(b for _, b in spans), most / len(template)) for most, spans in runs]


def scan_words(words: list[bytes], index: Index, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(template, first word, end word, containment) of each verified run of windows."""
    found: dict[str, list[tuple[int, int, float]]] = {}
    own = index.word_hashes(words)
    shingles = {size: runs_of(own, size) for size in index.grams}
    met = {size: bool(len(x)) and bool(among(x, index.grams[size]).any()) for size, x in shingles.items()}
    for c in index.classes:
        if not met[c.size]:
            continue
        # a stretch with fewer of the templates' shingles than are accepted holds no accepted window
        runs = among(shingles[c.size], c.grams)
        if runs.sum() < c.least:
            continue
        before = np.concatenate([[0], np.cumsum(runs)])
        last = max(0, len(words) - c.window)
        starts = np.arange(0, last + 1, c.step)
        starts = starts[before[np.minimum(starts + c.reach - c.size + 1, len(runs))] - before[starts] >= c.least]
        tried: dict[int, list[int]] = {}
        for start in starts.tolist():
            values = minima(shingles[c.size][start : max(start + 1, start + c.reach - c.size + 1)], c.seeds)
            for n in {n for band, value in enumerate(values.tolist()) for n in c.buckets[band].get(value, ())}:
                tried.setdefault(n, []).append(start)
        for n, at in sorted(tried.items()):
            name, template = c.members[n]
            low = at[0]
            for start, following in zip(at, [*at[1:], None], strict=True):
                if following != start + c.step:
                    found.setdefault(name, []).extend(verified(words, low, min(start + c.step - 1, last), c.window, c.size, template, threshold))
                    low = following
    out = []
    for name, spans in sorted((name, spans) for name, spans in found.items() if spans):
        spans.sort()
        low, high, best = spans[0]
        for a, b, share in spans[1:]:
            if a <= high:
                high, best = max(high, b), max(best, share)
            else:
                out.append((name, low, high, best))
                low, high, best = a, b, share
        out.append((name, low, high, best))
    return out


_FOUND = "doc_id long, n_words long, matches array<struct<template: string, first: long, end: long, containment: double>>"


def scan_documents(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, matches) of every row: where windows contain ``threshold`` of a template's shingles.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased; shingles
    have five, or all of a shorter template. Overlapping matches of a template are one.
    A null or empty text has no words and no match; texts are scanned whole at any length;
    repeated rows are rows of their own; templates without words match nothing, and equal
    ones count under the first name; an empty table gives no rows; other columns are
    ignored. Templates of more than TEMPLATE_CHARS are taken in parts, each in a pass of
    its own over the rows.
    """
    kind = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, matches = [], []
                for text, before in zip(batch.column("text").to_pylist(), batch.column("matches").to_pylist(), strict=True):
                    words = words_of(text)
                    sizes.append(len(words))
                    matches.append(before + [{"template": n, "first": a, "end": b, "containment": s} for n, a, b, s in scan_words(words, shared.value, threshold)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(sizes, pa.int64()), pa.array(matches, kind)], names=["doc_id", "text", "n_words", "matches"])

        return run

    context = docs.sparkSession.sparkContext
    found = docs.select(F.col("doc_id").cast("long"), common.text_of(), F.lit(0).cast("long").alias("n_words"), F.array().cast(_FOUND.split("matches ")[1]).alias("matches"))
    parts = parts_of(sorted(templates, key=lambda t: (t[0], t[1] or "")))
    for part in parts:
        found = found.mapInArrow(scan(context.broadcast(Index.of(part, threshold))), _FOUND.replace("n_words", "text string, n_words"))
    return found.select("doc_id", "n_words", "matches")


def report(found: DataFrame) -> DataFrame:
    """One row per document, with the templates it holds, in order."""
    return found.select(
        "doc_id",
        "n_words",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["template"]))), ",").alias("templates"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("containment"),
    )
