"""Licence scans with a generalised suffix automaton.

The tokens of all templates and phrases make one suffix automaton.  Texts are
streamed through it: after each word the state and length give the longest
suffix of the text that stands in some template (matching statistics).
Phrases and templates of a few words are read off the states; matches of
``MIN_MATCH`` words or more are chained, in the order of one template, into
spans that cover part of it.  Of spans that lie in one another only the best
stay.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, require

MIN_MATCH = 5
#: Words that a chain may leave out, in the text or in the template.
MAX_GAP = 24
#: Share of a template's words that a span must cover to give its label.
MIN_COVER = 0.7
#: Score of a text that names a licence but has no notice.
NAMED = 0.5

# Phrases with their labels, how notices of one line open, the
# names they go on with, and public licence notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
OPENINGS = ("licensed under", "released under", "distributed under", "published under", "available under", "provided under the terms of", "this work is licensed under")
NAMES = {
    "mit": ("the MIT License",),
    "apache": ("the Apache License",),
    "apache-2.0": ("the Apache License, Version 2.0",),
    "gpl": ("the GNU General Public License",),
    "gpl-2.0": ("the GNU General Public License, version 2",),
    "gpl-3.0": ("the GNU General Public License, version 3",),
    "lgpl": ("the GNU Lesser General Public License",),
    "agpl": ("the GNU Affero General Public License",),
    "mpl-2.0": ("the Mozilla Public License, version 2.0",),
    "bsd": ("the BSD License", "the BSD 2-Clause License", "the BSD 3-Clause License"),
    "isc": ("the ISC License",),
    "cc-by": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd": ("CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa": ("CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc-by-nc-nd": ("CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
IDENTIFIERS = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "all-rights-reserved": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
}
#: (label, notice): whole notices, those of one line, and lines with an identifier.
TEMPLATES = [
    *NOTICES.items(),
    ("all-rights-reserved", "All rights reserved"),
    *((label, f"{opening} {name}") for label, names in NAMES.items() for name in names for opening in OPENINGS),
    *((name.lower(), f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS),
]


def words(text: str) -> tuple[K.Block, np.ndarray, np.ndarray, np.ndarray]:
    block = next(K.blocks(pa.array([text]))).lowered()
    return block, *block.runs(K.ALNUM)


class Automaton:
    """Of token sequences; ``ends[s]`` has, for each sequence in which the
    strings of state s stand, where the first of them ends."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for sequence in sequences:
            last = 0
            for token in sequence:
                last = self._extend(last, token)
        for number, sequence in enumerate(sequences):
            state = 0
            for i, token in enumerate(sequence):
                state = self.next[state][token]
                up = state
                while up > 0 and number not in self.ends[up]:
                    self.ends[up][number] = i
                    up = self.link[up]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, above: int, token: int, old: int) -> int:
        """A copy of ``old`` for its strings that end a path from ``above``."""
        copy = self._state(self.length[above] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = copy
        while above >= 0 and self.next[above].get(token) == old:
            self.next[above][token] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, token, known)
        new = self._state(self.length[last] + 1, {}, 0)
        above = last
        while above >= 0 and token not in self.next[above]:
            self.next[above][token] = new
            above = self.link[above]
        if above >= 0:
            known = self.next[above][token]
            self.link[new] = known if self.length[known] == self.length[above] + 1 else self._split(above, token, known)
        return new

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        to = self.next[state].get(token)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    def __init__(self, phrases: Mapping[str, str], templates: Sequence[tuple[str, str]], min_match: int, max_gap: int):
        self.min_match, self.max_gap = min_match, max_gap
        self.names = [label for label, _ in templates]
        vocabulary: dict[int, int] = {}
        sequences = []
        for text in [*(notice for _, notice in templates), *phrases]:
            block, b, e, _ = words(text)
            sequences.append([vocabulary.setdefault(h, len(vocabulary)) for h in block.hashes(b, e).tolist()])
        self.sizes = [len(s) for s in sequences[: len(templates)]]
        self.automaton = a = Automaton(sequences)
        self.known = np.array(sorted(vocabulary), np.uint64)
        self.ids = np.array([vocabulary[h] for h in self.known.tolist()], np.int64)
        v = self.v = len(vocabulary)
        self.pair = np.zeros((v, v), bool)
        self.opens = np.zeros((v, v), bool)
        for s in sequences:
            self.pair[s[:-1], s[1:]] = True
        # sequences that are looked for whole: phrases, and the shortest templates
        whole = [(s, number, None) for number, s in enumerate(sequences[: len(templates)]) if len(s) < min_match]
        whole += [(s, None, label) for label, s in zip(phrases.values(), sequences[len(templates) :], strict=True)]
        # what of them ends at each state, and the least match length for it
        self.hits: list[list[tuple[int | None, str | None, int, int]]] = [[] for _ in a.next]
        for s, number, label in whole:
            self.opens[s[0], s[1] if len(s) > 1 else slice(None)] = True
            state = 0
            for token in s:
                state = a.next[state][token]
            for t in range(1, len(a.next)):
                up = t
                while up > 0 and up != state:
                    up = a.link[up]
                if up == state:
                    self.hits[t].append((number, label, len(s), len(s) if t == state else 0))

    def scan(self, block: K.Block) -> list[dict]:
        """For each text: n_words, places (label, start) and spans."""
        low = block.lowered()
        begins, ends, of = low.runs(K.ALNUM)
        out = [{"n_words": int(n), "places": [], "spans": []} for n in np.bincount(of, minlength=block.n)]
        h = low.hashes(begins, ends)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        ids = np.where(self.known[at] == h, self.ids[at], -1)
        good = (ids[:-1] >= 0) & (ids[1:] >= 0) & (of[:-1] == of[1:])
        good &= self.pair[ids[:-1], ids[1:]]
        opened = np.concatenate([[0], np.cumsum(good & self.opens[ids[:-1], ids[1:]])])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(np.int8), [0]])))
        first, last = edges[::2], edges[1::2]  # pairs first .. last - 1, so words first .. last
        use = (last - first + 1 >= self.min_match) | (opened[last] > opened[first])
        word0 = np.searchsorted(of, np.arange(block.n))
        for i, j in zip(first[use].tolist(), last[use].tolist(), strict=True):
            doc = int(of[i])
            self._stream(ids[i : j + 1].tolist(), i - int(word0[doc]), out[doc])
        for row in out:
            row["spans"] = self._chain(row["spans"])
        return out

    def _stream(self, tokens: list[int], start: int, row: dict) -> None:
        step, state, length = self.automaton.step, 0, 0
        for i, token in enumerate(tokens):
            before = state, length
            state, length = step(state, length, token)
            if before[1] >= self.min_match and length <= before[1]:
                self._match(row, start + i - before[1], start + i, before[0])
            for number, label, size, least in self.hits[state]:
                if length >= least and number is None:
                    row["places"].append((label, start + i + 1 - size))
                elif length >= least:
                    row["spans"].append((start + i + 1 - size, start + i + 1, number, 0))
        if length >= self.min_match:
            self._match(row, start + len(tokens) - length, start + len(tokens), state)

    def _match(self, row: dict, a: int, b: int, state: int) -> None:
        row["spans"] += [(a, b, number, end + 1 - (b - a)) for number, end in self.automaton.ends[state].items() if number < len(self.sizes)]

    def _chain(self, matches: list[tuple[int, int, int, int]]) -> list[dict]:
        """Spans of chained matches: label, start, end (words), coverage.

        A match (words a to b of the text, a template and its word ``begin``)
        goes on the chain of its template that covers most, of equals the one
        that began first.
        """
        done, live = [], []
        for a, b, number, begin in sorted(matches):
            done += [c for c in live if a - c["end"] > self.max_gap]
            live = [c for c in live if a - c["end"] <= self.max_gap]
            fits = [c for c in live if c["number"] == number and c["end"] <= a and 0 <= begin - c["to"] <= self.max_gap]
            if fits:
                max(fits, key=lambda c: c["covered"]).update(end=b, to=begin + b - a)
                max(fits, key=lambda c: c["covered"])["covered"] += b - a
            else:
                live.append({"number": number, "start": a, "end": b, "to": begin + b - a, "covered": b - a})
        spans = done + live
        for c in spans:
            c["worth"] = c["covered"], c["covered"] / self.sizes[c["number"]]
        spans.sort(key=lambda c: (c["start"], -c["end"], -c["worth"][0], -c["worth"][1], self.names[c["number"]]))
        out, around = [], []
        for c in spans:
            around = [o for o in around if o["end"] > c["start"]]
            if not any(o["end"] >= c["end"] and o["worth"] > c["worth"] for o in around):
                around.append(c)
                out.append({"label": self.names[c["number"]], "start": c["start"], "end": c["end"], "coverage": round(c["worth"][1], 6)})
        return out


SCHEMA = "doc_id long, n_words long, places array<struct<label: string, start: long>>, spans array<struct<label: string, start: long, end: long, coverage: double>>"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))),
    ]
)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES, key: str = "doc_id", text: str = "text", min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> DataFrame:
    """doc_id, n_words, places of phrases and spans of templates, per row.

    Positions count words from 0.  Null texts count as empty and have no
    words; a repeated row is scanned again; other columns are left out.  A
    span that lies in one of another template that covers more words (of
    equally many, a greater share) is left out; equals stay.  A part that a
    template has twice counts where it stands first.
    """
    require(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, min_match, max_gap)
        for batch in batches:
            rows = [row for block in K.blocks(batch.column(1)) for row in scanner.scan(block)]
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "n_words": r["n_words"], "places": [{"label": x, "start": a} for x, a in r["places"]], "spans": r["spans"]} for i, r in zip(ids, rows, strict=True)], _ARROW)

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, SCHEMA)


def summary(scanned: DataFrame, min_cover: float = MIN_COVER) -> DataFrame:
    """Counts, first and last place, labels and a score of each scanned row.

    The score is the greatest coverage of a template, and ``NAMED`` at least
    where a phrase stands.
    """
    starts = F.col("places.start")
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    covering = F.filter("spans", lambda s: s["coverage"] >= min_cover)
    best = F.coalesce(F.array_max(F.col("spans.coverage")), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.transform(covering, lambda s: s["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("places") > 0, NAMED).otherwise(0.0)).alias("score"),
    )
