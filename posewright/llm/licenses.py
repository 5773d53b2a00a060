"""Licence scan: Dice coefficient over word bigrams between licence templates and windows of a text.

A template of ``w`` words is compared with every window of ``w`` words (the whole text, if it is shorter).
Two bounds prune without loss. Sizes: sets of ``a`` and ``b`` bigrams can reach a coefficient ``t`` only if
``a`` lies between ``b * t / (2 - t)`` and ``b * (2 - t) / t``. Anchors: a window that reaches ``t`` shares at
least ``ceil(b * t / (2 - t))`` of the template's bigrams, so it holds one of any ``b - that + 1`` of them; the
bigrams with the longest words are taken. A text without an anchor's longest word is passed over after one
Aho-Corasick scan, and windows are compared only around anchors, where running counts of the template's
bigrams leave enough of them.

Licences of one family differ in a word or a clause, so one place of a text can reach the coefficient with
several templates. Of templates whose windows overlap, the one that shares the most bigrams is reported
(then the one with the best coefficient), and more than one only where they are equal in both.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
WORD = re.compile(r"\w+")

# Notices by licence, and the texts of short licences. Full texts of long licences come as a table.
BSD_START = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:")
BSD_CLAUSES = (" 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
               "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
               "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
BSD_THIRD = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
             "products derived from this software without specific prior written permission.")
PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
CC_NAMES = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
GNU_NAMES = (("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"),
             ("LGPL-3.0", "program", "Lesser General", "3"), ("LGPL-3.0", "library", "Lesser General", "3"), ("AGPL-3.0", "program", "Affero General", "3"))
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("BSD-2-Clause", BSD_START), ("BSD-2-Clause", BSD_START + BSD_CLAUSES), ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", BSD_START), ("BSD-3-Clause", BSD_START + BSD_CLAUSES + BSD_THIRD), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *((f"CC-{short}-4.0", f"Licensed under CC {short} 4.0.") for short, _ in CC_NAMES),
    *((f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for short, long in CC_NAMES),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    *((name, f"This work is licensed under the GNU {kind} Public License, version {version}.") for name, _, kind, version in GNU_NAMES),
    *((name, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as "
             f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, what, kind, version in GNU_NAMES),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License version 2 as published by the Free Software Foundation."),
    ("0BSD", PERMISSION + "."),
    ("ISC", PERMISSION + ", provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software."),
)


def templates_of(table: DataFrame, name: str = "name", text: str = "text") -> tuple[tuple[str, str], ...]:
    """Templates from a table of licence texts (a few thousand rows at most, since every worker holds them all)."""
    rows = table.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(name, text).distinct().orderBy(name, text).collect()
    return tuple((r[0], r[1]) for r in rows)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(tokens: list[str]) -> list[tuple[str, str]]:
    return list(zip(tokens, tokens[1:], strict=False))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Template:
    def __init__(self, name: str, text: str, threshold: float):
        tokens = words(text)
        self.name, self.size, self.set = name, len(tokens), set(bigrams(tokens))
        b = len(self.set)
        self.least, self.most = math.ceil(b * threshold / (2 - threshold) - 1e-9), math.floor(b * (2 - threshold) / threshold + 1e-9)
        ranked = sorted(self.set, key=lambda g: (-max(map(len, g)), -sum(map(len, g)), g))
        self.anchors = frozenset(ranked[:b - self.least + 1])


class Scanner:
    """Templates prepared for one threshold; of two bigrams at least, so that every template has an anchor."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.templates = [t for t in (Template(n, x, threshold) for n, x in templates) if len(t.set) > 1]
        self.by_anchor: dict[tuple, list[int]] = {}
        for k, t in enumerate(self.templates):
            for g in t.anchors:
                self.by_anchor.setdefault(g, []).append(k)
        self.keys = {max(g, key=lambda w: (len(w), w)) for g in self.by_anchor}
        self.found = None

    def __getstate__(self):
        return self.__dict__ | {"found": None}

    def may_match(self, low: str) -> bool:
        """Whether a lower-case text holds the longest word of some anchor, perhaps inside another word."""
        if self.found is None:
            self.found = ahocorasick.Automaton()
            for k in self.keys:
                self.found.add_word(k, k)
            self.found.make_automaton()
        return next(self.found.iter(low), None) is not None

    def windows(self, text: str | None):
        """``(template, start, size, shared, dice)`` of every window that reaches the threshold."""
        low = (text or "").lower()
        if not self.templates or not self.may_match(low):
            return
        tokens = WORD.findall(low)
        grams = bigrams(tokens)
        starts: dict[int, set[int]] = {}
        for p, g in enumerate(grams):
            for k in self.by_anchor.get(g, ()):
                size = self.templates[k].size
                last = max(0, len(tokens) - size)
                starts.setdefault(k, set()).update(range(min(last, max(0, p - size + 2)), min(last, p) + 1))
        for k, where in starts.items():
            t = self.templates[k]
            sums = np.concatenate([[0], np.cumsum(np.fromiter((g in t.set for g in grams), np.int64, len(grams)))])
            at = np.array(sorted(where))
            held = sums[np.minimum(at + t.size - 1, len(grams))] - sums[at]
            for s in at[held >= t.least].tolist():
                window = set(grams[s:s + t.size - 1])
                if t.least <= len(window) <= t.most and (d := dice(window, t.set)) >= self.threshold:
                    yield t, s, min(t.size, len(tokens)), len(window & t.set), d

    def scan(self, text: str | None) -> dict[str, float]:
        """The best coefficient of each licence that reaches the threshold anywhere, siblings included."""
        out: dict[str, float] = {}
        for t, _, _, _, d in self.windows(text):
            out[t.name] = max(d, out.get(t.name, 0.0))
        return out

    def best(self, text: str | None) -> dict[str, float]:
        """The licences of the places of a text, each with its best coefficient: of overlapping windows the one that shares most."""
        out: dict[str, float] = {}
        places: list[tuple[int, int, int, float]] = []
        for t, s, size, shared, d in sorted(self.windows(text), key=lambda w: (-w[3], -w[4], w[0].name, w[1])):
            over = [p for p in places if s < p[1] and p[0] < s + size]
            if all((shared, d) == p[2:] for p in over):
                places.append((s, s + size, shared, d))
                out[t.name] = max(d, out.get(t.name, 0.0))
        return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, n_licenses, license, dice, licenses``.

    ``licenses`` lists the licences of the text's places (see ``Scanner.best``), by name, with commas: one
    for each place, or several that its words cannot tell apart. ``license`` is the one with the best
    coefficient (of equal ones, the first by name). Without a match, and for null or empty texts, the count
    is zero and the others are null. Whole texts are read; repeated rows are scanned each; null ids stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(templates, threshold))

    def run(batches):
        for b in batches:
            found = [shared.value.best(t) for t in b.column("text").to_pylist()]
            best = [min(f, key=lambda n: (-f[n], n)) if f else None for f in found]  # noqa: B023
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([len(f) for f in found], pa.int32()), pa.array(best, pa.string()),
                 pa.array([f[n] if f else None for f, n in zip(found, best, strict=True)], pa.float64()),
                 pa.array([",".join(sorted(f)) if f else None for f in found], pa.string())],
                ["doc_id", "n_licenses", "license", "dice", "licenses"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_licenses int, license string, dice double, licenses string")
