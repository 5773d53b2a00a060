"""The pruned licence scan against a comparison of every window with every template."""

import random

from posewright.llm import licenses as L

FILL = "the of under license and a version 2 free software public general notice this work is".split()


def every_window(text, templates, threshold):
    out = {}
    tokens = L.words(text or "")
    for name, body in templates:
        want = set(L.bigrams(L.words(body)))
        size = len(L.words(body))
        if len(want) < 2:
            continue
        for s in range(max(1, len(tokens) - size + 1)):
            d = L.dice(set(L.bigrams(tokens[s:s + size])), want)
            if d >= threshold:
                out[name] = max(d, out.get(name, 0))
    return out


def noisy(rng):
    words = L.words(rng.choice(L.TEMPLATES)[1])
    for _ in range(rng.randint(0, max(1, len(words) // 6))):
        words[rng.randrange(len(words))] = rng.choice(FILL)
    return [*rng.choices(FILL, k=rng.randint(0, 12)), *words, *rng.choices(FILL, k=rng.randint(0, 12))]


def test_equals_every_window():
    rng = random.Random(5)
    for threshold in (0.8, 0.6):
        scanner = L.Scanner(threshold=threshold)
        hits = 0
        for _ in range(150):
            text = " ".join(noisy(rng))
            got = scanner.scan(text)
            assert got == every_window(text, L.TEMPLATES, threshold)
            hits += bool(got)
        assert hits > 50


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License."), (3, "Released under the MIT License."), (None, "MIT"),
            (4, "x " * 50_000 + "LICENSED under the\nApache license -- version 2.0! " + "y " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS license", "1 AS dice")
    got = L.scan_licenses(docs).collect()
    assert [(r.doc_id, r.n_licenses, r.license, r.dice) for r in got] == [
        (1, 0, None, None), (2, 0, None, None), (3, 1, "MIT", 1.0), (3, 1, "MIT", 1.0), (None, 0, None, None), (4, 1, "Apache-2.0", 1.0)]
    assert L.scan_licenses(docs.limit(0)).collect() == []


def test_finds_the_notices_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.license for r in L.scan_licenses(docs).where("n_licenses > 0").collect()}
    lines = {"CC BY-NC 4.0": "CC-BY-NC-4.0", "Apache License, Version 2.0": "Apache-2.0",
             "GNU General Public License, version 3": "GPL-3.0", "under the MIT License": "MIT"}
    want = {r.doc_id: name for r in docs.collect() for line, name in lines.items() if line in r.text}
    assert want and got == want


#: Headers as they stand in files, with what surrounds them, and the licence that each must give.
HEADERS = [
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-2-Clause", L.BSD_START + L.BSD_CLAUSES), ("BSD-3-Clause", L.BSD_START + L.BSD_CLAUSES + L.BSD_THIRD),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
]


def test_siblings_are_told_apart():
    scanner = L.Scanner()
    for name, header in HEADERS:
        for text in (header, f"Copyright 2020 somebody. {header} This is distributed in the hope that it will be useful.", header.upper().replace(" ", "\n")):
            assert set(scanner.best(text)) == {name}, (name, scanner.best(text))
    assert set(scanner.best(L.BSD_START)) == {"BSD-2-Clause", "BSD-3-Clause"}  # its words cannot tell
    both = " ".join([HEADERS[2][1], "and some files differ:", HEADERS[9][1]])
    assert set(scanner.best(both)) == {"AGPL-3.0", "CC-BY-SA-4.0"}


def test_best_equals_a_plain_choice():
    rng, scanner = random.Random(9), L.Scanner(threshold=0.7)
    for _ in range(60):
        text = " ".join(noisy(rng) + noisy(rng))
        tokens, found = L.words(text), []
        for name, body in L.TEMPLATES:
            want = set(L.bigrams(L.words(body)))
            size = len(L.words(body))
            for s in range(max(1, len(tokens) - size + 1)):
                got = set(L.bigrams(tokens[s:s + size]))
                if L.dice(got, want) >= 0.7:
                    found.append((-len(got & want), -L.dice(got, want), name, s, min(size, len(tokens))))
        taken, names = [], {}
        for a, b, name, s, size in sorted(found):
            if all((a, b) == (c, d) for c, d, e, f in taken if s < f and e < s + size):
                taken.append((a, b, s, s + size))
                names[name] = max(-b, names.get(name, 0))
        assert scanner.best(text) == names


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("X-1", "a licence of its own that nobody else has ever used"), (None, "x"), ("Y", None)], "name string, text string")
    docs = spark.createDataFrame([(1, "So: A licence of its own, that nobody else has ever used!"), (2, "Released under the MIT License.")], "doc_id long, text string")
    got = L.scan_licenses(docs, L.templates_of(table)).orderBy("doc_id").collect()
    assert [(r.n_licenses, r.license, r.licenses) for r in got] == [(1, "X-1", "X-1"), (0, None, None)]
