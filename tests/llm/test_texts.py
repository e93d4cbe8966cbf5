"""Line dedup, Jaccard join, decontamination, toxicity, license scans: brute force on small tables."""

import re
from collections import Counter, defaultdict

import duckdb
import helpers
import numpy as np
import pytest

from ribostrand.llm import jaccard as J
from ribostrand.llm.decontamination import align, contaminated, decontaminate
from ribostrand.llm.license_scan import SENTENCES, license_scan, license_sql
from ribostrand.llm.line_dedup import dedup_lines, earlier_lengths
from ribostrand.llm.toxicity import fit, held_out, score, toxicity


def brute_lines(rows, least):
    """The texts left, in corpus order."""
    seen, out = defaultdict(list), []
    docs = [t.split("\n") for _, t in rows]
    for d, lines in enumerate(docs):
        sums = np.cumsum([0] + [len(x.split()) for x in lines])
        gone = set()
        for i, line in enumerate(lines):
            best = 0
            for e, j in seen[line]:
                k = 0
                while i + k < len(lines) and j + k < len(docs[e]) and lines[i + k] == docs[e][j + k]:
                    k += 1
                best = max(best, k)
            if sums[i + best] - sums[i] >= least:
                gone |= set(range(i, i + best))
            seen[line].append((d, i))
        out.append((rows[d][0], len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("least", [1, 20, 40])
def test_line_dedup(docs, least):
    rows = sorted(((r[0], r[1] or "") for r in helpers.rows()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = Counter((r["doc_id"], r["n_deleted"], r["text"]) for r in dedup_lines(docs, least).collect())
    if least == 1:  # lines without words have no run of a word
        got, wanted = ({k: v for k, v in c.items() if k[0] != 3} for c in (got, brute_lines(rows, least)))
        assert got == wanted
    else:
        assert got == brute_lines(rows, least)


def test_line_dedup_of_nothing(none):
    out = dedup_lines(none)
    assert out.count() == 0 and out.columns == [*none.columns, "n_lines", "n_deleted"]


def test_sweeps_over_parts():
    rng = np.random.default_rng(5)
    places, lcps = rng.permutation(200), rng.integers(0, 6, 200)
    lcps[0] = 0
    whole, _ = earlier_lengths(places, lcps, [])
    for i in range(200):
        best, shared = 0, 10**9
        for j in range(i - 1, -1, -1):
            shared = min(shared, lcps[j + 1])
            if places[j] < places[i]:
                best = max(best, shared)
        assert best == whole[i]


def brute_components(rows, n, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = word.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, n, percent):
    rows = [(r[0], r[1]) for r in helpers.rows()]
    got = Counter(tuple(r) for r in J.jaccard_components(docs, n, percent).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows, n, percent)


def test_jaccard_of_nothing(none):
    assert J.jaccard_components(none).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_the_entries_they_need(percent):
    rng = np.random.default_rng(percent)
    for size in (1, 2, 5, 9, 14, 30, 61, 150, 400):
        for _ in range(30):
            a = rng.integers(0, 1 << 62, size).astype(np.uint64)
            b = a.copy()
            for _ in range(rng.integers(0, size // 4 + 1)):
                b = np.delete(b, rng.integers(0, len(b))) if len(b) > 1 and rng.random() < 0.5 else np.append(b, np.uint64(rng.integers(0, 1 << 62)))
            a, b = np.unique(a), np.unique(b)
            both = J.common(a, b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                bands = {x[0]: x for x in J.keys(a, percent)}
                shared = [(len(np.intersect1d(bands[t][2], k)), bands[t][1], need) for t, need, k in J.keys(b, percent) if t in bands]
                assert any(s >= x and s >= y for s, x, y in shared), (size, shared)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 3), (200, 201), (201, 202)], "x long, y long")
    got = {r["id"]: r["component"] for r in J.components(links).collect()}
    assert {got[i] for i in [*range(2, 41), 100]} == {1} and got[201] == got[202] == 200


def test_decontamination(spark, docs, none):
    items = [helpers.prose(50 + k, 30) for k in range(3)]
    edited = items[1].split(" ")
    edited[4], edited[15] = "replaced", "also"
    del edited[22]
    planted = [(100, "before it " + items[0] + " behind"), (101, helpers.prose(70, 90) + " " + " ".join(edited)), (102, " ".join(items[2].split(" ")[:9])), (103, items[0].upper())]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)] + [(8, None, "x"), (9, "", "x"), (10, "zzzz qqqq", "x")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r for r in contaminated(both, bench).collect()}
    assert set(got) == {(100, 0), (101, 1), (103, 0)}
    assert got[100, 0]["ratio"] == 1 and (got[100, 0]["first_word"], got[100, 0]["last_word"]) == (2, 31)
    assert 0.6 <= got[101, 1]["ratio"] < 1
    kept = {r["doc_id"] for r in decontaminate(both, bench).select("doc_id").collect()}
    assert kept == ({r[0] for r in helpers.rows()} | {102})
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_edited_copies_are_found(spark):
    """Against alignment of every pair: copies with few words left between edits, alone in the corpus or among intact ones."""
    items = {k: [f"w{(k * 37 + i * i * 7 + i) % 211}" for i in range(25 + k)] for k in range(4)} | {7: ["one", "two", "three"], 8: [f"s{i}" for i in range(6)]}

    def edits(own):
        for step in (3, 4, 5, 6):
            yield [f"x{i}" if i % step == step - 1 else w for i, w in enumerate(own)]
        yield [x for i, w in enumerate(own) for x in ([w, "extra"] if i % 2 else [w])]
        yield [w for i, w in enumerate(own) if i % 5 != 4]
        yield own[1:]

    texts = [" ".join(["before", "it", *e, "behind"]) for own in items.values() for e in edits(own)] + [" ".join(items[0])] * 3 + [" ".join(items[1] + ["far"] * 90 + items[1][:20]), "w1 w2 one"]
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")).collect()}
    number = defaultdict(lambda: len(number))
    wanted = set()
    for d, t in enumerate(texts):
        for k, own in items.items():
            best = align(np.array([number[w] for w in t.split()]), np.array([number[w] for w in own]))[0]
            if best >= 0.6 * 2 * len(own):
                wanted.add((d, k, best))
    assert got == wanted and len(wanted) > 30


def test_alignment_of_words():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for i in range(1, len(b) + 1):
            for j in range(1, len(a) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[j - 1] == b[i - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert align(a, b)[0] == h.max()


def test_toxicity(spark, none):
    rows = [(i, helpers.prose(i, 40) + (" what an idiot" if i % 5 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)] + [(0, 1, None), (5000, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r["score"] <= 1 for r in got.values())
    assert any(r["held_out"] for r in got.values())
    for i in range(300):
        assert got[i]["predicted"] == int(i % 5 == 0)
    assert got[1000]["score"] == got[1001]["score"]
    assert score(none, fit(docs, labels.limit(0))).count() == 0
    assert toxicity(docs, labels.where("toxic = 0")).where("predicted = 1").count() == 0
    import zlib

    flags = docs.select("doc_id", held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in flags)


def test_license_scan(spark, docs, none):
    mit = "Copyright (c) 2020 X\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    shuffled = "\n".join(mit.split("\n")[::-1])
    more = docs.unionByName(spark.createDataFrame([(200, mit), (201, shuffled), (202, "Released under the MIT License. x. Licensed under CC BY-NC 4.0.")], "doc_id long, text string"), allowMissingColumns=True)
    got = {r["doc_id"]: r for r in license_scan(more).collect()}
    assert got[200]["license"] == "MIT" and got[200]["n_known"] == 3 and got[201]["license"] is None and got[201]["n_known"] == 3
    assert got[202]["licenses"] == "MIT,CC-BY-NC-4.0" and got[16]["license"] == "Apache-2.0" and got[1]["license"] is None
    assert license_scan(none).count() == 0
    documents = more.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    twin = Counter(tuple(r) for r in con.execute(license_sql()).fetchall())
    assert twin == Counter(tuple(r) for r in license_scan(more).collect())
    plan = license_scan(more)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PUBLISHED = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"),
    ("BSD-2-Clause", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n *\n * 1. Redistributions of source code must retain the above copyright notice, this\n *    list of conditions and the following disclaimer.\n *\n * 2. Redistributions in binary form must reproduce the above copyright notice,\n *    this list of conditions and the following disclaimer in the documentation\n *    and/or other materials provided with the distribution.\n"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\r\npurpose with or without fee is hereby granted, provided that the above\r\ncopyright notice and this permission notice appear in all copies.\r\n"),
    ("GPL-3.0-or-later", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one"),
    ("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\n"), ("MIT", "Name: x\nLicense: MIT\nAuthor: y"),
    (None, "This source code form is subject to the terms.\nOf the Mozilla Public License, v. 2.0"), (None, "released under\n\nthe MIT license"), (None, "not released under the MIT license"), (None, "released under the MIT license in part"), (None, "released. under the MIT license"),
]


def test_licenses_as_published(spark):
    rows = [(i, t) for i, (_, t) in enumerate(PUBLISHED)]
    listed = [(name, w) for name, ws in SENTENCES.items() for w in ws]
    for i, (_, w) in enumerate(listed):
        own = w.split()
        rows += [(1000 + 100 * i + k, "before it.\n" + " ".join(own[:k]) + "\n" + " ".join(own[k:]) + "\nbehind it") for k in range(1, len(own))]
    got = {r["doc_id"]: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["license"] for i in range(len(PUBLISHED))] == [name for name, _ in PUBLISHED]
    assert all(got[d]["sentence_ids"] == listed[d // 100 - 10][0] for d, _ in rows if d >= 1000)
