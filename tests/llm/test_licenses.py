import random
import re

from loomtext.llm import licenses as L

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(words):
    """(word, label) of every place where a phrase stands."""
    return sorted((i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())


def brute(words):
    """Kept (label, first, end) of the added rules: every rule at every word, and of
    each pair one inside the other goes by the order of kind, length, place and rule."""
    found = set()
    for k, r in enumerate(L.rules()):
        if r.kind != "base":
            for i in range(len(words)):
                m = r.match.match((" " + " ".join(words[i:]) + " ").encode())
                if m:
                    found.add((list(L.CERTAINTY).index(r.kind), -len(m[1].split()), i, k, i + len(m[1].split())))
    kept = []
    for kind, size, a, k, b in sorted(found):
        if not any(x <= a and b <= y for x, y, _ in kept):
            kept.append((a, b, L.rules()[k].label))
    return sorted(kept)


FRAGMENTS = [
    "licensed under the", "Released under the", "MIT License", "the mit", "license", "Apache License, Version 2.0", "Apache", "CC BY", "CC-BY-NC-SA 4.0", "cc by sa", "3.0", "version 3", "GNU General Public License", "GNU Lesser General Public License v2.1",
    "SPDX-License-Identifier: BSD-3-Clause", "spdx license identifier", "gplv2", "BSD license", "2-clause BSD", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "foo", "é", "Mozilla Public License", "MPL 2.0",
    "this program is free software; you can redistribute it and/or modify it under the terms of the", "all rights reserved", "no part of this", "prohibited", ".", "\n", "x y z", "neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
]


def test_equals_brute_force_for_any_size_of_piece():
    scan, rnd = L.scanner(), random.Random(4)
    for case in range(250):
        text = " ".join(rnd.choice(FRAGMENTS) for _ in range(rnd.randint(0, 25)))
        words = words_of(text)
        for size in (1 << 20, 40):
            n, found = scan.detections(text.encode(), size)
            kept = [(a, b, scan.own[k].kind, scan.own[k].label) for a, b, k in scan.kept(found)]
            assert n == len(words)
            assert sorted((a, label) for a, _, kind, label in kept if kind == "base") == base(words), text
            assert sorted((a, b, label) for a, b, kind, label in kept if kind != "base") == brute(words), text


def test_rules_are_many_gated_and_within_reach():
    assert len(L.rules()) > 300
    for label, kind, pattern in (line.split(" ", 2) for line in L.RULES.strip().splitlines()):
        assert kind in L.CERTAINTY
        gaps = sum(map(int, re.findall(r"~(\d+)", pattern)))
        assert len(pattern.split()) + gaps <= L.REACH, label
    for r in L.rules():
        assert r.keywords and all(re.fullmatch(rb"[a-z0-9]+", w) for w in r.keywords)


def test_gate_never_hides_a_match():
    rnd, ungated = random.Random(9), L.rules()
    scan = L.scanner()
    for _ in range(60):
        words = words_of(" ".join(rnd.choice(FRAGMENTS) for _ in range(12)))
        text = (" " + " ".join(words) + " ").encode()
        want = {(m.start(), k) for k, r in enumerate(ungated) for m in r.match.finditer(text)}
        assert len(want) == len(scan.piece([w.encode() for w in words], [], 0))


def test_known_licences():
    def labels(text):
        scan = L.scanner()
        return {scan.own[k].label for _, _, k in scan.kept(scan.detections(text.encode())[1])}

    assert labels("This work is licensed under the GNU General Public License, version 3.") == {"gpl", "gpl-3.0"}
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-4.0"}
    assert labels("Released under the MIT License.") == {"mit"}
    assert labels("Licensed under the Apache License, Version 2.0.") == {"apache", "apache-2.0"}
    assert labels("// SPDX-License-Identifier: LGPL-2.1-or-later") == {"lgpl-2.1"}
    assert labels("GNU Lesser General Public License, version 2.1") == {"lgpl-2.1"}
    assert labels("He was licensed to drive an open source bus; the general public may permit it, by cc of the mit.") == set()


def test_rows_nulls_empties_long_texts_and_clashing_columns(spark):
    long = "word " * 600_000 + "the MIT license"
    rows = [(1, None, 1), (2, "", 2), (3, "MIT\nlicense mit license", 3), (3, "MIT\nlicense mit license", 3), (None, "cc. BY", 4), (5, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    out = L.scan_licenses(df).collect()
    got = {r.doc_id: tuple(r)[1:8] for r in out}
    assert len(out) == 6
    assert got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3] == (4, 2, 0, 2, "mit", "mit", 0.8) and got[None] == (2, 1, 0, 0, "cc-by", "cc-by", 0.8)
    assert got[5][:4] == (600_003, 1, 600_001, 600_001)
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_base_of_the_table_equals_a_direct_reading(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in L.scan_licenses(docs).collect():
        words = words_of(texts[r.doc_id])
        at = base(words)
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
