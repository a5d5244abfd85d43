"""Declared identifiers of the commonest licences."""

import pytest

from lograft.llm import licenses

from .test_operators import table

NAMES = ("MIT", "ISC", "Zlib", "Unlicense", "WTFPL", "PostgreSQL", "OpenSSL")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(k, f"x\n// SPDX-License-Identifier: {n}\n") for k, n in enumerate(NAMES)] + [(10 + k, f"licensed under the {n}.") for k, n in enumerate(NAMES)] + [(20 + k, f"we use {n} at licence time") for k, n in enumerate(NAMES)]
    return {r.doc_id: r.labels for r in licenses.scan(table(spark, rows)).collect()}


@pytest.mark.parametrize("k", range(len(NAMES)))
def test_declared(labels, k):
    assert labels[k] == labels[10 + k] == [NAMES[k].lower()] and labels[20 + k] == []


TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated files",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
    "gpl": "released under GPLv3",
    "gpl ": "The GPL applies.",
    " gpl": "gpl v2 or later",
    "lgpl": "see LGPLv2.1+ for this",
    "apache": "Apache 2.0 licence",
    "cc-by-nc-sa": "images: BY-NC-SA 4.0",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.",
    "": "the committee made a remark on quality, and nothing is permitted to grow",
}


def test_texts_of_licences(spark):
    names = list(TEXTS)
    found = {r.doc_id: r for r in licenses.scan(table(spark, list(enumerate(TEXTS.values())))).collect()}
    for k, name in enumerate(names):
        assert name.strip() in found[k].labels if name else found[k].labels == [], (name, found[k].labels)


def test_every_clause_matches_its_own_words_and_has_a_gate():
    import re

    rules, gate = licenses.rules(), licenses.gate(licenses.rules())
    assert len(rules) > 300 and all(any(g in key for g in gate) for *_, key, _ in rules)
    patterns = [(label, re.compile(p), key) for _, _, label, key, p in rules]
    for label, words in licenses.CLAUSES:
        text = words.replace("~", "of any kind")
        assert any(p.search(text) and key in text for found, p, key in patterns if found == label), words


def test_score_is_the_share_of_what_is_detected(spark):
    """Marks in a text change nothing; overlapping detections count once."""
    texts = ["x\x01 SPDX-License-Identifier: MIT \x02 y", "apache license " * 3 + "and more", "mit license", "none"]
    for r in licenses.scan(table(spark, list(enumerate(texts)))).collect():
        low = r.text.lower()
        inside = bytearray(len(low))
        for d in r.detections:
            inside[d.start : d.end] = b"\1" * (d.end - d.start)
        base = sum(len(p) * low.count(p) for p, _ in licenses.BASE)
        assert r.score == pytest.approx(min(1, max(sum(inside), base) / max(1, len(low)))), r.text
        assert (r.doc_id == 3) == (r.score == 0)


def test_own_words_stand_in_every_match_and_are_shared_by_few_rules():
    import re
    from collections import Counter

    table = licenses.signatures()
    guarded = Counter((r.keyword, r.own) for r in table)
    assert max(guarded.values()) <= 20, guarded.most_common(3)
    assert len(licenses.CLAUSES) + len(licenses.SHORT) >= 200
    for r in table:
        # What a match cannot do without, written down from the pattern: its words outside optional parts.
        plain = re.sub(r"\\(.)", r"\1", r.pattern)
        assert r.own in plain and r.keyword in plain.replace("licen[sc]", "licen"), r


CLAUSE_TEXTS = [" ".join(words.replace("~", "x y").split()) for _, words in licenses.CLAUSES]


def test_every_clause_is_found_in_a_text_of_its_own(spark):
    """Upper case, line ends and marks between the words, as in licence headers."""
    texts = [t.upper().replace(" ", ",\n * ", 2) for t in CLAUSE_TEXTS]
    found = {r.doc_id: r for r in licenses.scan(table(spark, list(enumerate(texts)))).collect()}
    for k, (label, words) in enumerate(licenses.CLAUSES):
        assert label in found[k].labels, words
