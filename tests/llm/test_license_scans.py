import random
import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import license_scans
from logmere.llm.license_rules import BASE, GATES, all_rules

RULES = [(r, re.compile(r.pattern)) for r in all_rules()]


def by_hand(text):
    """All rules on every text, and each pair of detections compared."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    spaced = f" {' '.join(words)} "
    word_at = lambda k: spaced[:k].count(" ") - 1
    found = set()
    for rule, pattern in RULES:
        for m in pattern.finditer(spaced):
            found.add((word_at(m.start()), -word_at(m.end()), rule.order, rule.label, rule.confidence))
    ordered, standing = sorted(found), []
    for k, (start, minus_end, order, label, confidence) in enumerate(ordered):
        covered = any(
            d[0] <= start and -d[1] >= -minus_end and d[2] <= order for d in ordered[:k]
        )
        if not covered:
            standing.append((start, -minus_end, order, label, confidence))
    starts, base = [], set()
    for phrase, label in BASE:
        parts = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        starts += at
        base |= {label} if at else set()
    wrong = 1.0
    for d in standing:
        wrong *= 1 - d[4]
    labels = sorted(base | {d[3] for d in standing})
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(labels),
        pytest.approx(1 - wrong),
    )


def check(docs):
    rows = license_scans.summary(license_scans.scan(docs)).collect()
    want = sorted(((str(r["doc_id"]), r["text"] or "") for r in docs.collect()), key=lambda x: x)
    got = sorted(rows, key=lambda r: str(r["doc_id"]))
    assert len(got) == len(want)
    for row in got:
        texts = [t for k, t in want if k == str(row["doc_id"])]
        assert any(tuple(row)[1:] == by_hand(t) for t in texts), (row, texts[0][:300])
    return {r["doc_id"]: r for r in rows}


def test_given_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_known_texts(documents):
    texts = [
        "Licensed under the Apache License, Version 2.0.",
        "This is licensed under the GNU General Public License, version 3 or any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under CC BY-NC 4.0. All rights reserved.",
        "Released under the MIT License. mit mit MIT licence",
        "cc by cc by CC-BY\ncc\nby",
        "no signs here at all",
        "Copyright (c) 2020 A. Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    rows = check(documents(texts))
    assert rows[0]["labels"] == "apache-2.0"
    assert rows[1]["labels"] == "gpl,gpl-3.0-or-later" and rows[1]["base_labels"] == "gpl"
    assert rows[2]["labels"] == "gpl-2.0-or-later"
    assert rows[3]["labels"] == "cc-by,cc-by-nc-4.0,reserved"
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"]) == (4, 0, 6)
    assert (rows[6]["labels"], rows[6]["score"]) == ("", 0.0)


def test_random_mixtures(documents):
    rng = random.Random(7)
    parts = "CC BY SA NC 4.0 GNU General Public License version 3 or later LGPL v2.1 MIT BSD 3-Clause"
    parts = (parts + " Apache under licensed the terms of All rights reserved 2 new é").split()
    check(documents([" ".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(150)]))


def test_odd_rows(documents):
    many = "All rights reserved. CC BY 4.0 " * 400
    odd = [None, "", " .,\x01\x02", "ALL\x00RIGHTS RESERVEDé", "Kelvin K cc by", many, "w " * 200_000]
    rows = documents(odd + [(3, "cc by"), (None, "cc by")])
    check(rows.withColumn("words", F.lit(1)).withColumn("gated", F.lit("x")).withColumn("label", F.lit(2)))


def test_empty_table(documents):
    assert license_scans.scan(documents([])).count() == 0


PLAIN = {
    "released under the GNU GPL": "gpl",
    "see the General Public Licence": "gpl",
    "GNU General Public License": "gpl",
    "under a Creative Commons Attribution License": "cc-by",
    "CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    "https://creativecommons.org/licenses/by-nc-nd/4.0/": "cc-by-nc-nd",
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "Licensed under the EUPL": "eupl-1.2",
    "Server Side Public License, v 1": "sspl-1.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2.0",
    "You should have received a copy of the GNU Lesser General Public License": "gpl,lgpl",  # base labels stay
    "The Software shall be used for Good, not Evil.": "json",
    "Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software": "bsd-3-clause",
    "THE SOFTWARE IS PROVIDED \u201cAS IS\u201d AND THE AUTHOR DISCLAIMS ALL WARRANTIES": "isc",
    "Todos los derechos reservados": "reserved",
    "No part of this book may be reproduced": "no-reproduction",
    "\u00a9 2021 Somebody": "copyright",
    "He bought a copy of the public software; the exception proves the rule.": "",
}


def test_plain_citations_and_passages(documents):
    rows = check(documents(list(PLAIN)))
    labels = [rows[k]["labels"] for k in range(len(PLAIN))]
    assert dict(zip(PLAIN, labels, strict=True)) == PLAIN


def shown(pattern):
    """A text that a rule fits: first choices, options left out."""
    import re._parser as parser

    def build(parts):
        out = ""
        for op, arg in parts:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "NOT_LITERAL":
                out += "q"
            elif name == "IN":
                kind, value = arg[0]
                out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0])}.get(str(kind), lambda: "q")()
            elif name == "SUBPATTERN":
                out += build(arg[3])
            elif name == "BRANCH":
                out += build(arg[1][0])
            elif name == "MAX_REPEAT":
                out += build(arg[2]) * arg[0]
        return out

    return f" {build(parser.parse(pattern)).strip()} "


def test_every_rule_fits_a_text_that_its_keyword_lets_pass(documents):
    samples = [shown(r.pattern) for r, _ in RULES]
    for (rule, pattern), text in zip(RULES, samples, strict=True):
        assert pattern.search(text), (rule, text)
        assert any(k in text for k in rule.keywords), (rule, text)
        assert all(any(g in k for g in GATES) for k in rule.keywords), rule
    check(documents(samples))


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 400
