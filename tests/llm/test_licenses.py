import re

from rosterlane.llm.license_rules import ANCHORS, rules
from rosterlane.llm.licenses import PHRASES, op4_licenses, scan_licenses
from tests.llm import cases
from tests.llm.test_decontaminate import words

RULES = [(p, label, k, re.compile(x), s) for p, label, k, x, s in rules()]


def brute(text):
    w = words(text)
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(w)) if w[i : i + len(parts)] == parts]
    norm = " " + " ".join(w) + " "
    found = sorted((m.start(), -m.end(), p, label, s) for p, label, _, x, s in RULES for m in x.finditer(norm))
    kept = []
    for s, e, p, label, score in found:
        if not any(-e <= x[1] and x[2] <= p for x in kept):
            kept.append((s, -e, p, label, score))
    base = sorted({x for _, x in places})
    score = max([0.0, *(x[4] for x in kept), *([0.9] if places else [])])
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *(x[3] for x in kept)})), score


def check(rows, docs):
    assert sorted((tuple(r)[:8] for r in rows), key=repr) == sorted(((i, *brute(t)) for i, t in docs), key=repr)


def test_keywords_and_anchors_are_necessary():
    assert len(rules()) > 250
    for _, _, keyword, pattern, _ in rules():
        surely = re.sub(r"\([^()]*\)\?", "", re.sub(r"\([^()]*\)\?", "", pattern))
        assert any(a in f" {keyword}" for a in ANCHORS) or " licen" in surely, keyword
    samples = ["0bsd", "apache 2 0", "agplv3", "mpl 2 0", "w3c software license", "zlib license", "x11 license", "beerware", "bsd 3 clause", "cc0 1 0", "same terms as perl itself"]
    for s in samples:
        assert any(x.search(f" {s} ") and k in f" {s} " for _, _, k, x, _ in RULES), s


def test_query_against_brute_force(spark, sf_dir):
    rows = op4_licenses(spark, sf_dir).collect()
    check(rows, cases.corpus(spark, sf_dir))
    assert {x for r in rows for x in r.labels.split(",")} >= {"mit", "apache", "cc-by-nc"}


def test_overlaps_and_awkward_rows(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0; see http://www.apache.org/licenses/LICENSE-2.0",
        "CC BY-NC-SA 4.0 and cc-by, also https://creativecommons.org/licenses/by-sa/4.0/",
        "GNU Lesser General Public License v2.1 or later. GNU General Public License",
        "SPDX-License-Identifier: MIT License. MIT LICENSE mit license mit license",
        "SPDX-License-Identifier: BSD-3-Clause; Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "mitlicense permit license", "MIT License " * 3000, "gpl x apache license version 2 0 y cc by nc " * 700, "licenKe", "no licence here", "All rights reserved. 0BSD x",
    ]
    docs = [(100 + i, t) for i, t in enumerate(texts)]
    check(scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    check(scan_licenses(cases.frame(spark, ["labels", "norm"])).collect(), [(r[0], r[1]) for r in cases.rows()])
    assert scan_licenses(cases.empty(spark)).count() == 0
