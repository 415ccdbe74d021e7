import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rosterlane.llm import phrases
from rosterlane.llm.words import words_of
from tests.llm import cases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, support=30, longest=4, top=2000):
    """The contract, phrase by phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    kept = {}
    for (lang, words), a in found.items():
        inside = lambda w: any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1))  # noqa: B023,E731
        if not any(g == lang and len(w) > len(words) and inside(w) and 100 * b >= 80 * a for (g, w), b in found.items()):
            cuts = [(2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            kept.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    out = []
    for lang, every in kept.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(every)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def random_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "Of", "and", "new york", "a\tb", "é", "zwölf", "x", "日本", "end."] + [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None, "und", ""])
        rows.append((lang, "".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", "! "]) for _ in range(rng.randint(0, 60)))))
    return [*rows, *[("en", "Near the old river bank. near the old river mouth")] * 40, ("en", None), (None, "")]


@pytest.mark.parametrize(("shards", "cells"), [(1, 1 << 24), (4, 1 << 24), (3, 16), (5, 1)])
def test_against_plain_counts_also_where_cells_collide(spark, shards, cells):
    rows = random_rows(250)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    options = {"support": 12, "shards": shards, "n_cells": cells, "top": 25}
    assert sorted(map(tuple, phrases.collocations(df, **options).collect())) == plain(rows, 12, top=25)


def test_longer_phrases_start_before_words_have_been_counted_in_all_shards(spark, monkeypatch):
    """Lengths interleave, and no phrase is counted in more steps than there are shards."""
    seen, true_cut = [], phrases.cut
    monkeypatch.setattr(phrases, "cut", lambda df: seen.append(true_cut(df)) or seen[-1])
    monkeypatch.setattr(phrases, "discard", lambda df: None)
    df = spark.createDataFrame(random_rows(400), "lang string, text string").repartition(4)
    phrases.count_phrases(df, support=12)
    steps = [{r.k: r.least for r in t.groupBy("k").agg(F.min("start").alias("least")).collect()} for t in seen if "start" in t.columns]
    assert 2 in steps[1] and 3 in steps[2] and steps[1][2] == 1
    for step, table in enumerate(t for t in seen if "start" in t.columns):
        assert not table.where(F.col("start") + phrases.SHARDS <= step).count()


def test_each_occurrence_is_written_in_one_step_only(spark, monkeypatch):
    """Open counts are not carried from step to step, and a phrase that no single shard makes frequent is found."""
    seen, true_cut = [], phrases.cut
    monkeypatch.setattr(phrases, "cut", lambda df: seen.append(true_cut(df)) or seen[-1])
    monkeypatch.setattr(phrases, "discard", lambda df: None)
    df = spark.createDataFrame([("en", "a b. c a b")] * 8, "lang string, text string").coalesce(1)
    counts, totals = phrases.count_phrases(df, support=16)
    assert {(r.phrase, r.n) for r in counts.collect()} == {("a", 16), ("b", 16), ("a b", 16)}
    assert [r.n for r in totals.collect()] == [40]
    written = [t.where("k = 1").agg(F.sum("n")).first()[0] or 0 for t in seen if "start" in t.columns]
    assert written[: phrases.SHARDS] == [10] * phrases.SHARDS and sum(written) == 40


def test_slices_keep_words_languages_and_breaks():
    w = words_of(pa.array(["A b, a", None, "", "a"]), phrases._WORD, True)
    s = phrases.slice_of(w, np.array([0, 0, 1, 1]), ["en", "de"])
    words = [None, *[(s.raw[a:b].tobytes(), s.names[n]) for a, b, n in zip(s.at[:-1], s.at[1:], s.lang, strict=True)]]
    assert [words[c] for c in s.codes] == [(b"a", "en"), (b"b", "en"), None, (b"a", "en"), None, (b"a", "de"), None]
    assert phrases._whole(phrases._planes(s.codes)).tolist() == s.codes.tolist()
    assert phrases.phrase_strings(s.words(), np.array([0]), 2).to_pylist() == ["a b"]


def test_awkward_rows(spark):
    rows = [(r[2], r[1]) for r in cases.rows()]
    got = phrases.collocations(cases.frame(spark, ["phrase", "n"]), support=2).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2)
    assert phrases.collocations(cases.empty(spark)).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    big = 1 << 62
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big // 3)], "lang string, phrase string, k int, n long")
    assert [r.score for r in phrases.scored(counts).collect()] == [2000000 * (big // 3) // (2 * big - 1)]


def test_pieces_end_at_rows_and_breaks():
    w = words_of(pa.array(["a b, c", None, "d e"]), phrases._WORD, True)
    assert phrases.adjacent(w).tolist() == [True, False, False, True, False]
    assert phrases.phrase_strings(w, np.array([3, 0]), 2).to_pylist() == ["d e", "a b"]


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    expect = con.sql(phrases.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, phrases.op11_collocations(spark, sf_dir).collect())) == sorted(expect)
    assert expect
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert plain(docs) == sorted(expect)
