import re

import numpy as np
from pyspark.sql import functions as F
from rosterlane.llm.quality import CUTOFF, TOLERANCES, op1_quality, quality
from tests.llm import cases


def stats(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for t in tri:
        seen[t] = seen.get(t, 0) + 1
    covered = {i + k for i, t in enumerate(tri) if seen[t] > 1 for k in range(3)}
    lines, earlier, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in earlier
            earlier.add(x)
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, rep, n < 50 or 100 * rep > 50 * n


def check(rows, docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r.doc_id, *(r[k] for k in names)) for r in rows), key=repr) == sorted(((i, *stats(t)) for i, t in docs), key=repr)
    assert not any(r.kept and r.base_failed for r in rows)


def test_query_statistics_and_verdicts(spark, sf_dir):
    rows = op1_quality(spark, sf_dir).collect()
    check(rows, cases.corpus(spark, sf_dir))
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_outliers_are_found_in_correlated_groups_with_a_third_of_bad_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        words = ["w" * int(rng.integers(2, 9)) + str(k) for k in range(int(rng.integers(60, 200)))]
        if i % 5 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en", "big" if i % 3 else f"small{i}"))
    got = quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == {i for i in range(900) if i % 5 == 0}
    assert all((r.distance**2 <= CUTOFF) == r.kept for r in got)


def test_awkward_rows(spark):
    got = quality(cases.frame(spark, ["kept", "grp", "n_words", "x_0"]), least=4)
    check(got.collect(), [(r[0], r[1]) for r in cases.rows()])
    assert quality(cases.empty(spark)).count() == 0
    one = quality(cases.frame(spark).where(F.col("doc_id") == 7)).collect()
    assert len(one) == 1 and one[0].distance is None


def plain_mcd(x, share=0.75, steps=5):
    """Reweighted MCD with the unit matrix added: three deterministic starts, the exact nearest share of the rows in each step."""
    def near(c, m):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    mid = np.median(x, axis=0)
    dev = np.maximum((np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0)) / 1.349, 1)
    z = (x - mid) / dev
    one = np.eye(x.shape[1])
    starts = [np.diag(dev**2) + one]
    for y in (np.tanh(z), z / np.sqrt((z**2).sum(axis=1, keepdims=True) + 1e-12)):
        c = np.cov(y.T, bias=True)
        corr = c / np.sqrt(np.maximum(np.outer(np.diag(c), np.diag(c)), 1e-18))
        np.fill_diagonal(corr, 1)
        starts.append(corr * np.outer(dev, dev) + 2 * one)
    best = None
    for c in starts:
        m = mid
        for _ in range(steps):
            core = x[np.argsort(near(c, m), kind="stable")[: int(np.ceil(share * len(x)))]]
            m, c = core.mean(axis=0), np.cov(core.T, bias=True) + one
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], c, m)
    d = near(*best[1:])
    core = x[d <= 12.83 * max(np.median(d) / 4.3515, 1e-9)]
    return near(np.cov(core.T, bias=True) * 0.975 / 0.9238 + one, core.mean(axis=0))


def features(r):
    n = max(r.n_words, 1)
    raw = [np.log(n), np.log((r.word_chars + 1) / n), *(np.sqrt(v / n) for v in (r.n_symbols, r.n_dup_lines, r.n_repeat_words))]
    return [v / t for v, t in zip(raw, TOLERANCES, strict=True)]


def test_distances_and_verdicts_are_those_of_a_plain_estimate(spark):
    """Three groups of their own, one of them with a third of all rows, and small sources that their language judges."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        length, wide = int(rng.lognormal(5, 0.5)) + 60, int(rng.integers(3, 8))
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 2 + 2 * wide)))) for _ in range(length)]
        if i % 9 == 0:
            words = [w + "#" * int(rng.integers(0, 3)) for w in words]
        if i % 7 == 0:
            words += words[: length // 4]
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "s0" if i % 3 == 0 or i % 2 else "s1" if i % 4 else f"rare{i}"))
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    groups = {}
    for i, _, lang, source in rows:
        if not source.startswith("rare"):
            groups.setdefault((lang, source), []).append(i)
    judged = dict(groups)
    everyone = [i for i, _, lang, _ in rows if lang == "en"]
    checked, same = 0, 0
    for key, ids in [*judged.items(), ("rare", everyone)]:
        d = plain_mcd(np.array([features(got[i]) for i in ids]))
        for i, value in zip(ids, d, strict=True):
            if key == "rare" and not rows[i][3].startswith("rare"):
                continue
            checked += 1
            same += abs(got[i].distance ** 2 - value) <= 0.15 * value + 0.2
            if got[i].base_failed or abs(value - CUTOFF) > 0.2 * CUTOFF:
                assert got[i].kept == (not got[i].base_failed and value <= CUTOFF), (key, i, got[i], value)
    assert checked == 1500 and same > 0.97 * checked and 0 < sum(not r.kept for r in got.values()) < 500


def test_one_planted_outlier_of_each_statistic(spark):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefghij"), n))
    text = lambda n, size=6: [word(size) for _ in range(n)]
    rows = [(i, "\n".join(" ".join(text(10)) for _ in range(int(rng.integers(8, 40))))) for i in range(600)]
    lines = [" ".join(text(10)) for _ in range(76)]
    bad = {
        900: " ".join(text(300, 14)),  # long words
        901: " ".join(w + "|" for w in text(300)),  # symbols
        902: "\n".join([*lines, *lines[:24]]),  # repeated lines, 48 % of the words in repeats
        903: " ".join(text(230)) + (" " + " ".join(text(22))) * 8,  # repeated words
    }
    rows += list(bad.items())
    frame = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality(frame).collect()}
    assert not any(got[i].base_failed for i in bad)
    assert {i for i, r in got.items() if not r.kept} == set(bad)
