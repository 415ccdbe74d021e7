import hashlib
import random

import numpy as np
from rosterlane.llm.repeats import cut_repeats, op5_repeats, parting_splitters, sort_multikey
from tests.llm import cases


def brute(texts):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for k, b in enumerate(data):
        for i in range(len(b) - 199):
            seen.setdefault(b[i : i + 200], []).append((k, i))
    gone = [np.zeros(len(b), bool) for b in data]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + 200] = True
    out = []
    for b, g in zip(data, gone, strict=True):
        runs = int((np.diff(np.concatenate(([False], g)).astype(int)) == 1).sum())
        out.append((len(b), int(g.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()))
    return out


def check(rows, docs):
    expect = [(i, *e) for (i, _), e in zip(docs, brute([t for _, t in docs]), strict=True)]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(expect, key=repr)


def test_multikey_sort_and_common_lengths():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (400, 24)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[200:250, :17] = rows[0, :17]
    order, common = sort_multikey(rows)
    ranked = [rows[i].tobytes() for i in order]
    assert ranked == sorted(r.tobytes() for r in rows)
    for i in range(1, len(ranked)):
        same = next((k for k in range(24) if ranked[i][k] != ranked[i - 1][k]), 24)
        assert common[i] == same


def test_any_two_buckets_meet_at_one_splitter_between_them():
    for n in (1, 2, 5, 16, 37):
        lists = [parting_splitters(b, n) for b in range(n + 1)]
        for x in range(n + 1):
            for y in range(x + 1, n + 1):
                assert len([c for c in set(lists[x]) & set(lists[y]) if x <= c < y]) == 1
        assert max(map(len, lists)) <= 2 * n.bit_length()


def test_query_against_brute_force(spark, sf_dir):
    check(op5_repeats(spark, sf_dir).collect(), cases.corpus(spark, sf_dir))


def test_boundaries_part_common_passages(spark, sf_dir):
    """Buckets of a few suffixes: passages that all texts share, whole and in part, lie in many of them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other, docs = prose(60), prose(31), []
    for k in range(60):
        a = rng.choice([0, 0, 0, 9, 30, 100])
        docs.append((k, prose(rng.randint(0, 20)) + passage[a : len(passage) - rng.choice([0, 0, 50, 140])] + prose(rng.randint(0, 20))))
        docs.append((100 + k, prose(rng.randint(0, 40)) + other + prose(rng.randint(0, 40))))
    docs += [(300, "ab" * 400), (301, "z" * 900), (302, prose(50) + "ab" * 150)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for bucket in (3, 40):
        check(cut_repeats(frame, bucket=bucket).collect(), docs)


def test_planted_passages(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(9))
    prose = lambda n: " ".join(word() for _ in range(n))[:n]
    passage, docs = prose(700), []
    for k in range(40):
        a, b = sorted(rng.sample(range(701), 2))
        docs.append((k, prose(rng.randint(0, 500)) + passage[a:b] + prose(rng.randint(0, 500))))
    docs += [(100, passage[:200]), (101, "x" + passage[:199]), (102, passage[:200] + "é" + passage[200:450]), (103, "ab" * 300), (104, "z" * 1000), (105, prose(150) * 3)]
    docs += [(200 + k, docs[k % 3][1]) for k in range(9)]
    near = list(prose(900))
    for k in range(30):
        changed = near.copy()
        for i in rng.sample(range(900), 4):
            changed[i] = "#"
        docs.append((300 + k, "".join(changed)))
    for bucket in (20, 1 << 15):
        check(cut_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bucket=bucket).collect(), docs)


def test_awkward_rows(spark):
    docs = [(r[0], r[1] if r[1] is None or len(r[1]) < 10**5 else r[1][:3000]) for r in cases.rows()]
    got = cut_repeats(spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, places string"))
    check(got.collect(), docs)
    whole = {r.doc_id: r for r in cut_repeats(cases.frame(spark)).collect()}
    assert whole[4].n_removed == whole[4].n_bytes == 150000
    assert cut_repeats(cases.empty(spark)).count() == 0
