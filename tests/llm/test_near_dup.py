import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from rosterlane.llm import near_dup
from rosterlane.llm.near_dup import CHUNKS, DISTANCE, SYMBOLS, chunk_keys, deduplicate, near_duplicates, op6_near_duplicates
from tests.llm import cases
from tests.llm.test_tokens import SHORT_TWINS

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets, n = {}, []
    for i, t in docs:
        sets.setdefault(i, set()).add(shingles(t))
        n.append((i, len(shingles(t))))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(i, j):
        a, b = sorted((find(i), find(j)))
        parent[b] = a

    seen = {}
    for i, own in sorted(sets.items()):
        for s in own - {frozenset()}:
            seen.setdefault(s, []).append(i)
    for same in seen.values():
        for i in same:
            join(i, same[0])
    by = {}
    for s in seen:
        for g in s:
            by.setdefault(g, []).append(s)
    pairs = {frozenset(p) for ss in by.values() for p in combinations(ss, 2)}
    for p in pairs:
        s, t = p
        if 100 * len(s & t) >= 85 * len(s | t):
            join(seen[s][0], seen[t][0])
    low = {}
    for i in sets:
        low[find(i)] = min(i, low.get(find(i), i))
    return {(i, k, low[find(i)], i == low[find(i)]) for i, k in n}


def test_pigeonhole_covers_every_error_pattern():
    keys = chunk_keys(SYMBOLS, CHUNKS, DISTANCE)
    assert len(keys) == 40
    rng = np.random.default_rng(1)
    for _ in range(3000):
        wrong = set(rng.choice(SYMBOLS, DISTANCE, replace=False).tolist())
        assert any(not wrong & set(k) for k in keys)
    small = chunk_keys(8, 3, 4)
    for wrong in combinations(range(8), 4):
        assert any(not set(wrong) & set(k) for k in small)


def test_query_against_brute_force(spark, sf_dir):
    got = {tuple(r) for r in op6_near_duplicates(spark, sf_dir).collect()}
    assert got == brute(cases.corpus(spark, sf_dir))


def test_chains_thresholds_and_awkward_rows(spark):
    base = [f"w{i}" for i in range(104)]
    docs = []
    for k in range(12):  # a chain: neighbours are linked, the ends are not
        docs.append((1000 + k, " ".join(base[2 * k :] + [f"x{i}" for i in range(2 * k)])))
    s = [f"v{i}" for i in range(41)]
    docs += [(2000, " ".join(s)), (2001, " ".join(s[:-6] + ["V1", "V2"])), (2002, " ".join(s[:40] + ["q"]))]
    rows = [(r[0], r[1]) for r in cases.rows() if r[0] is not None]
    frame = spark.createDataFrame(docs + rows, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(frame).collect()} == brute(docs + rows)
    awkward = cases.frame(spark, ["n_shingles", "component_id"])
    got = near_duplicates(awkward)
    assert got.count() == len(cases.rows())
    assert all(r.kept and r.component_id is None for r in got.where("doc_id is null").collect())
    kept = deduplicate(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, None}
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_what_leaders_leave_is_joined_without_losing_a_link(spark):
    """A cluster of copies with 1 to 5 edits each: few are linked, and only some through others."""
    import random

    from pyspark.sql import functions as F
    from rosterlane.llm import near_dup

    rng = random.Random(6)
    base, docs = [f"w{i}" for i in range(150)], []
    for k in range(150):
        words = base.copy()
        for i in rng.sample(range(150), rng.choice([1, 2, 2, 3, 4, 5])):
            words[i] = rng.choice(["x", "y", f"z{k}"])
        docs.append((k, " ".join(words)))
    other = [f"v{i}" for i in range(90)]
    for k in range(40):
        words = other.copy()
        for i in rng.sample(range(90), rng.choice([0, 1, 2, 3])):
            words[i] = f"u{k}"
        docs.append((1000 + k, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(frame).collect()} == brute(docs)

    # The residual join alone, from scratch: every linked pair of a cluster that shares one key.
    sets = near_dup.map_batches(frame.withColumnRenamed("doc_id", "id"), near_dup._set_rows, "node long, n long, shingles array<long>")
    rows = sets.withColumn("root", F.col("node"))
    members = sets.select(F.lit(1).alias("key"), "node")
    got = {frozenset((r.a, r.b)) for r in near_dup.prefix_pairs(rows, members).collect()}
    full = {i: shingles(t) for i, t in docs}
    linked = {frozenset((i, j)) for i, j in combinations(full, 2) if 100 * len(full[i] & full[j]) >= 85 * len(full[i] | full[j])}
    assert linked <= got and len(got) < 0.25 * len(docs) ** 2 / 2


def test_ids_with_several_texts_lose_no_document(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (7, y), (9, z), (9, ""), (9, None), (4, z.replace("z59", "Q")), (20, y + " end"), (30, "one two")]
    rows += [(40, f"own{k} text number {k} here with words {k}") for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_duplicates(frame).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in deduplicate(frame).collect()}
    assert kept == {3, 4, 30, 40}


def test_words_that_a_polynomial_hash_confuses(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two three {a} five"), (2, f"one two three {b} five"), (3, a), (4, b), (5, b)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_rows_near_what_a_cluster_shares_are_connected(spark):
    """close_links against all pairs, at sizes where the rounding of the bound decides."""
    import random

    from rosterlane.llm.near_dup import close_links

    rng = random.Random(3)
    rows = [(c, 1000 * c + k, 1000 * c + k, n := rng.randint(20, 60), rng.randint(0, n // 7 + 1)) for c in range(8) for k in range(rng.choice([3, 12, 60]))]
    got = [(r.a, r.b) for r in close_links(spark.createDataFrame(rows, "cluster int, node long, root long, n long, size long")).collect()]
    bound = lambda s: s - 2 * -(-85 * s // 185)
    by = {r[1]: r for r in rows}
    is_close = lambda x, y: x[0] == y[0] and x[4] + y[4] <= bound(x[3] + y[3])
    assert all(is_close(by[a], by[b]) for a, b in got)

    def groups(links):
        parent = {i: i for i in by}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[find(a)] = find(b)
        return {frozenset(i for i in by if find(i) == r) for r in map(find, by)}

    assert groups(got) == groups([(x[1], y[1]) for x, y in combinations(rows, 2) if is_close(x, y)]) and len(got) < 3 * len(rows)


def test_short_words_that_a_sum_confuses():
    for x, y in SHORT_TWINS:
        a, b = near_dup.shingle_sets(pa.array([f"one two {x} three four", f"one two {y} three four"]))
        assert len(a) == len(b) == 1 and a[0] != b[0]
