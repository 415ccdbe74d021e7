"""The most alike reference text against all pairs, and how few pairs are scored."""

import random

from pyspark.sql import functions as F
from rosterlane.functions.similarity import address_similarity
from rosterlane.operators import match as m
from rosterlane.operators import nearest as n


def texts(count, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        street = rng.choice(["Main", "Oak", "Elm", "Birch Hill", "River", "Old Mill"])
        zip_code = f"{rng.randint(10000, 10020)}" if rng.random() < 0.7 else ""
        out.append(f"{rng.randint(1, 40)} {street} {rng.choice(['St', 'Ave'])}, {rng.choice(['Springfield', 'Salem', 'Troy'])}, {rng.choice(['CA', 'NY'])} {zip_code}".strip())
    return out


def all_pairs(asked, known):
    pairs = asked.where("a <> ''").select("id", "a").crossJoin(known.select("ref", "b"))
    scored = address_similarity(pairs, "a", "b", "score").withColumn("score", F.round("score", 9))
    top = scored.groupBy("id").agg(F.min_by(F.struct("ref", "score"), F.struct(-F.col("score"), "ref")).alias("m"))
    return sorted((r.id, r.m.ref, r.m.score) for r in top.collect())


def frames(spark, a, b):
    asked = spark.createDataFrame(list(enumerate(a)), "id long, a string")
    known = spark.createDataFrame([(f"r{i:04}", x) for i, x in enumerate(b)], "ref string, b string")
    return asked, known


def test_same_winners_as_all_pairs(spark):
    asked, known = frames(spark, [*texts(120, 1), "", "9 Main St, Troy, NY"], texts(150, 2))
    assert sorted((r.id, r.ref, r.score) for r in n.nearest(asked, known, most=1000).collect()) == all_pairs(asked, known)
    # without keys that half of the reference holds, the winners that score 0.75 are the same
    few = {r.id: (r.ref, r.score) for r in n.nearest(asked, known, most=75).collect()}
    assert all(few[i] == (ref, score) for i, ref, score in all_pairs(asked, known) if score >= 0.75)


def test_the_bound_is_never_below_the_score(spark):
    asked, known = frames(spark, texts(60, 3), [*texts(60, 4), "x", "é 1"])
    pairs = asked.select("a").crossJoin(known.select("b"))
    both = address_similarity(pairs, "a", "b", "score").withColumn("bound", n.bound(F.col("a"), F.col("b"), n.letters_of(F.col("a")), n.letters_of(F.col("b"))))
    assert both.where("bound < score - 1e-9").count() == 0
    assert both.agg(F.avg(F.col("bound") - F.col("score"))).first()[0] < 0.2


def test_few_pairs_are_scored_and_no_key_is_hot(spark, monkeypatch):
    """A third of all share a street; its words tell nothing apart, and of the candidates few can win."""
    words = [f"{i % 97} Main St, City{i % 50}, CA {10000 + i}" for i in range(900)] + [f"{i} Elm Road, Town{i % 50}, NY {20000 + i}" for i in range(1800)]
    asked, known = frames(spark, [w.replace("St", "Street") for w in words[::3]], words)
    counted, score = [], n.address_similarity
    monkeypatch.setattr(n, "address_similarity", lambda df, *a: counted.append(df.count()) or score(df, *a))
    index = known.select(F.explode(n.keys_of(F.col("b"))).alias("key")).groupBy("key").count()
    assert index.where("count > 200").count() > 3
    got = n.nearest(asked, known).collect()
    assert len(got) == 900 and all(r.ref == f"r{3 * r.id:04}" for r in got)
    candidates = n.candidates(asked, known).count()
    assert candidates < 900 * 250 and sum(counted) < 5 * 900 < candidates / 5


def test_addresses_without_or_with_a_wrong_zip_find_theirs(spark):
    reference = spark.createDataFrame([("n1", "12 Oak Ave", "Salem", "NY", "10001"), ("n2", "12 Elm St", "Troy", "CA", "10002")], "npi string, address_1 string, city string, state string, postal_code string")
    entities = spark.createDataFrame([(1, "x", "12 Oak Ave", "Salem", "NY", None), (2, "x", "12 Elm St", "Troy", "CA", "99999"), (3, "x", "", None, " ", None), (4, "x", "zz", "qq", "ww", "00000")], "id long, name string, address_line1 string, city string, state string, zip string")
    got = {r.id: (r.reason, r.ref_id) for r in m.address_reference_match(entities, reference).collect()}
    assert got == {1: (None, "n1"), 2: (None, "n2"), 3: ("EMPTY_ADDRESS", None), 4: ("NO_RESULTS", None)}


def plain_listing(names, rows):
    """The first row by exact name, else with all search words, else whose words the search holds."""
    titles = {"dr", "md", "do", "pa", "np", "rn", "mr", "ms", "mrs"}
    out = {}
    for i, name in names:
        for tier in (1, 2, 3):
            long = lambda x, n: [w for w in dict.fromkeys(x.split()) if len(w) > n and w not in titles]
            met = {1: lambda e: e == name, 2: lambda e: len(long(name, 2)) > 1 and all(w in e for w in long(name, 2)), 3: lambda e: len(long(e, 3)) > 1 and all(w in name for w in long(e, 3))}[tier]
            found = [p for p, e in rows if met(e)]
            if found:
                out[i] = (tier, min(found))
                break
    return out


def test_listing_match_where_a_third_share_their_words(spark):
    rng = random.Random(6)
    words = ["general", "hospital", "north", "south", "river", "clinic", "care", "anna", "bert", "cole", "dane", "smithson", "johnson", "xu"]
    name = lambda: " ".join(["general hospital", rng.choice(words), rng.choice(words)] if rng.random() < 0.4 else rng.sample(words, rng.randint(1, 4)))
    asked, rows = [(i, name()) for i in range(150)], [(i, name()) for i in range(150)]
    entities = spark.createDataFrame(asked, "id long, name string")
    listing = spark.createDataFrame(rows, "pos long, name string")
    for most in (1000, 20, 0):
        assert {r.id: (r.tier, r.pos) for r in m.listing_match(entities, listing, most).collect()} == plain_listing(asked, rows)
