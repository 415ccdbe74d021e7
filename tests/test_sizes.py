"""What queries must not do as tables grow: send tables to all, or compute a name once for each use."""

from pyspark.sql import functions as F
from rosterlane.functions.similarity import address_similarity, token_cosine
from rosterlane.operators import match, nearest
from rosterlane.plans import registry


def plan_of(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_registry_name_search_sends_no_table_to_all(spark, sf_dir):
    assert "Broadcast" not in plan_of(spark, sf_dir, "registry_name_search")


def test_candidate_scoring_sends_no_table_to_all_and_cleans_names_once(spark, sf_dir):
    plan = plan_of(spark, sf_dir, "candidate_scoring")
    assert "Broadcast" not in plan
    assert plan.count(r"\([^)]+\)") < 5


def test_words_are_told_apart_once_per_text_not_per_pair(spark):
    asked, known = spark.createDataFrame([(1, "1 Oak St, Troy, NY")], "id long, a string"), spark.createDataFrame([("r", "1 OAK ST, Troy")], "ref string, b string")
    plan = nearest.candidates(asked, known)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") < 8


def test_cosine_of_hashed_words_and_the_bound_without_letters(spark):
    texts = ["1 Oak St, Troy, Troy, NY NY", "1 oak st", "1 1 1 Oak", "1 1 oak oak", "!", "İİ İ 1", "xxxx 1", "Troy Troy Troy Troy NY"]
    t = spark.createDataFrame([(x,) for x in texts], "a string")
    pairs = t.select("a", nearest.words_of(F.col("a")).alias("x")).crossJoin(t.select(F.col("a").alias("b"), nearest.words_of(F.col("a")).alias("y")))
    both = pairs.withColumn("plain", token_cosine(F.col("a"), F.col("b"))).withColumn("cosine", nearest.cosine(F.col("a"), F.col("b"), F.col("x"), F.col("y")))
    assert both.where("abs(plain - cosine) > 1e-12").count() == 0 and both.where("plain > 0.1 and plain < 0.9").count() > 9
    scored = address_similarity(both, "a", "b", "score").withColumn("bound", nearest.bound(F.col("a"), F.col("b"), alike=F.col("cosine")))
    assert scored.where("bound < score - 1e-9").count() == 0


def test_a_pair_s_words_are_told_apart_once_for_its_cosine(spark):
    pairs = spark.createDataFrame([("1 Oak Oak St", "oak st 2")], "a string, b string").select(token_cosine(F.col("a"), F.col("b")).alias("c"))
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2
    rows = spark.createDataFrame([("1 Oak Oak St", "oak st 2"), ("", "x"), (None, "x")], "a string, b string").repartition(1).select("a", token_cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert {r.a: round(r.c, 9) for r in rows} == {"1 Oak Oak St": round(3 / 18**0.5, 9), "": 0.0, None: 0.0}


def test_places_that_repeat_words_are_found(spark):
    """Words that stand twice (both sides) or three times (the exact way) count as often as they stand."""
    places = [("p1", "Care", "1 Oak St", "Troy", "NY", "10001"), ("p2", "Care Care", "1 Oak St", "Troy", "NY", "10002"), ("p3", "Care Care Care", "1 Oak St", "Troy", "NY", "10003"), ("p4", "Other", "77 Elm Rd", "Salem", "CA", "20001")]
    known = spark.createDataFrame(places, "poi_id string, name string, address_1 string, city string, state string, postal_code string")
    asked = [(i, p[1], p[2], p[3], p[4], p[5]) for i, p in enumerate(places)] + [(9, None, None, " ", None, None), (10, "zz", "yy", "xx", "ww", "99999")]
    entities = spark.createDataFrame(asked, "id long, name string, address_line1 string, city string, state string, zip string")
    got = {r.id: (r.is_found, r.reason, r.poi_id, r.score) for r in match.poi_match(entities, known).collect()}
    assert got == {0: (True, None, "p1", 1.0), 1: (True, None, "p2", 1.0), 2: (True, None, "p3", 1.0), 3: (True, None, "p4", 1.0), 9: (False, "EMPTY_QUERY", None, None), 10: (False, "LOW_CONFIDENCE_OR_NO_RESULTS", None, None)}
