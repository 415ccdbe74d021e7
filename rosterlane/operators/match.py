"""Matching entities to reference tables: keyed lookups and blocked fuzzy joins, ranked to one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlane.functions import text as t

from .nearest import nearest

_ORG = ("LLC", "PC", "INC", "LTD", "PLLC", "PA")
_TITLES = ("dr", "md", "do", "pa", "np", "rn", "mr", "ms", "mrs")
CANDIDATES = 5


def registry_lookup(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, npi, is_found, name, phone, specialty, address, license): is_found is null without an id, false if the registry lacks it."""
    asked = entities.select("id", t.blank_to_null(t.trim(F.col("npi_id"))).alias("npi"))
    known = registry.select("npi", F.lit(True).alias("hit"), F.concat_ws(" ", "first_name", "last_name").alias("name"), F.col("telephone_number").alias("phone"), F.col("taxonomy_desc").alias("specialty"), F.concat_ws(", ", "address_1", "city", "state", "postal_code").alias("address"), "license")
    found = F.when(F.col("npi").isNotNull(), F.coalesce("hit", F.lit(False)))
    return asked.join(known, "npi", "left").select("id", "npi", found.alias("is_found"), "name", "phone", "specialty", "address", "license")


def _keys(df: DataFrame) -> DataFrame:
    """One row per entity and search strategy: rank and the fields that must be equal. A name is cleaned and split once, not for each strategy."""
    named = df.select("id", F.upper("state").alias("state"), F.upper("city").alias("city"), t.name_for_registry(F.col("name")).alias("name"))
    split = named.select("*", F.split("name", " ").alias("words"), _plain_words(F.col("name")).alias("search"))
    name, words = F.col("name"), F.col("words")
    last = F.element_at(words, -1)
    org = F.lit(False)
    for w in _ORG:
        org = org | last.contains(w)
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    told = split.select("id", "state", "city", "search", "name", words[0].alias("first"), last.alias("last"), rest.alias("rest"), F.size(words).alias("size"), (org | (F.size(words) > 4)).alias("org"))

    def way(rank: int, when: Column, kind: str, first: Column | None, family: Column, city: bool, state: bool) -> Column:
        none = F.lit(None).cast("string")
        fields = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (none if first is None else first).alias("first"), family.alias("family"), (F.col("city") if city else none).alias("k_city"), (F.col("state") if state else none).alias("k_state"))
        return F.when(when & (name != ""), fields)

    first, last, rest, org, size = (F.col(c) for c in ("first", "last", "rest", "org", "size"))
    person, single = ~org & (size >= 2), ~org & (size < 2)
    ways = [
        way(1, org, "org", None, name, True, True), way(2, org, "org", None, name, False, True), way(3, org, "org", None, name, False, False),
        way(1, person, "full", first, last, True, True), way(2, person, "full", first, rest, True, True), way(3, person, "full", first, last, False, True),
        way(4, person, "full", first, rest, False, True), way(5, person, "full", first, last, False, False), way(6, person, "prefix", F.substring(first, 1, 2), last, False, True),
        way(1, single, "last", None, name, False, True), way(2, single, "last", None, name, False, False),
    ]
    return told.select("id", "state", "search", F.explode(F.array(*ways)).alias("w")).where("w is not null").select("id", "state", "search", "w.*")


def _plain_words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.upper(c), r"[^A-Z\s]", "")), r"\s+")


def candidate_score(search: Column, entry: Column, same_state: Column) -> Column:
    """Of two arrays of words: +2 for each search word that stands in the entry, +1 if only a prefix does either way, +1 for the state."""
    one = lambda w: F.when(F.array_contains(entry, w), 2).when(F.exists(entry, lambda e: e.startswith(w) | w.startswith(e)), 1).otherwise(0)
    return F.aggregate(F.transform(search, one), F.lit(0), lambda s, x: s + x) + F.coalesce(same_state, F.lit(False)).cast("int")


def _key(*fields: str) -> Column:
    """The fields as one text: equal where all of them are, nulls included."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("\x02")) for c in fields])


def registry_candidates(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, rank, npi, score, n): the first five registry rows by npi of each entity and strategy, scored.

    Each strategy is an equi-join on the fields it names; a registry row is filed once under each kind of key, and of those filed under a key
    the first five by npi stay, so a search meets at most five however many share a name. Words are split once per row.
    Both sides have several rows for each row read, which the planner's sizes leave out: a merge join, or it would broadcast either to all.
    """
    fields = ["kind", "first", "family", "k_city", "k_state"]
    asked = _keys(entities).select("id", "rank", "state", "search", _key(*fields).alias("key"))
    first, last, city, state = (F.upper(c) for c in ("first_name", "last_name", "city", "state"))
    none = F.lit(None).cast("string")
    filed = [F.struct(F.lit(k).alias("kind"), a.alias("first"), last.alias("family"), c.alias("k_city"), s.alias("k_state")) for k, a, c, s in (("full", first, city, state), ("full", first, none, state), ("full", first, none, none), ("prefix", F.substring(first, 1, 2), none, state), ("last", none, none, state), ("last", none, none, none))]
    name = F.when(F.col("last_name").isNotNull(), F.concat_ws(" ", "first_name", "middle_name", "last_name"))
    if "organization_name" in registry.columns:
        org = F.upper("organization_name")
        filed += [F.struct(F.lit("org").alias("kind"), none.alias("first"), org.alias("family"), c.alias("k_city"), s.alias("k_state")) for c, s in ((city, state), (none, state), (none, none))]
        name = F.coalesce(name, F.col("organization_name"))
    listed = registry.select("npi", _plain_words(name).alias("entry"), state.alias("r_state"), F.array(*filed).alias("filed"))
    rows = listed.select("npi", "entry", "r_state", F.explode("filed").alias("f")).where("f.family is not null")
    top = rows.select("npi", "entry", "r_state", "f.*").select("npi", "entry", "r_state", _key(*fields).alias("key"))
    top = top.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("npi"))).where(F.col("pos") <= CANDIDATES)
    scored = asked.join(top.hint("merge"), "key").select("id", "rank", "npi", candidate_score(F.col("search"), F.col("entry"), F.col("state") == F.col("r_state")).alias("score"))
    return scored.withColumn("n", F.count("*").over(Window.partitionBy("id", "rank")))


def registry_name_search(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, rank, npi, score): the lowest strategy that answers; its best candidate of 3 points or more, or its only one."""
    ranked = registry_candidates(entities, registry).withColumn("pos", F.row_number().over(Window.partitionBy("id", "rank").orderBy(F.desc("score"), "npi")))
    accepted = ranked.where((F.col("pos") == 1) & ((F.col("score") >= 3) | (F.col("n") == 1)))
    return accepted.groupBy("id").agg(F.min(F.struct("rank", "npi", "score")).alias("b")).select("id", "b.rank", "b.npi", "b.score")


def lookup_cascade(entities: DataFrame, registry: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, npi, how, verified, name, phone, specialty, address, license): by id if there is one, else by name, else by page_search() over pages (page_id, id, tier, html).

    What is found is verified: an id of a page that the registry lacks gives a row with the id and the entity's name alone. how is NPI_NOT_FOUND if none answers.
    """
    by_id = registry_lookup(entities, registry).where("is_found").select("id", F.lit(1).alias("order"), "npi", F.lit("BY_ID").alias("how"))
    rest = entities.join(by_id, "id", "left_anti")
    by_name = registry_name_search(rest, registry).select("id", F.lit(2).alias("order"), "npi", F.lit("BY_NAME").alias("how"))
    by_page = first_page_ids(rest, pages).select("id", F.lit(3).alias("order"), "npi", F.lit("BY_PAGE").alias("how"))
    best = by_id.unionByName(by_name).unionByName(by_page).groupBy("id").agg(F.min(F.struct("order", "npi", "how")).alias("b")).select("id", "b.npi", "b.how")
    told = verify_ids(best.join(entities.select("id", "name"), "id").withColumnRenamed("how", "source"), registry).withColumnRenamed("source", "how")
    joined = entities.select("id").join(told, "id", "left")
    return joined.select("id", "npi", F.coalesce("how", F.lit("NPI_NOT_FOUND")).alias("how"), F.coalesce("verified", F.lit(False)).alias("verified"), "name", "phone", "specialty", "address", "license")


def verify_ids(found: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, npi, verified, name, phone, specialty, address, license, source): found ids (id, npi, name, source) joined back to the registry.

    A hit gives the registry's row, a miss a row with the id and the name that was searched alone.
    """
    known = registry.select("npi", F.lit(True).alias("hit"), F.concat_ws(" ", "first_name", "last_name").alias("r_name"), F.col("telephone_number").alias("phone"), F.col("taxonomy_desc").alias("specialty"), F.concat_ws(", ", "address_1", "city", "state", "postal_code").alias("address"), "license")
    hit = F.coalesce("hit", F.lit(False))
    return found.join(known, "npi", "left").select("id", "npi", hit.alias("verified"), F.when(hit, F.col("r_name")).otherwise(F.col("name")).alias("name"), "phone", "specialty", "address", "license", "source")


def first_page_ids(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, npi, name, source): the first id that a page of the first tier gives an entity, else one of the second tier.

    pages: (page_id, id, tier, html), id being the entity that the page was searched for.
    """
    from .extract import ids_from_pages

    ids = ids_from_pages(pages).select("page_id", F.get("ids", F.lit(0)).alias("npi"))
    hits = pages.select("page_id", "id", "tier").join(ids, "page_id").join(entities.select("id", "name"), "id")
    first = hits.where("tier in (1, 2)").groupBy("id").agg(F.min_by(F.struct("npi", "name", "tier"), F.struct("tier", "page_id")).alias("h"))
    return first.select("id", "h.npi", "h.name", F.concat_ws(":", F.lit("PAGE"), F.col("h.tier").cast("string")).alias("source"))


def page_search(entities: DataFrame, pages: DataFrame, registry: DataFrame) -> DataFrame:
    """verify_ids() of first_page_ids()."""
    return verify_ids(first_page_ids(entities, pages), registry)


def _significant(c: Column, longer_than: int) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: (F.length(w) > longer_than) & ~w.isin(*_TITLES))


def listing_match(entities: DataFrame, listing: DataFrame, most: int = 1000) -> DataFrame:
    """(id, tier, pos): the first listing row by exact name; else with all search words; else whose own words the search holds.

    Tiers 2 and 3 join on three letters of the side that must be contained (its rarest in the other table, and those of another word where more
    than `most` names hold it), then verify.
    """
    asked = entities.select("id", F.lower(t.trim(t.name_for_search(F.col("name")))).alias("search"))
    rows = listing.select("pos", F.lower(t.trim(F.col("name"))).alias("entry"))
    exact = asked.join(rows, F.col("search") == F.col("entry")).select("id", F.lit(1).alias("tier"), "pos")
    names = asked.select("search").distinct().withColumn("words", F.array_distinct(_significant(F.col("search"), 2)))
    entries = rows.groupBy("entry").agg(F.min("pos").alias("pos")).withColumn("words", F.array_distinct(_significant(F.col("entry"), 3)))
    two = _contained(names.where(F.size("words") >= 2), "search", entries, "entry", 2, most)
    three = _contained(entries.where(F.size("words") >= 2), "entry", names, "search", 3, most)
    fuzzy = asked.join(two.unionByName(three), "search").select("id", "tier", "pos")
    rest = fuzzy.join(exact.select("id").distinct(), "id", "left_anti")
    return exact.unionByName(rest).groupBy("id").agg(F.min(F.struct("tier", "pos")).alias("b")).select("id", "b.tier", "b.pos")


def _trigrams(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))


def _contained(small: DataFrame, small_name: str, large: DataFrame, large_name: str, tier: int, most: int = 1000) -> DataFrame:
    """(search, tier, pos) where all words of small stand in large's name, also inside its words.

    A contained word's three-letter parts are all there too, so the join is on the part of small that fewest names of large hold. Where even
    that is in more than `most` names, it is on this part and the rarest one of another word: names that hold a hot part are filed under it with each of their
    other parts.
    """
    place = ["pos"] if large_name == "entry" else []
    spelled = large.select(large_name, *place, F.array_distinct(_trigrams(F.col(large_name))).alias("parts"))
    single = spelled.select(large_name, *place, "parts", F.explode("parts").alias("part"))
    often = single.groupBy("part").agg(F.count("*").alias("n"))
    asked = small.select(small_name, "words", *([] if place else ["pos"]))
    each = asked.select(small_name, F.posexplode("words").alias("w", "word")).select(small_name, "w", F.explode(F.array_distinct(_trigrams(F.col("word")))).alias("part"))
    by_word = each.join(often, "part", "left").groupBy(small_name, "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "part")).alias("p"))
    rarest = by_word.groupBy(small_name).agg(F.array_sort(F.collect_list("p")).alias("p"))  # a row per word
    first, second = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    both = (first["n"] > most) & (second["part"] != first["part"])
    keyed = asked.join(rarest, small_name).select(*asked.columns, F.when(both, F.concat(first["part"], F.lit("\x01"), second["part"])).otherwise(first["part"]).alias("key"))
    hot = single.join(often.where(F.col("n") > most).select("part"), "part", "left_semi").select(large_name, *place, "part", F.explode("parts").alias("other")).where("other <> part")
    filed = single.select(large_name, *place, F.col("part").alias("key")).unionByName(hot.select(large_name, *place, F.concat("part", F.lit("\x01"), "other").alias("key")))
    met = keyed.join(filed, "key").where(F.forall("words", lambda w: F.col(large_name).contains(w)))
    return met.select("search", F.lit(tier).alias("tier"), "pos")


def address_reference_match(entities: DataFrame, reference: DataFrame, least: float = 0.65, **options) -> DataFrame:
    """(id, reason, ref_id, score): the reference address that is most alike, of any zip (see nearest.py); EMPTY_ADDRESS, or NO_RESULTS if none scores `least`."""
    query = F.array_join(F.array_compact(F.array(*[t.blank_to_null(F.col(c)) for c in ("address_line1", "city", "state", "zip")])), ", ")
    asked = entities.select("id", query.alias("a"))
    known = reference.select(F.col("npi").alias("ref"), F.concat_ws(", ", "address_1", "city", "state", "postal_code").alias("b"))
    top = nearest(asked, known, **options).where(F.col("score") >= least)
    return asked.join(top, "id", "left").select("id", F.when(F.col("a") == "", "EMPTY_ADDRESS").when(F.col("ref").isNull(), "NO_RESULTS").alias("reason"), F.col("ref").alias("ref_id"), F.round("score", 6).alias("score"))


def poi_match(entities: DataFrame, places: DataFrame, least: float = 0.65, **options) -> DataFrame:
    """(id, is_found, reason, poi_id, score): the place that is most like the entity's name and address, of any zip (see nearest.py).

    places: (poi_id, name, address_1, city, state, postal_code). EMPTY_QUERY without anything to ask for, LOW_CONFIDENCE_OR_NO_RESULTS
    without a place that scores `least`.
    """
    name = t.blank_to_null(t.name_for_search(F.col("name")))
    query = F.array_join(F.array_compact(F.array(name, *[t.blank_to_null(F.col(c)) for c in ("address_line1", "city", "state", "zip")])), ", ")
    asked = entities.select("id", query.alias("a"))
    known = places.select(F.col("poi_id").alias("ref"), F.concat_ws(", ", "name", "address_1", "city", "state", "postal_code").alias("b"))
    met = asked.join(nearest(asked, known, **options).where(F.col("score") >= least), "id", "left")
    reason = F.when(F.col("a") == "", "EMPTY_QUERY").when(F.col("ref").isNull(), "LOW_CONFIDENCE_OR_NO_RESULTS")
    return met.select("id", reason.isNull().alias("is_found"), reason.alias("reason"), F.col("ref").alias("poi_id"), F.round("score", 6).alias("score"))


def source_pivot(sources: DataFrame, types=("NPI_API", "AZURE_POI", "SCRAPING_ENRICHMENT")) -> DataFrame:
    """(provider_id, <type>_phone, <type>_website ...): the first row of each source type."""
    first = sources.where("is_found").groupBy("provider_id").pivot("source_type", list(types)).agg(F.min_by("phone", "source_id").alias("phone"), F.min_by("website", "source_id").alias("website"))
    return first


def contact_resolution(entities: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, contact): own e-mail, else the first that a point of interest or scraped source has (email, else provider_email)."""
    have = [F.when(F.length(c) > 0, F.col(c)) for c in ("email", "provider_email") if c in sources.columns]
    told = sources.where("source_type in ('AZURE_POI', 'SCRAPING_ENRICHMENT')").select(F.col("provider_id").alias("id"), "source_id", F.coalesce(*have).alias("found")).where("found is not null")
    first = told.groupBy("id").agg(F.min_by("found", "source_id").alias("found"))
    return entities.join(first, "id", "left").select("id", F.coalesce(F.when(F.length("email") > 0, F.col("email")), "found").alias("contact"))


def latest_values(issues: DataFrame, fields) -> DataFrame:
    """(provider_id, field_name, value): the suggestion of the greatest issue id."""
    return issues.where(F.col("field_name").isin(*fields)).groupBy("provider_id", "field_name").agg(F.max_by("suggested_value", "id").alias("value"))


def preferred_values(issues: DataFrame) -> DataFrame:
    """(provider_id, field, value, status): an accepted issue if there is one, else the first."""
    field = F.lower("field_name")
    order = Window.partitionBy("provider_id", field).orderBy(F.when(F.col("status").startswith("ACCEPTED"), 0).otherwise(1), "id")
    return issues.withColumn("r", F.row_number().over(order)).where("r = 1").select("provider_id", field.alias("field"), F.col("suggested_value").alias("value"), "status")
