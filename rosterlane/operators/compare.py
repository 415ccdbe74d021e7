"""Field-by-field comparison of entities with their sources: one wide row in, a row per discrepancy out.

A wide row holds the entity (id, name, address, phone, state as standardised, and raw fields), and a struct per source; an absent
source is a null struct. Rules are one array of candidate rows and one explode; no scan is repeated per rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlane.functions import scoring as sc
from rosterlane.functions import text as t
from rosterlane.functions.similarity import addresses_match, jaro_winkler, levenshtein_similarity, token_cosine

DISCREPANCY = "struct<rule_order: int, field: string, code: string, source_type: string, severity: string, suggested: string, confidence: double, action: string, status: string>"


def _row(when: Column, order: int, field: str, code: str, source: str, severity: str, suggested, confidence: Column, action: str | None = None, status: str | None = None) -> Column:
    value = F.lit(suggested) if suggested is None or isinstance(suggested, str) else suggested
    parts = [F.lit(order).alias("rule_order"), F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(source).alias("source_type"), F.lit(severity).alias("severity"), value.cast("string").alias("suggested"), confidence.alias("confidence"), F.lit(action).cast("string").alias("action"), F.lit(status).cast("string").alias("status")]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(*parts))


def _has(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)) > 0


def _same_phone(a: Column, b: Column) -> Column:
    return F.coalesce(t.phone_with_plus(a) == t.phone_with_plus(b), F.lit(False)) & _has(a) & _has(b)


def _alike(a: Column, b: Column, needed: Column) -> Column:
    """The address similarity of two columns of a row where it is needed, else 0; all such columns of a plan share one pass through Python."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    mixed = 0.40 * token_cosine(x, y) + 0.45 * jaro_winkler(x, y, needed) + 0.15 * levenshtein_similarity(x, y)
    return F.when(needed & (x != "") & (y != ""), mixed).otherwise(0.0)


def format_timings(timings: Column) -> Column:
    """day: slot, slot; day: status ..."""
    one = lambda x: F.concat(F.coalesce(x["day"], F.lit("Day")), F.lit(": "), F.when(F.size(x["time_slots"]) > 0, F.array_join(x["time_slots"], ", ")).otherwise(F.coalesce(x["status"], F.lit("Closed"))))
    return F.array_join(F.transform(timings, one), "; ")


def compare_current(wide: DataFrame) -> DataFrame:
    """wide with discrepancies (rule checks first), and contributions of each kind of source.

    Columns: npi{name, phone, address}, license_status, listing{timings, availability_status}, website{phone, address},
    maps{phone, address}, certification{name, license}; issues as rule_issues() makes them.
    """
    same = {f"__{n}_same": F.coalesce(addresses_match(F.col("address"), F.col(f"{n}.address")), F.lit(False)) for n in ("npi", "website", "maps")}  # each once
    unlike = lambda n: _has(F.col(f"{n}.address")) & ~F.col(f"__{n}_same")
    df = wide.withColumns(same).withColumns({f"__{n}_alike": _alike(F.col("address"), F.col(f"{n}.address"), unlike(n)) for n in ("website", "maps")})
    npi, site, maps, listing, cert = F.col("npi"), F.col("website"), F.col("maps"), F.col("listing"), F.col("certification")
    own_name, npi_name = F.col("name"), t.normalize_text(npi["name"])
    name_ok = _has(own_name) & _has(npi_name) & (npi_name.contains(own_name) | own_name.contains(npi_name))
    address_ok = lambda n: _has(F.col(f"{n}.address")) & _has(F.col("address")) & F.col(f"__{n}_same")
    phone_ok = lambda c: _same_phone(c, F.col("phone"))
    one, none = F.lit(1.0), F.lit(0.0)
    status = F.upper(F.coalesce("license_status", F.lit("")))
    rules = [
        _row(npi.isNotNull() & ~name_ok, 10, "name", "NPI_NAME_MISMATCH", "NPI_API", "MEDIUM", npi["name"], sc.final_score(one, none, none, F.lit(True))),
        _row(_has(npi["address"]) & ~address_ok("npi"), 11, "address", "NPI_ADDRESS_MISMATCH", "NPI_API", "MEDIUM", npi["address"], sc.final_score(one, none, none, F.lit(True))),
        _row(_has(npi["phone"]) & ~phone_ok(npi["phone"]), 12, "phone", "NPI_PHONE_MISMATCH", "NPI_API", "MEDIUM", npi["phone"], sc.final_score(one, none, one, F.lit(True))),
        _row((status != "") & (status != "ACTIVE"), 13, "license_status", "LICENSE_INACTIVE", "LICENSE_REGISTRY", "HIGH", None, F.lit(0.8)),
        _row(F.size(listing["timings"]) > 0, 14, "appointment_availability", "APPOINTMENT_AVAILABILITY", "LISTING_WEBSITE", "LOW", format_timings(listing["timings"]), F.lit(0.6), "INFORMATIONAL", "ACCEPTED"),
        _row(_has(listing["availability_status"]) & (listing["availability_status"] != "NO_INFO"), 15, "availability_status", "APPOINTMENT_STATUS", "LISTING_WEBSITE", "LOW", listing["availability_status"], F.lit(0.6), "INFORMATIONAL", "ACCEPTED"),
        _row(_has(site["phone"]) & ~phone_ok(site["phone"]), 16, "phone", "WEBSITE_PHONE_MISMATCH", "WEBSITE", "MEDIUM", site["phone"], sc.final_score(one, none, F.lit(0.6))),
        _row(_has(site["address"]) & ~address_ok("website"), 17, "address", "WEBSITE_ADDRESS_MISMATCH", "WEBSITE", "MEDIUM", site["address"], sc.final_score(one, F.col("__website_alike"), none)),
        _row(_has(maps["phone"]) & ~phone_ok(maps["phone"]), 18, "phone", "AZURE_PHONE_MISMATCH", "AZURE_MAPS", "MEDIUM", maps["phone"], sc.final_score(F.lit(0.85), none, F.lit(0.6))),
        _row(_has(maps["address"]) & ~address_ok("maps"), 19, "address", "AZURE_ADDRESS_MISMATCH", "AZURE_MAPS", "MEDIUM", maps["address"], sc.final_score(F.lit(0.85), F.col("__maps_alike"), none)),
        _row(_has(cert["name"]), 20, "certification", "CERTIFICATION_SUGGESTED", "NPI_CERTIFICATIONS", "MEDIUM", primary_text(cert), sc.final_score(one, none, none, F.lit(True), _has(cert["license"]))),
    ]
    checked = F.transform("issues", lambda i: F.struct(i["rule_order"].alias("rule_order"), i["field"].alias("field"), i["code"].alias("code"), F.lit("INPUT_VALIDATION").alias("source_type"), i["severity"].alias("severity"), i["suggested"].alias("suggested"), i["confidence"].alias("confidence"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("status")))
    found = F.concat(checked, F.array_compact(F.array(*rules))).cast(f"array<{DISCREPANCY}>")
    gave = lambda ok, there: F.when(there, F.when(ok, 1.0).otherwise(0.5)).otherwise(0.0)
    contributions = F.struct(
        gave(name_ok | address_ok("npi") | phone_ok(npi["phone"]), npi.isNotNull()).alias("npi"),
        F.when(status == "ACTIVE", 1.0).otherwise(0.0).alias("license"),
        gave(phone_ok(site["phone"]) | address_ok("website"), site.isNotNull()).alias("website"),
        F.when(F.coalesce("phone_verified", F.lit(False)), 1.0).otherwise(0.0).alias("phone"),
    )
    return df.withColumn("discrepancies", found).withColumn("contributions", contributions).drop("__website_alike", "__maps_alike", *same)


def held_values(entities: DataFrame) -> Column:
    """A map from the fields of issues to what the directory holds there, as it is written; fields without a column have none."""
    columns = {"name": "name", "phone": "phone", "address": "address_line1", "address_line1": "address_line1", "city": "city", "state": "state", "zip": "zip", "speciality": "speciality", "license_status": "license_status", "npi": "npi_id"}
    return F.create_map(*[x for field, c in columns.items() if c in entities.columns for x in (F.lit(field), F.col(c).cast("string"))])


def score_entities(compared: DataFrame) -> DataFrame:
    """compared with conflicts, failures, score, level, review, severity, recommendation, route and reasons.

    Conflicts are counted before suggestions are reduced to the best per field. failed_sources is an array of names. Reasons of
    an entity that is to be reviewed for its score alone are LOW_CONFIDENCE.
    """
    conflicts = F.size(F.filter("discrepancies", lambda d: d["code"].contains("MISMATCH") | d["code"].contains("INACTIVE")))
    failed = F.size("failed_sources")
    df = compared.withColumn("conflicts", conflicts).withColumn("failures", failed)
    contributed = {k: F.col("contributions")[k] for k in sc.RECORD_WEIGHTS}
    score = F.round(sc.record_confidence(contributed, F.col("failures"), F.col("conflicts"), F.col("hard_reject")), 6)
    df = df.withColumn("score", score).withColumn("review", sc.needs_review(F.col("score"), F.col("conflicts"), F.col("failures"), F.col("hard_reject")))
    reasons = F.array_compact(F.array(F.when(F.col("failures") > 0, "EXTERNAL_SOURCE_FAILURE"), F.when(F.col("conflicts") > 0, "DATA_CONFLICTS"), F.when(F.col("hard_reject"), "MISSING_OR_INVALID_REQUIRED_FIELDS")))
    return df.select(
        "*", sc.level(F.col("score")).alias("level"), sc.severity(F.col("score")).alias("record_severity"),
        sc.recommendation(F.col("review"), F.col("hard_reject")).alias("recommendation"), sc.route(F.col("score"), F.col("review")).alias("route"),
        F.when((F.size(reasons) == 0) & F.col("review"), F.array(F.lit("LOW_CONFIDENCE"))).otherwise(reasons).alias("reasons"),
    )


def best_suggestions(compared: DataFrame) -> DataFrame:
    """(id, field, code, source_type, severity, old_value, suggested, confidence, action, status): per field the suggestion of most confidence, the earlier rule on ties.

    Where compared has held (see held_values()), old_value is what the directory holds of the field.
    """
    held = F.col("held") if "held" in compared.columns else F.lit(None).cast("map<string, string>")
    rows = compared.select("id", held.alias("held"), F.explode("discrepancies").alias("d")).select("id", "held", "d.*").where("suggested is not null")
    best = Window.partitionBy("id", "field").orderBy(F.desc("confidence"), "rule_order")
    top = rows.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")
    action = sc.issue_action(F.col("action"), F.col("source_type"), F.col("confidence"))
    return top.select("id", "rule_order", "field", "code", "source_type", F.coalesce("severity", F.lit("MEDIUM")).alias("severity"), F.col("held")[F.col("field")].alias("old_value"), "suggested", F.round("confidence", 6).alias("confidence"), action.alias("action"), sc.issue_status(action).alias("status"))


def fallback_issues(compared: DataFrame, keep_unactionable: bool = False) -> DataFrame:
    """(id, field, code, source_type, severity, suggested, confidence): an issue for each missing field of entities without a discrepancy.

    They carry no suggestion, so unless they are kept they are dropped like all others without one.
    """
    rows = compared.where(F.size("discrepancies") == 0).select("id", F.explode("missing").alias("field"))
    made = rows.select("id", "field", F.lit("MISSING_REQUIRED_FIELD").alias("code"), F.lit("INPUT_VALIDATION").alias("source_type"), F.lit("HIGH").alias("severity"), F.lit(None).cast("string").alias("suggested"), F.lit(0.8).alias("confidence"))
    return made if keep_unactionable else made.where("suggested is not null")


#: Scores of listed sources are their weight over all four weights.
_TOTAL = sum(sc.SOURCE_WEIGHTS.values())
_VOTE = {k: v / _TOTAL for k, v in sc.SOURCE_WEIGHTS.items()}
_SUGGESTION = "struct<rule_order: int, mode: string, field: string, source_type: string, old: string, suggested: string, confidence: double, action: string, severity: string>"


def _legacy_rules() -> list[Column]:
    """The second profile's 26 rules (three of them over several fields) as candidate suggestions of a wide row, null where a rule is silent."""
    col, has = F.col, _has
    own = {c: col(c) for c in ("name", "phone", "address_line1", "city", "state", "zip", "speciality", "license_number", "website")}
    npi, maps, poi, scraped, ocr, listing, cert = (col(c) for c in ("npi", "maps", "poi", "scraped", "ocr", "listing", "certification"))
    same_phone = lambda c: t.phone_digits(c) == t.phone_digits(own["phone"])
    same_specialty = lambda c: t.normalize_specialty(c) == t.normalize_specialty(own["speciality"])
    unverified = ~F.coalesce(col("address_verified"), F.lit(False))
    unlike = lambda c: ~F.coalesce(addresses_match(own["address_line1"], c), F.lit(False))
    differ = lambda f, a, b: has(a) & has(b) & (f(a) != f(b))
    zero, none, na = F.lit(0.0), F.lit(None).cast("string"), F.lit("Not available")
    informational = {"action": "INFORMATIONAL", "severity": "INFO"}

    def rule(order, mode, field, source, when, value, vote, address, old=None, authoritative=None, multiple=None, action=None, severity=None):
        score = F.round(sc.final_score(F.lit(vote), address if isinstance(address, Column) else F.lit(address), zero, authoritative, multiple), 6)
        before = F.coalesce(own[field].cast("string"), F.lit("")) if old is None else old
        parts = {"rule_order": F.lit(order), "mode": F.lit(mode), "field": F.lit(field), "source_type": F.lit(source), "old": before, "suggested": value.cast("string"), "confidence": score,
                 "action": F.lit(action) if action else sc.legacy_action(score), "severity": F.lit(severity) if severity else sc.legacy_severity(score)}
        return F.when(F.coalesce(when, F.lit(False)), F.struct(*[v.alias(k) for k, v in parts.items()]))

    gate = unverified & maps["is_valid"] & has(maps["formatted"]) & unlike(maps["formatted"])
    poi_gate = unverified & poi.isNotNull() & unlike(F.coalesce(poi["formatted"], F.lit("")))
    as_given, yes_no = lambda c: c, lambda c: F.when(c, "Yes").otherwise("No")
    rules = [
        rule(1, "set", "phone", "NPI_API", has(npi["phone"]) & ~same_phone(npi["phone"]), npi["phone"], _VOTE["npi"], F.when(has(own["address_line1"]), 1.0).otherwise(0.0)),
        rule(2, "set", "speciality", "NPI_API", has(npi["speciality"]) & ~same_specialty(npi["speciality"]), npi["speciality"], 1.0, 0.0, authoritative=F.lit(True)),
        rule(3, "set", "address_line1", "AZURE_MAPS", unverified & ~maps["is_valid"] & (maps["reason"] == "NO_RESULTS"), F.lit("Address not found - please verify"), _VOTE["azure"], 0.0),
        rule(4, "set", "zip", "AZURE_MAPS", gate & differ(as_given, maps["postal_code"], own["zip"]), maps["postal_code"], _VOTE["azure"], col("__maps_address")),
        rule(5, "set", "city", "AZURE_MAPS", gate & differ(t.normalize_address, maps["city"], own["city"]), maps["city"], _VOTE["azure"], col("__maps_city")),
        rule(6, "set", "state", "AZURE_MAPS", gate & differ(t.normalize_text, maps["state"], own["state"]), maps["state"], _VOTE["azure"], col("__maps_state")),
        rule(7, "set", "address_line1", "AZURE_MAPS", gate & (maps["score"] > 0) & (maps["score"] < 0.6), F.coalesce(F.nullif(F.substring_index(maps["formatted"], ",", 1), F.lit("")), maps["formatted"]), _VOTE["azure"], maps["score"]),
        rule(8, "set", "phone", "AZURE_POI", has(poi["phone"]) & ~same_phone(poi["phone"]), poi["phone"], _VOTE["azure"], 0.5),
        rule(9, "set", "zip", "AZURE_POI", poi_gate & differ(as_given, poi["postal_code"], own["zip"]), poi["postal_code"], _VOTE["azure"], col("__poi_address")),
        rule(9, "set", "city", "AZURE_POI", poi_gate & differ(t.normalize_address, poi["city"], own["city"]), poi["city"], _VOTE["azure"], col("__poi_city")),
        rule(9, "set", "state", "AZURE_POI", poi_gate & differ(t.normalize_text, poi["state"], own["state"]), poi["state"], _VOTE["azure"], col("__poi_state")),
        rule(10, "set", "website", "AZURE_POI", has(poi["website"]), poi["website"], _VOTE["azure"], 0.5),
        rule(11, "absent", "phone", "SCRAPING_ENRICHMENT", has(scraped["phone"]) & ~same_phone(scraped["phone"]), scraped["phone"], _VOTE["scrape"], 0.4),
        rule(12, "absent", "website", "SCRAPING_ENRICHMENT", has(scraped["website"]), scraped["website"], _VOTE["scrape"], 0.3),
        rule(13, "set", "name", "PDF_OCR", has(ocr["name"]) & ~ocr["name"].eqNullSafe(own["name"]), ocr["name"], _VOTE["pdf"], 0.3),
        rule(14, "absent", "phone", "PDF_OCR", has(ocr["phone"]) & ~same_phone(ocr["phone"]), ocr["phone"], _VOTE["pdf"], 0.2),
        rule(15, "absent", "address_line1", "PDF_OCR", unverified & has(ocr["address"]) & unlike(ocr["address"]), ocr["address"], _VOTE["pdf"], col("__ocr_address")),
        rule(16, "absent", "phone", "LISTING_WEBSITE", has(listing["phone"]) & ~same_phone(listing["phone"]), listing["phone"], _VOTE["scrape"], 0.7),
        rule(17, "absent", "address_line1", "LISTING_WEBSITE", unverified & has(listing["address"]) & unlike(listing["address"]), listing["address"], _VOTE["scrape"], col("__listing_address")),
        rule(18, "absent", "speciality", "LISTING_WEBSITE", has(listing["specialty"]) & ~same_specialty(listing["specialty"]), listing["specialty"], _VOTE["scrape"], 0.7),
        rule(19, "set", "license_number", "LISTING_WEBSITE", has(listing["license_number"]) & ~listing["license_number"].eqNullSafe(own["license_number"]), listing["license_number"], _VOTE["scrape"], 0.7),
        rule(25, "absent", "speciality", "NPI_CERTIFICATIONS", has(cert["specialty"]) & ~same_specialty(cert["specialty"]), cert["specialty"], 1.0, 0.0, authoritative=F.lit(True)),
        rule(26, "set", "certification", "NPI_CERTIFICATIONS", has(cert["name"]), primary_text(cert), 1.0, 0.0, na, F.lit(True), has(cert["license"])),
    ]
    listed = [
        (19, "license_state", has(listing["license_state"]), listing["license_state"], 0.7, {}), (19, "license_status", has(listing["license_status"]), listing["license_status"], 0.7, {}),
        (20, "office_hours", has(listing["office_hours"]), listing["office_hours"], 0.6, {}),
        (21, "appointment_availability", F.size(listing["timings"]) > 0, format_timings(listing["timings"]), 0.75, informational),
        (22, "availability_status", has(listing["availability_status"]) & (listing["availability_status"] != "NO_INFO"), listing["availability_status"], 0.7, informational),
        (23, "accepting_new_patients", listing["accepting_new_patients"].isNotNull(), yes_no(listing["accepting_new_patients"]), 0.6, {}),
        (23, "telehealth_available", listing["telehealth_available"].isNotNull(), yes_no(listing["telehealth_available"]), 0.6, {}),
        (24, "affiliations", has(listing["affiliations"]), listing["affiliations"], 0.5, {}),
    ]
    return rules + [rule(order, "set", field, "LISTING_WEBSITE", when, value, _VOTE["scrape"], address, na, **more) for order, field, when, value, address, more in listed]


def compare_legacy(wide: DataFrame) -> DataFrame:
    """(id, field, source_type, old, suggested, confidence, action, severity) by the second profile, a row per field with a suggestion.

    wide: an entity per row (id, name, phone, address_line1, city, state, zip, speciality, license_number, website, address_verified: by the
    map service) with a struct per source: npi{phone, speciality}, maps{is_valid, reason, formatted, city, state, postal_code, score},
    poi{phone, website, formatted, city, state, postal_code}, scraped{phone, website}, ocr{name, phone, address}, listing{phone, address,
    specialty, license_number, license_state, license_status, office_hours, timings, availability_status, accepting_new_patients,
    telehealth_available, affiliations}, certification{specialty, name, license}. Per field the last "set" rule wins; without one, the
    first that yields to earlier ones.
    """
    col = F.col
    unlike = lambda c: ~F.coalesce(addresses_match(col("address_line1"), c), F.lit(False))
    pairs = {
        "maps_address": ("address_line1", "maps.formatted", unlike(col("maps.formatted"))), "maps_city": ("city", "maps.city", F.lit(True)), "maps_state": ("state", "maps.state", F.lit(True)),
        "poi_address": ("address_line1", "poi.formatted", unlike(F.coalesce(col("poi.formatted"), F.lit("")))), "poi_city": ("city", "poi.city", F.lit(True)), "poi_state": ("state", "poi.state", F.lit(True)),
        "ocr_address": ("address_line1", "ocr.address", unlike(col("ocr.address"))), "listing_address": ("address_line1", "listing.address", unlike(col("listing.address"))),
    }
    df = wide.withColumns({f"__{n}": _alike(col(a), col(b), needed) for n, (a, b, needed) in pairs.items()})
    found = F.array_compact(F.array(*_legacy_rules())).cast(f"array<{_SUGGESTION}>")
    rows = df.select("id", F.explode(found).alias("d")).select("id", "d.*")
    rank = F.when(col("mode") == "set", -col("rule_order")).otherwise(1000 + col("rule_order"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("id", "field").orderBy(rank))).where("r = 1")
    return top.select("id", "field", "source_type", "old", "suggested", "confidence", "action", "severity")


def primary_text(certification: Column) -> Column:
    """A certification's name, with its licence if it has one."""
    return F.when(_has(certification["license"]), F.concat(certification["name"], F.lit(" (License: "), certification["license"], F.lit(")"))).otherwise(certification["name"])


def apply_verified_address(entities: DataFrame, matches: DataFrame, least: float = 0.7) -> DataFrame:
    """entities with the address parts of a confident match by the map service (id, is_valid, score, street, city, state, postal_code), marked as verified."""
    joined = entities.drop("address_verified", "address_source").join(matches.select("id", "is_valid", F.col("score").alias("__score"), F.col("street").alias("__1"), F.col("city").alias("__2"), F.col("state").alias("__3"), F.col("postal_code").alias("__4")), "id", "left")
    sure = F.coalesce(F.col("is_valid") & (F.coalesce("__score", F.lit(0.0)) >= least), F.lit(False))
    part = lambda own, new: F.when(sure & _has(F.col(new)), F.col(new)).otherwise(F.col(own)).alias(own)
    parts = {"address_line1": "__1", "city": "__2", "state": "__3", "zip": "__4"}
    own = [part(c, parts[c]) if c in parts else F.col(c) for c in entities.columns if c not in ("address_verified", "address_source")]
    return joined.select(*own, sure.alias("address_verified"), F.when(sure, "AZURE_MAPS").alias("address_source"))


def apply_poi_address(entities: DataFrame, pois: DataFrame) -> DataFrame:
    """entities with the address of a point of interest (id, street, city, state, postal_code) where it differs and the map service has not verified their own."""
    joined = entities.join(pois.select("id", F.col("street").alias("__1"), F.col("city").alias("__2"), F.col("state").alias("__3"), F.col("postal_code").alias("__4")), "id", "left")
    verified = F.coalesce(F.col("address_verified") & (F.col("address_source") == "AZURE_MAPS"), F.lit(False))
    parts = {"address_line1": "__1", "city": "__2", "state": "__3", "zip": "__4"}
    differs = F.lit(False)
    for own, new in parts.items():
        differs = differs | ~F.col(new).eqNullSafe(F.col(own))
    take = ~verified & _has(F.col("__1")) & differs
    put = {c: F.when(take, F.col(new)).otherwise(F.col(c)) for c, new in parts.items()}
    put |= {"address_verified": F.when(take, True).otherwise(F.col("address_verified")), "address_source": F.when(take, "AZURE_POI").otherwise(F.col("address_source"))}
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in entities.columns])


def fill_contact(entities: DataFrame, pois: DataFrame, scraped: DataFrame) -> DataFrame:
    """entities with blank e-mails from the point of interest, then the scraped row; phones from scraped, then the other; addresses that are
    blank or N/A from the scraped one (id, phone, email, address, city, state, zip)."""
    joined = entities.join(pois.select("id", F.col("phone").alias("__pp"), F.col("email").alias("__pe")), "id", "left")
    joined = joined.join(scraped.select("id", F.col("phone").alias("__sp"), F.col("email").alias("__se"), *[F.col(c).alias(f"__{c}") for c in ("address", "city", "state", "zip")]), "id", "left")
    some = lambda *cs: F.coalesce(*[F.when(_has(F.col(c)), F.col(c)) for c in cs])
    moved = (~_has(F.col("address_line1")) | (F.col("address_line1") == "N/A")) & _has(F.col("__address"))
    put = {"email": F.coalesce(some("email", "__pe", "__se"), F.col("email")), "phone": F.coalesce(some("phone", "__sp", "__pp"), F.col("phone")), "address_line1": F.when(moved, F.col("__address")).otherwise(F.col("address_line1"))}
    put |= {c: F.when(moved & _has(F.col(f"__{c}")), F.col(f"__{c}")).otherwise(F.col(c)) for c in ("city", "state", "zip")}
    return joined.select(*[put[c].alias(c) if c in put else F.col(c) for c in entities.columns])


def fill_missing(entities: DataFrame, registry: DataFrame) -> DataFrame:
    """entities with phone, licence and specialty from the registry where blank, and the address block where blank or N/A."""
    known = registry.select(F.col("npi").alias("npi_id"), "telephone_number", "license", "taxonomy_desc", "address_1", F.col("city").alias("r_city"), F.col("state").alias("r_state"), "postal_code")
    joined = entities.join(known, "npi_id", "left")
    blank = lambda c: t.blank_to_null(F.col(c))
    no_address = blank("address_line1").isNull() | (F.upper(t.trim(F.col("address_line1"))) == "N/A")
    block = lambda c, r: F.when(no_address, F.coalesce(r, c)).otherwise(F.col(c)).alias(c)
    return joined.select("id", "npi_id", "name", F.coalesce(blank("phone"), "telephone_number").alias("phone"), F.coalesce(blank("license_number"), "license").alias("license_number"), F.coalesce(blank("speciality"), "taxonomy_desc").alias("speciality"), block("address_line1", "address_1"), block("city", "r_city"), block("state", "r_state"), block("zip", "postal_code"))
