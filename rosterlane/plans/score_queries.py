"""Queries of similarity, scoring, comparison and whole validation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlane.functions import scoring as sc
from rosterlane.functions import similarity as sim
from rosterlane.operators import compare as c
from rosterlane.operators import resolve as a
from rosterlane.operators import validate as v

from . import run_oracle as o
from .pipeline import report, run_validation, source_outcomes, wide_rows
from .registry import query

_A, _B = "a", "b"  # columns of address_pairs


@query("token_cosine", "address_pairs", r"""
SELECT id, round(dot / (sqrt(na) * sqrt(nb)), 6) AS score FROM (SELECT p.id, (SELECT sum(x.n * y.n) FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p.a), '\w+')) AS w) q GROUP BY w) x
  JOIN (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p.b), '\w+')) AS w) q GROUP BY w) y ON x.w = y.w) AS dot,
  (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p.a), '\w+')) AS w) q GROUP BY w) z) AS na,
  (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p.b), '\w+')) AS w) q GROUP BY w) z) AS nb FROM address_pairs p) s""")
def cosine(t):
    return t("address_pairs").select("id", F.round(sim.token_cosine(F.col(_A), F.col(_B)), 6).alias("score"))


@query("levenshtein_similarity", "address_pairs", "SELECT id, round(1 - levenshtein(lower(a), lower(b)) / greatest(length(a), length(b)), 6) AS score FROM address_pairs")
def edits(t):
    return t("address_pairs").select("id", F.round(sim.levenshtein_similarity(F.col(_A), F.col(_B)), 6).alias("score"))


@query("jaro_winkler", "address_pairs", f"SELECT * FROM (WITH {o.jaro_winkler('address_pairs')} SELECT p.id, round(j.score, 6) AS score FROM address_pairs p JOIN jw j ON lower(p.a) = j.s AND lower(p.b) = j.t) w")
def winkler(t):
    return sim.with_jaro_winkler(t("address_pairs"), "a", "b", "score").select("id", F.round("score", 6).alias("score"))


@query("address_similarity", "address_pairs", f"""SELECT * FROM (WITH {o.similarity('address_pairs')} SELECT p.id, round(x.alike, 6) AS score, CASE WHEN p.a = '' THEN TRUE WHEN p.a = p.b THEN FALSE ELSE x.alike < 0.99 END AS suggest FROM address_pairs p JOIN sim x ON p.a = x.a AND p.b = x.b) w""")
def alike(t):
    return sim.address_similarity(t("address_pairs"), out="score").select("id", F.round("score", 6).alias("score"), sim.should_suggest(F.col(_A), F.col(_B), F.col("score")).alias("suggest"))


_N = r"trim(regexp_replace(regexp_replace(lower({0}), '[.,\-]', ' ', 'g'), '\s+', ' ', 'g'))"
_W = r"list_filter(string_split({0}, ' '), lambda w: NOT regexp_matches(w, '^\d{{5}}'))"


@query("addresses_match", "address_pairs", rf"""
SELECT id, CASE WHEN a = b OR x = y THEN TRUE WHEN zx <> '' AND zy <> '' AND zx <> zy THEN FALSE WHEN sx <> '' AND sy <> '' AND sx <> sy THEN FALSE WHEN zx = '' OR zx <> zy THEN FALSE
  WHEN {_W.format('x')} = {_W.format('y')} THEN TRUE
  ELSE list_has_all({_W.format('x')}, {_W.format('y')}) AND list_has_all({_W.format('y')}, {_W.format('x')}) AND regexp_extract_all(x, '\d+') = regexp_extract_all(y, '\d+') END AS matched
FROM (SELECT id, a, b, {_N.format('a')} AS x, {_N.format('b')} AS y, regexp_extract(a, '\b(\d{{5}})\b', 1) AS zx, regexp_extract(b, '\b(\d{{5}})\b', 1) AS zy,
  regexp_extract(a, '\b([A-Z]{{2}})\s+\d{{5}}', 1) AS sx, regexp_extract(b, '\b([A-Z]{{2}})\s+\d{{5}}', 1) AS sy FROM address_pairs) p""")
def same_address(t):
    return t("address_pairs").select("id", sim.addresses_match(F.col(_A), F.col(_B)).alias("matched"))


@query("component_match", "providers registry", f"""
SELECT p.id, round((CAST(p.zip = r.postal_code AS INT) + CAST(upper(p.state) = upper(r.state) AS INT) + CAST(lower(p.city) = lower(r.city) AS INT) + CAST({_N.format("string_split(p.address_line1, ',')[1]")} = {_N.format('r.address_1')} AS INT)) / 4, 6) AS score,
  {_N.format("string_split(p.address_line1, ',')[1]")} = {_N.format('r.address_1')} AS street FROM providers p JOIN registry r ON p.npi_id = r.npi""")
def components(t):
    p, r = t("providers"), t("registry")
    joined = p.join(r, p["npi_id"] == r["npi"])
    own = {"zip": p["zip"], "state": p["state"], "city": p["city"], "street": F.split("address_line1", ",")[0]}
    listed = {"zip": r["postal_code"], "state": r["state"], "city": r["city"], "street": r["address_1"]}
    return joined.select("id", sim.component_match(own, listed).alias("m")).select("id", F.round("m.score", 6).alias("score"), F.col("m.street").alias("street"))


@query("strict_confidence", "validation_issues", "SELECT id, round(0.5 * confidence + 0.3 * (id % 7) / 7 + 0.2 * (id % 3) / 3, 6) AS score FROM validation_issues")
def strict(t):
    part = lambda n: (F.col("id") % n).cast("double") / n
    return t("validation_issues").select("id", F.round(sc.strict_confidence(F.col("confidence"), part(7), part(3)), 6).alias("score"))


@query("confidence_quarantine", "validation_issues", """
SELECT id, CASE WHEN id % 5 = 0 THEN 'TYPE' WHEN id % 7 = 0 THEN 'RANGE' END AS error, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN round(0.5 * confidence + 0.3 * 0.5, 6) END AS score FROM validation_issues""")
def tried(t):
    address = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 0, 1.5).otherwise(0.5)
    score, error = sc.try_confidence(F.col("confidence"), address, F.lit(0.0))
    return t("validation_issues").select("id", error.alias("error"), F.round(score, 6).alias("score"))


@query("final_score", "validation_issues", """
SELECT id, round(CASE WHEN id % 3 = 0 THEN least(1.0, m * 1.15) ELSE m END, 6) AS score FROM (SELECT id, CASE WHEN id % 2 = 0 THEN least(1.0, greatest(base, confidence) * 1.3) ELSE base END AS m
  FROM (SELECT id, confidence, 0.5 * confidence + 0.3 * ((id % 7) / 7) AS base FROM validation_issues) b) l""")
def final(t):
    score = sc.final_score(F.col("confidence"), (F.col("id") % 7) / 7, F.lit(0.0), F.col("id") % 2 == 0, F.col("id") % 3 == 0)
    return t("validation_issues").select("id", F.round(score, 6).alias("score"))


@query("source_vote", "provider_sources", """
SELECT provider_id, CASE WHEN sum(w) > 0 THEN round(sum(CASE WHEN is_found THEN w ELSE 0 END) / sum(w), 6) ELSE 0 END AS vote FROM (SELECT provider_id, is_found,
  CASE source_type WHEN 'NPI_API' THEN 0.95 WHEN 'AZURE_POI' THEN 0.85 WHEN 'SCRAPING_ENRICHMENT' THEN 0.70 ELSE 0.0 END AS w FROM provider_sources) s GROUP BY 1""")
def vote(t):
    kind = F.when(F.col("source_type") == "NPI_API", "npi").when(F.col("source_type") == "AZURE_POI", "azure").when(F.col("source_type") == "SCRAPING_ENRICHMENT", "scrape")
    return t("provider_sources").withColumn("kind", kind).groupBy("provider_id").agg(F.round(sc.source_vote(F.col("kind"), F.col("is_found")), 6).alias("vote"))


@query("issue_action", "validation_issues", """
SELECT id, CASE WHEN source_type IN ('NPI_API', 'NPI_CERTIFICATIONS') OR confidence >= 0.75 THEN 'AUTO_ACCEPT' ELSE 'NEEDS_REVIEW' END AS new_action, CASE WHEN confidence >= 0.45 THEN 'LOW' ELSE 'HIGH' END AS legacy FROM validation_issues WHERE suggested_value IS NOT NULL""")
def action(t):
    given = F.lit(None).cast("string")
    return t("validation_issues").where("suggested_value is not null").select("id", sc.issue_action(given, F.col("source_type"), F.col("confidence")).alias("new_action"), sc.legacy_severity(F.col("confidence")).alias("legacy"))


@query("route_decision", "validation_issues", """
SELECT id, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN confidence < 0.4 THEN 'HIGH' WHEN confidence < 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN confidence >= 0.65 AND id % 3 <> 0 THEN 'approved' ELSE 'needs_review' END AS route FROM validation_issues""")
def routed(t):
    s = F.col("confidence")
    review = sc.needs_review(s, (F.col("id") % 3 == 0).cast("int"), F.lit(0), F.lit(False))
    return t("validation_issues").select("id", sc.level(s).alias("level"), sc.severity(s).alias("severity"), sc.route(s, review).alias("route"))


def listing_of(t):
    """Opening times and availability of the listing as run_validation() takes them."""
    one = F.struct("pos", "day", F.when(F.col("slot") != "", F.array("slot")).otherwise(F.array().cast("array<string>")).alias("time_slots"), "status")
    times = t("listing_hours").groupBy("provider_id").agg(F.array_sort(F.collect_list(one)).alias("x"))
    timings = F.transform("x", lambda x: F.struct(x["day"].alias("day"), x["time_slots"].alias("time_slots"), x["status"].alias("status")))
    return t("listing_status").join(times, "provider_id", "full").select("provider_id", timings.alias("timings"), "availability_status")


def _inputs(t):
    return t("providers"), t("registry"), t("provider_sources"), t("license_statuses"), listing_of(t)


def _run(t):
    return run_validation(*_inputs(t))


@query("validation_run", o.TABLES, o.run("SELECT field, source_type, action, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM issues GROUP BY ALL"))
def counts(t):
    return _run(t).issues.groupBy("field", "source_type", "action").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query("compare_current", o.TABLES, o.run("SELECT id, rule_order, field, code, source_type, severity, suggested, round(confidence, 6) AS confidence, action FROM disc"))
def current(t):
    rows = _run(t).scored.select("id", F.explode("discrepancies").alias("d")).select("id", "d.*")
    return rows.select("id", "rule_order", "field", "code", "source_type", "severity", "suggested", F.round("confidence", 6).alias("confidence"), "action")


@query("best_suggestion", o.TABLES, o.run(f"SELECT id, rule_order, field, code, source_type, severity, {o.OLD_VALUE} AS old_value, i.suggested, i.confidence, i.action, i.status FROM issues i JOIN providers p USING (id)"))
def best(t):
    return _run(t).issues


@query("record_confidence", o.TABLES, o.run("SELECT id, score, level, record_severity, recommendation, route, CAST(conflicts AS INT) AS conflicts, CAST(failures AS INT) AS failures, hard_reject, reasons FROM judged"))
def scored(t):
    return _run(t).scored.select("id", "score", "level", "record_severity", "recommendation", "route", "conflicts", "failures", "hard_reject", F.array_join("reasons", ",").alias("reasons"))


@query("source_outcomes", o.TABLES, o.run("SELECT id, source, success, error FROM outcomes"))
def outcomes(t):
    return source_outcomes(wide_rows(*_inputs(t)))


@query("fallback_issues", "providers", f"""
SELECT id, field, 'MISSING_REQUIRED_FIELD' AS code, 'INPUT_VALIDATION' AS source_type, 'HIGH' AS severity, CAST(NULL AS VARCHAR) AS suggested, CAST(0.8 AS DOUBLE) AS confidence FROM ({o._RULES}) r WHERE code = 'MISSING_REQUIRED_FIELD' AND id % 2 = 1""")
def fallback(t):
    checked = v.validate_entities(t("providers"))
    none = F.array().cast("array<struct<code: string>>")
    compared = checked.withColumn("discrepancies", F.when(F.col("id") % 2 == 1, none).otherwise(F.array(F.struct(F.lit("x").alias("code")))))
    return c.fallback_issues(compared, keep_unactionable=True)


_PHONE = "regexp_replace({0}, '[^0-9+]', '', 'g')"


@query("compare_phone_rules", "providers registry provider_sources", f"""
SELECT p.id, 'NPI_PHONE_MISMATCH' AS code, r.telephone_number AS suggested FROM providers p JOIN registry r ON trim(p.npi_id) = r.npi WHERE r.telephone_number <> '' AND coalesce({_PHONE.format('r.telephone_number')} <> {_PHONE.format('p.phone')}, TRUE)
UNION ALL SELECT p.id, 'WEBSITE_PHONE_MISMATCH', s.phone FROM providers p JOIN provider_sources s ON p.id = s.provider_id AND s.source_type = 'SCRAPING_ENRICHMENT' AND s.is_found WHERE s.phone <> '' AND coalesce({_PHONE.format('s.phone')} <> {_PHONE.format('p.phone')}, TRUE)
UNION ALL SELECT p.id, 'AZURE_PHONE_MISMATCH', s.phone FROM providers p JOIN provider_sources s ON p.id = s.provider_id AND s.source_type = 'AZURE_POI' AND s.is_found WHERE s.phone <> '' AND coalesce({_PHONE.format('s.phone')} <> {_PHONE.format('p.phone')}, TRUE)""")
def phones(t):
    rows = _run(t).scored.select("id", F.explode("discrepancies").alias("d")).select("id", "d.code", "d.suggested")
    return rows.where("code in ('NPI_PHONE_MISMATCH', 'WEBSITE_PHONE_MISMATCH', 'AZURE_PHONE_MISMATCH')")


@query("compare_legacy", "providers legacy_sources", o.LEGACY)
def legacy(t):
    s, none = t("legacy_sources"), F.lit(None).cast("string")
    of = lambda source, /, **columns: F.when(F.col(f"has_{source}"), F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])).alias(source)
    slots = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    day = lambda name, times, status: F.struct(F.lit(name).alias("day"), times.alias("time_slots"), status.alias("status"))
    timings = F.array(day("Monday", slots("9:00 AM", "10:00 AM"), none), day("Sunday", slots(), F.lit("CLOSED")))
    wide = t("providers").join(s, "id").select(
        "id", "name", "phone", "address_line1", "city", "state", "zip", "speciality", "license_number", "website", "address_verified", of("npi", phone="npi_phone", speciality="npi_speciality"),
        of("maps", is_valid="maps_valid", reason="maps_reason", formatted="maps_formatted", city="maps_city", state="maps_state", postal_code="maps_zip", score="maps_score"),
        of("poi", phone="poi_phone", website="poi_website", formatted="poi_formatted", city="poi_city", state="poi_state", postal_code="poi_zip"), of("scraped", phone="scraped_phone", website="scraped_website"),
        of("ocr", name="ocr_name", phone="ocr_phone", address="ocr_address"),
        of("listing", phone="listing_phone", address="listing_address", specialty="listing_specialty", license_number="listing_license", license_state="listing_license_state", license_status="listing_license_status", office_hours="listing_hours_text",
           timings=timings, availability_status="listing_availability", accepting_new_patients="listing_accepting", telehealth_available="listing_telehealth", affiliations="listing_affiliations"),
        of("cert", specialty="cert_specialty", name="cert_name", license="cert_license").alias("certification"),
    )
    return c.compare_legacy(wide)


_RUN_AND_ISSUES = o.TABLES + " validation_issues"


def _status(t, run):
    return a.directory_status(t("providers"), t("validation_issues"), run.scored)


@query("directory_status", _RUN_AND_ISSUES, o.run_status("""SELECT id, directory_status, CASE WHEN directory_status IN ('MANUAL_ACCEPT', 'PUBLISHED') THEN 'ACTIVE' ELSE directory_status END AS entity_status,
  CASE directory_status WHEN 'MANUAL_ACCEPT' THEN 'MANUAL_REVIEW_COMPLETED' WHEN 'NEEDS_REVIEW' THEN 'REVIEW_REQUIRED' WHEN 'PUBLISHED' THEN 'AUTO_PUBLISHED' ELSE 'REJECTED' END AS alert_type,
  CASE directory_status WHEN 'REJECTED' THEN 'HIGH' WHEN 'NEEDS_REVIEW' THEN record_severity ELSE 'LOW' END AS alert_severity,
  CASE directory_status WHEN 'MANUAL_ACCEPT' THEN 'Provider has ' || CAST(ok AS VARCHAR) || ' manually accepted issue(s) - status set to ACTIVE' WHEN 'REJECTED' THEN 'Provider rejected due to missing or invalid required fields'
    WHEN 'NEEDS_REVIEW' THEN 'Provider requires human review (confidence: ' || printf('%.1f', round(score * 100, 1)) || '%)' ELSE 'Provider auto-published (confidence: ' || printf('%.1f', round(score * 100, 1)) || '%)' END AS alert FROM status"""))
def status(t):
    return _status(t, _run(t))


@query("validation_report", _RUN_AND_ISSUES, o.run_status("""SELECT s.id, s.score, s.level, s.review AS needs_review, s.record_severity AS severity, s.recommendation, s.directory_status, coalesce(u.used, '') AS used, coalesce(u.failed, '') AS failed, coalesce(i.n, 0) AS n_issues, coalesce(i.found, '') AS found, TIMESTAMP '2024-01-02 03:04:05' AS validated_at
  FROM status s LEFT JOIN (SELECT id, string_agg(CASE WHEN success THEN source END, ',' ORDER BY k) AS used, string_agg(CASE WHEN NOT success THEN source END, ',' ORDER BY k) AS failed FROM outcomes GROUP BY 1) u ON s.id = u.id
  LEFT JOIN (SELECT id, count(*) AS n, string_agg(field || '=' || coalesce(old_value || '>', '') || suggested, '|' ORDER BY field) AS found FROM (SELECT i.*, """ + o.OLD_VALUE + """ AS old_value FROM issues i JOIN providers p USING (id)) i GROUP BY 1) i ON s.id = i.id"""))
def reported(t):
    run = _run(t)
    rows = report(run, _status(t, run), F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    found = F.array_join(F.transform("discrepancies", lambda d: F.concat(d["field"], F.lit("="), F.concat_ws(">", d["old_value"], d["suggested"]))), "|")
    return rows.select("id", "confidence.score", "confidence.level", "needs_review", "severity", "recommendation", "directory_status", F.array_join("sources_used", ",").alias("used"), F.array_join("sources_failed", ",").alias("failed"), "n_issues", found.alias("found"), "validated_at")


@query("directory_entries", _RUN_AND_ISSUES, o.run_status("SELECT p.id, p.name, p.npi_id AS npi, p.speciality AS specialty, p.address_line1 AS address, p.phone, s.score AS confidence, s.level AS verified_level FROM status s JOIN providers p ON s.id = p.id WHERE s.directory_status = 'PUBLISHED'"))
def entries(t):
    run = _run(t)
    return a.directory_entries(t("providers"), _status(t, run), run.scored)


@query("review_tasks", _RUN_AND_ISSUES, o.run_status("SELECT id, unnest(string_split(reasons, ',')) AS reason, record_severity AS priority FROM status WHERE directory_status = 'NEEDS_REVIEW'"))
def tasks(t):
    run = _run(t)
    return a.review_tasks(_status(t, run), run.scored)


@query("upload_validations", _RUN_AND_ISSUES, o.run_status("""SELECT s.id * 7 AS file_id, s.id, 'PDF_UPLOAD' AS source_type, directory_status AS validation_status, score AS confidence_score, review AS needs_review, CAST(coalesce(d.n, 0) AS INT) AS n_discrepancies
  FROM status s LEFT JOIN (SELECT id, count(*) AS n FROM disc GROUP BY 1) d ON s.id = d.id WHERE s.id % 3 = 0"""))
def uploads(t):
    run = _run(t)
    asked = t("providers").where("id % 3 = 0").select((F.col("id") * 7).alias("file_id"), "id")
    return a.upload_validations(asked, _status(t, run), run.scored)


@query("apply_verified_address", "providers legacy_sources", """
SELECT p.id, CASE WHEN ok THEN 'S' || CAST(p.id AS VARCHAR) ELSE p.address_line1 END AS address_line1, CASE WHEN ok AND maps_city <> '' THEN maps_city ELSE p.city END AS city, CASE WHEN ok THEN maps_state ELSE p.state END AS state, CASE WHEN ok THEN maps_zip ELSE p.zip END AS zip,
  ok AS address_verified, CASE WHEN ok THEN 'AZURE_MAPS' END AS address_source FROM providers p JOIN (SELECT id, maps_city, maps_state, maps_zip, has_maps AND maps_valid AND maps_score >= 0.7 AS ok FROM legacy_sources) s ON p.id = s.id""")
def verified(t):
    return _verified(t).select("id", "address_line1", "city", "state", "zip", "address_verified", "address_source")


def _verified(t):
    maps = t("legacy_sources").where("has_maps").select("id", F.col("maps_valid").alias("is_valid"), F.col("maps_score").alias("score"), F.concat(F.lit("S"), F.col("id").cast("string")).alias("street"), F.col("maps_city").alias("city"), F.col("maps_state").alias("state"), F.col("maps_zip").alias("postal_code"))
    return c.apply_verified_address(t("providers"), maps).withColumns({n: F.col(n) for n in ("address_verified", "address_source")})


@query("apply_poi_address", "providers legacy_sources", """
SELECT p.id, CASE WHEN ok THEN 'P' || CAST(p.id AS VARCHAR) WHEN sure THEN 'S' || CAST(p.id AS VARCHAR) ELSE p.address_line1 END AS address_line1, CASE WHEN ok THEN poi_city WHEN sure AND maps_city <> '' THEN maps_city ELSE p.city END AS city,
  sure OR ok AS address_verified, CASE WHEN ok THEN 'AZURE_POI' WHEN sure THEN 'AZURE_MAPS' END AS address_source
FROM providers p JOIN (SELECT *, has_poi AND NOT sure AS ok FROM (SELECT id, has_poi, maps_city, poi_city, has_maps AND maps_valid AND maps_score >= 0.7 AS sure FROM legacy_sources) x) s ON p.id = s.id""")
def at_poi(t):
    pois = t("legacy_sources").where("has_poi").select("id", F.concat(F.lit("P"), F.col("id").cast("string")).alias("street"), F.col("poi_city").alias("city"), F.col("poi_state").alias("state"), F.col("poi_zip").alias("postal_code"))
    return c.apply_poi_address(_verified(t), pois).select("id", "address_line1", "city", "address_verified", "address_source")


@query("fill_contact", "providers legacy_sources", """
SELECT p.id, coalesce(nullif(CASE WHEN p.id % 2 = 0 THEN p.email END, ''), CASE WHEN has_poi AND p.id % 3 = 0 THEN 'poi@x' END, CASE WHEN has_scraped THEN 'web@x' END, CASE WHEN p.id % 2 = 0 THEN p.email END) AS email,
  coalesce(nullif(p.phone, ''), CASE WHEN has_scraped THEN scraped_phone END, CASE WHEN has_poi THEN poi_phone END) AS phone,
  CASE WHEN p.id % 4 = 1 AND has_scraped THEN 'W' || CAST(p.id AS VARCHAR) WHEN p.id % 4 = 1 THEN 'N/A' ELSE p.address_line1 END AS address_line1, CASE WHEN p.id % 4 = 1 AND has_scraped AND p.id % 3 = 0 THEN 'Webtown' ELSE p.city END AS city
FROM providers p JOIN legacy_sources s ON p.id = s.id""")
def contacts(t):
    p = t("providers").withColumn("address_line1", F.when(F.col("id") % 4 == 1, "N/A").otherwise(F.col("address_line1"))).withColumn("email", F.when(F.col("id") % 2 == 0, F.col("email")))
    s, none = t("legacy_sources"), F.lit(None).cast("string")
    pois = s.where("has_poi").select("id", F.col("poi_phone").alias("phone"), F.when(F.col("id") % 3 == 0, "poi@x").alias("email"))
    web = s.where("has_scraped").select("id", F.col("scraped_phone").alias("phone"), F.lit("web@x").alias("email"), F.concat(F.lit("W"), F.col("id").cast("string")).alias("address"), F.when(F.col("id") % 3 == 0, "Webtown").alias("city"), none.alias("state"), none.alias("zip"))
    return c.fill_contact(p, pois, web).select("id", "email", "phone", "address_line1", "city")


@query("fill_missing", "providers registry", """
SELECT p.id, p.npi_id, p.name, coalesce(nullif(trim(p.phone), ''), r.telephone_number) AS phone, coalesce(nullif(trim(p.license_number), ''), r.license) AS license_number, coalesce(nullif(trim(p.speciality), ''), r.taxonomy_desc) AS speciality,
  CASE WHEN bare THEN coalesce(r.address_1, p.own) ELSE p.own END AS address_line1, CASE WHEN bare THEN coalesce(r.city, p.city) ELSE p.city END AS city, CASE WHEN bare THEN coalesce(r.state, p.state) ELSE p.state END AS state, CASE WHEN bare THEN coalesce(r.postal_code, p.zip) ELSE p.zip END AS zip
FROM (SELECT *, upper(trim(coalesce(own, ''))) IN ('', 'N/A') AS bare FROM (SELECT *, CASE id % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN '' WHEN 2 THEN ' n/a ' WHEN 3 THEN NULL ELSE address_line1 END AS own FROM providers) o) p LEFT JOIN registry r ON p.npi_id = r.npi""")
def filled(t):
    """Four of six entities without an address: N/A in two writings, the empty text, null."""
    k = F.col("id") % 6
    bare = F.when(k == 0, "N/A").when(k == 1, "").when(k == 2, " n/a ").when(k > 3, F.col("address_line1"))
    return c.fill_missing(t("providers").withColumn("address_line1", bare), t("registry"))


@query("applied_types", "validation_issues", """
SELECT id, CASE WHEN b IS NOT NULL THEN lower(trim(b)) IN ('true', 'yes', '1') END AS accepting_new_patients, CASE WHEN json_valid(j) THEN CAST(json(j) AS VARCHAR) ELSE j END AS certifications_json, CASE WHEN b IS NOT NULL OR j IS NOT NULL THEN 'ACTIVE' ELSE 'NEW' END AS status FROM (
  SELECT c_custkey AS id, arg_max(v, i) FILTER (f = 'b') AS b, arg_max(v, i) FILTER (f = 'j') AS j FROM customer LEFT JOIN (
    SELECT provider_id, id AS i, CASE WHEN id % 2 = 0 THEN 'b' ELSE 'j' END AS f, CASE id % 8 WHEN 0 THEN 'Yes' WHEN 2 THEN ' TRUE' WHEN 4 THEN '1' WHEN 6 THEN 'never' WHEN 1 THEN '{"a": 1,  "b": [1, 2]}' WHEN 3 THEN '[ ]' WHEN 5 THEN 'no json' ELSE '"text"' END AS v FROM validation_issues WHERE id % 3 = 0) i ON c_custkey = provider_id GROUP BY 1) x""")
def applied_types(t):
    """Values of boolean and JSON columns, written in several ways."""
    k, ways = F.col("id") % 8, {0: "Yes", 2: " TRUE", 4: "1", 6: "never", 1: '{"a": 1,  "b": [1, 2]}', 3: "[ ]", 5: "no json", 7: '"text"'}
    value = F.coalesce(*[F.when(k == i, v) for i, v in ways.items()])
    values = t("validation_issues").where("id % 3 = 0").select("provider_id", F.when(F.col("id") % 2 == 0, "accepting_new_patients").otherwise("certifications_json").alias("column"), value.alias("value"), "id")
    entities = t("customer").select(F.col("c_custkey").alias("id"), F.lit(None).cast("boolean").alias("accepting_new_patients"), F.lit(None).cast("string").alias("certifications_json"), F.lit("NEW").alias("status"))
    return a.apply_values(entities, values)


