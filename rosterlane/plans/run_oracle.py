"""DuckDB SQL of address similarity and of a whole validation run, as parts of the oracles' WITH lists."""

from __future__ import annotations

from .check_queries import _ADDR, _NORM, _RULES

_REACH = "greatest(0, greatest(length(s), length(t)) // 2 - 1)"
_FREE = f"list_filter(range(greatest(0, x[1] - {_REACH}), least(length(t), x[1] + {_REACH} + 1)), lambda j: substr(t, CAST(j + 1 AS BIGINT), 1) = substr(s, CAST(x[1] + 1 AS BIGINT), 1) AND NOT list_contains(list_transform(acc, lambda u: u % 100000), j))"
_WORDS = r"list_filter(string_split({0}, ' '), lambda w: NOT regexp_matches(w, '^\d{{5}}'))"
_COUNT = "len(list_filter({0}, lambda v: v = w))"


def jaro_winkler(pairs: str) -> str:
    """CTEs up to jw (s, t, score) for the lower-cased pairs of `pairs` (a, b). A match is coded as 100000 i + j."""
    return f"""
jw_pairs AS (SELECT DISTINCT lower(a) AS s, lower(b) AS t FROM {pairs} WHERE a <> '' AND b <> ''),
jw_met AS (SELECT s, t, CASE WHEN s = t THEN CAST([] AS BIGINT[]) ELSE list_reduce([CAST([] AS BIGINT[])] || list_transform(range(length(s)), lambda i: [i]), lambda acc, x: CASE WHEN len({_FREE}) > 0 THEN list_append(acc, x[1] * 100000 + {_FREE}[1]) ELSE acc END) END AS m FROM jw_pairs),
jw_parts AS (SELECT s, t, len(m) AS k, list_transform(m, lambda u: substr(s, u // 100000 + 1, 1)) AS mine, list_transform(list_sort(list_transform(m, lambda u: u % 100000)), lambda j: substr(t, j + 1, 1)) AS theirs,
    coalesce(list_filter(range(1, least(4, length(s), length(t)) + 1), lambda i: substr(s, CAST(i AS BIGINT), 1) <> substr(t, CAST(i AS BIGINT), 1))[1] - 1, least(4, length(s), length(t))) AS same FROM jw_met),
jw_jaro AS (SELECT s, t, same, CASE WHEN s = t THEN 1.0 WHEN k = 0 THEN 0.0 ELSE (k / length(s) + k / length(t) + (k - len(list_filter(range(1, k + 1), lambda i: mine[i] <> theirs[i])) / 2) / k) / 3 END AS jaro FROM jw_parts),
jw AS (SELECT s, t, CASE WHEN jaro = 0 THEN 0.0 ELSE least(1.0, jaro + same * 0.1 * (1 - jaro)) END AS score FROM jw_jaro)"""


def similarity(pairs: str) -> str:
    """CTEs up to sim (a, b, matched, alike): whether two addresses match, and how alike they are, for the distinct pairs of `pairs`."""
    return f"""
sim_pairs AS (SELECT DISTINCT a, b FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL),{jaro_winkler("sim_pairs")},
sim_parts AS (SELECT a, b, {_ADDR.format("a")} AS x, {_ADDR.format("b")} AS y, regexp_extract(a, '\\b(\\d{{5}})\\b', 1) AS za, regexp_extract(b, '\\b(\\d{{5}})\\b', 1) AS zb,
    regexp_extract(a, '\\b([A-Z]{{2}})\\s+\\d{{5}}', 1) AS sa, regexp_extract(b, '\\b([A-Z]{{2}})\\s+\\d{{5}}', 1) AS sb, regexp_extract_all(lower(a), '\\w+') AS ta, regexp_extract_all(lower(b), '\\w+') AS tb FROM sim_pairs),
sim_scores AS (SELECT *, CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE coalesce(list_sum(list_transform(list_distinct(ta), lambda w: {_COUNT.format("ta")} * {_COUNT.format("tb")})), 0)
    / (sqrt(list_sum(list_transform(list_distinct(ta), lambda w: {_COUNT.format("ta")} ** 2))) * sqrt(list_sum(list_transform(list_distinct(tb), lambda w: {_COUNT.format("tb")} ** 2)))) END AS cosine FROM sim_parts),
sim AS (SELECT p.a, p.b, CASE WHEN p.a = '' OR p.b = '' THEN FALSE WHEN p.a = p.b OR x = y THEN TRUE WHEN za <> '' AND zb <> '' AND za <> zb THEN FALSE WHEN sa <> '' AND sb <> '' AND sa <> sb THEN FALSE WHEN za = '' OR za <> zb THEN FALSE
    WHEN {_WORDS.format("x")} = {_WORDS.format("y")} THEN TRUE
    ELSE list_has_all({_WORDS.format("x")}, {_WORDS.format("y")}) AND list_has_all({_WORDS.format("y")}, {_WORDS.format("x")}) AND regexp_extract_all(x, '\\d+') = regexp_extract_all(y, '\\d+') END AS matched,
  CASE WHEN p.a = '' OR p.b = '' THEN 0.0 ELSE 0.40 * cosine + 0.45 * j.score + 0.15 * (1 - levenshtein(lower(p.a), lower(p.b)) / greatest(length(p.a), length(p.b))) END AS alike
  FROM sim_scores p LEFT JOIN jw j ON lower(p.a) = j.s AND lower(p.b) = j.t)"""


_PHONE = "regexp_replace({0}, '[^0-9+]', '', 'g')"
_ROW = "SELECT id, {ord} AS rule_order, '{field}' AS field, '{code}' AS code, '{source}' AS source_type, '{severity}' AS severity, {value} AS suggested, CAST({score} AS DOUBLE) AS confidence, {action} AS action FROM wide WHERE {when}"


def _row(ord, field, code, source, severity, value, score, when, action="CAST(NULL AS VARCHAR)"):
    return _ROW.format(ord=ord, field=field, code=code, source=source, severity=severity, value=value, score=score, when=when, action=action)


_UNLIKE = "coalesce({0}_address, '') <> '' AND NOT coalesce({0}_matched, FALSE)"
_DIFFERS = f"coalesce({{0}}_phone, '') <> '' AND NOT coalesce({_PHONE.format('{0}_phone')} = phone, FALSE)"
_TIMES = "coalesce(day, 'Day') || ': ' || CASE WHEN slot <> '' THEN slot ELSE coalesce(status, 'Closed') END"

#: What the directory holds of an issue's field; i is the issue, p the provider.
OLD_VALUE = "CASE i.field WHEN 'name' THEN p.name WHEN 'phone' THEN p.phone WHEN 'address' THEN p.address_line1 WHEN 'address_line1' THEN p.address_line1 WHEN 'city' THEN p.city WHEN 'state' THEN p.state WHEN 'zip' THEN p.zip WHEN 'speciality' THEN p.speciality WHEN 'npi' THEN p.npi_id END"
TABLES = "providers registry provider_sources license_statuses listing_hours listing_status"
RUN = f"""
rules AS ({_RULES}),
own AS (SELECT p.id, trim(p.npi_id) AS npi_id, coalesce({_NORM.format('p.name')}, '') AS name, coalesce({_ADDR.format('p.address_line1')}, '') AS address, {_PHONE.format('p.phone')} AS phone FROM providers p),
first_source AS (SELECT provider_id, source_type, arg_min(phone, source_id) FILTER (phone IS NOT NULL AND source_id = m) AS phone, arg_min(address, source_id) FILTER (address IS NOT NULL AND source_id = m) AS address
  FROM (SELECT *, min(source_id) OVER (PARTITION BY provider_id, source_type) AS m FROM provider_sources WHERE is_found) f GROUP BY 1, 2),
joined AS (SELECT o.*, r.npi IS NOT NULL AS found, CASE WHEN r.npi IS NOT NULL THEN concat_ws(' ', r.first_name, r.last_name) END AS npi_name, r.telephone_number AS npi_phone,
    CASE WHEN r.npi IS NOT NULL THEN concat_ws(', ', r.address_1, r.city, r.state, r.postal_code) END AS npi_address, r.taxonomy_desc AS cert_name, r.license AS cert_license,
    w.provider_id IS NOT NULL AS has_site, w.phone AS site_phone, w.address AS site_address, m.phone AS maps_phone, m.address AS maps_address, l.license_status, h.times, s.availability_status
  FROM own o LEFT JOIN registry r ON nullif(o.npi_id, '') = r.npi LEFT JOIN first_source w ON o.id = w.provider_id AND w.source_type = 'SCRAPING_ENRICHMENT' LEFT JOIN first_source m ON o.id = m.provider_id AND m.source_type = 'AZURE_POI'
  LEFT JOIN license_statuses l ON o.id = l.provider_id LEFT JOIN (SELECT provider_id, string_agg({_TIMES}, '; ' ORDER BY pos) AS times FROM listing_hours GROUP BY 1) h ON o.id = h.provider_id LEFT JOIN listing_status s ON o.id = s.provider_id),
all_pairs AS (SELECT address AS a, npi_address AS b FROM joined UNION ALL SELECT address, site_address FROM joined UNION ALL SELECT address, maps_address FROM joined),{similarity("all_pairs")},
wide AS (SELECT j.*, coalesce(x.matched, FALSE) AS npi_matched, coalesce(y.matched, FALSE) AS site_matched, coalesce(z.matched, FALSE) AS maps_matched, coalesce(y.alike, 0) AS site_alike, coalesce(z.alike, 0) AS maps_alike,
    j.name <> '' AND coalesce({_NORM.format('npi_name')}, '') <> '' AND (contains({_NORM.format('npi_name')}, j.name) OR contains(j.name, {_NORM.format('npi_name')})) AS name_ok, upper(coalesce(license_status, '')) AS lic
  FROM joined j LEFT JOIN sim x ON j.address = x.a AND j.npi_address = x.b LEFT JOIN sim y ON j.address = y.a AND j.site_address = y.b LEFT JOIN sim z ON j.address = z.a AND j.maps_address = z.b),
disc AS (SELECT id, rule_order, field, code, 'INPUT_VALIDATION' AS source_type, severity, suggested, confidence, CAST(NULL AS VARCHAR) AS action FROM rules
  UNION ALL {_row(10, 'name', 'NPI_NAME_MISMATCH', 'NPI_API', 'MEDIUM', 'npi_name', '1.0', 'found AND NOT coalesce(name_ok, FALSE)')}
  UNION ALL {_row(11, 'address', 'NPI_ADDRESS_MISMATCH', 'NPI_API', 'MEDIUM', 'npi_address', '1.0', _UNLIKE.format('npi'))}
  UNION ALL {_row(12, 'phone', 'NPI_PHONE_MISMATCH', 'NPI_API', 'MEDIUM', 'npi_phone', '1.0', _DIFFERS.format('npi'))}
  UNION ALL {_row(13, 'license_status', 'LICENSE_INACTIVE', 'LICENSE_REGISTRY', 'HIGH', 'CAST(NULL AS VARCHAR)', '0.8', "lic <> '' AND lic <> 'ACTIVE'")}
  UNION ALL {_row(14, 'appointment_availability', 'APPOINTMENT_AVAILABILITY', 'LISTING_WEBSITE', 'LOW', 'times', '0.6', 'times IS NOT NULL', "'INFORMATIONAL'")}
  UNION ALL {_row(15, 'availability_status', 'APPOINTMENT_STATUS', 'LISTING_WEBSITE', 'LOW', 'availability_status', '0.6', "availability_status <> 'NO_INFO'", "'INFORMATIONAL'")}
  UNION ALL {_row(16, 'phone', 'WEBSITE_PHONE_MISMATCH', 'WEBSITE', 'MEDIUM', 'site_phone', '0.62', _DIFFERS.format('site'))}
  UNION ALL {_row(17, 'address', 'WEBSITE_ADDRESS_MISMATCH', 'WEBSITE', 'MEDIUM', 'site_address', '0.5 + 0.3 * site_alike', _UNLIKE.format('site'))}
  UNION ALL {_row(18, 'phone', 'AZURE_PHONE_MISMATCH', 'AZURE_MAPS', 'MEDIUM', 'maps_phone', '0.545', _DIFFERS.format('maps'))}
  UNION ALL {_row(19, 'address', 'AZURE_ADDRESS_MISMATCH', 'AZURE_MAPS', 'MEDIUM', 'maps_address', '0.425 + 0.3 * maps_alike', _UNLIKE.format('maps'))}
  UNION ALL {_row(20, 'certification', 'CERTIFICATION_SUGGESTED', 'NPI_CERTIFICATIONS', 'MEDIUM', "cert_name || coalesce(' (License: ' || nullif(cert_license, '') || ')', '')", '1.0', "coalesce(cert_name, '') <> ''")}),
issues AS (SELECT id, rule_order, field, code, source_type, coalesce(severity, 'MEDIUM') AS severity, suggested, round(confidence, 6) AS confidence,
    coalesce(action, CASE WHEN source_type IN ('NPI_API', 'NPI_CERTIFICATIONS') OR confidence >= 0.75 THEN 'AUTO_ACCEPT' ELSE 'NEEDS_REVIEW' END) AS action, CASE WHEN action = 'INFORMATIONAL' THEN 'ACCEPTED' ELSE 'OPEN' END AS status
  FROM disc WHERE suggested IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY confidence DESC, rule_order) = 1),
checked AS (SELECT id, arg_min(field || ':' || code, rule_order) AS error, bool_or(code = 'MISSING_REQUIRED_FIELD' OR field IN ('address', 'state')) AS hard FROM rules GROUP BY id),
outcomes AS (SELECT w.id, 1 AS k, 'INPUT_VALIDATION' AS source, c.id IS NULL AS success, c.error FROM wide w LEFT JOIN checked c ON w.id = c.id
  UNION ALL SELECT id, 2, 'NPI_API', found, CASE WHEN NOT found THEN 'NPI_NOT_FOUND' END FROM wide
  UNION ALL SELECT id, 3, 'LICENSE_REGISTRY', lic <> '', CASE WHEN lic = '' THEN 'LICENSE_NOT_FOUND' END FROM wide
  UNION ALL SELECT id, 4, 'AZURE_MAPS', coalesce(maps_address, '') <> '', CASE WHEN coalesce(maps_address, '') = '' THEN 'NO_RESULTS' END FROM wide
  UNION ALL SELECT id, 5, 'NPI_CERTIFICATIONS', coalesce(cert_name, '') <> '', CASE WHEN coalesce(cert_name, '') <> '' THEN NULL WHEN coalesce(npi_id, '') = '' THEN 'NPI_NOT_PROVIDED' ELSE 'CERTIFICATIONS_NOT_FOUND' END FROM wide),
counted AS (SELECT w.id, coalesce(c.hard, FALSE) AS hard_reject, (SELECT count(*) FROM disc d WHERE d.id = w.id AND (contains(d.code, 'MISMATCH') OR contains(d.code, 'INACTIVE'))) AS conflicts, (SELECT count(*) FROM outcomes o WHERE o.id = w.id AND NOT o.success) AS failures,
    0.35 * CASE WHEN NOT found THEN 0.0 WHEN coalesce(name_ok, FALSE) OR npi_matched OR coalesce({_PHONE.format('npi_phone')} = phone AND phone <> '' AND npi_phone <> '', FALSE) THEN 1.0 ELSE 0.5 END + 0.25 * CASE WHEN lic = 'ACTIVE' THEN 1.0 ELSE 0.0 END
    + 0.20 * CASE WHEN NOT has_site THEN 0.0 WHEN site_matched OR coalesce({_PHONE.format('site_phone')} = phone AND phone <> '' AND site_phone <> '', FALSE) THEN 1.0 ELSE 0.5 END
    + 0.20 * CASE WHEN phone <> '' AND regexp_matches(phone, '^\\+?1?\\d{{10}}$') THEN 1.0 ELSE 0.0 END AS base
  FROM wide w LEFT JOIN checked c ON w.id = c.id),
scores AS (SELECT *, CASE WHEN hard_reject THEN 0.0 ELSE round(greatest(0.0, base - 0.05 * failures - 0.10 * conflicts), 6) END AS score FROM counted),
scored AS (SELECT *, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN score < 0.4 THEN 'HIGH' WHEN score < 0.65 THEN 'MEDIUM' ELSE 'LOW' END AS record_severity,
    score < 0.65 OR conflicts > 0 OR failures > 0 OR hard_reject AS review FROM scores),
judged AS (SELECT *, CASE WHEN hard_reject THEN 'REJECT' WHEN review THEN 'NEEDS_REVIEW' ELSE 'APPROVE' END AS recommendation, CASE WHEN score >= 0.65 AND NOT review THEN 'approved' ELSE 'needs_review' END AS route,
    concat_ws(',', CASE WHEN failures > 0 THEN 'EXTERNAL_SOURCE_FAILURE' END, CASE WHEN conflicts > 0 THEN 'DATA_CONFLICTS' END, CASE WHEN hard_reject THEN 'MISSING_OR_INVALID_REQUIRED_FIELDS' END, CASE WHEN review AND failures = 0 AND conflicts = 0 AND NOT hard_reject THEN 'LOW_CONFIDENCE' END) AS reasons FROM scored)"""

#: With the table validation_issues: status (id, directory_status, ok), ok being the accepted issues.
STATUS = """
accepted AS (SELECT provider_id, count(*) AS n FROM validation_issues WHERE status = 'ACCEPTED' GROUP BY 1),
status AS (SELECT j.*, a.n AS ok, CASE WHEN a.n > 0 THEN 'MANUAL_ACCEPT' WHEN recommendation = 'REJECT' THEN 'REJECTED' WHEN recommendation = 'NEEDS_REVIEW' THEN 'NEEDS_REVIEW' ELSE 'PUBLISHED' END AS directory_status FROM judged j LEFT JOIN accepted a ON j.id = a.provider_id)"""


def run(tail: str) -> str:
    return f"SELECT * FROM (WITH {RUN} {tail}) w"


def run_status(tail: str) -> str:
    return f"SELECT * FROM (WITH {RUN},{STATUS} {tail}) w"


_VOTES = {"npi": 0.95 / 3.10, "azure": 0.85 / 3.10, "scrape": 0.70 / 3.10, "pdf": 0.60 / 3.10}
_DIGITS = "coalesce(regexp_replace({0}, '[^0-9]', '', 'g'), '')"
_SPECIALTY = r"coalesce(array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[,.\-]', ' ', 'g'), '\s+'), lambda w: w <> '')), ' '), '')"


def _legacy():
    phone = lambda s: f"{s}_phone <> '' AND {_DIGITS.format(f'{s}_phone')} <> {_DIGITS.format('phone')}"
    specialty = lambda c: f"{c} <> '' AND {_SPECIALTY.format(c)} <> {_SPECIALTY.format('speciality')}"
    maps = "has_maps AND NOT address_verified AND maps_valid AND maps_formatted <> '' AND NOT maps_m"
    poi = "has_poi AND NOT address_verified AND NOT coalesce(poi_m, FALSE)"
    differ = lambda a, b, f: f"{a} <> '' AND {b} <> '' AND {f.format(a)} <> {f.format(b)}"
    own = lambda c: f"coalesce({c}, '')"
    na = "'Not available'"
    # order, mode, field, source, condition, old, suggested, vote or None for 1 with authority, address component, informational, with licence
    rules = [
        (1, "set", "phone", "NPI_API", f"has_npi AND {phone('npi')}", own("phone"), "npi_phone", "npi", "CASE WHEN address_line1 <> '' THEN 1.0 ELSE 0.0 END"), (2, "set", "speciality", "NPI_API", f"has_npi AND {specialty('npi_speciality')}", own("speciality"), "npi_speciality", None, "0"),
        (3, "set", "address_line1", "AZURE_MAPS", "has_maps AND NOT address_verified AND NOT maps_valid AND maps_reason = 'NO_RESULTS'", own("address_line1"), "'Address not found - please verify'", "azure", "0"),
        (4, "set", "zip", "AZURE_MAPS", f"{maps} AND {differ('maps_zip', 'zip', '{0}')}", own("zip"), "maps_zip", "azure", "maps_a"), (5, "set", "city", "AZURE_MAPS", f"{maps} AND {differ('maps_city', 'city', _ADDR)}", own("city"), "maps_city", "azure", "maps_city_a"),
        (6, "set", "state", "AZURE_MAPS", f"{maps} AND {differ('maps_state', 'state', _NORM)}", own("state"), "maps_state", "azure", "maps_state_a"), (7, "set", "address_line1", "AZURE_MAPS", f"{maps} AND maps_score > 0 AND maps_score < 0.6", own("address_line1"), "string_split(maps_formatted, ',')[1]", "azure", "maps_score"),
        (8, "set", "phone", "AZURE_POI", f"has_poi AND {phone('poi')}", own("phone"), "poi_phone", "azure", "0.5"), (9, "set", "zip", "AZURE_POI", f"{poi} AND {differ('poi_zip', 'zip', '{0}')}", own("zip"), "poi_zip", "azure", "poi_a"),
        (9, "set", "city", "AZURE_POI", f"{poi} AND {differ('poi_city', 'city', _ADDR)}", own("city"), "poi_city", "azure", "poi_city_a"), (9, "set", "state", "AZURE_POI", f"{poi} AND {differ('poi_state', 'state', _NORM)}", own("state"), "poi_state", "azure", "poi_state_a"),
        (10, "set", "website", "AZURE_POI", "has_poi AND poi_website <> ''", own("website"), "poi_website", "azure", "0.5"), (11, "absent", "phone", "SCRAPING_ENRICHMENT", f"has_scraped AND {phone('scraped')}", own("phone"), "scraped_phone", "scrape", "0.4"),
        (12, "absent", "website", "SCRAPING_ENRICHMENT", "has_scraped AND scraped_website <> ''", own("website"), "scraped_website", "scrape", "0.3"), (13, "set", "name", "PDF_OCR", "has_ocr AND ocr_name <> '' AND ocr_name IS DISTINCT FROM name", own("name"), "ocr_name", "pdf", "0.3"),
        (14, "absent", "phone", "PDF_OCR", f"has_ocr AND {phone('ocr')}", own("phone"), "ocr_phone", "pdf", "0.2"), (15, "absent", "address_line1", "PDF_OCR", "has_ocr AND NOT address_verified AND ocr_address <> '' AND NOT ocr_m", own("address_line1"), "ocr_address", "pdf", "ocr_a"),
        (16, "absent", "phone", "LISTING_WEBSITE", f"has_listing AND {phone('listing')}", own("phone"), "listing_phone", "scrape", "0.7"), (17, "absent", "address_line1", "LISTING_WEBSITE", "has_listing AND NOT address_verified AND listing_address <> '' AND NOT listing_m", own("address_line1"), "listing_address", "scrape", "listing_a"),
        (18, "absent", "speciality", "LISTING_WEBSITE", f"has_listing AND {specialty('listing_specialty')}", own("speciality"), "listing_specialty", "scrape", "0.7"),
        (19, "set", "license_number", "LISTING_WEBSITE", "has_listing AND listing_license <> '' AND listing_license IS DISTINCT FROM license_number", own("license_number"), "listing_license", "scrape", "0.7"),
        (19, "set", "license_state", "LISTING_WEBSITE", "has_listing AND listing_license_state <> ''", na, "listing_license_state", "scrape", "0.7"), (19, "set", "license_status", "LISTING_WEBSITE", "has_listing AND listing_license_status <> ''", na, "listing_license_status", "scrape", "0.7"),
        (20, "set", "office_hours", "LISTING_WEBSITE", "has_listing", na, "listing_hours_text", "scrape", "0.6"), (21, "set", "appointment_availability", "LISTING_WEBSITE", "has_listing", na, "'Monday: 9:00 AM, 10:00 AM; Sunday: CLOSED'", "scrape", "0.75", True),
        (22, "set", "availability_status", "LISTING_WEBSITE", "has_listing AND listing_availability <> 'NO_INFO'", na, "listing_availability", "scrape", "0.7", True),
        (23, "set", "accepting_new_patients", "LISTING_WEBSITE", "has_listing AND listing_accepting IS NOT NULL", na, "CASE WHEN listing_accepting THEN 'Yes' ELSE 'No' END", "scrape", "0.6"), (23, "set", "telehealth_available", "LISTING_WEBSITE", "has_listing AND listing_telehealth IS NOT NULL", na, "CASE WHEN listing_telehealth THEN 'Yes' ELSE 'No' END", "scrape", "0.6"),
        (24, "set", "affiliations", "LISTING_WEBSITE", "has_listing AND listing_affiliations <> ''", na, "listing_affiliations", "scrape", "0.5"), (25, "absent", "speciality", "NPI_CERTIFICATIONS", f"has_cert AND {specialty('cert_specialty')}", own("speciality"), "cert_specialty", None, "0"),
        (26, "set", "certification", "NPI_CERTIFICATIONS", "has_cert AND cert_name <> ''", na, "cert_name || coalesce(' (License: ' || cert_license || ')', '')", None, "0"),
    ]
    parts = []
    for order, mode, field, source, when, old, value, vote, address, *more in rules:
        score = "1.0" if vote is None else f"round(0.5 * {_VOTES[vote]!r} + 0.3 * ({address}), 6)"
        parts.append(f"SELECT id, {order} AS rule_order, '{mode}' AS mode, '{field}' AS field, '{source}' AS source_type, {old} AS old, {value} AS suggested, CAST({score} AS DOUBLE) AS confidence, {bool(more)} AS told FROM legacy WHERE {when}")
    return " UNION ALL ".join(parts)


_SIMS = {"maps": ("address_line1", "maps_formatted"), "maps_city": ("city", "maps_city"), "maps_state": ("state", "maps_state"), "poi": ("address_line1", "coalesce(poi_formatted, '')"), "poi_city": ("city", "poi_city"), "poi_state": ("state", "poi_state"), "ocr": ("address_line1", "ocr_address"), "listing": ("address_line1", "listing_address")}
LEGACY = f"""SELECT * FROM (WITH base AS (SELECT p.id, p.name, p.phone, p.address_line1, p.city, p.state, p.zip, p.speciality, p.license_number, s.* EXCLUDE (id) FROM providers p JOIN legacy_sources s ON p.id = s.id),
legacy_pairs AS ({' UNION ALL '.join(f'SELECT {a} AS a, {b} AS b FROM base' for a, b in _SIMS.values())}),{similarity('legacy_pairs')},
legacy AS (SELECT base.*, {', '.join(f'coalesce(t{k}.alike, 0) AS {n}_a, coalesce(t{k}.matched, FALSE) AS {n}_m' for k, n in enumerate(_SIMS))} FROM base {' '.join(f'LEFT JOIN sim t{k} ON base.{a} = t{k}.a AND {b} = t{k}.b' for k, (a, b) in enumerate(_SIMS.values()))}),
told AS ({_legacy()})
SELECT id, field, source_type, old, suggested, confidence, CASE WHEN told THEN 'INFORMATIONAL' WHEN confidence >= 0.45 THEN 'AUTO_ACCEPT' ELSE 'NEEDS_REVIEW' END AS action, CASE WHEN told THEN 'INFO' WHEN confidence >= 0.45 THEN 'LOW' ELSE 'HIGH' END AS severity
FROM told QUALIFY row_number() OVER (PARTITION BY id, field ORDER BY CASE WHEN mode = 'set' THEN -rule_order ELSE 1000 + rule_order END) = 1) w"""


def nearest(asked: str, known: str, most: int = 200) -> str:
    """A table (id, a, ref, score): for each row of asked (id, a) the most alike of known (ref, b) with which it shares a word, or two that follow one another, that at most `most` of known hold."""
    keys = lambda w: f"unnest(list_distinct({w} || list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])))"
    lev = "0.15 * (1 - levenshtein(lower(m.a), lower(m.b)) / greatest(length(m.a), length(m.b)))"
    return f"""(WITH n_asked AS ({asked}), n_known AS ({known}), n_refs AS (SELECT b, min(ref) AS ref, regexp_extract_all(lower(b), '\\w+') AS w FROM n_known WHERE b <> '' GROUP BY b),
  n_texts AS (SELECT DISTINCT a, regexp_extract_all(lower(a), '\\w+') AS w FROM n_asked WHERE a <> ''), n_index AS (SELECT b, ref, {keys("w")} AS key FROM n_refs),
  n_held AS (SELECT key FROM n_index GROUP BY key HAVING count(*) <= {most}),
  n_met AS (SELECT DISTINCT t.a, i.b, i.ref FROM (SELECT a, {keys("w")} AS key FROM n_texts) t JOIN n_index i ON t.key = i.key JOIN n_held h ON t.key = h.key),
  n_cheap AS (SELECT m.a, m.b, m.ref, {lev} AS lev, coalesce(list_sum(list_transform(list_distinct(x.w), lambda w: {_COUNT.format("x.w")} * {_COUNT.format("y.w")})), 0)
    / (sqrt(list_sum(list_transform(list_distinct(x.w), lambda w: {_COUNT.format("x.w")} ** 2))) * sqrt(list_sum(list_transform(list_distinct(y.w), lambda w: {_COUNT.format("y.w")} ** 2)))) AS cosine
    FROM n_met m JOIN n_texts x ON m.a = x.a JOIN n_refs y ON m.b = y.b),
  n_first AS (SELECT a, arg_max(b, 0.40 * cosine + lev) AS b FROM n_cheap GROUP BY a),
  n_reached AS (SELECT * FROM (WITH {jaro_winkler("n_first")} SELECT c.a, 0.40 * cosine + 0.45 * j.score + lev AS reached FROM n_first f JOIN n_cheap c ON f.a = c.a AND f.b = c.b JOIN jw j ON lower(c.a) = j.s AND lower(c.b) = j.t)),
  n_close AS (SELECT c.* FROM n_cheap c JOIN n_reached r ON c.a = r.a WHERE 0.40 * cosine + lev + 0.45 >= reached - 0.000001),{jaro_winkler("n_close")},
  n_top AS (SELECT c.a, c.ref, round(0.40 * cosine + 0.45 * j.score + lev, 9) AS score FROM n_close c JOIN jw j ON lower(c.a) = j.s AND lower(c.b) = j.t
    QUALIFY row_number() OVER (PARTITION BY c.a ORDER BY round(0.40 * cosine + 0.45 * j.score + lev, 9) DESC, c.ref) = 1)
  SELECT q.id, q.a, n.ref, n.score FROM n_asked q LEFT JOIN n_top n ON q.a = n.a AND n.score >= 0.65)"""
