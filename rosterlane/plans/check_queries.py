"""Queries of standardisation and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlane.functions import text as t
from rosterlane.operators import validate as v

from .registry import query

_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_ADDR = r"trim(regexp_replace(regexp_replace(lower({}), '[.,\-]', ' ', 'g'), '\s+', ' ', 'g'))"
_ZIP = r"nullif(regexp_extract({}, '\b(\d{{5}})(?:-\d{{4}})?\b', 1), '')"
_STATE = r"nullif(regexp_extract({}, '\b([A-Z]{{2}})\s+\d{{5}}', 1), '')"
_STATES = ", ".join(f"'{s}'" for s in t.STATES)


@query("standardize_entities", "providers", rf"""
SELECT id, coalesce({_NORM.format('name')}, '') AS name, trim(npi_id) AS npi, {_ADDR.format('address_line1')} AS address,
  regexp_replace(phone, '[^0-9+]', '', 'g') AS phone, CAST(NULL AS VARCHAR) AS website, coalesce({_NORM.format('speciality')}, '') AS specialty,
  upper(trim(state)) AS state, coalesce(nullif(trim(city), ''), trim(string_split(address_line1, ',')[-3])) AS city,
  coalesce(nullif(trim(zip), ''), {_ZIP.format('address_line1')}) AS zip FROM providers""")
def standardize(tb):
    return v.standardize_entities(tb("providers"))


@query("extract_address_parts", "address_pairs", f"""
SELECT id, {_ZIP.format('b')} AS zip, {_STATE.format('b')} AS state, CASE WHEN len(string_split(b, ',')) >= 3 THEN nullif(trim(string_split(b, ',')[-3]), '') END AS city
FROM address_pairs""")
def parts(tb):
    b = F.col("b")
    return tb("address_pairs").select("id", t.extract_zip(b).alias("zip"), t.extract_state(b).alias("state"), t.extract_city(b).alias("city"))


_SPEC = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[,.\-]', ' ', 'g'), '\s+'), lambda w: w <> '')), ' ')"


@query("order_insensitive_specialty", "providers registry", f"""
SELECT p.id, coalesce({_SPEC.format('p.speciality')}, '') AS own, coalesce({_SPEC.format('r.taxonomy_desc')}, '') AS listed,
  coalesce({_SPEC.format('p.speciality')}, '') = coalesce({_SPEC.format('r.taxonomy_desc')}, '') AS same
FROM providers p JOIN registry r ON p.npi_id = r.npi""")
def specialty(tb):
    joined = tb("providers").join(tb("registry"), F.col("npi_id") == F.col("npi"))
    own, listed = t.normalize_specialty(F.col("speciality")), t.normalize_specialty(F.col("taxonomy_desc"))
    return joined.select("id", own.alias("own"), listed.alias("listed"), (own == listed).alias("same"))


@query("split_credentials", "providers", r"""
SELECT id, trim(regexp_replace(regexp_replace(name, '[(),]', ' ', 'g'), '\s+', ' ', 'g')) AS search_name, trim(string_split(name, '(')[1]) AS plain_name,
  array_to_string(list_filter(list_transform(string_split(regexp_extract(name, '\(([^)]+)\)', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS credentials,
  regexp_replace(upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '\s*\([^)]+\)', '', 'g'), '\s*,\s*[A-Za-z]+\s*$', '', 'g'), '\s*,\s+[A-Za-z]+$', '', 'g'), '\s+', ' ', 'g'))), '[.\-'']', '', 'g') AS registry_name,
  string_split(trim(regexp_replace(name, '(\([^)]*\)|,.*)', '', 'g')), ' ')[-1] AS last_word
FROM providers""")
def names(tb):
    n = F.col("name")
    return tb("providers").select("id", t.name_for_search(n).alias("search_name"), t.name_without_credentials(n).alias("plain_name"), F.array_join(t.credentials(n), "|").alias("credentials"), t.name_for_registry(n).alias("registry_name"), F.element_at(F.split(t.trim(F.regexp_replace(n, r"\([^)]*\)|,.*", "")), " "), -1).alias("last_word"))


@query("format_phones", "providers", """
SELECT id, CASE WHEN length(d) = 10 THEN substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7, 4) ELSE phone END AS formatted, d AS digits
FROM (SELECT id, phone, coalesce(regexp_replace(phone, '[^0-9]', '', 'g'), '') AS d FROM providers) x""")
def phones(tb):
    return tb("providers").select("id", t.format_phone(F.col("phone")).alias("formatted"), t.phone_digits(F.col("phone")).alias("digits"))


_RULES = f"""
SELECT id, r.rule_order, r.field, r.code, r.severity, CAST(r.confidence AS DOUBLE) AS confidence, r.suggested FROM (SELECT id, unnest(list_filter([
  CASE WHEN coalesce(trim(name), '') = '' THEN {{'rule_order': 0, 'field': 'name', 'code': 'MISSING_REQUIRED_FIELD', 'severity': 'HIGH', 'confidence': 0.6, 'suggested': CAST(NULL AS VARCHAR)}} END,
  CASE WHEN coalesce(trim(address_line1), '') = '' THEN {{'rule_order': 1, 'field': 'address', 'code': 'MISSING_REQUIRED_FIELD', 'severity': 'HIGH', 'confidence': 0.6, 'suggested': NULL}} END,
  CASE WHEN coalesce(trim(phone), '') = '' THEN {{'rule_order': 2, 'field': 'phone', 'code': 'MISSING_REQUIRED_FIELD', 'severity': 'HIGH', 'confidence': 0.6, 'suggested': NULL}} END,
  CASE WHEN coalesce(trim(state), '') = '' THEN {{'rule_order': 3, 'field': 'state', 'code': 'MISSING_REQUIRED_FIELD', 'severity': 'HIGH', 'confidence': 0.6, 'suggested': NULL}} END,
  CASE WHEN trim(phone) <> '' AND NOT regexp_matches(regexp_replace(phone, '[^0-9+]', '', 'g'), '^\\+?1?\\d{{10}}$') THEN {{'rule_order': 4, 'field': 'phone', 'code': 'INVALID_PHONE_FORMAT', 'severity': 'HIGH', 'confidence': 0.65, 'suggested': regexp_replace(phone, '[^0-9+]', '', 'g')}} END,
  CASE WHEN trim(address_line1) <> '' AND ({_ZIP.format('address_line1')} IS NULL OR {_STATE.format('address_line1')} IS NULL) THEN {{'rule_order': 5, 'field': 'address', 'code': 'INVALID_ADDRESS_FORMAT', 'severity': 'HIGH', 'confidence': 0.6, 'suggested': NULL}} END,
  CASE WHEN trim(state) <> '' AND upper(trim(state)) NOT IN ({_STATES}) THEN {{'rule_order': 6, 'field': 'state', 'code': 'INVALID_STATE_CODE', 'severity': 'HIGH', 'confidence': 0.7, 'suggested': NULL}} END,
  CASE WHEN trim(npi_id) <> '' AND NOT regexp_matches(trim(npi_id), '^\\d{{10}}$') THEN {{'rule_order': 7, 'field': 'npi', 'code': 'INVALID_NPI_FORMAT', 'severity': 'MEDIUM', 'confidence': 0.6, 'suggested': NULL}} END
], lambda x: x IS NOT NULL)) AS r FROM providers) y"""


@query("entity_issues", "providers", _RULES)
def all_issues(tb):
    return v.entity_issues(tb("providers"))


@query("required_field_issues", "providers", f"SELECT * FROM ({_RULES}) z WHERE code = 'MISSING_REQUIRED_FIELD'")
def required(tb):
    return v.entity_issues(tb("providers")).where("code = 'MISSING_REQUIRED_FIELD'")


@query("phone_format_issues", "providers", f"SELECT id, suggested FROM ({_RULES}) z WHERE code = 'INVALID_PHONE_FORMAT'")
def phone_format(tb):
    return v.entity_issues(tb("providers")).where("code = 'INVALID_PHONE_FORMAT'").select("id", "suggested")


@query("state_code_issues", "providers", f"SELECT id, confidence FROM ({_RULES}) z WHERE code = 'INVALID_STATE_CODE'")
def state_code(tb):
    return v.entity_issues(tb("providers")).where("code = 'INVALID_STATE_CODE'").select("id", "confidence")


@query("npi_checksum", "providers", r"""
SELECT id, npi_id, coalesce(regexp_matches(npi_id, '^[12]\d{9}$') AND (24 + list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN
    CASE WHEN CAST(substr(npi_id, CAST(i AS INT), 1) AS INT) > 4 THEN 2 * CAST(substr(npi_id, CAST(i AS INT), 1) AS INT) - 9 ELSE 2 * CAST(substr(npi_id, CAST(i AS INT), 1) AS INT) END
    ELSE CAST(substr(npi_id, CAST(i AS INT), 1) AS INT) END))) % 10 = 0, FALSE) AS valid FROM providers""")
def checksum(tb):
    return tb("providers").select("id", "npi_id", v.npi_is_valid(F.col("npi_id")).alias("valid"))


@query("hard_reject", "providers", f"""
SELECT p.id, coalesce(b.missing, '') AS missing, coalesce(b.malformed, '') AS malformed, coalesce(b.hard, FALSE) AS hard_reject, b.id IS NULL AS input_ok, coalesce(b.errors, '') AS errors
FROM providers p LEFT JOIN (SELECT id, string_agg(CASE WHEN code = 'MISSING_REQUIRED_FIELD' THEN field END, ',' ORDER BY rule_order) AS missing,
    string_agg(CASE WHEN code <> 'MISSING_REQUIRED_FIELD' THEN field END, ',' ORDER BY rule_order) AS malformed, string_agg(field || ':' || code, ',' ORDER BY rule_order) AS errors,
    bool_or(code = 'MISSING_REQUIRED_FIELD' OR field IN ('address', 'state')) AS hard FROM ({_RULES}) z GROUP BY id) b ON p.id = b.id""")
def hard(tb):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return v.validate_entities(tb("providers")).select("id", joined("missing"), joined("malformed"), "hard_reject", "input_ok", joined("errors"))


@query("metric_quarantine", "validation_run_metrics", """
SELECT id, array_to_string(list_filter([CASE WHEN workflow_latency_ms < 0 THEN 'workflow_latency_ms' END, CASE WHEN prompt_tokens < 0 THEN 'prompt_tokens' END,
  CASE WHEN completion_tokens < 0 THEN 'completion_tokens' END, CASE WHEN total_tokens < 0 THEN 'total_tokens' END, CASE WHEN estimated_cost_usd < 0 THEN 'estimated_cost_usd' END], lambda x: x IS NOT NULL), ',') AS violations
FROM validation_run_metrics""")
def quarantine(tb):
    return v.quarantine_metrics(tb("validation_run_metrics")).select("id", F.array_join("violations", ",").alias("violations"))


@query("search_entities", "providers", """
SELECT id, name FROM providers WHERE status = 'ACTIVE' AND name ILIKE '%family1%' AND (contains(lower(name), 'medicine') OR contains(coalesce(lower(npi_id), ''), 'medicine') OR contains(coalesce(lower(speciality), ''), 'medicine'))""")
def search(tb):
    return v.search_entities(tb("providers"), "ACTIVE", "family1", "Medicine").select("id", "name")


@query("review_complete", "validation_issues decisions", """
SELECT i.provider_id, bool_and(d.decision IS NOT NULL AND (d.decision <> 'reject' OR coalesce(trim(d.correct_value) <> '', FALSE))) AS complete
FROM validation_issues i LEFT JOIN decisions d ON i.id = d.issue_id WHERE i.status = 'OPEN' GROUP BY i.provider_id""")
def complete(tb):
    return v.review_complete(tb("validation_issues"), tb("decisions"))


@query("last_names", "providers", r"""
SELECT id, CASE WHEN contains(plain, ',') THEN trim(split_part(plain, ',', 1)) ELSE string_split(plain, ' ')[-1] END AS last_name FROM (
  SELECT id, trim(regexp_replace(regexp_replace(CASE id % 3 WHEN 0 THEN 'Dr. ' || name WHEN 1 THEN name ELSE name || ' PhD' END, '\([^)]*\)', '', 'g'), '(?i)\b(?:dr|mr|mrs|ms|md|do|dds|phd|rn|np|pa)\b\.?', '', 'g')) AS plain FROM providers) p""")
def last_names(t):
    from rosterlane.functions.text import last_name

    k, name = F.col("id") % 3, F.col("name")
    written = F.when(k == 0, F.concat(F.lit("Dr. "), name)).when(k == 1, name).otherwise(F.concat(name, F.lit(" PhD")))
    return t("providers").select("id", last_name(written).alias("last_name"))
