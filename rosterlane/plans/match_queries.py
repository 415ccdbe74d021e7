"""Queries of joins, lookups and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlane.functions import text as t
from rosterlane.operators import extract as x
from rosterlane.operators import match as m
from rosterlane.operators import report as r
from rosterlane.sources import entities as s

from .registry import query
from .run_oracle import nearest


@query("issues_with_entity", "validation_issues providers", """
SELECT i.id, i.field_name, i.status, p.name, p.phone, p.email, p.npi_id FROM validation_issues i LEFT JOIN providers p ON i.provider_id = p.id""")
def with_entity(tb):
    return r.issues_with_entity(tb("validation_issues"), tb("providers")).select("id", "field_name", "status", "name", "phone", "email", "npi_id")


@query("entities_with_issue_count", "validation_issues providers", """
SELECT p.id, p.name, coalesce(c.n, 0) AS issue_count FROM providers p LEFT JOIN (SELECT provider_id, count(*) AS n FROM validation_issues GROUP BY 1) c ON p.id = c.provider_id""")
def issue_count(tb):
    return r.entities_with_issue_count(tb("providers"), tb("validation_issues")).select("id", "name", "issue_count")


@query("entities_without_issues", "validation_issues providers", "SELECT id, name FROM providers WHERE id NOT IN (SELECT provider_id FROM validation_issues WHERE status = 'OPEN')")
def without_issues(tb):
    """Without an open one: every entity of the table has an issue."""
    return r.entities_with_issue_count(tb("providers"), tb("validation_issues").where("status = 'OPEN'")).where("issue_count = 0").select("id", "name")


@query("run_entities_semi", "validation_issues providers", "SELECT id, name FROM providers WHERE id IN (SELECT provider_id FROM validation_issues WHERE run_id = 1995)")
def run_entities(tb):
    return r.entities_of_run(tb("providers"), tb("validation_issues"), 1995).select("id", "name")


@query("new_ids_anti", "providers registry", r"""
SELECT a.npi, CASE WHEN NOT regexp_matches(a.npi, '^\d{10}$') THEN 'invalid' WHEN p.npi_id IS NOT NULL THEN 'duplicate' WHEN g.npi IS NULL THEN 'not_found' ELSE 'inserted' END AS outcome,
  CASE WHEN regexp_matches(a.npi, '^\d{10}$') AND p.npi_id IS NULL THEN g.first_name || coalesce(' ' || g.middle_name, '') || ' ' || g.last_name END AS name
FROM (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN r.npi WHEN c_custkey % 7 = 0 THEN 'x' || CAST(c_custkey AS VARCHAR) ELSE CAST(1900000000 + c_custkey AS VARCHAR) END AS npi
      FROM customer c LEFT JOIN (SELECT npi, CAST(substr(npi, 1, 9) AS BIGINT) - 100000000 AS k FROM registry) r ON r.k = c.c_custkey) a
LEFT JOIN (SELECT npi_id FROM providers WHERE id % 3 = 0) p ON a.npi = p.npi_id LEFT JOIN registry g ON a.npi = g.npi WHERE a.npi IS NOT NULL""")
def new_ids(tb):
    reg = tb("registry")
    keyed = reg.select("npi", (F.substring("npi", 1, 9).cast("long") - 100000000).alias("k"))
    key = F.col("c_custkey")
    asked = tb("customer").join(keyed, key == F.col("k"), "left").select(F.when(key % 2 == 0, F.col("npi")).when(key % 7 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise((1900000000 + key).cast("string")).alias("npi"))
    known = tb("providers").where("id % 3 = 0")
    return s.entities_from_registry(asked.where("npi is not null"), known, reg).select("npi", "outcome", "name")


_LOOKUP = """
SELECT p.id, nullif(trim(p.npi_id), '') AS npi, CASE WHEN nullif(trim(p.npi_id), '') IS NOT NULL THEN r.npi IS NOT NULL END AS is_found,
  CASE WHEN r.npi IS NOT NULL THEN concat_ws(' ', r.first_name, r.last_name) END AS name, r.telephone_number AS phone, r.taxonomy_desc AS specialty,
  CASE WHEN r.npi IS NOT NULL THEN concat_ws(', ', r.address_1, r.city, r.state, r.postal_code) END AS address, r.license
FROM providers p LEFT JOIN registry r ON trim(p.npi_id) = r.npi"""


@query("registry_lookup", "providers registry", _LOOKUP)
def lookup(tb):
    return m.registry_lookup(tb("providers"), tb("registry"))


# All entities are persons of two name words here, so the oracle has those six strategies.
_CANDIDATES = r"""
words AS (SELECT id, city, state, search, string_split(search, ' ')[1] AS first, string_split(search, ' ')[-1] AS last,
    array_to_string(string_split(search, ' ')[2:], ' ') AS rest FROM (SELECT id, upper(city) AS city, upper(state) AS state,
    regexp_replace(upper(trim(regexp_replace(regexp_replace(regexp_replace(name, '\s*\([^)]+\)', '', 'g'), '\s*,\s*[A-Za-z]+\s*$', '', 'g'), '\s+', ' ', 'g'))), '[.\-'']', '', 'g') AS search FROM providers) n),
reg AS (SELECT npi, upper(first_name) AS f, upper(last_name) AS l, upper(city) AS c, upper(state) AS s, concat_ws(' ', first_name, middle_name, last_name) AS entry FROM registry),
ways AS (
  SELECT id, 1 AS rank, search, w.state AS state, npi, entry, s FROM words w JOIN reg ON f = first AND l = last AND c = w.city AND s = w.state
  UNION ALL SELECT id, 2, search, w.state, npi, entry, s FROM words w JOIN reg ON f = first AND l = rest AND c = w.city AND s = w.state
  UNION ALL SELECT id, 3, search, w.state, npi, entry, s FROM words w JOIN reg ON f = first AND l = last AND s = w.state
  UNION ALL SELECT id, 4, search, w.state, npi, entry, s FROM words w JOIN reg ON f = first AND l = rest AND s = w.state
  UNION ALL SELECT id, 5, search, w.state, npi, entry, s FROM words w JOIN reg ON f = first AND l = last
  UNION ALL SELECT id, 6, search, w.state, npi, entry, s FROM words w JOIN reg ON substr(f, 1, 2) = substr(first, 1, 2) AND l = last AND s = w.state),
five AS (SELECT * FROM ways QUALIFY row_number() OVER (PARTITION BY id, rank ORDER BY npi) <= 5),
scored AS (SELECT id, rank, npi, CAST(list_sum(list_transform(string_split(trim(regexp_replace(upper(search), '[^A-Z\s]', '', 'g')), ' '), lambda w: CASE
      WHEN list_contains(string_split(trim(regexp_replace(upper(entry), '[^A-Z\s]', '', 'g')), ' '), w) THEN 2
      WHEN len(list_filter(string_split(trim(regexp_replace(upper(entry), '[^A-Z\s]', '', 'g')), ' '), lambda e: starts_with(e, w) OR starts_with(w, e))) > 0 THEN 1 ELSE 0 END)) AS INT)
    + CASE WHEN state = s THEN 1 ELSE 0 END AS score, count(*) OVER (PARTITION BY id, rank) AS n FROM five)"""


def _with(tables: str, ctes: str, tail: str) -> tuple[str, str]:
    return tables, f"SELECT * FROM (WITH {ctes} {tail}) w"


@query("candidate_scoring", *_with("providers registry", _CANDIDATES, "SELECT id, rank, npi, score, n FROM scored"))
def candidates(tb):
    return m.registry_candidates(tb("providers"), tb("registry"))


_SEARCH = """SELECT id, rank, npi, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank) AS k FROM
  (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id, rank ORDER BY score DESC, npi) = 1) b WHERE score >= 3 OR n = 1) a WHERE k = 1"""


@query("registry_name_search", *_with("providers registry", _CANDIDATES, _SEARCH))
def name_search(tb):
    return m.registry_name_search(tb("providers"), tb("registry"))


_LISTING = r"""
asked AS (SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[(),]', ' ', 'g'), '\s+', ' ', 'g')) AS search FROM providers),
rows AS (SELECT pos, trim(lower(name)) AS entry FROM listing),
names AS (SELECT DISTINCT search, list_distinct(list_filter(string_split(search, ' '), lambda w: length(w) > 2 AND w NOT IN ('dr','md','do','pa','np','rn','mr','ms','mrs'))) AS words FROM asked),
entries AS (SELECT entry, min(pos) AS pos, list_distinct(list_filter(string_split(entry, ' '), lambda w: length(w) > 3 AND w NOT IN ('dr','md','do','pa','np','rn','mr','ms','mrs'))) AS words FROM rows GROUP BY entry),
tiers AS (SELECT id, 1 AS tier, pos FROM asked JOIN rows ON search = entry
  UNION ALL SELECT a.id, 2, e.pos FROM asked a JOIN names n ON a.search = n.search JOIN entries e ON len(n.words) >= 2 AND len(list_filter(n.words, lambda w: NOT contains(e.entry, w))) = 0
  UNION ALL SELECT a.id, 3, e.pos FROM asked a JOIN entries e ON len(e.words) >= 2 AND len(list_filter(e.words, lambda w: NOT contains(a.search, w))) = 0)"""


@query("listing_match", *_with("providers listing", _LISTING, "SELECT id, tier, pos FROM tiers QUALIFY row_number() OVER (PARTITION BY id ORDER BY tier, pos) = 1"))
def listing(tb):
    return m.listing_match(tb("providers"), tb("listing"))


_ASKED = "SELECT id, concat_ws(', ', {0}nullif(trim(address_line1), ''), nullif(trim(city), ''), nullif(trim(state), ''), nullif(trim(zip), '')) AS a FROM providers"


@query("address_reference_match", "providers registry", "SELECT id, CASE WHEN a = '' THEN 'EMPTY_ADDRESS' WHEN ref IS NULL THEN 'NO_RESULTS' END AS reason, ref AS ref_id, round(score, 6) AS score FROM "
  + nearest(_ASKED.format(""), "SELECT npi AS ref, concat_ws(', ', address_1, city, state, postal_code) AS b FROM registry") + " m")
def address_reference(tb):
    return m.address_reference_match(tb("providers"), tb("registry"))


_SEARCH_NAME = r"nullif(trim(regexp_replace(regexp_replace(name, '[(),]', ' ', 'g'), '\s+', ' ', 'g')), ''), "


@query("poi_match", "providers registry", "SELECT id, a <> '' AND ref IS NOT NULL AS is_found, CASE WHEN a = '' THEN 'EMPTY_QUERY' WHEN ref IS NULL THEN 'LOW_CONFIDENCE_OR_NO_RESULTS' END AS reason, ref AS poi_id, round(score, 6) AS score FROM "
  + nearest(_ASKED.format(_SEARCH_NAME), "SELECT npi AS ref, concat_ws(', ', last_name, address_1, city, state, postal_code) AS b FROM registry") + " m")
def pois(tb):
    places = tb("registry").select(F.col("npi").alias("poi_id"), F.col("last_name").alias("name"), "address_1", "city", "state", "postal_code")
    return m.poi_match(tb("providers"), places)


#: DuckDB: whether a text of ten digits is a valid identifier.
_VALID = r"""(regexp_matches({0}, '^[12]\d{{9}}$') AND (24 + list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i % 2 = 1 THEN 2 * CAST(substr({0}, CAST(i AS INT), 1) AS INT) // 10 + 2 * CAST(substr({0}, CAST(i AS INT), 1) AS INT) % 10 ELSE CAST(substr({0}, CAST(i AS INT), 1) AS INT) END))) % 10 = 0)"""
_LABELS = (r"(?i)NPI[\s:#]*(\d{10})", r"(?i)NPI\s*(?:Number|#|No\.?|ID)?[\s:]*(\d{10})", r"(?i)National\s+Provider\s+Identifier[\s:]*(\d{10})", r"(?i)npi_number[''\":\s]*(\d{10})", r"(?i)data-npi[''\"=\s]*(\d{10})")


def page_ids(table: str) -> str:
    """DuckDB: (page_id, ids) of a table (page_id, html): labelled identifiers, else those that stand alone and not by a date, else linked ones."""
    every = " || ".join(f"regexp_extract_all(html, '{p}', 1)" for p in _LABELS)
    valid = lambda x: f"list_filter({x}, lambda n: {_VALID.format('n')})"
    alone = r"""list_filter(regexp_extract_all(html, '\b(\d{10})\b', 1), lambda n: NOT starts_with(n, '0') AND NOT (regexp_matches(n, '^1[0-2]') AND regexp_matches(substr(html, greatest(1, CAST(position(n IN html) AS BIGINT) - 15), 30), '\d{2}/\d{2}/\d{4}')))"""
    linked = r"regexp_extract_all(html, '(?i)npi[/=](\d{10})', 1) || regexp_extract_all(html, '(?i)NPI\s*#?\s*(\d{10})', 1)"
    return f"""SELECT page_id, ids FROM (SELECT page_id, CASE WHEN len(l) > 0 THEN l WHEN len(a) > 0 THEN a ELSE k END AS ids FROM (SELECT page_id, {valid(every)} AS l, {valid(alone)} AS a, {valid(linked)} AS k FROM {table}) x) y WHERE len(ids) > 0"""


@query("lookup_cascade", "providers registry tier_pages", f"""SELECT * FROM (WITH {_CANDIDATES}, named AS ({_SEARCH}),
  paged AS (SELECT t.id, f.ids[1] AS npi FROM ({page_ids('tier_pages')}) f JOIN tier_pages t ON f.page_id = t.page_id QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY t.tier, t.page_id) = 1),
  best AS (SELECT p.id, p.name, coalesce(r.npi, n.npi, g.npi) AS npi, CASE WHEN r.npi IS NOT NULL THEN 'BY_ID' WHEN n.npi IS NOT NULL THEN 'BY_NAME' WHEN g.npi IS NOT NULL THEN 'BY_PAGE' ELSE 'NPI_NOT_FOUND' END AS how
    FROM providers p LEFT JOIN registry r ON trim(p.npi_id) = r.npi LEFT JOIN named n ON p.id = n.id LEFT JOIN paged g ON p.id = g.id)
  SELECT b.id, b.npi, b.how, r.npi IS NOT NULL AS verified, CASE WHEN r.npi IS NOT NULL THEN concat_ws(' ', r.first_name, r.last_name) WHEN b.npi IS NOT NULL THEN b.name END AS name, r.telephone_number AS phone, r.taxonomy_desc AS specialty,
    CASE WHEN r.npi IS NOT NULL THEN concat_ws(', ', r.address_1, r.city, r.state, r.postal_code) END AS address, r.license FROM best b LEFT JOIN registry r ON b.npi = r.npi) c""")
def cascade(tb):
    return m.lookup_cascade(tb("providers"), tb("registry"), tb("tier_pages"))


@query("page_search", "providers registry tier_pages", f"""
SELECT h.id, h.npi, r.npi IS NOT NULL AS verified, CASE WHEN r.npi IS NOT NULL THEN concat_ws(' ', r.first_name, r.last_name) ELSE p.name END AS name, r.telephone_number AS phone, r.taxonomy_desc AS specialty,
  CASE WHEN r.npi IS NOT NULL THEN concat_ws(', ', r.address_1, r.city, r.state, r.postal_code) END AS address, r.license, 'PAGE:' || CAST(h.tier AS VARCHAR) AS source
FROM (SELECT t.id, t.tier, f.ids[1] AS npi FROM ({page_ids('tier_pages')}) f JOIN tier_pages t ON f.page_id = t.page_id QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY t.tier, t.page_id) = 1) h
JOIN providers p ON h.id = p.id LEFT JOIN registry r ON h.npi = r.npi""")
def paged(tb):
    return m.page_search(tb("providers"), tb("tier_pages"), tb("registry"))


@query("verify_ids", "providers registry", """
SELECT p.id, coalesce(p.npi_id, '1234567893') AS npi, r.npi IS NOT NULL AS verified, CASE WHEN r.npi IS NOT NULL THEN concat_ws(' ', r.first_name, r.last_name) ELSE p.name END AS name, r.telephone_number AS phone, r.taxonomy_desc AS specialty,
  CASE WHEN r.npi IS NOT NULL THEN concat_ws(', ', r.address_1, r.city, r.state, r.postal_code) END AS address, r.license, 'LIST' AS source FROM providers p LEFT JOIN registry r ON coalesce(p.npi_id, '1234567893') = r.npi""")
def verified(tb):
    return m.verify_ids(tb("providers").select("id", F.coalesce("npi_id", F.lit("1234567893")).alias("npi"), "name", F.lit("LIST").alias("source")), tb("registry"))


def entries(tb):
    """Registry rows as nested entries: a mailing address first, every fifth without a location; a secondary taxonomy first, every fourth without a primary one."""
    r = tb("registry").withColumn("k", F.substring("npi", 1, 9).cast("long") - 100000000)
    kept = lambda c, when: F.when(when, c)
    address = lambda purpose, street, phone: F.struct(F.lit(purpose).alias("address_purpose"), street.alias("address_1"), F.col("city"), F.col("state"), F.col("postal_code"), phone.alias("telephone_number"))
    taxonomy = lambda code, desc, primary, license: F.struct(F.lit(code).alias("code"), desc.alias("desc"), F.lit(primary).alias("primary"), license.alias("license"), F.col("state"))
    org = F.col("k") % 6 == 0
    basic = F.struct(*[kept(F.col(c), ~org).alias(c) for c in ("first_name", "middle_name", "last_name")], kept(F.concat(F.lit("Clinic "), F.col("last_name")), org | (F.col("k") % 12 == 1)).alias("organization_name"))
    addresses = F.array_compact(F.array(address("MAILING", F.lit("PO Box 1"), F.lit("000")), kept(address("LOCATION", F.col("address_1"), F.col("telephone_number")), F.col("k") % 5 != 0)))
    taxonomies = F.array_compact(F.array(taxonomy("207X", kept(F.lit("Assistant"), F.col("k") % 3 != 0), False, F.lit(None).cast("string")), kept(taxonomy("163W", F.col("taxonomy_desc"), True, F.col("license")), F.col("k") % 4 != 0)))
    return r.select(F.col("npi").alias("number"), basic.alias("basic"), addresses.alias("addresses"), taxonomies.alias("taxonomies"))


_K = "CAST(substr(npi, 1, 9) AS BIGINT) - 100000000"
_ENTRY = """
SELECT npi, CASE WHEN k % 6 <> 0 THEN first_name END AS first_name, CASE WHEN k % 6 <> 0 THEN middle_name END AS middle_name, CASE WHEN k % 6 <> 0 THEN last_name END AS last_name, CASE WHEN k % 6 = 0 OR k % 12 = 1 THEN 'Clinic ' || last_name END AS organization_name,
  CASE WHEN k % 5 <> 0 THEN telephone_number ELSE '000' END AS telephone_number, CASE WHEN k % 5 <> 0 THEN address_1 ELSE 'PO Box 1' END AS address_1, city, state, postal_code,
  CASE WHEN {0} THEN taxonomy_desc WHEN k % 3 <> 0 THEN 'Assistant' END AS taxonomy_desc, CASE WHEN {0} THEN license END AS license, CASE WHEN {0} THEN '163W' ELSE '207X' END AS taxonomy_code, state AS license_state FROM (SELECT *, """ + _K + " AS k FROM registry) r"


@query("registry_entries_primary", "registry", _ENTRY.format("k % 4 <> 0"))
def primary_rows(tb):
    return s.registry_from_entries(entries(tb))


@query("registry_entries_first", "registry", _ENTRY.format("FALSE"))
def first_rows(tb):
    return s.registry_from_entries(entries(tb), primary=False)


@query("registry_entity_rows", "registry", f"""
SELECT npi, coalesce(CASE WHEN first_name IS NOT NULL THEN first_name || coalesce(' ' || middle_name, '') || ' ' || last_name END, organization_name, 'Unknown Provider') AS name,
  CASE WHEN length(d) = 10 THEN substr(d, 1, 3) || '-' || substr(d, 4, 3) || '-' || substr(d, 7, 4) ELSE telephone_number END AS phone, coalesce(taxonomy_desc, 'General Practice') AS speciality, license AS license_number, license_state, 'Active' AS license_status,
  address_1 AS address_line1, city, state, postal_code AS zip FROM (SELECT *, coalesce(regexp_replace(telephone_number, '[^0-9]', '', 'g'), '') AS d FROM ({_ENTRY.format('k % 4 <> 0')}) e) x""")
def entity_rows(tb):
    return s.registry_rows(s.registry_from_entries(entries(tb)))


@query("certifications", "registry", f"""
SELECT npi, CASE WHEN k % 4 <> 0 THEN taxonomy_desc WHEN k % 3 <> 0 THEN 'Assistant' END AS specialty,
  concat_ws('|', CASE WHEN k % 3 <> 0 THEN 'Assistant/207X/false/' END, CASE WHEN k % 4 <> 0 THEN taxonomy_desc || '/163W/true/' || license END) AS certifications FROM (SELECT *, {_K} AS k FROM registry) r""")
def certified(tb):
    text = lambda c: F.concat_ws("/", c["name"], c["code"], c["is_primary"].cast("string"), F.coalesce(c["license"], F.lit("")))
    return s.certifications(entries(tb)).select("npi", "specialty", F.array_join(F.transform("certifications", text), "|").alias("certifications"))


@query("source_pivot", "provider_sources", """
SELECT provider_id, min_by(phone, source_id) FILTER (source_type = 'NPI_API' AND phone IS NOT NULL) AS "NPI_API_phone", min_by(website, source_id) FILTER (source_type = 'NPI_API' AND website IS NOT NULL) AS "NPI_API_website",
  min_by(phone, source_id) FILTER (source_type = 'AZURE_POI') AS "AZURE_POI_phone", min_by(website, source_id) FILTER (source_type = 'AZURE_POI') AS "AZURE_POI_website",
  min_by(phone, source_id) FILTER (source_type = 'SCRAPING_ENRICHMENT') AS "SCRAPING_ENRICHMENT_phone", min_by(website, source_id) FILTER (source_type = 'SCRAPING_ENRICHMENT') AS "SCRAPING_ENRICHMENT_website"
FROM provider_sources WHERE is_found GROUP BY provider_id""")
def pivot(tb):
    return m.source_pivot(tb("provider_sources"))


@query("contact_resolution", "providers provider_sources", """
SELECT p.id, coalesce(nullif(p.email, ''), s.email) AS contact FROM providers p LEFT JOIN (SELECT provider_id, arg_min(email, source_id) AS email FROM provider_sources
  WHERE email <> '' AND source_type IN ('AZURE_POI', 'SCRAPING_ENRICHMENT') GROUP BY 1) s ON p.id = s.provider_id""")
def contact(tb):
    return m.contact_resolution(tb("providers"), tb("provider_sources"))


@query("latest_issue_value", "validation_issues", """
SELECT provider_id, field_name, value FROM (SELECT provider_id, field_name, suggested_value AS value, row_number() OVER (PARTITION BY provider_id, field_name ORDER BY id DESC) AS k
  FROM validation_issues WHERE field_name IN ('certification', 'appointment_availability', 'availability_status')) x WHERE k = 1""")
def latest(tb):
    return m.latest_values(tb("validation_issues"), ("certification", "appointment_availability", "availability_status"))


@query("preferred_issue_value", "validation_issues", """
SELECT provider_id, lower(field_name) AS field, suggested_value AS value, status FROM validation_issues
QUALIFY row_number() OVER (PARTITION BY provider_id, lower(field_name) ORDER BY CASE WHEN status LIKE 'ACCEPTED%' THEN 0 ELSE 1 END, id) = 1""")
def preferred(tb):
    return m.preferred_values(tb("validation_issues"))
