"""Queries of extraction from pages and OCR texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlane.operators import extract as x
from rosterlane.operators.elements import attribute, element_tree, text_of

from .match_queries import page_ids
from .registry import query


@query("ids_from_pages", "id_pages", f"SELECT page_id, array_to_string(ids, ',') AS ids FROM (SELECT page_id, list_distinct(ids) AS ids FROM ({page_ids('id_pages')}) p) q")
def ids(t):
    return x.ids_from_pages(t("id_pages")).select("page_id", F.array_join("ids", ",").alias("ids"))


_BLOCKS = r"SELECT doc_id, k - 1 AS block, trim(parts[k], E' \n') AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '(?im)(?:^|\n)(?:\d+\.|PROVIDER|---+)') AS parts FROM ocr_text) a) b WHERE trim(parts[k], E' \n') <> ''"


@query("ocr_blocks", "ocr_text", _BLOCKS.replace("k - 1 AS block", "CAST(k - 1 AS INT) AS block"))
def blocks(t):
    return x.ocr_blocks(t("ocr_text")).select("doc_id", "block", F.regexp_replace(F.regexp_replace("text", r"^[ \n]+", ""), r"[ \n]+\z", "").alias("text"))


def _got(pattern: str, text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', 1), '')"


_KEYWORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in ("physician", "surgeon", "dentist", "nurse", "therapist", "center", "clinic", "hospital", "podiatrist", "dermatology", "cardiology"))
_OCR_PHONE = r"(?i)(?:Phone|TEL|Ph)[:\s]*(\(?[\d\s\-\.\)]{10,14})"
_PLAIN = rf"length(text) > 5 AND NOT regexp_matches(text, '^\d') AND NOT regexp_matches(text, '{_OCR_PHONE}') AND NOT regexp_matches(text, '[A-Z]{{2}}\s*\d{{5}}') AND NOT regexp_matches(text, '^[A-Z\s]+[:\s]')"
_OCR_LINES = f"""SELECT doc_id, block, k, trim(lines[k]) AS text FROM (SELECT doc_id, block, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, block, string_split(text, chr(10)) AS lines FROM ({_BLOCKS}) b) c) d WHERE trim(lines[k]) <> ''"""
_OCR_TOLD = rf"""SELECT doc_id, block, k,
  coalesce(regexp_replace(trim({_got(r'(?i)(?:Name|PROVIDER|Provider Name)[:\s]*(.+)')}), '^[A-Za-z\s:]+:\s*', ''), CASE WHEN {_PLAIN} THEN trim(substr(text, 1, 100)) END) AS name,
  {_got(r'(?i)NPI[:\s]*(\d{10})')} AS npi, regexp_replace({_got(_OCR_PHONE)}, '[\s()]', '', 'g') AS phone, {_got(r'(?i)License[:\s]*([A-Z0-9\-]+)')} AS license_number,
  coalesce(trim({_got(r'(?i)(?:Address|Address Line)[:\s]*(.+)')}), CASE WHEN regexp_matches(text, '(?i)\d+\s+\w+\s+(st|ave|blvd|road|drive|lane|court|street)') THEN substr(text, 1, 100) END) AS address_line1,
  trim({_got(r'(?i)(?:City)[:\s]*(.+)')}) AS city, coalesce({_got(r'(?i)(?:State|ST)[:\s]*([A-Z]{2})')}, CASE WHEN NOT regexp_matches(text, '(?i)State[:\s]') THEN {_got(r'\b([A-Z]{2})\b')} END) AS state,
  coalesce(regexp_replace({_got(r'(?i)(?:Zip|ZIP|Zip Code)[:\s]*(\d{5}(?:[-\s]?\d{4})?)')}, '[\s-]', '', 'g'), CASE WHEN NOT regexp_matches(text, '(?i)Zip[:\s]') THEN {_got(r'\b(\d{5})(?:[-\s]?\d{4})?\b')} END) AS zip,
  coalesce(trim({_got(r'(?i)(?:Specialty|Specialization|Speciality)[:\s]*(.+)')}), CASE WHEN {_KEYWORDS} THEN trim(substr(text, 1, 100)) END) AS speciality FROM ({_OCR_LINES}) l"""
_OCR_FIRST, _OCR_LAST = ("name", "address_line1", "city", "state", "zip", "speciality"), ("npi", "phone", "license_number")


@query("ocr_fields", "ocr_text", "SELECT * FROM (SELECT doc_id, CAST(block AS INT) AS block, " + ", ".join([f"arg_min({c}, k) FILTER ({c} IS NOT NULL) AS {c}" for c in _OCR_FIRST] + [f"arg_max({c}, k) FILTER ({c} IS NOT NULL) AS {c}" for c in _OCR_LAST]) + f" FROM ({_OCR_TOLD}) t GROUP BY 1, 2) f WHERE length(trim(name)) > 2")
def fields(t):
    """No text of the table has a line "City, ST" without a label; a test of its own covers it."""
    return x.ocr_fields(x.ocr_blocks(t("ocr_text")))


@query("ocr_lookahead", "ocr_text", rf"""
SELECT doc_id, CAST(line AS INT) AS line, trim(substr(text, 1, 100)) AS name, npi, phone, zip, state, address_line1 FROM (
  SELECT doc_id, line, text, last_value(npi IGNORE NULLS) OVER w AS npi, last_value(phone IGNORE NULLS) OVER w AS phone, first_value(zip IGNORE NULLS) OVER w AS zip, first_value(state IGNORE NULLS) OVER w AS state, first_value(address IGNORE NULLS) OVER w AS address_line1 FROM (
    SELECT doc_id, line, text, {_got(r'(?i)NPI[:\s]*(\d{10})')} AS npi, regexp_replace({_got(_OCR_PHONE)}, '[\s()]', '', 'g') AS phone, {_got(r'\b(\d{5})(?:[-\s]?\d{4})?\b')} AS zip, {_got(r'\b([A-Z]{2})\b')} AS state,
      CASE WHEN regexp_matches(text, '(?i)\d+\s+\w+\s+(st|ave|blvd|road|drive|lane|court|street)') THEN substr(text, 1, 100) END AS address
    FROM (SELECT doc_id, k - 1 AS line, lines[k] AS text FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM ocr_text) a) b) c) d
  WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)) e
WHERE length(text) >= 5 AND NOT regexp_matches(text, '(?i)^(page|address|city|state|zip|phone|fax|npi|license|id|\d+)$')""")
def lookahead(t):
    lines = t("ocr_text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return x.ocr_lookahead(lines)


_DAYS = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"


_ENTRY = r"'^([^:]+):\s*(.+?)(?:\s*[-–]\s*(.+))?$'"
_NUMBER = "list_position(list_transform({0}, lambda d: lower(substr(d, 1, 3))), CASE WHEN lower(trim({1})) IN (SELECT unnest(list_transform({0}, lambda d: lower(d)) || list_transform({0}, lambda d: lower(substr(d, 1, 3))))) THEN substr(lower(trim({1})), 1, 3) END)"


@query("office_hours", "office_hours", f"""
SELECT id, {_DAYS}[d] AS day, CASE WHEN until <> '' THEN start || ' - ' || until ELSE start END AS slot, CASE WHEN contains(lower(start), 'closed') THEN 'CLOSED' WHEN contains(lower(start), 'by appointment') THEN 'BY_APPOINTMENT' ELSE 'OPEN' END AS status FROM (
  SELECT id, start, until, unnest(range(low, high + 1)) AS d FROM (SELECT id, start, until, {_NUMBER.format(_DAYS, 'ends[1]')} AS low, {_NUMBER.format(_DAYS, 'ends[-1]')} AS high FROM (
    SELECT id, regexp_split_to_array(regexp_extract(raw, {_ENTRY}, 1), '[-–]') AS ends, regexp_extract(raw, {_ENTRY}, 2) AS start, regexp_extract(raw, {_ENTRY}, 3) AS until FROM (
      SELECT id, trim(unnest(regexp_split_to_array(hours, '[\\n;,]'))) AS raw FROM office_hours) a WHERE raw <> '') b) c WHERE low <= high) e""")
def hours(t):
    return x.office_hours(t("office_hours")).select("id", "day", "slot", "status")


@query("listing_merge", "provider_sources", """
SELECT provider_id, arg_min(phone, source_id) FILTER (phone IS NOT NULL) AS phone, arg_min(address, source_id) FILTER (address IS NOT NULL) AS address, arg_min(website, source_id) FILTER (website IS NOT NULL) AS website
FROM provider_sources WHERE is_found GROUP BY 1""")
def merged(t):
    return x.merge_listings(t("provider_sources"))


@query("profile_links", "", """
SELECT page_id, CASE WHEN starts_with(link, 'http') THEN link ELSE 'https://site.example.com' || link END AS link FROM (SELECT page_id, list_filter(regexp_extract_all(html, '(?i)href="([^"]*)"', 1), lambda h: contains(h, '/'))[1] AS link FROM pages) p WHERE link IS NOT NULL""")
def links(t):
    return x.profile_links(t("pages"))


def _elements(tag: str, rank: int, source: str, table: str = "hour_pages") -> str:
    """DuckDB: (page_id, rank, source, k, text) of a page's elements, without their tags."""
    return f"SELECT page_id, {rank} AS rank, '{source}' AS source, k, trim(regexp_replace(regexp_replace(found[k], '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM (SELECT page_id, found, unnest(range(1, len(found) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1) AS found FROM {table}) a) b"


_DAY = "CASE " + " ".join(f"WHEN contains(lower({{0}}), '{d.lower()}') THEN '{d}'" for d in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")) + " END"
_SLOTS = r"array_to_string(regexp_extract_all(text, '\d{1,2}:\d{2}\s*(?:am|pm|AM|PM)?'), ',')"
_STATUS = r"CASE WHEN contains(lower(text), 'closed') THEN 'CLOSED' WHEN contains(lower(text), 'by appointment') OR contains(lower(text), 'appointment only') THEN 'BY_APPOINTMENT' WHEN contains(lower(text), 'open') OR regexp_matches(text, '\d{1,2}:\d{2}') THEN 'OPEN' END"
_NAMED_DAY = "Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday"
_DEFINED = r"<dt>([^<]*)</dt>\s*<dd>([^<]*)</dd>"


def _pairs(table: str, pattern: str, rank: int, source: str) -> str:
    """DuckDB: (page_id, rank, source, k, term, text) of a pattern's two groups."""
    found = [f"regexp_extract_all(html, '{pattern}', {group})" for group in (1, 2)]
    return f"SELECT page_id, {rank} AS rank, '{source}' AS source, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS term, unnest(b) AS text FROM (SELECT page_id, {found[0]} AS a, {found[1]} AS b FROM {table}) p"


@query("timings_from_pages", "hour_pages", rf"""
SELECT page_id, day, slots, status, raw_text, source FROM (
  SELECT page_id, rank, k, coalesce({_DAY.format("coalesce(term, text)")}, term) AS day, {_SLOTS} AS slots, {_STATUS} AS status, CASE WHEN term IS NULL THEN text ELSE term || ': ' || text END AS raw_text, source FROM (
    SELECT page_id, 0 AS rank, 'selector' AS source, unnest(range(1, len(a) + 1)) AS k, NULL AS term, unnest(a) AS text FROM (SELECT page_id, regexp_extract_all(html, '<(?:div|p) (?:class|id)="[^"]*hours[^"]*">([^<]*)<', 1) AS a FROM hour_pages) p
    UNION ALL SELECT * FROM ({_pairs("hour_pages", "<tr[^>]*><t[dh]>([^<]*)</t[dh]><t[dh]>([^<]*)</t[dh]>", 100, "table")}) t WHERE regexp_matches(term, '(?i)Mon|Tue|Wed|Thu|Fri|Sat|Sun') OR regexp_matches(text, '(?i)\d{{1,2}}:\d{{2}}|am|pm|closed')
    UNION ALL {_pairs("hour_pages", _DEFINED, 200, "definition-list")}
    UNION ALL SELECT page_id, rank, source, k, NULL, text FROM ({_elements('li', 300, 'list')}) l WHERE regexp_matches(text, '(?i){_NAMED_DAY}') OR regexp_matches(text, '\d{{1,2}}:\d{{2}}')
    UNION ALL SELECT page_id, rank, source, k, NULL, text FROM ({_elements('div', 400, 'div')}) d WHERE length(text) BETWEEN 11 AND 149 AND regexp_matches(text, '(?i)^(?:{_NAMED_DAY})') AND regexp_matches(text, '\d{{1,2}}:\d{{2}}')) e) f
WHERE day IS NOT NULL OR slots <> '' QUALIFY row_number() OVER (PARTITION BY page_id, day, slots, status ORDER BY rank, k) = 1""")
def timings(t):
    return x.timings_from_pages(t("hour_pages"))


def _tree(table: str) -> str:
    """DuckDB: CTEs up to e (page_id, pos, last, parent, tag, class, text), the elements of a table's pages whose tags are all closed, found by counting depth."""
    return rf"""
e_tokens AS (SELECT page_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS token FROM (SELECT page_id, regexp_extract_all(html, '<[^>]+>|[^<]+') AS x FROM {table}) p),
e_depth AS (SELECT *, starts_with(token, '</') AS ends, starts_with(token, '<') AND NOT starts_with(token, '</') AS opens, sum(CASE WHEN starts_with(token, '</') THEN -1 WHEN starts_with(token, '<') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS depth FROM e_tokens),
e_open AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos FROM e_depth WHERE opens),
e_range AS (SELECT o.page_id, o.pos, o.k, o.depth, o.token, min(c.k) AS until FROM e_open o JOIN e_depth c ON o.page_id = c.page_id AND c.ends AND c.k > o.k AND c.depth = o.depth - 1 GROUP BY ALL),
e AS (SELECT r.page_id, r.pos, r.pos + (SELECT count(*) FROM e_open i WHERE i.page_id = r.page_id AND i.k > r.k AND i.k < r.until) AS last, (SELECT max(i.pos) FROM e_open i WHERE i.page_id = r.page_id AND i.k < r.k AND i.depth = r.depth - 1) AS parent,
  regexp_extract(r.token, '^<([a-z]+)', 1) AS tag, regexp_replace(regexp_extract(r.token, 'class=("[^"]*"|''[^'']*''|[^\s>]+)', 1), '["'']', '', 'g') AS class,
  trim(coalesce((SELECT string_agg(t.token, '' ORDER BY t.k) FROM e_depth t WHERE t.page_id = r.page_id AND t.k > r.k AND t.k < r.until AND NOT t.opens AND NOT t.ends), '')) AS text FROM e_range r)"""


@query("page_elements", "nested_pages", f"SELECT * FROM (WITH {_tree('nested_pages')} SELECT page_id, CAST(pos AS INT) AS pos, CAST(last AS INT) AS last, CAST(coalesce(parent, -1) AS INT) AS parent, tag, class, text FROM e) w")
def elements(t):
    one = F.transform("elements", lambda e: F.struct(e["at"].alias("pos"), e["last"].alias("last"), e["parent"].alias("parent"), e["tag"].alias("tag"), attribute(e, "class").alias("class"), text_of(e).alias("text")))
    return element_tree(t("nested_pages")).select("page_id", F.explode(one).alias("e")).select("page_id", "e.*")


@query("nested_timings", "nested_pages", rf"""
SELECT page_id, day, slots, status, raw_text, source FROM (SELECT page_id, rank, k, l, coalesce({_DAY.format("coalesce(term, text)")}, term) AS day, {_SLOTS} AS slots, {_STATUS} AS status, CASE WHEN term IS NULL THEN text ELSE term || ': ' || text END AS raw_text, source FROM (WITH {_tree('nested_pages')},
  cells AS (SELECT b.page_id, b.pos AS k, r.pos AS l, c.text, row_number() OVER (PARTITION BY b.page_id, b.pos, r.pos ORDER BY c.pos) AS n FROM e b JOIN e r ON b.page_id = r.page_id AND b.tag = 'table' AND r.tag = 'tr' AND r.pos > b.pos AND r.pos <= b.last AND regexp_matches(lower(b.text), 'hour|day|appointment|availability')
    JOIN e c ON r.page_id = c.page_id AND c.tag IN ('td', 'th') AND c.pos > r.pos AND c.pos <= r.last)
  SELECT page_id, CASE WHEN class = 'office-hours' THEN 0 ELSE 9 END AS rank, 'selector' AS source, pos AS k, 0 AS l, NULL AS term, text FROM e WHERE contains(class, 'hours') AND length(text) BETWEEN 6 AND 999
  UNION ALL SELECT page_id, 100, 'table', k, l, max(text) FILTER (n = 1) AS term, max(text) FILTER (n = 2) AS text FROM cells GROUP BY page_id, k, l HAVING term <> '' AND text <> '' AND (regexp_matches(term, '(?i)Mon|Tue|Wed|Thu|Fri|Sat|Sun') OR regexp_matches(text, '(?i)\d{{1,2}}:\d{{2}}|am|pm|closed'))
  UNION ALL SELECT d.page_id, 200, 'definition-list', d.pos, a.pos, a.text, b.text FROM e d JOIN e a ON d.page_id = a.page_id AND a.parent = d.pos AND a.tag = 'dt' AND d.tag = 'dl' AND regexp_matches(lower(d.text), 'hour|day') JOIN e b ON b.page_id = a.page_id AND b.parent = d.pos AND b.tag = 'dd' AND b.pos = a.last + 1
  UNION ALL SELECT page_id, 300, 'list', pos, 0, NULL, text FROM e WHERE tag = 'li' AND length(text) < 200 AND (regexp_matches(text, '(?i){_NAMED_DAY}') OR regexp_matches(text, '\d{{1,2}}:\d{{2}}'))
  UNION ALL SELECT page_id, 400, 'div', pos, 0, NULL, text FROM e WHERE tag = 'div' AND length(text) BETWEEN 11 AND 149 AND regexp_matches(text, '(?i)^(?:{_NAMED_DAY})') AND regexp_matches(text, '\d{{1,2}}:\d{{2}}')) u) v
WHERE day IS NOT NULL OR slots <> '' QUALIFY row_number() OVER (PARTITION BY page_id, day, slots, status ORDER BY rank, k, l) = 1""")
def nested(t):
    return x.timings_from_pages(t("nested_pages"))


@query("affiliations_from_pages", "hour_pages", f"""
SELECT page_id, text AS name FROM ({_elements('li', 0, 'list')}) e WHERE length(text) BETWEEN 3 AND 99 AND regexp_matches(lower(text), 'hospital|medical cent|clinic|affiliat|facility') QUALIFY row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY k) = 1""")
def affiliated(t):
    return x.affiliations(t("hour_pages"))


@query("affiliations_union", "providers", """
SELECT provider_id, name, role, status, kind FROM (SELECT id AS provider_id, 'Hospital ' || CAST(id % 4 AS VARCHAR) AS name, 'Physician' AS role, 'ACTIVE' AS status, 'HOSPITAL' AS kind FROM providers
  UNION ALL SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE 'Hospital ' || CAST(id % 5 AS VARCHAR) END, 'Unknown Hospital'), 'Surgeon', 'ACTIVE', 'HOSPITAL' FROM providers WHERE id % 3 = 0 OR id % 4 <> id % 5) u""")
def union(t):
    p = t("providers")
    found = p.select(F.col("id").alias("provider_id"), F.concat(F.lit("Hospital "), (F.col("id") % 4).cast("string")).alias("name"), F.lit(None).cast("string").alias("role"), F.lit("").alias("status"), F.lit(None).cast("string").alias("kind"))
    stored = p.select(F.col("id").alias("provider_id"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("HOSPITAL "), (F.col("id") % 5).cast("string"))).alias("name"), F.lit("Surgeon").alias("role"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("kind"))
    return x.merge_affiliations(found, stored).withColumn("name", F.regexp_replace("name", "HOSPITAL", "Hospital"))


_HOSPITAL = r"""coalesce(nullif(trim(regexp_extract(text, '([A-Z][a-zA-Z\s&''-]+(?:Hospital|Medical Center|Health System|Clinic|Healthcare|Medical Group))', 1)), ''), nullif(trim(regexp_extract(text, '([A-Z][a-zA-Z\s&''-]{5,}(?:Hospital|Medical|Clinic|Health))', 1)), ''),
  CASE WHEN (contains(lower(text), 'hospital') OR contains(lower(text), 'medical center')) AND length(text) < 100 THEN trim(text) END)"""
_AT = r"CASE WHEN regexp_matches(text, '([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z]{2})') THEN regexp_extract(text, '([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z]{2})', 1) || ', ' || regexp_extract(text, '([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z]{2})', 2) END"


@query("hospital_names", "hospital_texts", f"SELECT id, {_HOSPITAL} AS name, {_AT} AS place FROM hospital_texts")
def hospitals(t):
    return t("hospital_texts").select("id", x.hospital_name(F.col("text")).alias("name"), x.place_of(F.col("text")).alias("place"))


def _marked(sources: str, rank: int, pattern: str) -> str:
    """DuckDB: (provider_id, source, city, state, rank, text) of a pattern's first group on the pages of some sources."""
    return f"SELECT provider_id, source, city, state, {rank} AS rank, unnest(regexp_extract_all(html, '{pattern}', 1)) AS text FROM source_pages WHERE source IN ({sources})"


@query("source_affiliations", "source_pages", f"""
SELECT provider_id, name, location, 'Physician' AS role, 'ACTIVE' AS status, 'HOSPITAL' AS kind, source FROM (SELECT provider_id, source, rank, {_HOSPITAL} AS name, coalesce({_AT}, city || ', ' || state) AS location FROM (
  {_marked("'HEALTHGRADES', 'VITALS', 'WEBMD'", 1, '<div class="main-hospital">([^<]*)<')} UNION ALL {_marked("'VITALS', 'WEBMD'", 2, '<span class="facility">([^<]*)<')}
  UNION ALL {_marked("'WEBMD'", 3, '<p class="location">([^<]*)<')} UNION ALL {_marked("'HEALTHGRADES'", 100, '<li>([^<]*Medical Center)<')}) m) n
WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provider_id, lower(trim(name)) ORDER BY source, rank, name, location) = 1""")
def affiliations_of_sources(t):
    """The sources' order is that of their names."""
    return x.source_affiliations(t("source_pages"))


@query("source_profiles", "source_pages", """
SELECT page_id, source, CASE WHEN starts_with(link, 'http') THEN link ELSE site || link END AS profile_url FROM (SELECT page_id, source, site, list_filter(links, lambda h: contains(h, path))[1] AS link FROM (
  SELECT page_id, source, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS links, CASE source WHEN 'HEALTHGRADES' THEN '/physician/' WHEN 'VITALS' THEN '/doctors/' WHEN 'WEBMD' THEN '/doctor/' ELSE '/pub/' END AS path,
    CASE source WHEN 'HEALTHGRADES' THEN 'https://www.healthgrades.com' WHEN 'VITALS' THEN 'https://www.vitals.com' WHEN 'WEBMD' THEN 'https://doctor.webmd.com' ELSE 'https://www.doximity.com' END AS site FROM source_pages) a) b
WHERE link IS NOT NULL AND NOT (source = 'DOXIMITY' AND contains(link, '/search'))""")
def profiles(t):
    return x.source_profiles(t("source_pages"))


@query("definition_timings", "listing_pages", f"""
SELECT page_id, coalesce({_DAY.format("term")}, term) AS day, {_SLOTS} AS slots, {_STATUS} AS status, term || ': ' || text AS raw_text FROM ({_pairs("listing_pages", _DEFINED, 200, "definition-list")}) d""")
def defined(t):
    return x.definition_timings(t("listing_pages")).drop("place")


_LINED = r"trim(regexp_replace(regexp_replace(regexp_replace(c, '(?i)<br[^>]*>|</(?:div|p|li|dd|dt)>', chr(10), 'g'), '<[^>]+>', '', 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), E' \n\t')"
_CELLS = f"list_transform(regexp_extract_all(r, '(?is)<td[^>]*>(.*?)</td>', 1), lambda c: {_LINED})"
_SAID = r"nullif(trim(regexp_extract(c[3], '(?i){0}:\s*([^\n]+)', 1)), '') AS {1}"


@query("listing_rows", "listing_pages", rf"""
SELECT page_id, c[1] AS name, c[2] AS specialty, {_SAID.format("License Number", "license_number")}, {_SAID.format("State", "license_state")}, {_SAID.format("Status", "license_status")}, c[4] AS affiliations, c[5] AS hours, contains(lower(c[6]), 'yes') AS accepting_new_patients, contains(lower(c[7]), 'yes') AS telehealth,
  nullif(regexp_extract(coalesce(c[8], ''), '\(?\d{{3}}\)?[\s.-]?\d{{3}}[\s.-]?\d{{4}}'), '') AS phone, nullif(trim(regexp_extract(coalesce(c[8], ''), '(?i)Address:\s*(.+?)(?:\n|$)', 1)), '') AS address
FROM (SELECT page_id, {_CELLS} AS c FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS r FROM listing_pages) a) b WHERE len(c) >= 7 AND c[1] <> '' AND NOT contains(lower(c[1]), 'provider')""")
def listed(t):
    return x.listing_rows(t("listing_pages")).drop("row")


@query("merge_timings", "listing_hours", """
SELECT provider_id AS id, day, slot AS slots, coalesce(status, 'OPEN') AS status, CASE WHEN day = 'Monday' AND provider_id % 2 = 0 THEN 'PROFILE' ELSE 'LISTING' END AS scraped_from FROM listing_hours""")
def merged_timings(t):
    rows = t("listing_hours").select(F.col("provider_id").alias("id"), F.lit("LISTING").alias("source"), "day", F.col("slot").alias("slots"), F.coalesce("status", F.lit("OPEN")).alias("status"))
    again = rows.where("day = 'Monday' and id % 2 = 0").withColumn("source", F.lit("PROFILE"))
    ranks = rows.sparkSession.createDataFrame([("PROFILE", 1), ("LISTING", 2)], "source string, rank int")
    return x.merge_timings(rows.unionByName(again), ranks)


@query("availability_status", "listing_hours", """
SELECT id, CASE WHEN slots AND id % 2 = 0 THEN 'ACCEPTING_APPOINTMENTS' WHEN slots THEN 'LIMITED_AVAILABILITY' WHEN id % 2 = 0 THEN 'ACCEPTING_NEW_PATIENTS' ELSE 'NO_INFO' END AS availability_status
FROM (SELECT c_custkey AS id, c_custkey IN (SELECT provider_id FROM listing_hours WHERE slot <> '') AS slots FROM customer) c""")
def available(t):
    flags = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 == 0).alias("accepting"))
    return x.availability_of(t("listing_hours").select(F.col("provider_id").alias("id"), F.col("slot").alias("slots")), flags)


@query("url_frontier", "providers", """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS INT) AS place, url FROM (
  SELECT id, 1 AS k, 'https://npiregistry.cms.hhs.gov/provider-view/' || npi_id AS url FROM providers WHERE npi_id <> ''
  UNION ALL SELECT id, 2, 'https://www.healthgrades.com/search?what=' || url_encode(name) || '&where=&pageNum=1' FROM providers UNION ALL SELECT id, 3, 'https://doctor.webmd.com/find-a-doctor/search?q=' || url_encode(name) FROM providers
  UNION ALL SELECT id, 4, 'https://www.vitals.com/search?q=' || url_encode(name) FROM providers
  UNION ALL SELECT id, 5, 'https://www.zocdoc.com/search/?dr_specialty=&address=' || url_encode(city) || '&insurance_carrier=-1&searchQueryGuid=&search_query=' || url_encode(name) FROM providers
  UNION ALL SELECT id, 6, CASE state WHEN 'CA' THEN 'https://search.dca.ca.gov/' ELSE 'https://www.nysed.gov/online-verifications-professional-licenses' END FROM providers WHERE state IN ('CA', 'NY')) u""")
def frontier(t):
    """Names here hold letters, digits, blanks, commas and parentheses, which both ways encode alike."""
    return x.url_frontier(t("providers"))
