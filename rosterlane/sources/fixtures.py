"""Derived tables for queries and tests, as SQL that Spark and DuckDB both run with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

#: Name: (tables it needs, SQL).
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "providers": (
        (),
        r"""
SELECT k AS id,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CONCAT(CAST(n AS VARCHAR(20)), CAST((10 - (24
    + CASE WHEN d0 > 4 THEN 2*d0-9 ELSE 2*d0 END + CASE WHEN d2 > 4 THEN 2*d2-9 ELSE 2*d2 END
    + CASE WHEN d4 > 4 THEN 2*d4-9 ELSE 2*d4 END + CASE WHEN d6 > 4 THEN 2*d6-9 ELSE 2*d6 END
    + CASE WHEN d8 > 4 THEN 2*d8-9 ELSE 2*d8 END + d1 + d3 + d5 + d7) % 10) % 10 AS VARCHAR(20))) END AS npi_id,
  CONCAT('Given', CAST(k % 37 AS VARCHAR(20)), ' Family', CAST(k % 101 AS VARCHAR(20)),
    CASE WHEN k % 5 = 0 THEN ' (RDHAP, BS)' WHEN k % 5 = 1 THEN ', MD' ELSE '' END) AS name,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN '555-12'
    ELSE CONCAT('(', CAST(200 + k % 700 AS VARCHAR(20)), ') 555-', CAST(1000 + k % 9000 AS VARCHAR(20))) END AS phone,
  CASE WHEN k % 3 = 0 THEN NULL ELSE CONCAT('p', CAST(k AS VARCHAR(20)), '@mail.example.com') END AS email,
  CONCAT(CAST(1 + k % 999 AS VARCHAR(20)), ' Main St, City', CAST(nk AS VARCHAR(20)), ', ', st, ' ', CAST(10000 + k % 90000 AS VARCHAR(20))) AS address_line1,
  CONCAT('City', CAST(nk AS VARCHAR(20))) AS city, st AS state, CAST(10000 + k % 90000 AS VARCHAR(20)) AS zip,
  CASE WHEN k % 4 = 0 THEN 'Nurse Anesthetist, Certified Registered' WHEN k % 4 = 1 THEN 'Internal Medicine' WHEN k % 4 = 2 THEN 'Family-Medicine' ELSE NULL END AS speciality,
  CASE WHEN k % 6 = 0 THEN NULL ELSE CONCAT('L', CAST(k AS VARCHAR(20))) END AS license_number,
  CASE WHEN k % 8 = 0 THEN 'NEEDS_REVIEW' ELSE 'ACTIVE' END AS status
FROM (SELECT k, n, nk, CASE WHEN nk % 3 = 0 THEN 'CA' WHEN nk % 3 = 1 THEN 'NY' ELSE 'ZZ' END AS st,
    n % 10 AS d0, CAST(FLOOR(n / 10) AS BIGINT) % 10 AS d1, CAST(FLOOR(n / 100) AS BIGINT) % 10 AS d2,
    CAST(FLOOR(n / 1000) AS BIGINT) % 10 AS d3, CAST(FLOOR(n / 10000) AS BIGINT) % 10 AS d4,
    CAST(FLOOR(n / 100000) AS BIGINT) % 10 AS d5, CAST(FLOOR(n / 1000000) AS BIGINT) % 10 AS d6,
    CAST(FLOOR(n / 10000000) AS BIGINT) % 10 AS d7, CAST(FLOOR(n / 100000000) AS BIGINT) % 10 AS d8
  FROM (SELECT c_custkey AS k, 100000000 + c_custkey AS n, c_nationkey AS nk FROM customer) a) b
""",
    ),
    "registry": (
        ("providers",),
        r"""
SELECT npi_id AS npi,
  CASE WHEN id % 7 = 0 THEN CONCAT('OTHER', CAST(id AS VARCHAR(20))) ELSE CONCAT('GIVEN', CAST(id % 37 AS VARCHAR(20))) END AS first_name,
  CASE WHEN id % 23 = 0 THEN 'Q' ELSE NULL END AS middle_name,
  CONCAT('FAMILY', CAST(id % 101 AS VARCHAR(20))) AS last_name,
  CASE WHEN id % 4 = 0 THEN CONCAT('999-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) ELSE phone END AS telephone_number,
  CASE WHEN id % 6 = 0 THEN CONCAT(CAST(1 + id % 999 AS VARCHAR(20)), ' Main St Suite 9') ELSE CONCAT(CAST(1 + id % 999 AS VARCHAR(20)), ' MAIN ST.') END AS address_1,
  city, state, zip AS postal_code,
  CASE WHEN id % 9 = 0 THEN 'Dentist' ELSE 'Certified Registered Nurse Anesthetist' END AS taxonomy_desc,
  CONCAT('L', CAST(id AS VARCHAR(20))) AS license
FROM providers WHERE npi_id IS NOT NULL AND id % 19 <> 0
""",
    ),
    "provider_sources": (
        ("providers",),
        r"""
SELECT id * 10 + 1 AS source_id, id AS provider_id, 'NPI_API' AS source_type, TRUE AS is_found,
  CASE WHEN id % 4 = 0 THEN CONCAT('999-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) ELSE phone END AS phone, address_line1 AS address, CAST(NULL AS VARCHAR(100)) AS website, CAST(NULL AS VARCHAR(100)) AS email
FROM providers WHERE id % 19 <> 0
UNION ALL
SELECT id * 10 + 2, id, 'AZURE_POI', id % 5 <> 0, CONCAT('888-555-', CAST(1000 + id % 9000 AS VARCHAR(20))),
  CONCAT(address_line1, ' Apt ', CAST(id % 3 AS VARCHAR(20))), CONCAT('https://poi', CAST(id AS VARCHAR(20)), '.example.com'),
  CASE WHEN id % 4 = 0 THEN CONCAT('poi', CAST(id AS VARCHAR(20)), '@place.example.com') WHEN id % 10 = 2 THEN '' ELSE NULL END
FROM providers WHERE id % 2 = 0
UNION ALL
SELECT id * 10 + 3, id, 'SCRAPING_ENRICHMENT', TRUE, phone, address_line1, CONCAT('https://web', CAST(id AS VARCHAR(20)), '.example.com'),
  CASE WHEN id % 5 <> 0 THEN CONCAT('web', CAST(id AS VARCHAR(20)), '@site.example.com') ELSE NULL END
FROM providers WHERE id % 3 = 0
""",
    ),
    "validation_issues": (
        (),
        r"""
SELECT o_orderkey AS id, o_custkey AS provider_id, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS run_id,
  CASE WHEN o_orderkey % 8 = 0 THEN 'phone' WHEN o_orderkey % 8 = 1 THEN 'Address' WHEN o_orderkey % 8 = 2 THEN 'Zip Code' WHEN o_orderkey % 8 = 3 THEN 'specialty'
    WHEN o_orderkey % 8 = 4 THEN 'certification' WHEN o_orderkey % 8 = 5 THEN 'availability_status' WHEN o_orderkey % 8 = 6 THEN 'appointment_availability' ELSE 'npi' END AS field_name,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CONCAT('v', CAST(o_orderkey AS VARCHAR(20))) END AS suggested_value,
  CAST(o_orderkey % 101 AS DOUBLE) / 100 AS confidence,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'HIGH' WHEN o_orderpriority = '2-HIGH' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN o_orderkey % 101 >= 75 THEN 'AUTO_ACCEPT' ELSE 'NEEDS_REVIEW' END AS action,
  CASE WHEN o_orderkey % 4 = 0 THEN 'NPI_API' WHEN o_orderkey % 4 = 1 THEN 'AZURE_MAPS' WHEN o_orderkey % 4 = 2 THEN 'WEBSITE' ELSE 'PDF_OCR' END AS source_type,
  CASE WHEN o_orderstatus = 'O' THEN 'OPEN' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'ACCEPTED' WHEN o_orderstatus = 'F' THEN 'ACCEPTED BY PROVIDER'
    WHEN o_orderkey % 2 = 0 THEN 'REJECTED' ELSE 'REJECTED BY PROVIDER' END AS status,
  o_orderdate AS created_at
FROM orders
""",
    ),
    "validation_runs": (
        (),
        r"""
SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS id, COUNT(DISTINCT o_custkey) AS total_providers, COUNT(*) AS processed,
  MIN(o_orderdate) AS started_at, MAX(o_orderdate) AS completed_at
FROM orders GROUP BY CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT)
""",
    ),
    "validation_run_metrics": (
        (),
        r"""
SELECT event_id AS id, user_id AS provider_id, 1995 + event_id % 7 AS run_id, CAST(FLOOR(value * 1000) AS BIGINT) AS workflow_latency_ms,
  event_id % 1000 AS prompt_tokens, event_id % 333 AS completion_tokens, event_id % 1000 + event_id % 333 AS total_tokens,
  CAST(event_id % 1000 AS DOUBLE) / 1000 * 0.001 + CAST(event_id % 333 AS DOUBLE) / 1000 * 0.002 AS estimated_cost_usd, ts AS created_at
FROM events
""",
    ),
    "spans": (
        (),
        r"""
SELECT event_id AS id, user_id AS parent_run_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'chain' END AS run_type,
  ts AS start_time, CAST(FLOOR(value * 1000) AS BIGINT) AS latency_ms, event_id % 1000 AS prompt_tokens, event_id % 333 AS completion_tokens
FROM events
""",
    ),
    "office_hours": (
        (),
        r"""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'Mon-Fri: 9:00 AM - 5:00 PM; Sat: 10:00 AM - 2:00 PM; Sunday: Closed'
  WHEN s_suppkey % 5 = 1 THEN 'Monday: 8:30 AM - 4:00 PM' WHEN s_suppkey % 5 = 2 THEN 'Wed: By appointment' WHEN s_suppkey % 5 = 3 THEN 'Sat-Mon: 9:00 AM - 1:00 PM' ELSE '' END AS hours
FROM supplier
""",
    ),
    "ocr_text": (
        (),
        r"""
SELECT s_suppkey AS doc_id, CONCAT('1. Name: Supplier Person', CAST(s_suppkey AS VARCHAR(20)), chr(10), 'NPI: ', CAST(1000000000 + s_suppkey AS VARCHAR(20)), chr(10),
  'Phone: 555-', CAST(100 + s_suppkey % 900 AS VARCHAR(20)), '-1234', chr(10), 'Address: ', CAST(1 + s_suppkey AS VARCHAR(20)), ' Oak Street', chr(10), 'State: CA', chr(10), 'Zip: 90210',
  chr(10), '2. Name: Second Person', CAST(s_suppkey AS VARCHAR(20)), chr(10), 'Specialty: Cardiology') AS text
FROM supplier
""",
    ),
    "id_pages": (
        ("providers",),
        r"""
SELECT id AS page_id, CASE WHEN id % 3 = 0 THEN CONCAT('<td>NPI: ', npi_id, '</td><p>0123456789</p>') WHEN id % 3 = 1 THEN CONCAT('<p>', npi_id, ' and 1234567890</p>')
  ELSE CONCAT('<a href="https://x.example.com/npi/', npi_id, '">p</a>') END AS html
FROM providers WHERE npi_id IS NOT NULL
""",
    ),
    "listing": (
        ("registry",),
        r"""
SELECT CAST(npi AS BIGINT) AS pos, CASE WHEN CAST(npi AS BIGINT) % 3 = 0 THEN CONCAT(first_name, ' ', last_name)
    WHEN CAST(npi AS BIGINT) % 3 = 1 THEN CONCAT('Dr ', first_name, ' Q ', last_name) ELSE CONCAT(last_name, ' ', first_name) END AS name,
  telephone_number AS phone, CONCAT(address_1, ', ', city, ', ', state, ' ', postal_code) AS address, taxonomy_desc AS specialty
FROM registry WHERE CAST(npi AS BIGINT) % 5 <> 0
""",
    ),
    "hour_pages": (
        (),
        r"""
SELECT s_suppkey AS page_id, CONCAT('<div class="office-hours main">Tuesday 9:00 am</div><p id="more-hours">by appointment only 8:15</p><p class="none">Wednesday</p>',
  '<table><tr><th>Day</th><th>Hours</th></tr><tr><td>Monday</td><td>', CAST(1 + s_suppkey % 9 AS VARCHAR(20)), ':30 AM</td></tr><tr><td>Lunch</td><td>closed</td></tr></table>',
  '<dl><dt>Opening days</dt><dt>On Friday</dt><dd>open</dd><dd>passed 1:00</dd></dl><ul><li>Monday ', CAST(1 + s_suppkey % 9 AS VARCHAR(20)),
  ':30 AM</li><li>Sunday closed</li><li>City', CAST(s_nationkey AS VARCHAR(20)), ' Hospital</li><li>CITY', CAST(s_nationkey AS VARCHAR(20)), ' HOSPITAL</li></ul><div>Saturday from ', CAST(1 + s_suppkey % 5 AS VARCHAR(20)), ':45</div>') AS html
FROM supplier
""",
    ),
    "nested_pages": (
        (),
        r"""
SELECT s_suppkey AS page_id, CONCAT(REPEAT('<div class=my-hours>', CAST(s_suppkey % 4 AS INT)), '<div class=office-hours id=a', CAST(s_suppkey AS VARCHAR(20)), '><div>Monday ', CAST(1 + s_suppkey % 9 AS VARCHAR(20)), ':30 am</div><div class="x y"><span>Tuesday</span> <b>closed</b></div></div>',
  REPEAT('</div>', CAST(s_suppkey % 4 AS INT)), '<table><tr><td>Hours</td><td>at <i>9:00</i></td></tr><tr><td>Sunday</td><td><table><tr><td>Friday</td><td>', CAST(1 + s_nationkey % 9 AS VARCHAR(20)), ':15 pm</td></tr></table></td></tr></table>',
  '<ul><li class=', CHR(39), 'hospital one', CHR(39), '>Oak Hospital<ol><li>Saturday 8:00</li></ol></li></ul><dl><dt>Open days</dt><dd>by appointment only</dd></dl>') AS html
FROM supplier
""",
    ),
    "source_pages": (
        ("providers",),
        r"""
SELECT id AS page_id, CAST(FLOOR(id / 3) AS BIGINT) AS provider_id, city, state, CASE id % 4 WHEN 0 THEN 'HEALTHGRADES' WHEN 1 THEN 'VITALS' WHEN 2 THEN 'WEBMD' ELSE 'DOXIMITY' END AS source,
  CONCAT('<a href="/about">a</a><a class="r" href="', CASE id % 8 WHEN 0 THEN '/physician/dr-' WHEN 1 THEN '/doctors/dr-' WHEN 2 THEN '/doctor/dr-' WHEN 3 THEN '/pub/search?q=' WHEN 7 THEN '/pub/dr-' ELSE '/none/' END, CAST(id AS VARCHAR(20)),
    '">b</a><a href="https://other.example.com/doctor/physician/9">c</a><div class="main-hospital">', CASE id % 3 WHEN 0 THEN 'Oak' WHEN 1 THEN 'Elm' ELSE 'OAK' END, ' Hospital, Springfield, IL</div><span class="facility">North ', CASE id % 5 WHEN 0 THEN 'River' ELSE 'Hill' END,
    ' Clinic</span><p class="location">South Health System</p><ul><li>Lake Medical Center</li><li>other</li></ul>') AS html
FROM providers
""",
    ),
    "run_spans": (
        (),
        r"""
SELECT -user_id AS id, CAST(NULL AS BIGINT) AS parent_run_id, 'workflow' AS name, 'chain' AS run_type, MIN(ts) AS start_time, CASE WHEN user_id % 7 = 0 THEN NULL ELSE MAX(ts) END AS end_time FROM events GROUP BY user_id
UNION ALL
SELECT event_id, -user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE NULL END, ts,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN ts + INTERVAL '3' SECOND ELSE ts + INTERVAL '7' SECOND END FROM events
""",
    ),
    "address_pairs": (
        ("providers", "registry"),
        r"""
SELECT p.id, p.address_line1 AS a, CONCAT(r.address_1, ', ', r.city, ', ', r.state, ' ', r.postal_code) AS b
FROM providers p JOIN registry r ON p.npi_id = r.npi
""",
    ),
    "license_statuses": (
        ("providers",),
        r"""
SELECT id AS provider_id, CASE WHEN id % 10 = 0 THEN 'EXPIRED' WHEN id % 10 < 8 THEN 'Active' ELSE NULL END AS license_status FROM providers WHERE id % 7 <> 0
""",
    ),
    "listing_hours": (
        ("providers",),
        r"""
SELECT id AS provider_id, 1 AS pos, 'Monday' AS day, CASE WHEN id % 4 = 0 THEN '' ELSE '9:00 AM' END AS slot, CASE WHEN id % 8 = 0 THEN 'CLOSED' ELSE NULL END AS status FROM providers WHERE id % 3 = 0
UNION ALL SELECT id, 2, 'Tuesday', '10:00 AM', 'OPEN' FROM providers WHERE id % 6 = 0
""",
    ),
    "listing_status": (
        ("providers",),
        r"""
SELECT id AS provider_id, CASE WHEN id % 5 = 0 THEN 'NO_INFO' WHEN id % 5 < 3 THEN 'ACCEPTING_APPOINTMENTS' ELSE NULL END AS availability_status FROM providers WHERE id % 3 = 0
""",
    ),
    "legacy_sources": (
        ("providers",),
        r"""
SELECT id, id % 2 = 0 AS has_npi, CASE WHEN id % 4 = 0 THEN CONCAT('999-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) ELSE phone END AS npi_phone,
  CASE WHEN id % 3 = 0 THEN 'Dentist' ELSE 'medicine, internal' END AS npi_speciality,
  id % 3 <> 0 AS has_maps, id % 5 <> 0 AS maps_valid, CASE WHEN id % 5 = 0 THEN 'NO_RESULTS' ELSE NULL END AS maps_reason,
  CASE WHEN id % 7 = 0 THEN address_line1 ELSE CONCAT(CAST(1 + id % 999 AS VARCHAR(20)), ' Main Street, ', city, ', ', state, ' ', CAST(10000 + (id + id % 2) % 90000 AS VARCHAR(20))) END AS maps_formatted,
  CASE WHEN id % 4 = 1 THEN CONCAT('New ', city) ELSE UPPER(city) END AS maps_city, CASE WHEN id % 6 = 1 THEN 'TX' ELSE LOWER(state) END AS maps_state,
  CAST(10000 + (id + id % 2) % 90000 AS VARCHAR(20)) AS maps_zip, CAST(id % 10 AS DOUBLE) / 10 AS maps_score, id % 8 = 1 AS address_verified,
  id % 4 = 2 AS has_poi, CONCAT('888-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) AS poi_phone, CASE WHEN id % 3 = 0 THEN NULL ELSE CONCAT('https://poi', CAST(id AS VARCHAR(20)), '.example.com') END AS poi_website,
  CASE WHEN id % 10 = 2 THEN NULL ELSE CONCAT(address_line1, ' Apt ', CAST(id % 3 AS VARCHAR(20))) END AS poi_formatted, 'Elsewhere' AS poi_city, 'NV' AS poi_state, '10002' AS poi_zip,
  id % 5 = 1 AS has_scraped, CONCAT('777-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) AS scraped_phone, CONCAT('https://web', CAST(id AS VARCHAR(20)), '.example.com') AS scraped_website,
  id % 7 = 3 AS has_ocr, CASE WHEN id % 2 = 0 THEN name ELSE UPPER(name) END AS ocr_name, CONCAT('666-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) AS ocr_phone, CONCAT(CAST(1 + id % 99 AS VARCHAR(20)), ' Side Rd, ', city, ', ', state, ' ', zip) AS ocr_address,
  id % 6 = 5 AS has_listing, CONCAT('444-555-', CAST(1000 + id % 9000 AS VARCHAR(20))) AS listing_phone, CONCAT(CAST(1 + id % 99 AS VARCHAR(20)), ' Other Ave, ', city, ', ', state, ' ', zip) AS listing_address,
  CASE WHEN id % 4 = 1 THEN 'Surgeon' ELSE speciality END AS listing_specialty, CONCAT('L', CAST(id + id % 2 AS VARCHAR(20))) AS listing_license, state AS listing_license_state,
  CASE WHEN id % 4 = 1 THEN 'ACTIVE' ELSE NULL END AS listing_license_status, 'Mon-Fri: 9:00 AM - 5:00 PM' AS listing_hours_text, CASE WHEN id % 4 = 3 THEN 'NO_INFO' ELSE 'LIMITED_AVAILABILITY' END AS listing_availability,
  CASE WHEN id % 5 = 0 THEN NULL ELSE id % 2 = 1 END AS listing_accepting, CASE WHEN id % 5 = 1 THEN NULL ELSE id % 4 = 1 END AS listing_telehealth, CASE WHEN id % 3 = 2 THEN 'City Hospital' ELSE NULL END AS listing_affiliations,
  id % 9 < 4 AS has_cert, CASE WHEN id % 2 = 0 THEN 'Nurse' ELSE speciality END AS cert_specialty, CASE WHEN id % 9 = 1 THEN NULL ELSE 'Board Certified' END AS cert_name, CASE WHEN id % 9 = 2 THEN NULL ELSE CONCAT('C', CAST(id AS VARCHAR(20))) END AS cert_license,
  CASE WHEN id % 11 = 0 THEN 'https://own.example.com' ELSE NULL END AS website
FROM providers
""",
    ),
    "tier_pages": (
        ("providers",),
        r"""
SELECT id * 2 AS page_id, id, 1 AS tier, CASE WHEN id % 4 = 0 THEN CONCAT('<p>National Provider Identifier: ', npi_id, '</p>') WHEN id % 4 = 1 THEN CONCAT('<div data-npi="', npi_id, '">1234567890</div>') ELSE '<p>1234567890 nothing</p>' END AS html
FROM providers WHERE npi_id IS NOT NULL AND id % 2 = 0 OR npi_id IS NOT NULL AND id % 4 = 1
UNION ALL SELECT id * 2 + 1, id, 2, CASE WHEN id % 3 = 0 THEN CONCAT('<a href="/npi/', npi_id, '">x</a>') WHEN id % 3 = 1 THEN CONCAT('seen 01/02/2024, ', npi_id, ' or npi_number: "', npi_id, '"') ELSE CONCAT('on 01/02/2024 ', npi_id) END
FROM providers WHERE npi_id IS NOT NULL
""",
    ),
    "record_results": (
        (),
        r"""
SELECT event_id AS id, 1995 + event_id % 7 AS run_id, event_id % 11 <> 0 AS ok, event_id % 3 = 0 AS needs_review, CAST(FLOOR(value * 1000) AS BIGINT) AS ms FROM events
""",
    ),
    "listing_pages": (
        (),
        r"""
SELECT s_suppkey AS page_id, CONCAT('<table><tr><th>Name</th><th>S</th><th>L</th><th>A</th><th>H</th><th>N</th><th>T</th></tr><tr><td>Provider</td><td>S</td><td>L</td><td>A</td><td>H</td><td>N</td><td>T</td></tr><tr><td>', s_name, '</td><td><b>Dentist</b></td><td>License Number: L', CAST(s_suppkey AS VARCHAR(20)),
  CASE WHEN s_suppkey % 3 = 0 THEN '<br>State: CA' ELSE '' END, chr(10), CASE WHEN s_suppkey % 4 = 0 THEN ' Status: Active ' ELSE '' END, '</td><td>City Hospital</td><td>Mon: 9:00 AM', chr(10), 'Tue: closed</td><td>', CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'no' END, '</td><td>YES</td>',
  CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CONCAT('<td>Phone: (212) 555-', CAST(1000 + s_suppkey % 9000 AS VARCHAR(20)), CASE WHEN s_suppkey % 5 = 1 THEN '' ELSE CONCAT('<br/>Address: ', CAST(1 + s_nationkey AS VARCHAR(20)), ' Main St', chr(10), 'rest') END, '</td>') END,
  '</tr><tr><td>short</td></tr></table><dl><dt>Opening days</dt><dt>Monday</dt><dd>', CAST(1 + s_suppkey % 9 AS VARCHAR(20)), ':15 am</dd><dd>skipped</dd><dt>On Sunday</dt><dd>closed</dd></dl>') AS html
FROM supplier
""",
    ),
    "hospital_texts": (
        (),
        r"""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN CONCAT('Works at Saint Mary Hospital in Springfield, IL since ', CAST(s_suppkey AS VARCHAR(20))) WHEN s_suppkey % 5 = 1 THEN CONCAT('the hospital no. ', CAST(s_suppkey AS VARCHAR(20)))
  WHEN s_suppkey % 5 = 2 THEN 'North Star Medical Group, New York, NY 10001' WHEN s_suppkey % 5 = 3 THEN 'no such place' ELSE 'Green Valley Health' END AS text
FROM supplier
""",
    ),
    "decisions": (
        ("validation_issues",),
        r"""
SELECT id AS issue_id, CASE WHEN id % 2 = 0 THEN 'accept' ELSE 'reject' END AS decision,
  CASE WHEN id % 2 = 0 THEN NULL ELSE CONCAT('c', CAST(id AS VARCHAR(20))) END AS correct_value
FROM validation_issues WHERE status = 'OPEN'
""",
    ),
}


def order(names) -> list[str]:
    """The named tables with all they need, each after what it needs."""
    out: list[str] = []
    for name in names:
        for need in (*order(TABLES[name][0]), name):
            if need not in out:
                out.append(need)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir, or one derived from them."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = TABLES[name]
    base = [b for b in BASE if f" {b}" in sql and b not in needs]
    for need in (*base, *needs):
        table(spark, sf_dir, need).createOrReplaceTempView(need)
    return spark.sql(sql)


def with_tables(names, query: str) -> str:
    """query for DuckDB, in front of it the derived tables it names."""
    ctes = ", ".join(f"{n} AS ({TABLES[n][1].strip()})" for n in order(names))
    return f"WITH {ctes} {query}" if ctes else query
