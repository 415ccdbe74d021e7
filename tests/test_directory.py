"""Every query against its DuckDB oracle, and operators against hand-computed cases."""

import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F
from rosterlane.functions import scoring, similarity
from rosterlane.functions import text as t
from rosterlane.operators import extract, match, report, resolve, validate
from rosterlane.plans import registry
from rosterlane.plans.pipeline import run_validation
from rosterlane.sources import entities, fixtures


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    told = duck.sql(registry.ORACLES[name])
    assert columns == sorted(told.columns)
    at = [told.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in told.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("s, a, p, score", [(0.8, 0.6, 0.4, 0.66), (0.73, 0.19, 0.91, 0.604), (0, 0, 0, 0), (1, 0, 0, 0.5), (0, 1, 0, 0.3), (0, 0, 1, 0.2), (1, 1, 1, 1), (1, 1, 0, 0.8), (1, 0, 1, 0.7), (0, 1, 1, 0.5)])
def test_strict_confidence(spark, s, a, p, score):
    got = one(spark, x=scoring.strict_confidence(*[F.lit(float(v)) for v in (s, a, p)])).x
    assert abs(got - score) < 1e-12


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -0.1, 1.1])
def test_strict_confidence_refuses(spark, bad):
    with pytest.raises(Exception, match="finite numbers"):
        one(spark, x=scoring.strict_confidence(F.lit(bad), F.lit(0.0), F.lit(0.0)))
    score, error = scoring.try_confidence(F.lit(bad), F.lit(0.0), F.lit(0.0))
    row = one(spark, s=score, e=error)
    assert row.s is None and row.e == ("RANGE" if abs(bad) < 2 else "TYPE")


def test_jaro_winkler_golden_values(spark):
    pairs = [("MARTHA", "MARHTA", 0.961111), ("abcd", "axyz", 0.55), ("abcxyz", "bcaxyz", 0.916667), ("a", "b", 0.0), ("A", "a", 1.0), ("", "x", 0.0), (None, "x", 0.0), ("dixon", "dicksonx", 0.813333)]
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    for r in similarity.with_jaro_winkler(df, "a", "b", "got").withColumn("direct", similarity.jaro_winkler(F.col("a"), F.col("b"))).collect():
        assert abs(r.got - r.s) < 1e-6 and r.got == r.direct
    same = similarity.with_jaro_winkler(df.selectExpr("b as a", "a as b", "s"), "a", "b", "got")
    assert all(0 <= r.got <= 1 for r in same.collect())


def test_addresses(spark):
    cases = [
        ("1 Main St, X, CA 90210", "1 MAIN ST. X CA 90210", True), ("1 Main St, X, CA 90210", "1 Main St, X, CA 90211", False), ("1 Main St, X, CA 90210", "1 Main St, X, NY 90210", False),
        ("Suite 9 1 Main St, X, CA 90210", "1 Main St Suite 9, X, CA 90210", False), ("Main St 1, X, CA 90210", "St Main 1 X, CA 90210", True), ("a", "b", False), (None, "b", False), ("a b", "a  b", True),
    ]
    df = spark.createDataFrame(cases, "a string, b string, ok boolean")
    for r in df.withColumn("got", similarity.addresses_match(F.col("a"), F.col("b"))).collect():
        assert r.got == r.ok, (r.a, r.b)


def test_text_rules(spark):
    row = one(
        spark, trim=t.trim(F.lit("\n x \t ")), city=t.extract_city(F.lit("1 Main St, Springfield, IL 62701")), zip=t.extract_zip(F.lit("x 62701-1234 y 1")), spec=t.normalize_specialty(F.lit("Nurse, Certified-Registered")),
        phone=t.format_phone(F.lit("(212) 555-0101")), phone11=t.format_phone(F.lit("1 212 555 0101"), True), last=t.last_name(F.lit("Dr. Ann Lee (DDS)")), name=t.name_for_registry(F.lit("Jo O'Neil-Day (RDH), MD")), cred=t.credentials(F.lit("A (x, y,) (z)")), field=t.normalize_field_name(F.lit(" Zip  Code ")),
    )
    assert row.asDict() == {"trim": "x", "city": "1 Main St", "zip": "62701", "spec": "certified nurse registered", "phone": "212-555-0101", "phone11": "212-555-0101", "last": "Lee", "name": "JO ONEILDAY", "cred": ["x", "y"], "field": "zip_code"}


def test_npi(spark):
    df = spark.createDataFrame([("1234567893", True), ("1234567890", False), ("3234567893", False), ("123456789", False), (None, False)], "n string, ok boolean")
    assert all(r.got == r.ok for r in df.withColumn("got", validate.npi_is_valid(F.col("n"))).collect())


def test_office_hours_and_listing_rows(spark):
    df = spark.createDataFrame([(1, "Fri-Mon: 9:00 AM - 1:00 PM; tue: closed\nWed-Thu: By Appointment, Someday: 1")], "id int, hours string")
    assert [(r.day, r.slot, r.status) for r in extract.office_hours(df).collect()] == [("Tuesday", "closed", "CLOSED"), ("Wednesday", "By Appointment", "BY_APPOINTMENT"), ("Thursday", "By Appointment", "BY_APPOINTMENT")]
    html = "<table><tr><th>Name</th><th>b</th><th>c</th><th>d</th><th>e</th><th>f</th><th>g</th></tr><tr><td>Ann</td><td><b>Dentist</b></td><td><p>License Number: L1</p>State: CA<br>Status: Active</td><td>H</td><td>9</td><td>Yes</td><td>no</td><td>212.555.0101<br>Address: 1 Main St, X</td></tr><tr><td>x</td></tr></table>"
    row = extract.listing_rows(spark.createDataFrame([(1, html)], "page_id int, html string")).collect()
    assert [(r.name, r.specialty, r.accepting_new_patients, r.telehealth) for r in row] == [("Ann", "Dentist", True, False)]
    assert [(r.license_number, r.license_state, r.license_status, r.phone, r.address) for r in row] == [("L1", "CA", "Active", "212.555.0101", "1 Main St, X")]


def test_pages_by_selectors(spark):
    html = [
        '<section class="practice-hours"><p data-testid="day-hours">Monday 9:00 AM</p></section><span class="appointment">Tuesday</span><div id="x">Friday at 8:30 pm</div>',
        "<dl><dt>Day</dt><dd>closed</dd><dd>9:00</dd></dl><ul><li>" + "x" * 200 + " Monday</li><li>no day</li></ul><br class='hours'>", "", None,
    ]
    rows = extract.timings_from_pages(spark.createDataFrame(list(enumerate(html)), "page_id int, html string")).collect()
    assert sorted((r.page_id, r.day, r.slots, r.status, r.source) for r in rows) == [(0, "Friday", "8:30 pm", "OPEN", "div"), (0, "Monday", "9:00 AM", "OPEN", "selector"), (0, "Tuesday", "", None, "selector"), (1, "Day", "", "CLOSED", "definition-list")]
    pages = [(1, "VITALS", '<div class="facility">Oak Clinic</div><div class="location">Elm Clinic</div>', "X", "CA"), (1, "HEALTHGRADES", '<ul><li>the OAK CLINIC hospital</li></ul><b class="practice-locations">Oak Clinic, Reno, NV</b>', "X", "CA"), (2, "WEBMD", None, None, None)]
    found = extract.source_affiliations(spark.createDataFrame(pages, "provider_id int, source string, html string, city string, state string")).collect()
    assert sorted((r.provider_id, r.name, r.location, r.source) for r in found) == [(1, "Oak Clinic", "Reno, NV", "HEALTHGRADES"), (1, "the OAK CLINIC hospital", "X, CA", "HEALTHGRADES")]
    links = [(1, "WEBMD", "<a href='/doctor/1'>x</a>"), (2, "DOXIMITY", '<A HREF="/pub/search">x</A><a href="/pub/2">y</a>'), (3, "OTHER", '<a href="/doctor/1">x</a>')]
    assert [tuple(r) for r in extract.source_profiles(spark.createDataFrame(links, "page_id int, source string, html string")).collect()] == [(1, "WEBMD", "https://doctor.webmd.com/doctor/1")]


def test_csv_and_ocr_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b'\xef\xbb\xbfprovider_id,name,city,extra\n 7 , "Ann, Lee" ,X,1\n,,,\n,Bob,,2\n')
    rows = entities.read_entities_csv(spark, str(tmp_path / "in.csv")).orderBy("name").collect()
    assert [(r.provider_code, r.name, r.phone) for r in rows] == [("7", "Ann, Lee", None), (None, "Bob", None)]
    shapes = ['{"analyzeResult":{"readResults":[{"lines":[{"text":" a "},{"words":[{"text":"b"},{"text":"c"}]},"d",""]}]}}', '{"readResults":[{"lines":["x"]}]}', '[{"lines":["y"]},{"lines":[{"text":"z"}]}]', "{}", None]
    lines = entities.read_ocr_lines(spark.createDataFrame(list(enumerate(shapes)), "doc_id int, result string")).collect()
    assert sorted((r.doc_id, r.page, r.text) for r in lines) == [(0, 0, "a"), (0, 0, "b c"), (0, 0, "d"), (1, 0, "x"), (2, 0, "y"), (2, 1, "z")]


def test_export_and_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'Ann "A"', None)], "id long, name string, npi_id string")
    for c in entities.DIRECTORY_COLUMNS[3:]:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    entities.export_csv(entities.directory_rows(rows), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text.splitlines()[1].startswith('"1","Ann ""A""",""')
    for kind in ("A", "B"):
        entities.append_sources(spark.createDataFrame([(1, kind)], "provider_id int, source_type string"), str(tmp_path / "sources"))
    assert spark.read.parquet(str(tmp_path / "sources")).count() == 2


def test_accept_all_then_export_gate_and_idempotent_replacement(spark, sf_dir):
    table = lambda n: fixtures.table(spark, sf_dir, n)
    issues = table("validation_issues")
    _, after, counts = resolve.accept_all(table("providers"), issues, 1996)
    c = counts.first()
    left = {r.run_id: r for r in report.export_gate(after).collect()}[1996]
    assert left.open_issues == c.failed and c.success > 0
    assert report.export_gate(resolve.reject_all(after, 1996)).where("run_id = 1996").first().allowed
    new = issues.where("id % 3 = 0").withColumn("status", F.lit("NEW"))
    once = resolve.replace_issues(issues, new)
    assert sorted(map(tuple, resolve.replace_issues(once, new).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_one_issue_per_entity_and_field(spark, sf_dir):
    table = lambda n: fixtures.table(spark, sf_dir, n)
    run = run_validation(table("providers"), table("registry"), table("provider_sources"))
    rows = run.issues.collect()
    assert len({(r.id, r.field) for r in rows}) == len(rows)
    assert all(0 <= r.confidence <= 1 and r.suggested is not None for r in rows)
    assert all(0 <= r.score <= 1 for r in run.scored.select("score").collect())


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id long, npi_id string, name string, phone string, email string, address_line1 string, city string, state string, zip string, speciality string, license_number string, status string")
    assert validate.validate_entities(p).count() == 0 and validate.standardize_entities(p).count() == 0


def test_ocr_city_and_state_and_labelled_patterns(spark):
    texts = [(1, "Name: Ann Lee\nZZ\nSpringfield, IL 62701\nTEL 2125550101"), (2, "PROVIDER: Title: Bob Ray\nSpecialization: Eyes\nCity: Town\nState: NY"), (3, "Jo Day Clinic\nPh: (212) 555-0101\nNPI 1234567893")]
    blocks = spark.createDataFrame(texts, "doc_id int, text string").withColumn("block", F.lit(0))
    got = {r.doc_id: r for r in extract.ocr_fields(blocks).collect()}
    assert (got[1].name, got[1].city, got[1].state, got[1].zip, got[1].phone) == ("Ann Lee", "Springfield", "IL", "62701", "2125550101")
    assert (got[2].name, got[2].speciality, got[2].city, got[2].state) == ("Bob Ray", "Eyes", "Town", "NY")
    assert (got[3].name, got[3].speciality, got[3].phone, got[3].npi) == ("Jo Day Clinic", "Jo Day Clinic", "212555-0101", "1234567893")
    pages = ["npi_number: '1234567893'", 'data-npi="1234567893"', "NPI#1234567893", "Phone 1234567893", "01/02/2024 at 1234567893 x", "01/02/2024, long before 1234567893", "x1234567893"]
    found = {r.page_id for r in extract.ids_from_pages(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")).collect()}
    assert found == {0, 1, 2, 3, 5}


def test_values_of_boolean_and_json_columns(spark):
    p = spark.createDataFrame([(1, None, None, "x"), (2, False, "[1]", "y")], "id long, telehealth_available boolean, affiliations_json string, status string")
    values = spark.createDataFrame([(1, "telehealth_available", " Yes ", 1), (1, "affiliations_json", '[ {"a" : 1} ]', 2), (2, "telehealth_available", "no", 3), (2, "affiliations_json", "{broken", 4)], "provider_id long, column string, value string, id long")
    got = {r.id: r for r in resolve.apply_values(p, values).collect()}
    assert (got[1].telehealth_available, got[1].affiliations_json, got[1].status) == (True, '[{"a":1}]', "ACTIVE")
    assert (got[2].telehealth_available, got[2].affiliations_json) == (False, "{broken")


def test_organisations_and_single_names_are_found(spark):
    registry = spark.createDataFrame([("1", None, None, None, "HAPPY DENTAL LLC", "TOWN", "CA"), ("2", "ANN", None, "LEE", None, "TOWN", "CA"), ("3", None, None, None, "A B C D E CARE", "X", "NY")], "npi string, first_name string, middle_name string, last_name string, organization_name string, city string, state string")
    asked = spark.createDataFrame([(1, "Happy Dental LLC", "Town", "CA"), (2, "Lee", "Else", "CA"), (3, "a b c d e care", "Q", "QQ"), (4, "Nobody", "Town", "CA")], "id int, name string, city string, state string")
    got = {r.id: (r["rank"], r.npi, r.score) for r in match.registry_name_search(asked, registry).collect()}
    assert got == {1: (1, "1", 7), 2: (1, "2", 3), 3: (3, "3", 12)}


def test_export_is_one_csv_with_one_header(spark, tmp_path):
    rows = spark.range(5000).selectExpr("cast(id as string) as id", "concat('n', 9999 - id) as name").repartition(7)
    entities.export_csv(rows, str(tmp_path / "out"), ("name",))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines[0] == '"id","name"' and len(lines) == 5001 and lines[1:] == sorted(lines[1:], key=lambda x: x.split(",")[1])
    (tmp_path / "bad.csv").write_text("name,city\nAnn,X\nBob,Y,too,many\n")
    assert {r.name: r.corrupt for r in entities.read_entities_csv(spark, str(tmp_path / "bad.csv")).collect()} == {"Ann": None, "Bob": "Bob,Y,too,many"}
