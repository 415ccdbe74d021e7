"""Extraction jobs over pages and OCR texts: built-in regular expressions, one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlane.functions import text as t

from .elements import attribute, below, children, element_tree, inside, lines_of, tagged, text_of
from .validate import npi_is_valid

#: Labelled patterns of an identifier, in order; then one that stands alone (not in the context of a date, not with a leading
#: zero), and those of links and snippets.
_LABELLED = (r"(?i)NPI[\s:#]*(\d{10})", r"(?i)NPI\s*(?:Number|#|No\.?|ID)?[\s:]*(\d{10})", r"(?i)National\s+Provider\s+Identifier[\s:]*(\d{10})", r"(?i)npi_number['\":\s]*(\d{10})", r"(?i)data-npi['\"=\s]*(\d{10})")
_DATE = r"\d{2}/\d{2}/"
_ALONE = rf"(?<![0-9A-Za-z_])((?!0|1[0-2])\d{{10}}|1[0-2](?<!{_DATE}\d{{4}}[\s\S]{{0,5}}1[0-2])(?<!{_DATE}1[0-2])\d{{8}})(?![0-9A-Za-z_])"
_LINKED = (r"(?i)npi[/=](\d{10})", r"(?i)NPI\s*#?\s*(\d{10})")
_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def ids_from_pages(pages: DataFrame) -> DataFrame:
    """(page_id, ids): valid labelled ids in order of pattern; if there are none, valid 10-digit numbers that no date context precedes;
    if none, ids in links and snippets."""
    html = F.col("html")
    valid = lambda xs: F.array_distinct(F.filter(xs, lambda n: npi_is_valid(n)))
    labelled = valid(F.flatten(F.array(*[_all(html, p) for p in _LABELLED])))
    alone = valid(_all(html, _ALONE))
    linked = valid(F.flatten(F.array(*[_all(html, p) for p in _LINKED])))
    found = F.when(F.size(labelled) > 0, labelled).when(F.size(alone) > 0, alone).otherwise(linked)
    return pages.select("page_id", found.alias("ids")).where(F.size("ids") > 0)


def ocr_blocks(texts: DataFrame) -> DataFrame:
    """(doc_id, block, text): parts between line-leading numbers, PROVIDER marks and rules; blank parts are dropped."""
    parts = F.split("text", r"(?im)(?:^|\n)(?:\d+\.|PROVIDER|---+)")
    return texts.select("doc_id", F.posexplode(parts).alias("block", "text")).where(t.trim(F.col("text")) != "")


def ocr_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, line, text) of non-blank lines."""
    lines = F.filter(F.transform(F.split("text", "\n"), t.trim), lambda x: x != "")
    return blocks.select("doc_id", "block", F.posexplode(lines).alias("line", "text"))


#: Labelled patterns of OCR lines, what marks a street, and words that mark a specialty line.
_LABELS = {
    "npi": r"(?i)NPI[:\s]*(\d{10})", "phone": r"(?i)(?:Phone|TEL|Ph)[:\s]*(\(?[\d\s\-\.\)]{10,14})", "license_number": r"(?i)License[:\s]*([A-Z0-9\-]+)",
    "name": r"(?i)(?:Name|PROVIDER|Provider Name)[:\s]*(.+)", "address_line1": r"(?i)(?:Address|Address Line)[:\s]*(.+)", "city": r"(?i)(?:City)[:\s]*(.+)",
    "state": r"(?i)(?:State|ST)[:\s]*([A-Z]{2})", "zip": r"(?i)(?:Zip|ZIP|Zip Code)[:\s]*(\d{5}(?:[-\s]?\d{4})?)", "speciality": r"(?i)(?:Specialty|Specialization|Speciality)[:\s]*(.+)",
}
_STREET = r"(?i)\d+\s+\w+\s+(st|ave|blvd|road|drive|lane|court|street)"
_SPECIALTIES = ("physician", "surgeon", "dentist", "nurse", "therapist", "center", "clinic", "hospital", "podiatrist", "dermatology", "cardiology")
#: The same for texts without labels; a word's end is where no ASCII letter, digit or underscore follows.
_STATE = r"(?<![0-9A-Za-z_])([A-Z]{2})(?![0-9A-Za-z_])"
_ZIP = r"(?<![0-9A-Za-z_])(\d{5})(?:[-\s]?\d{4})?(?![0-9A-Za-z_])"


def _find(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _labelled(name: str) -> Column:
    found = _find(F.col("text"), _LABELS[name])
    if name == "phone":
        return F.regexp_replace(found, r"[\s()]", "")
    if name == "zip":
        return F.regexp_replace(found, r"[\s-]", "")
    return F.regexp_replace(t.trim(found), r"^[A-Za-z\s:]+:\s*", "") if name == "name" else t.trim(found)


def ocr_fields(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, name, npi, phone, license_number, address_line1, city, state, zip, speciality) of blocks with a name of over 2 letters.

    Per field the first line that tells it wins, by its label or else by what the line looks like; for ids, phones and licences the last.
    A line "City, ST" that gives the city gives the state too, whatever an earlier line said.
    """
    text = F.col("text")
    unlabelled = lambda label, c: F.when(~text.rlike(rf"(?i){label}[:\s]"), c)
    keyword = F.lit(False)
    for w in _SPECIALTIES:
        keyword = keyword | F.lower(text).contains(w)
    plain = (F.length(text) > 5) & ~text.rlike(r"^\d") & ~text.rlike(_LABELS["phone"]) & ~text.rlike(r"[A-Z]{2}\s*\d{5}") & ~text.rlike(r"^[A-Z\s]+[:\s]")
    comma = F.when(text.contains(",") & ~text.rlike(r"(?i)City[:\s]"), t.trim(F.substring_index(text, ",", 1)))
    looks = {
        "name": F.when(plain, t.trim(F.substring(text, 1, 100))), "address_line1": F.when(text.rlike(_STREET), F.substring(text, 1, 100)), "city": comma,
        "state": unlabelled("State", _find(text, _STATE)), "zip": unlabelled("Zip", _find(text, _ZIP)), "speciality": F.when(keyword, t.trim(F.substring(text, 1, 100))),
    }
    lines = ocr_lines(blocks)
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line")))
    city = F.struct(F.coalesce(_labelled("city"), comma).alias("city"), F.when(_labelled("city").isNull(), _find(F.get(F.split(text, ","), F.lit(1)), r"[A-Z]{2}", 0)).alias("state"))
    of_city = F.min_by(city, F.when(city["city"].isNotNull(), F.col("line")))
    found = lines.groupBy("doc_id", "block").agg(
        *[first(F.coalesce(_labelled(k), looks[k])).alias(k) for k in looks if k not in ("city", "state")],
        of_city["city"].alias("city"),
        F.coalesce(of_city["state"], first(F.coalesce(_labelled("state"), looks["state"]))).alias("state"),
        *[F.max_by(_labelled(k), F.when(_labelled(k).isNotNull(), F.col("line"))).alias(k) for k in ("npi", "phone", "license_number")],
    )
    return found.where(F.length(t.trim(F.col("name"))) > 2).select("doc_id", "block", "name", "npi", "phone", "license_number", "address_line1", "city", "state", "zip", "speciality")


def ocr_lookahead(lines: DataFrame) -> DataFrame:
    """(doc_id, line, name, npi, phone, zip, state, address_line1): each line as a name, its fields from the next four."""
    text = F.col("text")
    ahead = Window.partitionBy("doc_id").orderBy("line").rowsBetween(1, 4)
    last = lambda c: F.last(c, ignorenulls=True).over(ahead)
    first = lambda c: F.first(c, ignorenulls=True).over(ahead)
    told = lines.withColumns({
        "npi": last(_labelled("npi")), "phone": last(_labelled("phone")), "zip": first(_find(text, _ZIP)),
        "state": first(_find(text, _STATE)), "address_line1": first(F.when(text.rlike(_STREET), F.substring(text, 1, 100))),
    })
    skip = (F.length("text") < 5) | text.rlike(r"(?i)^(page|address|city|state|zip|phone|fax|npi|license|id|\d+)\z")
    return told.where(~skip).select("doc_id", "line", t.trim(F.substring("text", 1, 100)).alias("name"), "npi", "phone", "zip", "state", "address_line1")


def _day_number(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, day in enumerate(_DAYS):
        out = F.when(F.lower(t.trim(c)).isin(day.lower(), day[:3].lower()), i).otherwise(out)
    return out


def office_hours(df: DataFrame, id_col: str = "id", text_col: str = "hours") -> DataFrame:
    """(id, day, slot, status, raw_text): entries "day[-day]: start[ - end]"; a range that would run backwards gives nothing."""
    entry = df.select(id_col, F.explode(F.filter(F.transform(F.split(text_col, r"[\n;,]"), t.trim), lambda x: x != "")).alias("raw_text"))
    rule = r"^([^:]+):\s*(.+?)(?:\s*[-–]\s*(.+))?\z"
    parts = entry.where(F.col("raw_text").rlike(rule)).select(id_col, "raw_text", *[F.regexp_extract("raw_text", rule, k).alias(n) for k, n in ((1, "days"), (2, "start"), (3, "end"))])
    ends = F.split("days", "[-–]")
    low, high = _day_number(ends[0]), F.when(F.size(ends) == 2, _day_number(ends[1])).otherwise(_day_number(ends[0]))
    spread = parts.withColumn("low", low).withColumn("high", high).where("low <= high").withColumn("d", F.explode(F.sequence("low", "high")))
    status = F.when(F.lower("start").contains("closed"), "CLOSED").when(F.lower("start").contains("by appointment"), "BY_APPOINTMENT").otherwise("OPEN")
    slot = F.when(F.col("end") != "", F.concat_ws(" - ", "start", "end")).otherwise(F.col("start"))
    return spread.select(id_col, F.element_at(F.array(*map(F.lit, _DAYS)), F.col("d") + 1).alias("day"), slot.alias("slot"), status.alias("status"), "raw_text")


def availability(has_slots: Column, accepting: Column) -> Column:
    return F.when(has_slots & accepting, "ACCEPTING_APPOINTMENTS").when(has_slots, "LIMITED_AVAILABILITY").when(accepting, "ACCEPTING_NEW_PATIENTS").otherwise("NO_INFO")


def availability_of(timings: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, availability_status) of entities with opening times (id, slots) and a flag (id, accepting)."""
    has = timings.where("slots <> ''").select("id").distinct().withColumn("__slots", F.lit(True))
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flags.join(has, "id", "left").select("id", availability(some("__slots"), some("accepting")).alias("availability_status"))


def _first_selector(element: Column, selectors) -> Column:
    """The place of the first selector that the element meets: a class, a value, or a part of one."""

    def meets(name: str, how: str, value: str) -> Column:
        told = attribute(element, name)
        return F.array_contains(F.split(told, r"\s+"), value) if how == "class" else told == value if how == "is" else told.contains(value)

    return F.coalesce(*[F.when(meets(*selector), i) for i, selector in enumerate(selectors)])


#: Selectors of elements that hold opening times, in the order in which they are searched.
_TIMED = (
    ("class", "class", "office-hours"), ("class", "class", "practice-hours"), ("class", "class", "appointment-times"), ("class", "class", "availability-slots"), ("class", "class", "hours-of-operation"),
    ("class", "has", "office-hours"), ("class", "has", "practice-hours"), ("class", "has", "appointment"), ("class", "has", "availability"), ("class", "has", "hours"),
    ("data-test", "is", "office-hours"), ("data-testid", "has", "hours"), ("id", "is", "office-hours"), ("id", "is", "practice-hours"), ("id", "has", "hours"),
)
#: The same: what a table, its first and its second cell, a list item and a block must hold.
_TABLE_WORDS, _DAY_CELL, _TIME_CELL = "hour|day|appointment|availability", "(?i)" + "|".join(d[:3] for d in _DAYS), r"(?i)\d{1,2}:\d{2}|am|pm|closed"
_DAY_NAME, _CLOCK, _SLOT = "(?i)" + "|".join(_DAYS), r"\d{1,2}:\d{2}", r"\d{1,2}:\d{2}\s*(?:am|pm|AM|PM)?"


def _timed(source: str, rank: Column, term: Column, text: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), rank.cast("int").alias("rank"), term.cast("string").alias("term"), text.alias("text"))


def _definitions(elements: Column) -> Column:
    """{source, rank, term, text} of definition lists that speak of hours or days: a definition among a list's children and the term right before it."""
    lists = F.filter(tagged(elements, "dl"), lambda dl: F.lower(text_of(dl)).rlike("hour|day"))

    def pairs(dl: Column) -> Column:
        told = F.transform(children(dl, "dt", "dd"), lambda e: F.struct(e["tag"].alias("tag"), text_of(e).alias("text")))
        before = F.concat(F.array(F.struct(F.lit("").alias("tag"), F.lit("").alias("text"))), told)
        both = F.transform(F.arrays_zip(before.alias("term"), told.alias("given")), lambda x: _timed("definition-list", F.lit(200), F.when((x["term"]["tag"] == "dt") & (x["term"]["text"] != "") & (x["given"]["tag"] == "dd"), x["term"]["text"]), x["given"]["text"]))
        return F.filter(both, lambda x: x["term"].isNotNull())

    return F.flatten(F.transform(lists, pairs))


def _row_times(elements: Column) -> Column:
    """The same of tables that speak of hours, days or appointments: rows whose first cell is a day or whose second is a time."""
    tables = F.filter(tagged(elements, "table"), lambda x: F.lower(text_of(x)).rlike(_TABLE_WORDS))
    rows = F.flatten(F.transform(tables, lambda x: below(x, "tr")))
    cells = F.transform(rows, lambda r: F.transform(F.slice(below(r, "td", "th"), 1, 2), text_of))
    told = F.filter(cells, lambda c: (F.get(c, F.lit(0)) != "") & (F.get(c, F.lit(1)) != "") & (F.get(c, F.lit(0)).rlike(_DAY_CELL) | F.get(c, F.lit(1)).rlike(_TIME_CELL)))
    return F.transform(told, lambda c: _timed("table", F.lit(100), F.get(c, F.lit(0)), F.get(c, F.lit(1))))


def timings_from_pages(pages: DataFrame) -> DataFrame:
    """(page_id, day, slots, status, raw_text, source): elements by class, id or data, then rows of tables, definitions, list items and blocks.

    Each day, slots and status once, the first found kept; neither a day nor a time gives nothing.
    """
    tree, none, every = element_tree(pages.select("page_id", "html")), F.lit(None), F.col("elements")
    marked = F.transform(every, lambda e: F.struct(_first_selector(e, _TIMED).alias("rank"), e.alias("e")))
    marked = F.transform(F.filter(marked, lambda x: x["rank"].isNotNull()), lambda x: _timed("selector", x["rank"], none, text_of(x["e"])))
    marked = F.filter(marked, lambda x: F.length(x["text"]).between(6, 999))
    items = F.filter(F.transform(inside(("ul", "ol"), "li"), text_of), lambda x: (F.length(x) < 200) & (x.rlike(_DAY_NAME) | x.rlike(_CLOCK)))
    blocks = F.filter(F.transform(tagged(every, "div"), text_of), lambda x: F.length(x).between(11, 149) & x.rlike(f"(?i)^(?:{'|'.join(_DAYS)})") & x.rlike(_CLOCK))
    one = lambda source, rank: lambda x: _timed(source, F.lit(rank), none, x)
    found = F.concat(marked, _row_times(every), _definitions(every), F.transform(items, one("list", 300)), F.transform(blocks, one("div", 400)))
    rows = tree.select("page_id", F.posexplode(found).alias("place", "e")).select("page_id", "place", "e.*")
    day = F.coalesce(day_of(F.coalesce("term", "text")), F.col("term"))
    raw = F.when(F.col("source") == "selector", F.substring("text", 1, 300)).otherwise(F.concat_ws(": ", "term", "text"))
    timed = rows.select("page_id", "rank", "place", day.alias("day"), slots_of(F.col("text")).alias("slots"), open_status(F.col("text")).alias("status"), raw.alias("raw_text"), "source").where("day is not null or slots <> ''")
    once = Window.partitionBy("page_id", "day", "slots", "status").orderBy("rank", "place")
    return timed.withColumn("r", F.row_number().over(once)).where("r = 1").select("page_id", "day", "slots", "status", "raw_text", "source")


def merge_timings(timings: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, day, slots, status, scraped_from): timings (id, source, day, slots, status) of several sources, the same day and slots once,
    from the source of least rank; sources: (source, rank)."""
    ranked = timings.join(sources, "source")
    once = Window.partitionBy("id", F.coalesce("day", F.lit("")), F.coalesce("slots", F.lit(""))).orderBy("rank", "status")
    return ranked.withColumn("r", F.row_number().over(once)).where("r = 1").select("id", "day", "slots", "status", F.col("source").alias("scraped_from"))


def definition_timings(pages: DataFrame) -> DataFrame:
    """(page_id, place, day, slots, status, raw_text) of definition lists that speak of hours or days: a term is the day of the next definition.

    A second definition of the same term has no day and is passed over.
    """
    told = element_tree(pages.select("page_id", "html")).select("page_id", F.posexplode(_definitions(F.col("elements"))).alias("place", "e")).select("page_id", "place", "e.term", "e.text")
    return told.select("page_id", "place", F.coalesce(day_of(F.col("term")), F.col("term")).alias("day"), slots_of(F.col("text")).alias("slots"), open_status(F.col("text")).alias("status"), F.concat_ws(": ", "term", "text").alias("raw_text"))


def slots_of(c: Column) -> Column:
    """The times of a text, comma-joined."""
    return F.array_join(F.regexp_extract_all(c, F.lit(_SLOT), F.lit(0)), ",")


def day_of(c: Column) -> Column:
    """The first weekday that a text names."""
    day = F.lit(None).cast("string")
    for d in reversed(_DAYS):
        day = F.when(F.lower(c).contains(d.lower()), d).otherwise(day)
    return day


def open_status(c: Column) -> Column:
    """CLOSED, BY_APPOINTMENT or OPEN as a text says, null if it says nothing."""
    low = F.lower(c)
    return F.when(low.contains("closed"), "CLOSED").when(low.contains("by appointment") | low.contains("appointment only"), "BY_APPOINTMENT").when(low.contains("open") | c.rlike(r"\d{1,2}:\d{2}"), "OPEN")


#: How names of hospitals and places are written.
_HOSPITALS = (r"([A-Z][a-zA-Z\s&'-]+(?:Hospital|Medical Center|Health System|Clinic|Healthcare|Medical Group))", r"([A-Z][a-zA-Z\s&'-]{5,}(?:Hospital|Medical|Clinic|Health))")
_PLACE = r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*),\s*([A-Z]{2})"


def hospital_name(c: Column) -> Column:
    """The hospital that a text names; a short text (fewer than 100 characters) that speaks of one is taken whole."""
    speaks = (F.lower(c).contains("hospital") | F.lower(c).contains("medical center")) & (F.length(c) < 100)
    return F.coalesce(*[t.trim(_find(c, p)) for p in _HOSPITALS], F.when(speaks, t.trim(c)))


def place_of(c: Column) -> Column:
    """"City, ST" of a text."""
    return F.when(c.rlike(_PLACE), F.concat_ws(", ", F.regexp_extract(c, _PLACE, 1), F.regexp_extract(c, _PLACE, 2)))


#: Directories that are searched by name, boards by state, hospitals by a part of the city's name.
_BY_NAME = ("https://www.healthgrades.com/search?what={0}&where=&pageNum=1", "https://doctor.webmd.com/find-a-doctor/search?q={0}", "https://www.vitals.com/search?q={0}")
_BY_NAME_AND_CITY = "https://www.zocdoc.com/search/?dr_specialty=&address={1}&insurance_carrier=-1&searchQueryGuid=&search_query={0}"
_BOARDS = {"MD": "https://www.mbp.state.md.us/bpqapp/", "VA": "https://www.dhp.virginia.gov/lookup/", "CA": "https://search.dca.ca.gov/", "NY": "https://www.nysed.gov/online-verifications-professional-licenses", "TX": "https://profile.tmb.state.tx.us/OnlineVerification", "FL": "https://mqa-internet.doh.state.fl.us/MQASearchServices/HealthCareProviders"}
_CITIES = (
    (("baltimore",), ("https://www.hopkinsmedicine.org/find-a-doctor", "https://www.medstarhealth.org/doctors")), (("cleveland",), ("https://my.clevelandclinic.org/staff",)),
    (("new york", "nyc"), ("https://www.mountsinai.org/profiles", "https://www.nyp.org/physician")), (("boston",), ("https://www.massgeneral.org/doctors", "https://www.brighamandwomens.org/find-a-doctor")),
    (("philadelphia",), ("https://www.pennmedicine.org/find-a-doctor",)), (("chicago",), ("https://www.nm.org/doctors",)),
    (("los angeles", "la"), ("https://www.cedars-sinai.org/find-a-doctor",)), (("houston",), ("https://www.houstonmethodist.org/doctor",)),
)
_REGISTRY_PAGE = "https://npiregistry.cms.hhs.gov/provider-view/"


def url_frontier(entities: DataFrame) -> DataFrame:
    """(id, place, url): the addresses at which to look for an entity, in order, each once: its website, registry page, directories, boards and hospitals."""
    has = lambda c: F.length(c) > 0
    encoded = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    name, city = encoded(F.col("name")), encoded(F.col("city"))
    filled = lambda pattern: F.concat(*[x for part in pattern.replace("{0}", "\0name\0").replace("{1}", "\0city\0").split("\0") if part for x in [name if part == "name" else city if part == "city" else F.lit(part)]])
    website = F.col("website") if "website" in entities.columns else F.lit(None).cast("string")
    urls = [F.when(has(website), website), F.when(has(F.col("npi_id")), F.concat(F.lit(_REGISTRY_PAGE), "npi_id"))]
    urls += [F.when(has(F.col("name")), filled(p)) for p in _BY_NAME] + [F.when(has(F.col("name")) & has(F.col("city")), filled(_BY_NAME_AND_CITY))]
    board = F.lit(None).cast("string")
    for state, url in _BOARDS.items():
        board = F.when((F.upper("state") == state) & has(t.last_name(F.col("name"))), url).otherwise(board)
    near = F.array().cast("array<string>")
    for parts, found in reversed(_CITIES):
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.lower("city").contains(part)
        near = F.when(hit & has(F.col("name")), F.array(*map(F.lit, found))).otherwise(near)
    every = F.array_distinct(F.array_compact(F.concat(F.array(*urls, board), near)))
    return entities.select("id", F.posexplode(every).alias("place", "url"))


def affiliations(pages: DataFrame) -> DataFrame:
    """(page_id, name): elements that name a hospital or medical centre, once each by lower-cased name, the first kept."""
    found = F.transform(tagged(F.col("elements"), "li", "p", "h1", "h2", "h3", "h4", "h5", "h6", "a"), lambda e: t.collapse(text_of(e)))
    rows = element_tree(pages.select("page_id", "html")).select("page_id", F.posexplode(found).alias("place", "name")).where("length(name) between 3 and 99")
    named = rows.where(F.lower("name").rlike("hospital|medical cent|clinic|affiliat|facility"))
    return named.groupBy("page_id", F.lower("name").alias("k")).agg(F.min_by("name", "place").alias("name")).drop("k")


#: Selectors of elements that name hospitals, by source and in order.
_AFFILIATED = {
    "HEALTHGRADES": (("class", "class", "hospital-affiliations"), ("class", "has", "hospital"), ("class", "has", "affiliation"), ("data-test", "is", "hospital"), ("class", "class", "practice-locations")),
    "VITALS": (("class", "has", "hospital"), ("class", "has", "affiliation"), ("class", "has", "facility")),
    "WEBMD": (("class", "has", "hospital"), ("class", "has", "facility"), ("class", "has", "location")),
}


def source_affiliations(pages: DataFrame) -> DataFrame:
    """(provider_id, name, location, role, status, kind, source): hospitals that the pages of three directories name, each once a provider.

    pages: (provider_id, source, html, city, state). The first source's list items count too. Sources, selectors and places tell which is first;
    without a place of its own a hospital is where the provider is.
    """
    tree, every = element_tree(pages.select("provider_id", "source", "city", "state", "html")), F.col("elements")
    ranked = lambda e: F.coalesce(*[F.when(F.col("source") == source, _first_selector(e, selectors)) for source, selectors in _AFFILIATED.items()])
    marked = F.filter(F.transform(every, lambda e: F.struct(ranked(e).alias("rank"), text_of(e).alias("text"))), lambda x: x["rank"].isNotNull())
    speaking = F.filter(F.transform(tagged(every, "li"), text_of), lambda x: F.lower(x).rlike("hospital|medical center"))
    items = F.when(F.col("source") == "HEALTHGRADES", F.transform(speaking, lambda x: F.struct(F.lit(100).alias("rank"), x.alias("text")))).otherwise(F.array().cast("array<struct<rank: int, text: string>>"))
    rows = tree.select("provider_id", "source", "city", "state", F.posexplode(F.concat(marked, items)).alias("place", "e")).select("*", "e.*")
    order = F.coalesce(*[F.when(F.col("source") == source, i) for i, source in enumerate(_AFFILIATED)])
    named = rows.select("provider_id", "source", "place", order.alias("order"), "rank", hospital_name(F.col("text")).alias("name"), F.coalesce(place_of(F.col("text")), F.concat_ws(", ", "city", "state")).alias("location"))
    kept = named.where("name is not null and (rank < 100 or length(name) > 5)")
    once = Window.partitionBy("provider_id", F.lower(t.trim(F.col("name")))).orderBy("order", "rank", "place", "name", "location")
    told = kept.withColumn("r", F.row_number().over(once)).where("r = 1")
    return told.select("provider_id", "name", "location", F.lit("Physician").alias("role"), F.lit("ACTIVE").alias("status"), F.lit("HOSPITAL").alias("kind"), "source")


def merge_affiliations(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(provider_id, name, role, status, kind): found before stored, each name once; blanks get their defaults."""
    rows = found.withColumn("rank", F.lit(0)).unionByName(stored.withColumn("rank", F.lit(1)), allowMissingColumns=True)
    default = {"name": "Unknown Hospital", "role": "Physician", "status": "ACTIVE", "kind": "HOSPITAL"}
    filled = rows.select("provider_id", "rank", *[F.coalesce(t.blank_to_null(F.col(c)), F.lit(d)).alias(c) for c, d in default.items()])
    once = Window.partitionBy("provider_id", F.lower(t.trim(F.col("name")))).orderBy("rank", "name", "role")
    return filled.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r", "rank")


def merge_listings(sources: DataFrame, columns=("phone", "address", "website")) -> DataFrame:
    """(provider_id, columns): each column's first value in the order of sources."""
    return sources.where("is_found").groupBy("provider_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("source_id"))).alias(c) for c in columns])


def profile_links(pages: DataFrame, path: str = "/", site: str = "https://site.example.com") -> DataFrame:
    """(page_id, link): the first link of a page whose address contains path, made absolute."""
    links = F.filter(_all(F.col("html"), r'(?i)href="([^"]*)"'), lambda x: x.contains(path))
    link = F.get(links, F.lit(0))
    return pages.select("page_id", F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(site), link)).alias("link")).where("link is not null")


#: By source, what the address of a profile contains, and the site it belongs to.
_PROFILES = {
    "HEALTHGRADES": ("/physician/", "https://www.healthgrades.com"), "VITALS": ("/doctors/", "https://www.vitals.com"),
    "WEBMD": ("/doctor/", "https://doctor.webmd.com"), "DOXIMITY": ("/pub/", "https://www.doximity.com"),
}


def source_profiles(pages: DataFrame) -> DataFrame:
    """(page_id, source, profile_url): the first link on a directory's search page to a profile there, made absolute; one to a search is none."""
    tree, url = element_tree(pages.select("page_id", "source", "html")), F.lit(None).cast("string")
    links = F.transform(tagged(F.col("elements"), "a"), lambda e: attribute(e, "href"))
    for source, (path, site) in _PROFILES.items():
        first = F.get(F.filter(links, lambda x: x.contains(path)), F.lit(0))
        if source == "DOXIMITY":
            first = F.when(~first.contains("/search"), first)
        url = F.when(F.col("source") == source, F.when(first.startswith("http"), first).otherwise(F.concat(F.lit(site), first))).otherwise(url)
    return tree.select("page_id", "source", url.alias("profile_url")).where("profile_url is not null")


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row, name, specialty, license_number, license_state, license_status, affiliations, hours, accepting_new_patients, telehealth,
    phone, address) of table rows with 7 cells or more; an eighth is the contact. Rows without a name or whose name says "provider" are headings."""
    listed = element_tree(pages.select("page_id", "html")).select("page_id", "page_text", "elements", F.posexplode(inside(("table",), "tr")).alias("row", "r"))
    rows = listed.select("page_id", "row", F.transform(below(F.col("r"), "td"), lines_of).alias("c"))
    cell = lambda i: F.get("c", F.lit(i))
    listed = rows.where((F.size("c") >= 7) & (cell(0) != "") & ~F.lower(cell(0)).contains("provider"))
    said = lambda label: t.trim(_find(cell(2), rf"(?i){label}:\s*([^\n]+)"))
    yes = lambda i: F.lower(cell(i)).contains("yes")
    contact = F.coalesce(cell(7), F.lit(""))
    return listed.select(
        "page_id", "row", cell(0).alias("name"), cell(1).alias("specialty"), said("License Number").alias("license_number"), said("State").alias("license_state"), said("Status").alias("license_status"),
        cell(3).alias("affiliations"), cell(4).alias("hours"), yes(5).alias("accepting_new_patients"), yes(6).alias("telehealth"),
        t.trim(_find(contact, r"\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}", 0)).alias("phone"), t.trim(_find(contact, r"(?i)Address:\s*(.+?)(?:\n|\z)")).alias("address"),
    )
