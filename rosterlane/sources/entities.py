"""Reading entities and OCR results, adding entities from a registry, and the exports and appends that follow a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlane.functions import text as t

CSV_COLUMNS = ("provider_id", "name", "phone", "email", "address_line1", "city", "state", "zip", "speciality", "license_number", "license_state")
_LINE = T.StructType([T.StructField("text", T.StringType()), T.StructField("words", T.ArrayType(T.StructType([T.StructField("text", T.StringType())])))])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, text): the records of CSV files, also those with line breaks in quotes, from files that are read in parts; first: a file's first one.

    A line begins a record where the quotes before it in its file are even in number: they are counted by line, summed within each part, and over the parts of a file.
    Lines of a record that crosses into the next part go with its first line. A file whose quotes are odd in number is cut at line ends.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part")).withColumn("at", F.monotonically_increasing_id())
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    within = Window.partitionBy("file", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    parts = lines.groupBy("file", "part").agg(F.sum("quotes").alias("quotes"))
    parts = parts.select("file", "part", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"), (F.sum("quotes").over(Window.partitionBy("file")) % 2 == 1).alias("odd"))
    counted = lines.withColumn("inside", F.coalesce(F.sum("quotes").over(within), F.lit(0))).join(parts, ["file", "part"])
    begins = F.col("odd") | ((F.col("before") + F.col("inside")) % 2 == 0)
    marked = counted.withColumn("begin", F.when(begins, F.struct("part", "at")))
    last = marked.groupBy("file", "part").agg(F.max("begin").alias("last"))
    carried = last.select("file", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    own = F.max("begin").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = marked.withColumn("own", own).join(carried, ["file", "part"]).withColumn("record", F.coalesce("own", "carried"))
    whole = placed.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("part", "at", "value"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    return whole.select("file", (F.col("record") == F.min("record").over(Window.partitionBy("file"))).alias("first"), text.alias("text"))


def read_entities_csv(spark: SparkSession, path: str) -> DataFrame:
    """The known columns of a CSV with a header, trimmed, and corrupt: the record where it doesn't fit the header, else null.

    provider_id becomes provider_code, the empty text null; blank lines and a mark at the start are skipped. Quoted fields may hold line breaks.
    """
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "multiLine": "true", "columnNameOfCorruptRecord": "__corrupt"}
    names = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join([f"`{c}` string" for c in names] + ["__corrupt string"])
    clean = [c.lstrip("\ufeff").strip() for c in names]
    records = csv_records(spark, path).where(F.trim("text") != "")
    heading = F.regexp_replace(F.regexp_replace("text", "[\ufeff\"]", ""), r"\s*,\s*", ",")
    rows = records.where(~(F.col("first") & (F.trim(heading) == ",".join(clean)))).select(F.from_csv("text", schema, options).alias("r")).select("r.*")
    raw = rows.toDF(*clean, "__corrupt")
    has = [c for c in CSV_COLUMNS if c in raw.columns]
    kept = raw.where(F.coalesce(*[t.blank_to_null(F.col(c)) for c in has]).isNotNull())
    value = lambda c: t.trim(F.col(c)) if c in has else F.lit(None).cast("string")
    return kept.select(t.blank_to_null(value("provider_id")).alias("provider_code"), *[value(c).alias(c) for c in CSV_COLUMNS[1:]], F.col("__corrupt").alias("corrupt"))


def read_ocr_lines(df: DataFrame, id_col: str = "doc_id", json_col: str = "result") -> DataFrame:
    """(doc_id, page, line, text) of OCR results: {analyzeResult: {readResults}}, {readResults} or a bare list of pages; a line is a text, {text} or {words}."""
    pages = "array<struct<lines: array<string>>>"
    shapes = [F.from_json(json_col, f"struct<analyzeResult: struct<readResults: {pages}>>")["analyzeResult"]["readResults"], F.from_json(json_col, f"struct<readResults: {pages}>")["readResults"], F.when(F.trim(json_col).startswith("["), F.from_json(json_col, pages))]
    lines = df.select(id_col, F.posexplode(F.coalesce(*shapes)).alias("page", "p")).select(id_col, "page", F.posexplode("p.lines").alias("line", "raw"))
    parsed = F.when(F.col("raw").startswith("{"), F.from_json("raw", _LINE))
    text = F.when(F.col("raw").startswith("{"), F.coalesce(parsed["text"], F.array_join(F.transform(parsed["words"], lambda w: w["text"]), " "))).otherwise(F.col("raw"))
    return lines.select(id_col, "page", "line", t.trim(text).alias("text")).where("text <> ''")


def entities_from_registry(asked: DataFrame, existing: DataFrame, registry: DataFrame) -> DataFrame:
    """(npi, outcome, name, phone, speciality, license_number, address columns): each distinct id is inserted, duplicate, not_found or invalid."""
    ids = asked.select(t.trim(F.col("npi")).alias("npi")).distinct()
    have = existing.select(F.col("npi_id").alias("npi"), F.lit(True).alias("have")).where("npi is not null").distinct()
    rows = registry_rows(registry).withColumn("known", F.lit(True))
    joined = ids.join(have, "npi", "left").join(rows, "npi", "left")
    outcome = F.when(~F.col("npi").rlike(r"^\d{10}\z"), "invalid").when(F.col("have"), "duplicate").when(F.col("known").isNull(), "not_found").otherwise("inserted")
    new = joined.withColumn("outcome", outcome)
    columns = [c for c in rows.columns if c not in ("npi", "known")]
    return new.select("npi", "outcome", *[F.when(F.col("outcome") == "inserted", F.col(c)).alias(c) for c in columns])


#: A registry entry as it is delivered: the basics, addresses by purpose, and taxonomies.
ENTRY = (
    "number string, basic struct<first_name: string, middle_name: string, last_name: string, organization_name: string>, "
    "addresses array<struct<address_purpose: string, address_1: string, city: string, state: string, postal_code: string, telephone_number: string>>, "
    "taxonomies array<struct<code: string, desc: string, primary: boolean, license: string, state: string>>"
)


def registry_from_entries(entries: DataFrame, primary: bool = True) -> DataFrame:
    """Flat registry rows of nested entries: the LOCATION address, else the first; the primary taxonomy, else (or without primary) the first.

    A lookup by id takes the first taxonomy, a search by name and a new entity the primary one.
    """
    address = F.coalesce(F.get(F.filter("addresses", lambda a: a["address_purpose"] == "LOCATION"), F.lit(0)), F.get("addresses", F.lit(0)))
    first = F.get("taxonomies", F.lit(0))
    taxonomy = F.coalesce(F.get(F.filter("taxonomies", lambda x: x["primary"]), F.lit(0)), first) if primary else first
    picked = entries.select(F.col("number").alias("npi"), "basic", address.alias("a"), taxonomy.alias("t"))
    basic = [F.col(f"basic.{c}").alias(c) for c in ("first_name", "middle_name", "last_name", "organization_name")]
    own = [F.col(f"a.{c}").alias(c) for c in ("telephone_number", "address_1", "city", "state", "postal_code")]
    return picked.select("npi", *basic, *own, F.col("t.desc").alias("taxonomy_desc"), F.col("t.license").alias("license"), F.col("t.code").alias("taxonomy_code"), F.coalesce("t.state", "a.state").alias("license_state"))


def certifications(entries: DataFrame) -> DataFrame:
    """(npi, certifications, specialty): the taxonomies that have a description, and the name of the primary one, else of the first."""
    named = F.filter("taxonomies", lambda x: F.length(x["desc"]) > 0)
    rows = F.transform(named, lambda x: F.struct(x["desc"].alias("name"), x["code"].alias("code"), F.coalesce(x["primary"], F.lit(False)).alias("is_primary"), x["license"].alias("license"), x["state"].alias("state")))
    told = entries.select(F.col("number").alias("npi"), F.coalesce(rows, F.array().cast("array<struct<name: string, code: string, is_primary: boolean, license: string, state: string>>")).alias("certifications"))
    return told.withColumn("primary", primary_certification(F.col("certifications"))).select("npi", "certifications", F.col("primary.name").alias("specialty"))


def primary_certification(rows: Column) -> Column:
    return F.coalesce(F.get(F.filter(rows, lambda c: c["is_primary"]), F.lit(0)), F.get(rows, F.lit(0)))


def registry_rows(registry: DataFrame) -> DataFrame:
    """Registry rows as entity rows: a person's or an organisation's name, formatted phone, specialty or its default."""
    org = F.col("organization_name") if "organization_name" in registry.columns else F.lit(None).cast("string")
    person = F.when(F.col("first_name").isNotNull() & F.col("last_name").isNotNull(), F.concat_ws(" ", "first_name", "middle_name", "last_name"))
    return registry.select(
        "npi",
        F.coalesce(person, org, F.lit("Unknown Provider")).alias("name"),
        t.format_phone(F.col("telephone_number")).alias("phone"),
        F.coalesce("taxonomy_desc", F.lit("General Practice")).alias("speciality"),
        F.col("license").alias("license_number"),
        F.coalesce(*[F.col(c) for c in ("license_state", "state") if c in registry.columns]).alias("license_state"),
        F.lit("Active").alias("license_status"),
        F.col("address_1").alias("address_line1"),
        "city", "state",
        F.col("postal_code").alias("zip"),
    )


DIRECTORY_COLUMNS = ("id", "name", "npi_id", "phone", "email", "address_line1", "city", "state", "speciality")


def directory_rows(entities: DataFrame) -> DataFrame:
    return entities.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIRECTORY_COLUMNS])


def export_csv(rows: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """One CSV over the folder's files in the order of their names: a header, then the rows in order (by the first column unless told), all fields quoted."""
    texts = rows.select(F.lit(1).alias("__at"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    header = rows.sparkSession.createDataFrame([(0, *rows.columns)], texts.schema)
    whole = header.unionByName(texts).orderBy("__at", *(order or rows.columns[:1]), *[c for c in rows.columns if c not in order])
    whole.drop("__at").write.option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)


def append_sources(rows: DataFrame, path: str) -> None:
    """Raw observations, partitioned by their source type."""
    rows.write.mode("append").partitionBy("source_type").parquet(path)
