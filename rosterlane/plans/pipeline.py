"""The whole validation run as one lazy plan: check, look up, compare, score, reduce to issues."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlane.functions import text as t
from rosterlane.operators import compare as c
from rosterlane.operators import match as m
from rosterlane.operators import validate as v


@dataclass
class Run:
    scored: DataFrame  # a row per entity: score, route, recommendation, discrepancies
    issues: DataFrame  # a row per entity and field


_TIMINGS = "array<struct<day: string, time_slots: array<string>, status: string>>"


def wide_rows(entities: DataFrame, registry: DataFrame, sources: DataFrame, licenses: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """An entity per row with its rule issues, a struct per source and the outcomes of all sources; absent sources are null.

    licenses: (provider_id, license_status). listing: (provider_id, timings, availability_status). Entities are read once; each source
    is one join.
    """
    own = v.validate_entities(entities).select("issues", "missing", "hard_reject", "input_ok", F.get("errors", F.lit(0)).alias("__error"), c.held_values(entities).alias("held"), *v.standard_columns(entities))
    known = registry.select(F.col("npi").alias("__npi"), F.struct(F.concat_ws(" ", "first_name", "last_name").alias("name"), F.col("telephone_number").alias("phone"), F.concat_ws(", ", "address_1", "city", "state", "postal_code").alias("address")).alias("npi"), F.struct(F.col("taxonomy_desc").alias("name"), "license").alias("certification"))
    seen = lambda kind: sources.where((F.col("source_type") == kind) & F.col("is_found")).groupBy(F.col("provider_id").alias("id")).agg(F.min_by(F.struct("phone", "address"), "source_id").alias("s"))
    joined = own.drop("website").withColumnRenamed("npi", "own_npi").join(known, t.blank_to_null(F.col("own_npi")) == F.col("__npi"), "left").drop("__npi")
    for kind, name in (("SCRAPING_ENRICHMENT", "website"), ("AZURE_POI", "maps")):
        joined = joined.join(seen(kind).withColumnRenamed("s", name), "id", "left")
    if licenses is None:
        joined = joined.withColumn("license_status", F.lit(None).cast("string"))
    else:
        joined = joined.join(licenses.select(F.col("provider_id").alias("id"), "license_status"), "id", "left")
    if listing is None:
        joined = joined.withColumn("listing", F.lit(None).cast(f"struct<timings: {_TIMINGS}, availability_status: string>"))
    else:
        joined = joined.join(listing.select(F.col("provider_id").alias("id"), F.struct("timings", "availability_status").alias("listing")), "id", "left")
    phone = F.col("phone")
    verified = t.blank_to_null(phone).isNotNull() & phone.rlike(v.PHONE)
    return with_outcomes(joined.withColumn("phone_verified", verified))


def with_outcomes(wide: DataFrame) -> DataFrame:
    """wide with outcomes: (source, success, error) of the input check, registry, licences, map service and certifications; and the sources used and failed."""
    asked = t.blank_to_null(F.col("own_npi")).isNotNull()
    has = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    told = [
        ("INPUT_VALIDATION", F.col("input_ok"), F.col("__error")), ("NPI_API", F.col("npi").isNotNull(), F.lit("NPI_NOT_FOUND")), ("LICENSE_REGISTRY", has(F.col("license_status")), F.lit("LICENSE_NOT_FOUND")),
        ("AZURE_MAPS", has(F.col("maps.address")), F.lit("NO_RESULTS")), ("NPI_CERTIFICATIONS", has(F.col("certification.name")), F.when(asked, "CERTIFICATIONS_NOT_FOUND").otherwise("NPI_NOT_PROVIDED")),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("source"), ok.alias("success"), F.when(~ok, error).alias("error")) for n, ok, error in told])
    names = lambda ok: F.transform(F.filter("outcomes", lambda x: x["success"] == ok), lambda x: x["source"])
    return wide.withColumn("outcomes", rows).drop("__error").withColumn("used_sources", names(True)).withColumn("failed_sources", names(False))


def source_outcomes(wide: DataFrame) -> DataFrame:
    """(id, source, success, error): the outcome log, a row per entity and source."""
    return wide.select("id", F.explode("outcomes").alias("o")).select("id", "o.*")


def run_validation(entities: DataFrame, registry: DataFrame, sources: DataFrame, licenses: DataFrame | None = None, listing: DataFrame | None = None) -> Run:
    compared = c.compare_current(wide_rows(entities, registry, sources, licenses, listing))
    return Run(c.score_entities(compared), c.best_suggestions(compared))


def report(run: Run, status: DataFrame, validated_at: Column | None = None) -> DataFrame:
    """A validation report per entity: id, validated_at (of the run; now, unless given), confidence (score, level, contributions, penalties), directory_status, needs_review, severity,
    recommendation, sources_used, sources_failed, n_issues, and discrepancies (the issues' field, code, source, old value, suggestion and confidence)."""
    one = F.struct("field", "rule_order", "code", "source_type", "old_value", "suggested", "confidence")
    found = run.issues.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("discrepancies"))
    penalties = F.struct(F.round(0.05 * F.col("failures"), 6).alias("sources"), F.round(0.10 * F.col("conflicts"), 6).alias("conflicts"))
    own = run.scored.select("id", F.struct("score", "level", "contributions", penalties.alias("penalties")).alias("confidence"), F.col("review").alias("needs_review"), F.col("record_severity").alias("severity"), "recommendation", F.col("used_sources").alias("sources_used"), F.col("failed_sources").alias("sources_failed"))
    at = F.current_timestamp() if validated_at is None else validated_at
    rows = own.withColumn("validated_at", at).join(status.select("id", "directory_status"), "id", "left").join(found, "id", "left")
    return rows.withColumn("n_issues", F.coalesce("n", F.lit(0))).withColumn("discrepancies", F.coalesce("discrepancies", F.array().cast("array<struct<field: string, rule_order: int, code: string, source_type: string, old_value: string, suggested: string, confidence: double>>"))).drop("n")
