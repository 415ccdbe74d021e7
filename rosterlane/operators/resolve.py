"""Applying issues to the directory: each operator returns new snapshots instead of changing rows in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlane.functions import text as t

#: Which column a field name stands for. Names that stand for themselves follow.
FIELD_COLUMNS = {
    "address": "address_line1", "address_line1": "address_line1", "address_line_1": "address_line1", "address_line2": "address_line2", "address_line_2": "address_line2",
    "zip": "zip", "zip_code": "zip", "speciality": "speciality", "specialty": "speciality", "license": "license_number", "license_number": "license_number",
    "certification": "primary_certification", "primary_certification": "primary_certification", "certifications": "certifications_json", "certifications_json": "certifications_json",
    "affiliations": "affiliations_json", "affiliations_json": "affiliations_json", "npi": "npi_id", "npi_id": "npi_id",
} | {c: c for c in ("name", "phone", "email", "city", "state", "license_status", "license_state", "npi_raw_data", "website", "provider_code", "taxonomy_code", "accepting_new_patients", "telehealth_available")}


def column_of(field: Column) -> Column:
    """The directory column of a field name, null if there is none."""
    names = F.create_map(*[F.lit(x) for pair in FIELD_COLUMNS.items() for x in pair])
    return F.element_at(names, t.normalize_field_name(field))


#: Columns that hold a boolean, and columns that hold JSON.
BOOLEANS = ("accepting_new_patients", "telehealth_available")
JSONS = ("certifications_json", "affiliations_json", "npi_raw_data")


def coerce_value(column: str, value: Column, kind: str) -> Column:
    """A text as a value of a directory column: yes, true and 1 are true; JSON columns get compact JSON, or the text itself if it is none."""
    if column in BOOLEANS:
        return t.truthy(value).cast(kind)
    if column in JSONS:
        parsed = F.try_parse_json(value)
        return F.coalesce(F.to_json(parsed), value).cast(kind)
    return value.cast(kind)


def apply_values(entities: DataFrame, values: DataFrame, activate: bool = True) -> DataFrame:
    """entities with the latest value (by issue id) of values (provider_id, column, value, id) written; touched rows become ACTIVE."""
    targets = [c for c in dict.fromkeys(FIELD_COLUMNS.values()) if c in entities.columns]
    latest = values.where(F.col("column").isin(*targets)).groupBy(F.col("provider_id").alias("id"), "column").agg(F.max_by("value", "id").alias("value"))
    wide = latest.groupBy("id").pivot("column", targets).agg(F.first("value"))
    wide = wide.select("id", *[F.col(c).alias(f"__{c}") for c in targets], F.lit(True).alias("__touched"))
    joined = entities.join(wide, "id", "left")
    new = [F.coalesce(coerce_value(c, F.col(f"__{c}"), entities.schema[c].dataType.simpleString()), F.col(c)).alias(c) if c in targets else F.col(c) for c in entities.columns]
    if activate and "status" in entities.columns:
        new = [F.when(F.col("__touched"), "ACTIVE").otherwise(F.col("status")).alias("status") if c == "status" else n for c, n in zip(entities.columns, new, strict=True)]
    return joined.select(*new)


def auto_apply(entities: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, issues, review): open issues of any run. AUTO_ACCEPT ones with a value and a column are applied and become ACCEPTED;
    the other ones with a value leave the provider for review; an AUTO_ACCEPT one without value is passed over."""
    opened = F.col("status") == "OPEN"
    judged = issues.withColumn("column", column_of(F.col("field_name")))
    auto = F.col("action") == "AUTO_ACCEPT"
    applied = opened & auto & F.col("column").isNotNull() & F.col("suggested_value").isNotNull()
    outcome = F.when(~opened, "closed").when(~auto, "review").when(F.col("column").isNull(), "review").when(F.col("suggested_value").isNull(), "skipped").otherwise("applied")
    marked = judged.withColumn("outcome", outcome)
    new_entities = apply_values(entities, marked.where(applied).select("provider_id", "column", F.col("suggested_value").alias("value"), "id"))
    new_issues = marked.withColumn("status", F.when(applied, "ACCEPTED").otherwise(F.col("status"))).drop("column")
    review = marked.where(opened).groupBy("provider_id").agg(F.bool_or(F.col("outcome") == "review").alias("needs_review"))
    return new_entities, new_issues, review


def accept_issues(entities: DataFrame, issues: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, outcomes): the named issues one decision each. Only open ones count; without value REJECTED, without column an error, else applied."""
    asked = issues.join(ids.select(F.col("issue_id").alias("id")).distinct(), "id", "left_semi").withColumn("column", column_of(F.col("field_name")))
    outcome = F.when(F.col("status") != "OPEN", "NOT_OPEN").when(F.col("suggested_value").isNull(), "REJECTED").when(F.col("column").isNull(), "UNMAPPED").otherwise("ACCEPTED BY PROVIDER")
    judged = asked.withColumn("outcome", outcome)
    values = judged.where("outcome = 'ACCEPTED BY PROVIDER'").select("provider_id", "column", F.col("suggested_value").alias("value"), "id")
    return apply_values(entities, values), judged.select("id", "provider_id", "field_name", "column", "suggested_value", "outcome")


def reject_issues(entities: DataFrame, issues: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, outcomes): rejected issues; a corrected value is written where its field has a column. Not only open issues may be rejected."""
    asked = issues.join(decisions.where("decision = 'reject'").select(F.col("issue_id").alias("id"), "correct_value"), "id").withColumn("column", column_of(F.col("field_name")))
    values = asked.where("correct_value is not null and column is not null").select("provider_id", "column", F.col("correct_value").alias("value"), "id")
    return apply_values(entities, values, activate=False), asked.select("id", "provider_id", "column", "correct_value", F.lit("REJECTED BY PROVIDER").alias("outcome"))


def accept_all(entities: DataFrame, issues: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, issues, counts) of a run: open issues without value are REJECTED, without column stay OPEN (failed), the others ACCEPTED."""
    mine = (F.col("run_id") == run_id) & (F.col("status") == "OPEN")
    judged = issues.withColumn("column", column_of(F.col("field_name")))
    new = F.when(~mine, F.col("status")).when(F.col("suggested_value").isNull(), "REJECTED").when(F.col("column").isNull(), "OPEN").otherwise("ACCEPTED")
    marked = judged.withColumn("was_open", mine).withColumn("status", new)
    values = marked.where("was_open and status = 'ACCEPTED'").select("provider_id", "column", F.col("suggested_value").alias("value"), "id")
    of = lambda s: F.count_if(F.col("was_open") & (F.col("status") == s))
    counts = marked.agg(of("ACCEPTED").alias("success"), of("OPEN").alias("failed"), of("REJECTED").alias("auto_rejected"))
    return apply_values(entities, values), marked.drop("column", "was_open"), counts


def reject_all(issues: DataFrame, run_id: int) -> DataFrame:
    return issues.withColumn("status", F.when((F.col("run_id") == run_id) & (F.col("status") == "OPEN"), "REJECTED").otherwise(F.col("status")))


def accept_all_of_provider(entities: DataFrame, issues: DataFrame, provider_id: int) -> tuple[DataFrame, DataFrame]:
    """One combined update of a provider from its open issues; all of them become ACCEPTED."""
    mine = (F.col("provider_id") == provider_id) & (F.col("status") == "OPEN")
    values = issues.where(mine & F.col("suggested_value").isNotNull()).select("provider_id", F.coalesce(column_of(F.col("field_name")), t.normalize_field_name(F.col("field_name"))).alias("column"), F.col("suggested_value").alias("value"), "id")
    return apply_values(entities, values), issues.withColumn("status", F.when(mine, "ACCEPTED").otherwise(F.col("status")))


def directory_status(entities: DataFrame, issues: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, directory_status, entity_status, alert_type, alert_severity, alert): any ACCEPTED issue publishes; else by the record's recommendation."""
    accepted = issues.where("status = 'ACCEPTED'").groupBy(F.col("provider_id").alias("id")).agg(F.count("*").alias("ok"))
    joined = entities.select("id").join(scored.select("id", "recommendation", "score", "record_severity"), "id").join(accepted, "id", "left")
    status = F.when(F.col("ok") > 0, "MANUAL_ACCEPT").when(F.col("recommendation") == "REJECT", "REJECTED").when(F.col("recommendation") == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("PUBLISHED")
    judged = joined.withColumn("directory_status", status)
    pick = lambda **by: F.element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else x for pair in by.items() for x in pair]), F.col("directory_status"))
    percent = F.concat(F.format_string("%.1f", F.round(F.col("score") * 100, 1)), F.lit("%)"))
    alert = pick(
        MANUAL_ACCEPT=F.concat(F.lit("Provider has "), F.col("ok").cast("string"), F.lit(" manually accepted issue(s) - status set to ACTIVE")),
        REJECTED=F.lit("Provider rejected due to missing or invalid required fields"),
        NEEDS_REVIEW=F.concat(F.lit("Provider requires human review (confidence: "), percent),
        PUBLISHED=F.concat(F.lit("Provider auto-published (confidence: "), percent),
    )
    return judged.select(
        "id", "directory_status", F.when(F.col("directory_status").isin("MANUAL_ACCEPT", "PUBLISHED"), "ACTIVE").otherwise(F.col("directory_status")).alias("entity_status"),
        pick(MANUAL_ACCEPT="MANUAL_REVIEW_COMPLETED", REJECTED="REJECTED", NEEDS_REVIEW="REVIEW_REQUIRED", PUBLISHED="AUTO_PUBLISHED").alias("alert_type"),
        pick(MANUAL_ACCEPT="LOW", REJECTED="HIGH", NEEDS_REVIEW=F.coalesce("record_severity", F.lit("MEDIUM")), PUBLISHED="LOW").alias("alert_severity"), alert.alias("alert"),
    )


def directory_entries(entities: DataFrame, status: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, name, npi, specialty, address, phone, confidence, verified_level): the published entities as rows of the public directory."""
    published = status.where("directory_status = 'PUBLISHED'").select("id")
    own = entities.select("id", "name", F.col("npi_id").alias("npi"), F.col("speciality").alias("specialty"), F.col("address_line1").alias("address"), "phone")
    return own.join(published, "id", "left_semi").join(scored.select("id", F.col("score").alias("confidence"), F.col("level").alias("verified_level")), "id")


def review_tasks(status: DataFrame, scored: DataFrame) -> DataFrame:
    """(id, reason, priority): a task for each reason of an entity that waits for review."""
    waiting = status.where("directory_status = 'NEEDS_REVIEW'").select("id")
    return scored.join(waiting, "id", "left_semi").select("id", F.explode("reasons").alias("reason"), F.col("record_severity").alias("priority"))


def upload_validations(uploads: DataFrame, status: DataFrame, scored: DataFrame) -> DataFrame:
    """(file_id, id, source_type, validation_status, confidence_score, needs_review, n_discrepancies): what became of uploaded entities (file_id, id)."""
    told = scored.select("id", F.col("score").alias("confidence_score"), F.col("review").alias("needs_review"), F.size("discrepancies").alias("n_discrepancies"))
    joined = uploads.join(status.select("id", F.col("directory_status").alias("validation_status")), "id", "left").join(told, "id", "left")
    return joined.select("file_id", "id", F.lit("PDF_UPLOAD").alias("source_type"), "validation_status", F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), F.coalesce("needs_review", F.lit(False)).alias("needs_review"), F.coalesce("n_discrepancies", F.lit(0)).alias("n_discrepancies"))


def replace_issues(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the providers and runs of new, and new: running it again changes nothing."""
    keys = new.select("provider_id", "run_id").distinct()
    return old.join(keys, ["provider_id", "run_id"], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_cascade(ids: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the deleted entities; the entity table itself is keyed by id, the others by provider_id."""
    out = {}
    for name, df in dependents.items():
        key = "provider_id" if "provider_id" in df.columns else "id"
        out[name] = df.join(ids.select(F.col("id").alias(key)), key, "left_anti")
    return out


def delete_runs(run_ids: DataFrame, runs: DataFrame, **dependents: DataFrame) -> dict[str, DataFrame]:
    """runs without the deleted ones (run_id), and each dependent table (issues, metrics) without their rows."""
    out = {"runs": runs.join(run_ids.select(F.col("run_id").alias("id")), "id", "left_anti")}
    return out | {name: df.join(run_ids.select("run_id"), "run_id", "left_anti") for name, df in dependents.items()}
