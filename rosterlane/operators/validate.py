"""Standardisation and rule checks of entities: each a single projection, issues by one explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlane.functions import text as t

ISSUE = "struct<rule_order: int, field: string, code: string, severity: string, confidence: double, suggested: string>"


#: Fixed value: a valid phone number without its punctuation.
PHONE = r"^\+?1?\d{10}\z"


def standardize_entities(df: DataFrame) -> DataFrame:
    """(id, name, npi, address, phone, website, specialty, state, city, zip), all normalised."""
    return df.select(*standard_columns(df))


def standard_columns(df: DataFrame) -> list[Column]:
    state = F.upper(t.trim(F.col("state")))
    website = t.trim(F.col("website")) if "website" in df.columns else F.lit(None).cast("string")
    return [
        F.col("id"),
        t.normalize_text(F.col("name")).alias("name"),
        t.trim(F.col("npi_id")).alias("npi"),
        t.normalize_address(F.col("address_line1")).alias("address"),
        t.phone_with_plus(F.col("phone")).alias("phone"),
        website.alias("website"),
        t.normalize_text(F.col("speciality")).alias("specialty"),
        state.alias("state"),
        F.coalesce(t.blank_to_null(F.col("city")), t.extract_city(F.col("address_line1"))).alias("city"),
        F.coalesce(t.blank_to_null(F.col("zip")), t.extract_zip(F.col("address_line1"))).alias("zip"),
    ]


def npi_is_valid(npi: Column) -> Column:
    """Ten digits, the first 1 or 2, whose check digit holds with the prefix 80840."""
    return F.coalesce(npi.rlike(r"^[12]\d{9}\z") & F.call_function("luhn_check", F.concat(F.lit("80840"), npi)), F.lit(False))


def _issue(order: int, condition: Column, field: str, code: str, severity: str, confidence: float, suggested: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if suggested is None else suggested
    made = F.struct(F.lit(order).alias("rule_order"), F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), value.alias("suggested"))
    return F.when(condition, made)


def rule_issues() -> Column:
    """array of the rules that an entity row breaks, in the order of the rules."""
    blank = lambda c: t.blank_to_null(F.col(c)).isNull()
    phone, state, npi = t.phone_with_plus(F.col("phone")), F.upper(t.trim(F.col("state"))), t.trim(F.col("npi_id"))
    address = F.col("address_line1")
    required = [("name", "name"), ("address", "address_line1"), ("phone", "phone"), ("state", "state")]
    checks = [_issue(i, blank(c), f, "MISSING_REQUIRED_FIELD", "HIGH", 0.6) for i, (f, c) in enumerate(required)]
    checks += [
        _issue(4, ~blank("phone") & ~phone.rlike(PHONE), "phone", "INVALID_PHONE_FORMAT", "HIGH", 0.65, phone),
        _issue(5, ~blank("address_line1") & (t.extract_zip(address).isNull() | t.extract_state(address).isNull()), "address", "INVALID_ADDRESS_FORMAT", "HIGH", 0.6),
        _issue(6, ~blank("state") & ~state.isin(t.STATES), "state", "INVALID_STATE_CODE", "HIGH", 0.7),
        _issue(7, ~blank("npi_id") & ~npi.rlike(r"^\d{10}\z"), "npi", "INVALID_NPI_FORMAT", "MEDIUM", 0.6),
    ]
    return F.array_compact(F.array(*checks)).cast(f"array<{ISSUE}>")


def validate_entities(df: DataFrame) -> DataFrame:
    """df with issues, missing and malformed fields, hard_reject, input_ok and the error list."""
    judged = df.withColumn("issues", rule_issues())
    of = lambda p: F.transform(F.filter("issues", p), lambda x: x["field"])
    missing = of(lambda x: x["code"] == "MISSING_REQUIRED_FIELD")
    malformed = of(lambda x: x["code"] != "MISSING_REQUIRED_FIELD")
    hard = (F.size(missing) > 0) | F.array_contains(malformed, "address") | F.array_contains(malformed, "state")
    return judged.select(
        "*",
        missing.alias("missing"),
        malformed.alias("malformed"),
        hard.alias("hard_reject"),
        (F.size("issues") == 0).alias("input_ok"),
        F.transform("issues", lambda x: F.concat_ws(":", x["field"], x["code"])).alias("errors"),
    )


def entity_issues(df: DataFrame) -> DataFrame:
    """(id, rule_order, field, code, severity, confidence, suggested): a row per broken rule."""
    return df.select("id", F.explode(rule_issues()).alias("i")).select("id", "i.*")


def quarantine_metrics(metrics: DataFrame, columns=("workflow_latency_ms", "prompt_tokens", "completion_tokens", "total_tokens", "estimated_cost_usd")) -> DataFrame:
    """metrics with violations: the columns that are negative; empty where the row is valid."""
    bad = F.array_compact(F.array(*[F.when(F.col(c) < 0, F.lit(c)) for c in columns]))
    return metrics.withColumn("violations", bad)


def search_entities(df: DataFrame, status: str | None = None, name: str | None = None, anywhere: str | None = None) -> DataFrame:
    """Filters by status, by a part of the name (any case) and by a part of name, npi or specialty; wildcards stand for themselves."""
    if status is not None:
        df = df.where(F.col("status") == status)
    if name is not None:
        safe = name.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        df = df.where(F.col("name").ilike(f"%{safe}%"))
    if anywhere is not None:
        low = anywhere.lower()
        hit = [F.coalesce(F.lower(c).contains(low), F.lit(False)) for c in ("name", "npi_id", "speciality")]
        df = df.where(hit[0] | hit[1] | hit[2])
    return df


def review_complete(issues: DataFrame, decisions: DataFrame) -> DataFrame:
    """(provider_id, complete): every open issue is decided, and every rejection has a corrected value."""
    joined = issues.where("status = 'OPEN'").join(decisions, issues["id"] == decisions["issue_id"], "left")
    done = F.col("decision").isNotNull() & ((F.col("decision") != "reject") | F.coalesce(t.trim(F.col("correct_value")) != "", F.lit(False)))
    return joined.groupBy("provider_id").agg(F.bool_and(done).alias("complete"))
