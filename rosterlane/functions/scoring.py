"""Confidence, decisions and statuses as column expressions. All weights and limits are parameters with the usual values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much each listed source counts in a vote; others count 0.
SOURCE_WEIGHTS = {"npi": 0.95, "azure": 0.85, "scrape": 0.70, "pdf": 0.60}
#: What each matching source contributes to a record's confidence.
RECORD_WEIGHTS = {"npi": 0.35, "license": 0.25, "website": 0.20, "phone": 0.20}
AUTHORITATIVE = ("NPI_API", "NPI_CERTIFICATIONS")


def valid_score(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)


def strict_confidence(source: Column, address: Column, phone: Column) -> Column:
    """0.5 source + 0.3 address + 0.2 phone; anything but numbers from 0 to 1 fails the query."""
    ok = valid_score(source) & valid_score(address) & valid_score(phone)
    return F.when(ok, 0.5 * source + 0.3 * address + 0.2 * phone).otherwise(F.raise_error(F.lit("scores must be finite numbers from 0 to 1")))


def try_confidence(source: Column, address: Column, phone: Column) -> tuple[Column, Column]:
    """(score or null, error): the quarantine form of strict_confidence."""
    parts = (source, address, phone)
    finite = [p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf")) for p in parts]
    error = F.when(~(finite[0] & finite[1] & finite[2]), "TYPE").when(~(valid_score(source) & valid_score(address) & valid_score(phone)), "RANGE")
    return F.when(error.isNull(), 0.5 * source + 0.3 * address + 0.2 * phone), error


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def final_score(source: Column, address: Column, phone: Column, authoritative: Column | None = None, multiple: Column | None = None) -> Column:
    """The base score, lifted by 1.3 for an authoritative source and by 1.15 for several, each capped at 1."""
    s, a, p = map(_clamp, (source, address, phone))
    base = 0.5 * s + 0.3 * a + 0.2 * p
    lifted = F.when(F.coalesce(authoritative, F.lit(False)), F.least(F.lit(1.0), F.greatest(base, s) * 1.3)).otherwise(base) if authoritative is not None else base
    return F.when(F.coalesce(multiple, F.lit(False)), F.least(F.lit(1.0), lifted * 1.15)).otherwise(lifted) if multiple is not None else lifted


def source_weight(source: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in SOURCE_WEIGHTS.items():
        out = F.when(source == name, weight).otherwise(out)
    return out


def source_vote(source: Column, matched: Column) -> Column:
    """Aggregate: the matched sources' share of the listed sources' weight."""
    total = F.sum(source_weight(source))
    return F.when(total > 0, F.sum(F.when(matched, source_weight(source)).otherwise(0.0)) / total).otherwise(0.0)


def record_confidence(contributions: dict[str, Column], failed: Column, conflicts: Column, hard_reject: Column) -> Column:
    base = sum((c * RECORD_WEIGHTS[k] for k, c in contributions.items()), F.lit(0.0))
    return F.when(hard_reject, 0.0).otherwise(F.greatest(F.lit(0.0), base - 0.05 * failed - 0.10 * conflicts))


def level(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def needs_review(score: Column, conflicts: Column, failed: Column, hard_reject: Column) -> Column:
    return (score < 0.65) | (conflicts > 0) | (failed > 0) | hard_reject


def severity(score: Column) -> Column:
    return F.when(score < 0.4, "HIGH").when(score < 0.65, "MEDIUM").otherwise("LOW")


def recommendation(review: Column, hard_reject: Column) -> Column:
    return F.when(hard_reject, "REJECT").when(review, "NEEDS_REVIEW").otherwise("APPROVE")


def route(score: Column, review: Column) -> Column:
    return F.when((score >= 0.65) & ~review, "approved").otherwise("needs_review")


def legacy_action(score: Column) -> Column:
    return F.when(score >= 0.45, "AUTO_ACCEPT").otherwise("NEEDS_REVIEW")


def legacy_severity(score: Column) -> Column:
    return F.when(score >= 0.45, "LOW").otherwise("HIGH")


def issue_action(given: Column, source: Column, confidence: Column) -> Column:
    return F.coalesce(given, F.when(source.isin(*AUTHORITATIVE) | (confidence >= 0.75), "AUTO_ACCEPT").otherwise("NEEDS_REVIEW"))


def issue_status(action: Column) -> Column:
    return F.when(action == "INFORMATIONAL", "ACCEPTED").otherwise("OPEN")
