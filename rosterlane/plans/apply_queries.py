"""Queries of applying issues, and of snapshots after replacing or deleting rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlane.operators import resolve as a

from .registry import query

_COLUMN = """CASE lower(replace(trim(field_name), ' ', '_')) WHEN 'phone' THEN 'phone' WHEN 'address' THEN 'address_line1' WHEN 'zip_code' THEN 'zip' WHEN 'specialty' THEN 'speciality'
  WHEN 'certification' THEN 'primary_certification' WHEN 'npi' THEN 'npi_id' END"""
_SHOWN = ("phone", "address_line1", "zip", "speciality", "npi_id")


def _entities(t):
    return t("providers").select("id", *_SHOWN, "status")


def _applied(where: str, value: str = "suggested_value", source: str = "validation_issues", activate: bool = True) -> str:
    """DuckDB: providers with the latest value per column of the issues that meet where."""
    latest = f"(SELECT provider_id, col, arg_max(v, id) AS v FROM (SELECT id, provider_id, {_COLUMN} AS col, {value} AS v, * FROM {source}) z WHERE {where} AND v IS NOT NULL AND col IS NOT NULL GROUP BY 1, 2)"
    columns = ", ".join(f"coalesce(max(CASE WHEN x.col = '{c}' THEN x.v END), any_value(p.{c})) AS {c}" for c in _SHOWN)
    touched = ", ".join(f"'{c}'" for c in _SHOWN)
    status = f"CASE WHEN count(CASE WHEN x.col IN ({touched}) THEN 1 END) > 0 THEN 'ACTIVE' ELSE any_value(p.status) END" if activate else "any_value(p.status)"
    return f"SELECT p.id, {columns}, {status} AS status FROM providers p LEFT JOIN {latest} x ON p.id = x.provider_id GROUP BY p.id"


@query("auto_apply", "providers validation_issues", _applied("status = 'OPEN' AND action = 'AUTO_ACCEPT'"))
def auto(t):
    return a.auto_apply(_entities(t), t("validation_issues"))[0]


_AUTO = f"""CASE WHEN status <> 'OPEN' THEN 'closed' WHEN action <> 'AUTO_ACCEPT' THEN 'review' WHEN {_COLUMN} IS NULL THEN 'review' WHEN suggested_value IS NULL THEN 'skipped' ELSE 'applied' END"""


@query("auto_apply_issues", "validation_issues", f"SELECT id, {_AUTO} AS outcome, CASE WHEN {_AUTO} = 'applied' THEN 'ACCEPTED' ELSE status END AS status FROM validation_issues", )
def auto_issues(t):
    return a.auto_apply(_entities(t), t("validation_issues"))[1].select("id", "outcome", "status")


@query("auto_apply_review", "validation_issues", f"SELECT provider_id, bool_or({_AUTO} = 'review') AS needs_review FROM validation_issues WHERE status = 'OPEN' GROUP BY 1")
def auto_review(t):
    return a.auto_apply(_entities(t), t("validation_issues"))[2]


@query("accept_issues", "providers validation_issues", _applied("status = 'OPEN' AND id % 2 = 0"))
def accept(t):
    return a.accept_issues(_entities(t), t("validation_issues"), t("decisions").where("decision = 'accept'"))[0]


@query("accept_outcomes", "validation_issues", f"""
SELECT id, {_COLUMN} AS "column", CASE WHEN suggested_value IS NULL THEN 'REJECTED' WHEN {_COLUMN} IS NULL THEN 'UNMAPPED' ELSE 'ACCEPTED BY PROVIDER' END AS outcome FROM validation_issues WHERE status = 'OPEN' AND id % 2 = 0""")
def outcomes(t):
    return a.accept_issues(_entities(t), t("validation_issues"), t("decisions").where("decision = 'accept'"))[1].select("id", "column", "outcome")


@query("reject_issues", "providers validation_issues", _applied("status = 'OPEN' AND id % 2 = 1", "'c' || CAST(id AS VARCHAR)", activate=False))
def reject(t):
    return a.reject_issues(_entities(t), t("validation_issues"), t("decisions"))[0]


@query("accept_all_run", "providers validation_issues", _applied("status = 'OPEN' AND run_id = 1996"))
def all_run(t):
    return a.accept_all(_entities(t), t("validation_issues"), 1996)[0]


@query("accept_all_counts", "validation_issues", f"""
SELECT count(*) FILTER (suggested_value IS NOT NULL AND {_COLUMN} IS NOT NULL) AS success, count(*) FILTER (suggested_value IS NOT NULL AND {_COLUMN} IS NULL) AS failed,
  count(*) FILTER (suggested_value IS NULL) AS auto_rejected FROM validation_issues WHERE status = 'OPEN' AND run_id = 1996""")
def all_counts(t):
    return a.accept_all(_entities(t), t("validation_issues"), 1996)[2]


@query("reject_all_run", "validation_issues", "SELECT id, CASE WHEN run_id = 1996 AND status = 'OPEN' THEN 'REJECTED' ELSE status END AS status FROM validation_issues")
def none_run(t):
    return a.reject_all(t("validation_issues"), 1996).select("id", "status")


@query("accept_all_provider", "providers validation_issues", _applied("status = 'OPEN' AND provider_id = 7"))
def one_provider(t):
    return a.accept_all_of_provider(_entities(t), t("validation_issues"), 7)[0]


@query("replace_issues", "validation_issues", """
SELECT id, run_id, status FROM validation_issues WHERE NOT (run_id = 1996 AND provider_id IN (SELECT provider_id FROM validation_issues WHERE run_id = 1996 AND id % 3 = 0))
UNION ALL SELECT id, run_id, 'NEW' FROM validation_issues WHERE run_id = 1996 AND id % 3 = 0""")
def replaced(t):
    issues = t("validation_issues")
    new = issues.where("run_id = 1996 and id % 3 = 0").withColumn("status", F.lit("NEW"))
    return a.replace_issues(issues, new).select("id", "run_id", "status")


@query("delete_cascade", "providers validation_issues provider_sources", """
SELECT 'providers' AS name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM providers WHERE id % 10 <> 0 UNION ALL
SELECT 'issues', count(*), CAST(sum(id) AS BIGINT) FROM validation_issues WHERE provider_id % 10 <> 0 UNION ALL SELECT 'sources', count(*), CAST(sum(source_id) AS BIGINT) FROM provider_sources WHERE provider_id % 10 <> 0""")
def cascade(t):
    left = a.delete_cascade(t("providers").where("id % 10 = 0"), providers=t("providers"), issues=t("validation_issues"), sources=t("provider_sources"))
    parts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(k).alias("ids")) for (n, df), k in zip(left.items(), ("id", "id", "source_id"), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
