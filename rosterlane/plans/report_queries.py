"""Queries of counters, summaries, latency and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlane.operators import report as r
from rosterlane.operators import resolve as a
from rosterlane.sources import entities as s
from rosterlane.sources.shared import scratch

from .registry import query

_COUNTERS = """
SELECT r.id, r.total_providers, coalesce(o.n, 0) AS needs_review, greatest(0, r.total_providers - coalesce(o.n, 0)) AS success_count, r.total_providers - coalesce(o.p, 0) AS success_providers
FROM validation_runs r LEFT JOIN (SELECT run_id, count(*) AS n, count(DISTINCT provider_id) AS p FROM validation_issues WHERE status = 'OPEN' GROUP BY 1) o ON r.id = o.run_id"""


@query("run_counters", "validation_runs validation_issues", _COUNTERS)
def counters(t):
    return r.run_counters(t("validation_runs"), t("validation_issues"))


@query("issue_summary_provider", "validation_issues", """
SELECT provider_id, count(*) AS total, count(*) FILTER (status = 'OPEN') AS pending, count(*) FILTER (status IN ('ACCEPTED', 'ACCEPTED BY PROVIDER')) AS accepted,
  count(*) FILTER (status IN ('REJECTED', 'REJECTED BY PROVIDER')) AS rejected FROM validation_issues GROUP BY provider_id""")
def by_provider(t):
    return r.issue_summary_provider(t("validation_issues"))


@query("issue_summary_run", "validation_issues validation_runs", """
SELECT i.run_id, i.total, i.auto_accept, i.needs_review, CAST(floor(s / 60) AS BIGINT) AS minutes, CAST(s % 60 AS BIGINT) AS seconds FROM
  (SELECT run_id, count(*) AS total, count(*) FILTER (action = 'AUTO_ACCEPT') AS auto_accept, count(*) FILTER (action = 'NEEDS_REVIEW') AS needs_review FROM validation_issues GROUP BY 1) i
  LEFT JOIN (SELECT id, CAST(epoch(CAST(completed_at AS TIMESTAMP)) - epoch(CAST(started_at AS TIMESTAMP)) AS BIGINT) AS s FROM validation_runs) r ON i.run_id = r.id""")
def by_run(t):
    return r.issue_summary_run(t("validation_issues"), t("validation_runs"))


@query("top_issues", "validation_issues", """
SELECT provider_id, run_id, id, place, greatest(0, total - 2) AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY provider_id, run_id ORDER BY id) AS place, count(*) OVER (PARTITION BY provider_id, run_id) AS total
  FROM validation_issues) x WHERE place <= 2""")
def top(t):
    return r.first_issues(t("validation_issues"), 2).select("provider_id", "run_id", "id", "place", "remaining")


@query("dashboard", "providers validation_runs validation_issues", f"""
SELECT (SELECT count(*) FROM providers) AS providers, count(*) AS runs, CAST(sum(needs_review) AS BIGINT) AS needs_review, CAST((SELECT count(*) FROM providers) - sum(needs_review) AS BIGINT) AS validated FROM ({_COUNTERS}) c""")
def dash(t):
    return r.dashboard(t("providers"), t("validation_runs"), t("validation_issues"))


@query("latest_runs", "validation_runs", "SELECT id, processed FROM validation_runs ORDER BY started_at DESC, id DESC LIMIT 5")
def runs(t):
    return r.latest_runs(t("validation_runs")).select("id", "processed")


@query("progress_eta", "validation_runs", """
SELECT id, CAST(floor(processed / total_providers * 100 + 0.5) AS BIGINT) AS pct, greatest(0, total_providers - processed) *
  ((epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(CAST(started_at AS TIMESTAMP))) / processed) AS eta_seconds FROM validation_runs""")
def eta(t):
    return r.progress(t("validation_runs"), "2000-01-01 00:00:00")


@query("export_gate", "validation_issues", "SELECT run_id, count(*) FILTER (status = 'OPEN') AS open_issues, count(*) FILTER (status = 'OPEN') = 0 AS allowed FROM validation_issues GROUP BY run_id")
def gate(t):
    return r.export_gate(t("validation_issues"))


@query("export_directory", "providers", "SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in s.DIRECTORY_COLUMNS) + " FROM providers")
def directory(t):
    return s.directory_rows(t("providers"))


_LAST = "(SELECT provider_id, suggested_value AS v FROM validation_issues WHERE run_id = 1996 AND field_name = '{0}' QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY id DESC) = 1) x{1}"


@query("export_run", "providers validation_issues", "SELECT p.id, " + ", ".join(f"coalesce(p.{c}, '') AS {c}" for c in ("name", "npi_id", "phone", "email", "address_line1", "city", "state", "zip", "speciality")) + ", " + ", ".join(f"coalesce(x{k}.v, '') AS {c}" for k, c in enumerate(r.EXTRA)) + " FROM providers p " + " ".join(f"LEFT JOIN {_LAST.format(c, k)} ON p.id = x{k}.provider_id" for k, c in enumerate(r.EXTRA)) + " WHERE p.id IN (SELECT provider_id FROM validation_issues WHERE run_id = 1996)")
def export(t):
    return r.export_run(t("providers"), t("validation_issues"), 1996)


@query("latency_per_provider", "validation_run_metrics", """
SELECT provider_id, count(*) AS n, round(avg(workflow_latency_ms), 6) AS avg_latency_ms, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(estimated_cost_usd), 6) AS cost_usd FROM validation_run_metrics GROUP BY 1""")
def latency(t):
    return r.latency_per_provider(t("validation_run_metrics")).withColumns({c: F.round(c, 6) for c in ("avg_latency_ms", "cost_usd")})


@query("daily_summary", "validation_run_metrics", """
SELECT CAST(created_at AS DATE) AS day, count(*) AS n, round(avg(workflow_latency_ms), 6) AS avg_latency_ms, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(estimated_cost_usd), 6) AS cost_usd
FROM validation_run_metrics WHERE created_at >= TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 30 DAY GROUP BY 1""")
def daily(t):
    return r.daily_summary(t("validation_run_metrics"), "2024-02-01 00:00:00").withColumns({c: F.round(c, 6) for c in ("avg_latency_ms", "cost_usd")})


@query("node_latency_unnest", "spans", "SELECT parent_run_id AS id, name AS node, latency_ms FROM spans")
def unnest(t):
    packed = t("spans").groupBy(F.col("parent_run_id").alias("id")).agg(F.to_json(F.collect_list(F.struct("name", "latency_ms"))).alias("per_node_latency"))
    return r.node_latency(packed)


@query("span_latency", "spans", """
SELECT parent_run_id, max(epoch_us(CAST(start_time AS TIMESTAMP)) // 1000 + latency_ms) - min(epoch_us(CAST(start_time AS TIMESTAMP)) // 1000) AS workflow_ms, CAST(sum(latency_ms) AS BIGINT) AS children_ms, count(*) AS nodes
FROM spans WHERE start_time IS NOT NULL AND latency_ms IS NOT NULL GROUP BY 1""")
def spans(t):
    return r.span_latency(t("spans"))


@query("token_cost", "spans", """
SELECT parent_run_id, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, round(p / 1000 * 0.001 + c / 1000 * 0.002, 6) AS cost_usd FROM
  (SELECT parent_run_id, CAST(sum(CASE WHEN run_type = 'llm' THEN coalesce(prompt_tokens, 0) ELSE 0 END) AS BIGINT) AS p, CAST(sum(CASE WHEN run_type = 'llm' THEN coalesce(completion_tokens, 0) ELSE 0 END) AS BIGINT) AS c FROM spans GROUP BY 1) x""")
def cost(t):
    return r.token_cost(t("spans")).withColumn("cost_usd", F.col("cost_usd").cast("double"))


_SPAN_MS = "(epoch_us(CAST(end_time AS TIMESTAMP)) // 1000 - epoch_us(CAST(start_time AS TIMESTAMP)) // 1000)"


@query("workflow_latency", "run_spans", f"""
SELECT p.id, coalesce({_SPAN_MS}, 0) AS workflow_ms, coalesce(c.children_ms, 0) AS children_ms, coalesce(c.nodes, 0) AS nodes, c.per_node FROM run_spans p LEFT JOIN (
  SELECT parent_run_id, CAST(sum(ms) AS BIGINT) AS children_ms, count(*) AS nodes, string_agg(name || '/' || run_type || ' ' || CAST(ms AS VARCHAR), ', ' ORDER BY start_time, id) AS per_node FROM (
    SELECT parent_run_id, id, start_time, coalesce(name, 'unknown') AS name, coalesce(run_type, 'unknown') AS run_type, {_SPAN_MS} AS ms FROM run_spans) x WHERE ms IS NOT NULL AND parent_run_id IS NOT NULL GROUP BY 1) c ON p.id = c.parent_run_id
WHERE p.parent_run_id IS NULL""")
def workflows(t):
    told = F.array_join(F.transform("per_node", lambda n: F.concat(n["name"], F.lit("/"), n["run_type"], F.lit(" "), n["latency_ms"].cast("string"))), ", ")
    return r.workflow_latency(t("run_spans")).withColumn("per_node", told)


@query("trace_summary", "spans", "SELECT parent_run_id, count(*) AS nodes, CAST(sum(latency_ms) AS BIGINT) AS total_ms, string_agg(name, ' -> ' ORDER BY start_time, id) AS sequence FROM spans GROUP BY 1")
def summary(t):
    return r.trace_summary(t("spans"))


@query("trace_analysis", "spans", """
SELECT parent_run_id, name, ms, CASE WHEN sum(ms) OVER w > 0 THEN round(ms / sum(ms) OVER w * 100, 6) ELSE 0 END AS share_pct,
  row_number() OVER (PARTITION BY parent_run_id ORDER BY ms DESC, name) = 1 AS slowest, row_number() OVER (PARTITION BY parent_run_id ORDER BY ms, name) = 1 AS fastest
FROM (SELECT parent_run_id, name, CAST(sum(latency_ms) AS BIGINT) AS ms FROM spans GROUP BY 1, 2) x WINDOW w AS (PARTITION BY parent_run_id)""")
def analysis(t):
    return r.trace_analysis(t("spans"))


@query("costly_runs_top", "validation_run_metrics providers validation_runs", """
SELECT m.id AS metric_id, p.name, m.run_id, m.estimated_cost_usd FROM validation_run_metrics m JOIN providers p ON m.provider_id = p.id JOIN validation_runs r ON m.run_id = r.id
WHERE m.estimated_cost_usd > 0.001 ORDER BY m.estimated_cost_usd DESC, m.id LIMIT 20""")
def costly(t):
    return r.costly_runs(t("validation_run_metrics"), t("providers"), t("validation_runs"), 0.001)


@query("batch_metrics", "validation_run_metrics", """
SELECT run_id, count(*) AS n, count(*) FILTER (workflow_latency_ms > 0) AS successes, CAST(sum(workflow_latency_ms) AS BIGINT) AS total_ms, round(avg(workflow_latency_ms), 6) AS avg_ms,
  CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(estimated_cost_usd), 6) AS cost_usd FROM validation_run_metrics GROUP BY 1""")
def batch(t):
    return r.batch_metrics(t("validation_run_metrics")).withColumns({c: F.round(c, 6) for c in ("avg_ms", "cost_usd")})


@query("record_counters", "record_results", """
SELECT run_id, count(*) AS processed, count(*) FILTER (ok AND NOT needs_review) AS success_count, count(*) FILTER (NOT ok OR needs_review) AS needs_review_count, count(*) FILTER (NOT ok) AS failed_count FROM record_results GROUP BY 1""")
def records(t):
    return r.record_counters(t("record_results"))


@query("batch_outcome", "record_results", """
SELECT run_id, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (needs_review) AS needs_review, round(sum(ms) / count(*), 6) AS mean_ms, CAST(sum(ms) AS BIGINT) AS total_ms FROM record_results GROUP BY 1""")
def outcome(t):
    return r.batch_outcome(t("record_results")).withColumn("mean_ms", F.round("mean_ms", 6))


_FOUND = "SELECT i.id, i.status, p.name FROM validation_issues i LEFT JOIN providers p ON i.provider_id = p.id WHERE (contains(lower(p.name), 'given1') OR contains(coalesce(p.npi_id, ''), 'given1')) AND i.status {0} 'OPEN'"


@query("search_issues_open", "validation_issues providers", _FOUND.format("="))
def open_issues(t):
    return r.search_issues(t("validation_issues"), t("providers"), "Given1", "open").select("id", "status", "name")


@query("search_issues_closed", "validation_issues providers", _FOUND.format("<>"))
def closed_issues(t):
    return r.search_issues(t("validation_issues"), t("providers"), "Given1", "closed").select("id", "status", "name")


@query("issues_to_announce", "validation_issues", "SELECT id, action, confidence FROM validation_issues WHERE action = 'NEEDS_REVIEW' OR confidence < 0.60")
def announced(t):
    return r.issues_to_announce(t("validation_issues")).select("id", "action", "confidence")


@query("trace_errors", "spans", """
SELECT parent_run_id, count(*) AS n_errors, string_agg(name || ': E' || CAST(id % 5 AS VARCHAR), '; ' ORDER BY start_time, id) AS errors FROM spans WHERE id % 13 = 0 GROUP BY 1""")
def errors(t):
    return r.trace_errors(t("spans").withColumn("error", F.when(F.col("id") % 13 == 0, F.concat(F.lit("E"), (F.col("id") % 5).cast("string")))))


@query("delete_runs", "validation_runs validation_issues validation_run_metrics", """
SELECT 'runs' AS name, id AS run_id, count(*) AS n FROM validation_runs WHERE id NOT IN (1995, 1997) GROUP BY 2 UNION ALL SELECT 'issues', run_id, count(*) FROM validation_issues WHERE run_id NOT IN (1995, 1997) GROUP BY 2
UNION ALL SELECT 'metrics', run_id, count(*) FROM validation_run_metrics WHERE run_id NOT IN (1995, 1997) GROUP BY 2""")
def deleted(t):
    gone = t("validation_runs").where("id in (1995, 1997)").select(F.col("id").alias("run_id"))
    left = a.delete_runs(gone, t("validation_runs"), issues=t("validation_issues"), metrics=t("validation_run_metrics"))
    counted = [df.groupBy(F.lit(name).alias("name"), F.col("id" if name == "runs" else "run_id").alias("run_id")).agg(F.count("*").alias("n")) for name, df in left.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("csv_round_trip", "providers", """
SELECT CAST(id AS VARCHAR) AS provider_code, name, coalesce(phone, '') AS phone, address_line1, CAST(NULL AS VARCHAR) AS license_state, CAST(NULL AS VARCHAR) AS corrupt FROM providers""")
def round_trip(t):
    """The directory written as one CSV in the shared folder and read again."""
    rows = t("providers").select(F.col("id").alias("provider_id"), "name", "phone", "address_line1")
    path = scratch(rows.sparkSession)
    s.export_csv(rows, path, ("name",))
    return s.read_entities_csv(rows.sparkSession, path).select("provider_code", "name", F.coalesce("phone", F.lit("")).alias("phone"), "address_line1", "license_state", "corrupt")


@query("ocr_result_lines", "", "SELECT s_suppkey AS doc_id, 0 AS page, 0 AS line, trim(s_name) AS text FROM supplier UNION ALL SELECT s_suppkey, 0, CASE WHEN s_suppkey % 3 = 2 THEN 1 ELSE 2 END, 'no ' || CAST(s_nationkey AS VARCHAR) FROM supplier")
def result_lines(t):
    name, number = F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")), F.concat(F.lit("no "), F.col("s_nationkey").cast("string"))
    texts = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(name.alias("text")), F.struct(F.lit("").alias("text")), F.struct(number.alias("text"))).alias("lines"))).alias("readResults")))
    words = F.concat(F.lit('{"analyzeResult":{"readResults":[{"lines":[{"text":"'), "s_name", F.lit('"},"",{"words":[{"text":"no"},{"text":"'), F.col("s_nationkey").cast("string"), F.lit('"}]}]}]}}'))
    bare = F.to_json(F.array(F.struct(F.array(name, number).alias("lines"))))
    rows = t("supplier").select(F.col("s_suppkey").alias("doc_id"), F.when(F.col("s_suppkey") % 3 == 0, texts).when(F.col("s_suppkey") % 3 == 1, words).otherwise(bare).alias("result"))
    return s.read_ocr_lines(rows)


@query("append_sources", "provider_sources", "SELECT source_type, count(*) AS n, count(DISTINCT provider_id) AS entities, count(*) FILTER (is_found) AS found FROM provider_sources GROUP BY 1")
def appended(t):
    """Two appends to one folder; one source type is read as a partition, the others as the rest."""
    rows = t("provider_sources")
    path = scratch(rows.sparkSession)
    for half in (0, 1):
        s.append_sources(rows.where(F.col("provider_id") % 2 == half), path)
    read = rows.sparkSession.read.parquet(path)
    return read.groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("provider_id").alias("entities"), F.count_if("is_found").alias("found"))
