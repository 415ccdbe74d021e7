"""Counters, summaries, latency and cost reports over issues, runs, metrics and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED = ("ACCEPTED", "ACCEPTED BY PROVIDER")
REJECTED = ("REJECTED", "REJECTED BY PROVIDER")


def issues_with_entity(issues: DataFrame, entities: DataFrame) -> DataFrame:
    of = entities.select(F.col("id").alias("provider_id"), "name", "phone", "email", "npi_id")
    return issues.join(of, "provider_id", "left")


def entities_with_issue_count(entities: DataFrame, issues: DataFrame) -> DataFrame:
    counted = issues.groupBy(F.col("provider_id").alias("id")).agg(F.count("*").alias("n"))
    return entities.join(counted, "id", "left").withColumn("issue_count", F.coalesce("n", F.lit(0))).drop("n")


def entities_of_run(entities: DataFrame, issues: DataFrame, run_id: int) -> DataFrame:
    ids = issues.where(F.col("run_id") == run_id).select(F.col("provider_id").alias("id")).distinct()
    return entities.join(ids, "id", "left_semi")


def run_counters(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, total_providers, needs_review, success_count, success_providers): open issues, and what remains of the providers (Q12: by
    issues; success_providers counts providers without an open issue)."""
    opened = issues.where("status = 'OPEN'").groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("open"), F.countDistinct("provider_id").alias("open_providers"))
    review, hit = F.coalesce("open", F.lit(0)), F.coalesce("open_providers", F.lit(0))
    return runs.join(opened, "id", "left").select("id", "total_providers", review.alias("needs_review"), F.greatest(F.lit(0), F.col("total_providers") - review).alias("success_count"), (F.col("total_providers") - hit).alias("success_providers"))


def issue_summary_provider(issues: DataFrame) -> DataFrame:
    return issues.groupBy("provider_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "OPEN").alias("pending"),
        F.count_if(F.col("status").isin(*ACCEPTED)).alias("accepted"), F.count_if(F.col("status").isin(*REJECTED)).alias("rejected"),
    )


def issue_summary_run(issues: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, total, auto_accept, needs_review, minutes, seconds) with the run's duration."""
    counts = issues.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(F.col("action") == "AUTO_ACCEPT").alias("auto_accept"), F.count_if(F.col("action") == "NEEDS_REVIEW").alias("needs_review"))
    spent = (F.unix_timestamp(F.col("completed_at").cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))).cast("long")
    times = runs.select(F.col("id").alias("run_id"), F.floor(spent / 60).alias("minutes"), (spent % 60).alias("seconds"))
    return counts.join(times, "run_id", "left")


def first_issues(issues: DataFrame, n: int = 10) -> DataFrame:
    """The first n issues of each provider and run, with their number and how many remain."""
    by = Window.partitionBy("provider_id", "run_id")
    numbered = issues.withColumn("place", F.row_number().over(by.orderBy("id"))).withColumn("total", F.count("*").over(by))
    return numbered.where(F.col("place") <= n).withColumn("remaining", F.greatest(F.lit(0), F.col("total") - n))


def dashboard(entities: DataFrame, runs: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: providers, runs, reviews and the rest (which may be negative: Q13)."""
    review = run_counters(runs, issues).agg(F.count("*").alias("runs"), F.sum("needs_review").alias("needs_review"))
    total = entities.agg(F.count("*").alias("providers"))
    return total.join(F.broadcast(review)).select("providers", "runs", "needs_review", (F.col("providers") - F.col("needs_review")).alias("validated"))


def latest_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(n)


def record_counters(validated: DataFrame) -> DataFrame:
    """(run_id, processed, success_count, needs_review_count, failed_count) of validated records (run_id, ok, needs_review): one that failed needs review."""
    failed, review = ~F.coalesce("ok", F.lit(False)), F.coalesce("needs_review", F.lit(False))
    return validated.groupBy("run_id").agg(F.count("*").alias("processed"), F.count_if(~failed & ~review).alias("success_count"), F.count_if(failed | review).alias("needs_review_count"), F.count_if(failed).alias("failed_count"))


def batch_outcome(validated: DataFrame) -> DataFrame:
    """(run_id, total, successful, failed, needs_review, mean_ms, total_ms) of records (run_id, ok, needs_review, ms)."""
    ok, spent = F.coalesce("ok", F.lit(False)), F.coalesce("ms", F.lit(0))
    return validated.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed"), F.count_if(F.coalesce("needs_review", F.lit(False))).alias("needs_review"),
        (F.sum(spent) / F.count("*")).alias("mean_ms"), F.sum(spent).alias("total_ms"),
    )


def search_issues(issues: DataFrame, entities: DataFrame, term: str = "", state: str = "all") -> DataFrame:
    """Issues whose provider's name or npi contains term (any case) and that are open, closed or either."""
    rows = issues_with_entity(issues, entities)
    if term:
        low = term.lower()
        rows = rows.where(F.coalesce(F.lower("name").contains(low), F.lit(False)) | F.coalesce(F.col("npi_id").contains(low), F.lit(False)))
    return rows.where({"all": F.lit(True), "open": F.col("status") == "OPEN", "closed": F.col("status") != "OPEN"}[state])


def issues_to_announce(issues: DataFrame, least: float = 0.60) -> DataFrame:
    """Issues that need review or are less sure than `least`."""
    return issues.where((F.col("action") == "NEEDS_REVIEW") | (F.col("confidence") < least))


def trace_errors(spans: DataFrame) -> DataFrame:
    """(parent_run_id, n_errors, errors): the names and errors of failed spans (error not null), in order."""
    failed = spans.where("error is not null")
    return failed.groupBy("parent_run_id").agg(F.count("*").alias("n_errors"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "id", "name", "error"))), lambda x: F.concat_ws(": ", x["name"], x["error"])), "; ").alias("errors"))


def progress(runs: DataFrame, now: str) -> DataFrame:
    """(id, pct, eta_seconds) at a given time."""
    elapsed = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    left = F.greatest(F.lit(0), F.col("total_providers") - F.col("processed"))
    return runs.select("id", F.floor(F.col("processed") / F.col("total_providers") * 100 + 0.5).cast("long").alias("pct"), F.when(F.col("processed") > 0, left * (elapsed / F.col("processed"))).alias("eta_seconds"))


def export_gate(issues: DataFrame) -> DataFrame:
    """(run_id, open_issues, allowed): a run may be exported without open issues."""
    return issues.groupBy("run_id").agg(F.count_if(F.col("status") == "OPEN").alias("open_issues"), (F.count_if(F.col("status") == "OPEN") == 0).alias("allowed"))


EXTRA = ("certification", "appointment_availability", "availability_status")


def export_run(entities: DataFrame, issues: DataFrame, run_id: int) -> DataFrame:
    """The rows of a run's export: its providers, and three columns of their latest suggestions; a certification of their own comes first.

    A run that has no issue, or one that is open, exports nothing: see export_gate().
    """
    mine = issues.where(F.col("run_id") == run_id)
    values = mine.where(F.col("field_name").isin(*EXTRA)).groupBy(F.col("provider_id").alias("id")).pivot("field_name", list(EXTRA)).agg(F.max_by("suggested_value", "id"))
    rows = entities_of_run(entities, issues, run_id).join(values, "id", "left")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = F.when(F.length("primary_certification") > 0, F.col("primary_certification")) if "primary_certification" in entities.columns else F.lit(None).cast("string")
    rows = rows.withColumn("certification", F.coalesce(own, "certification"))
    return rows.select("id", *[blank(c) for c in ("name", "npi_id", "phone", "email", "address_line1", "city", "state", "zip", "speciality", *EXTRA)])


def latency_per_provider(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("provider_id").agg(F.count("*").alias("n"), F.avg("workflow_latency_ms").alias("avg_latency_ms"), F.sum("total_tokens").alias("tokens"), F.sum("estimated_cost_usd").alias("cost_usd"))


def daily_summary(metrics: DataFrame, now: str, days: int = 30) -> DataFrame:
    recent = metrics.where(F.col("created_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    return recent.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.avg("workflow_latency_ms").alias("avg_latency_ms"), F.sum("total_tokens").alias("tokens"), F.sum("estimated_cost_usd").alias("cost_usd"))


def node_latency(metrics: DataFrame, json_col: str = "per_node_latency") -> DataFrame:
    """(id, node, latency_ms): a JSON list of {name, latency_ms} per row, unnested."""
    return metrics.select("id", F.explode(F.from_json(json_col, "array<struct<name: string, latency_ms: bigint>>")).alias("x")).select("id", F.col("x.name").alias("node"), F.col("x.latency_ms").alias("latency_ms"))


def span_latency(spans: DataFrame) -> DataFrame:
    """(parent_run_id, workflow_ms, children_ms, nodes): from the first start to the last end, and the sum of the children's own times."""
    timed = spans.where("start_time is not null and latency_ms is not null")
    start = F.unix_millis(F.col("start_time").cast("timestamp"))
    return timed.groupBy("parent_run_id").agg((F.max(start + F.col("latency_ms")) - F.min(start)).alias("workflow_ms"), F.sum("latency_ms").alias("children_ms"), F.count("*").alias("nodes"))


def workflow_latency(spans: DataFrame) -> DataFrame:
    """(id, workflow_ms, children_ms, nodes, per_node) of spans without a parent: their own time, and that of their children in order of start.

    spans: (id, parent_run_id, name, run_type, start_time, end_time). A span without both times takes none: 0 for a parent, left out of the nodes for a child.
    """
    ms = F.unix_millis(F.col("end_time").cast("timestamp")) - F.unix_millis(F.col("start_time").cast("timestamp"))
    timed = spans.select("id", "parent_run_id", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("run_type", F.lit("unknown")).alias("run_type"), "start_time", ms.alias("latency_ms"))
    nodes = F.array_sort(F.collect_list(F.struct("start_time", "id", "name", "run_type", "latency_ms")))
    children = timed.where("parent_run_id is not null and latency_ms is not null").groupBy(F.col("parent_run_id").alias("id")).agg(F.sum("latency_ms").alias("children_ms"), F.count("*").alias("nodes"), nodes.alias("per_node"))
    parents = timed.where("parent_run_id is null").select("id", F.coalesce("latency_ms", F.lit(0)).alias("workflow_ms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return parents.join(children, "id", "left").select("id", "workflow_ms", zero("children_ms"), zero("nodes"), F.transform("per_node", lambda x: F.struct(x["name"], x["run_type"], x["latency_ms"])).alias("per_node"))


def token_cost(spans: DataFrame, price_in: str = "0.001", price_out: str = "0.002") -> DataFrame:
    """(parent_run_id, prompt_tokens, completion_tokens, total_tokens, cost_usd) of the model calls among the spans; prices are for 1,000 tokens, costs decimals of 6 places."""
    calls = lambda c: F.sum(F.when(F.col("run_type") == "llm", F.coalesce(c, F.lit(0))).otherwise(0))
    sums = spans.groupBy("parent_run_id").agg(calls("prompt_tokens").alias("prompt_tokens"), calls("completion_tokens").alias("completion_tokens"))
    cost = lambda c, price: F.col(c).cast("decimal(18,0)") * F.lit(price).cast("decimal(12,9)") / F.lit(1000).cast("decimal(4,0)")
    total = F.round(cost("prompt_tokens", price_in) + cost("completion_tokens", price_out), 6).cast("decimal(18,6)")
    return sums.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens")).withColumn("cost_usd", total)


def trace_summary(spans: DataFrame) -> DataFrame:
    """(parent_run_id, nodes, total_ms, sequence)."""
    order = F.array_sort(F.collect_list(F.struct("start_time", "id", "name")))
    return spans.groupBy("parent_run_id").agg(F.count("*").alias("nodes"), F.sum("latency_ms").alias("total_ms"), F.array_join(F.transform(order, lambda x: x["name"]), " -> ").alias("sequence"))


def trace_analysis(spans: DataFrame) -> DataFrame:
    """(parent_run_id, name, ms, share_pct, slowest, fastest): each node's share of its trace."""
    nodes = spans.groupBy("parent_run_id", "name").agg(F.sum("latency_ms").alias("ms"))
    by = Window.partitionBy("parent_run_id")
    share = F.when(F.sum("ms").over(by) > 0, F.round(F.col("ms") / F.sum("ms").over(by) * 100, 6)).otherwise(0.0)
    first = lambda c: F.row_number().over(by.orderBy(c, "name")) == 1
    return nodes.select("parent_run_id", "name", "ms", share.alias("share_pct"), first(F.desc("ms")).alias("slowest"), first(F.asc("ms")).alias("fastest"))


def costly_runs(metrics: DataFrame, entities: DataFrame, runs: DataFrame, over: float, n: int = 20) -> DataFrame:
    dear = metrics.where(F.col("estimated_cost_usd") > over).withColumnRenamed("id", "metric_id")
    joined = dear.join(entities.select(F.col("id").alias("provider_id"), "name"), "provider_id").join(runs.select(F.col("id").alias("run_id"), "started_at"), "run_id")
    return joined.orderBy(F.desc("estimated_cost_usd"), "metric_id").limit(n).select("metric_id", "name", "run_id", "estimated_cost_usd")


def batch_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("workflow_latency_ms") > 0).alias("successes"), F.sum("workflow_latency_ms").alias("total_ms"), F.avg("workflow_latency_ms").alias("avg_ms"), F.sum("total_tokens").alias("tokens"), F.sum("estimated_cost_usd").alias("cost_usd"))
