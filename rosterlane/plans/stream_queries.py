"""Queries that run a stream to its end over the tables' files and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlane.sources.shared import exists, scratch
from rosterlane.sources.versions import VersionedTable
from rosterlane.streaming import streams as st

from . import run_oracle as o
from .pipeline import run_validation
from .registry import query
from .score_queries import listing_of


def _through(df: DataFrame, transform) -> DataFrame:
    """df as files, streamed through transform, read back."""
    spark, root = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(f"{root}/in")
    st.write_once(transform(st.read_files(spark, f"{root}/in", df.schema)), f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_validate", "providers", """
SELECT status, count(*) AS n, count(*) FILTER (name IS NULL OR address_line1 IS NULL OR phone IS NULL OR state = 'ZZ') AS rejected FROM providers GROUP BY status""")
def validated(t):
    out = _through(t("providers"), lambda s: st.validate_stream(s).select("id", "status", "hard_reject"))
    return out.groupBy("status").agg(F.count("*").alias("n"), F.count_if("hard_reject").alias("rejected"))


def _batches(parts: list[DataFrame], start) -> DataFrame | None:
    """start(stream, root) once for each of parts, whose files arrive before it: the query is started anew for each and goes on from its checkpoint. What lies in root/out then."""
    spark, root = parts[0].sparkSession, scratch(parts[0].sparkSession)
    for part in parts:
        part.write.mode("append").parquet(f"{root}/in")
        start(st.read_files(spark, f"{root}/in", part.schema), root).awaitTermination()
    return spark.read.parquet(f"{root}/out") if exists(spark, f"{root}/out") else None


@query("stream_decisions", "validation_issues decisions", """
SELECT issue_id, batch, decision, outcome, value FROM (
  SELECT d.issue_id, 1 + d.issue_id % 3 AS batch, d.decision, CASE WHEN d.decision = 'reject' THEN 'REJECTED BY PROVIDER' WHEN suggested_value IS NULL THEN 'REJECTED' WHEN mapped THEN 'ACCEPTED BY PROVIDER' ELSE 'UNMAPPED' END AS outcome,
    CASE WHEN d.decision = 'reject' AND mapped THEN correct_value WHEN d.decision = 'accept' AND mapped THEN suggested_value END AS value
  FROM decisions d JOIN (SELECT *, NOT field_name IN ('availability_status', 'appointment_availability') AS mapped FROM validation_issues) i ON i.id = d.issue_id
  UNION ALL
  SELECT d.issue_id, 3, 'reject', CASE WHEN d.decision = 'accept' AND suggested_value IS NOT NULL AND field_name IN ('availability_status', 'appointment_availability') THEN 'REJECTED BY PROVIDER' ELSE 'NOT_OPEN' END, NULL
  FROM decisions d JOIN validation_issues i ON i.id = d.issue_id WHERE d.issue_id % 3 < 2
  UNION ALL SELECT id, 2, 'accept', 'NOT_OPEN', NULL FROM validation_issues WHERE status <> 'OPEN'
  UNION ALL SELECT -id, 2, 'accept', 'UNKNOWN', NULL FROM validation_issues WHERE id % 50 = 7) e""")
def decided(t):
    """Three batches: the issues and a third of the decisions; another third, decisions on closed and on unknown issues, and the issues once more;
    the last third, and second decisions on issues that the first two batches have decided."""
    spark = t("decisions").sparkSession
    named = lambda df, n: df.select(F.col("issue_id"), F.lit("decision").alias("kind"), F.lit(n).alias("batch"), "decision", "correct_value")
    issues = t("validation_issues").select(F.col("id").alias("issue_id"), F.lit("issue").alias("kind"), "provider_id", "field_name", "suggested_value", "status")
    told = t("decisions")
    third = lambda k: named(told.where(F.col("issue_id") % 3 == k), k + 1)
    accept = lambda df: df.select("issue_id", F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("correct_value"))
    closed = accept(t("validation_issues").where("status <> 'OPEN'").select(F.col("id").alias("issue_id")))
    unknown = accept(t("validation_issues").where("id % 50 = 7").select((-F.col("id")).alias("issue_id")))
    again = told.where("issue_id % 3 < 2").select("issue_id", F.lit("reject").alias("decision"), F.lit("late").alias("correct_value"))
    empty = spark.createDataFrame([], st.EVENT)

    def batch(n: int, *rows: DataFrame) -> DataFrame:
        out = empty
        for r in rows:
            out = out.unionByName(r.drop("batch"), allowMissingColumns=True)
        return out.withColumn("at", F.timestamp_seconds(F.lit(n)))

    parts = [batch(1, issues, third(0)), batch(2, issues, third(1), named(closed, 2), named(unknown, 2)), batch(3, third(2), named(again, 3))]
    written = _batches(parts, lambda s, root: st.write_once(st.decisions_stream(s, groups=1024), f"{root}/out", f"{root}/state"))
    return written.select("issue_id", F.unix_timestamp("at").alias("batch"), "decision", "outcome", "value")


@query("stream_progress", "validation_issues", """
SELECT run_id, count(*) AS processed, count(*) FILTER (confidence >= 0.65) AS success, count(*) FILTER (confidence < 0.65) AS review FROM validation_issues GROUP BY 1""")
def progressed(t):
    """Two batches; update mode writes the runs that a batch has changed, of which each run's last counts."""
    e = t("validation_issues").select("run_id", F.when(F.col("confidence") >= 0.65, "approved").otherwise("needs_review").alias("route"), "id")

    def start(stream: DataFrame, root: str):
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/n={n}")
        return st.progress_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()

    out = _batches([e.where("id % 2 = 0"), e.where("id % 2 = 1")], start)
    last = F.max_by(F.struct("processed", "success", "review"), "batch").alias("c")
    return out.groupBy("run_id").agg(last).select("run_id", "c.*")


@query("stream_steps", "", """
SELECT e.at, e.name, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS at, event_type AS name FROM events) e
WHERE e.at + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def steps(t):
    """Three batches in the order of time. The third brings early events once more, which come too late; the last windows stay open."""
    e = t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("name"))
    low, high = e.agg(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    part = F.least(F.floor((F.unix_timestamp("ts") - low) * 3 / (high - low + 1)), F.lit(2))
    third = lambda k: e.where(part == k)
    late = e.where(F.unix_timestamp("ts") < low + (high - low) / 100)
    return _batches([third(0), third(1), third(2).unionByName(late)], lambda s, root: st.write_once(st.step_counts(s, "1 hour"), f"{root}/out", f"{root}/state"))


_ISSUE = "provider_id long, run_id long, rule_order int, field string, code string, source_type string, severity string, old_value string, suggested string, confidence double, action string, status string"


@query("stream_reconcile", "providers registry provider_sources license_statuses listing_hours listing_status", o.run(f"SELECT id, CAST(7 AS BIGINT) AS run_id, rule_order, field, code, source_type, severity, {o.OLD_VALUE} AS old_value, i.suggested, i.confidence, i.action, i.status FROM issues i JOIN providers p USING (id)"))
def reconciled(t):
    """Three batches of entities: one half with other phones, the other half, the first half as it is, whose issues replace those of the first batch."""
    p, others = t("providers").withColumn("run_id", F.lit(7).cast("long")), (t("registry"), t("provider_sources"), t("license_statuses"), listing_of(t))
    table = VersionedTable(p.sparkSession, scratch(p.sparkSession), _ISSUE, ("provider_id", "run_id"), 8)

    def validate(batch: DataFrame) -> DataFrame:
        return run_validation(batch.drop("run_id"), *others).issues.withColumnRenamed("id", "provider_id").withColumn("run_id", F.lit(7).cast("long"))

    halves = [p.where("id % 2 = 0").withColumn("phone", F.lit("(212) 555-0000")), p.where("id % 2 = 1"), p.where("id % 2 = 0")]
    _batches(halves, lambda s, root: st.reconcile_stream(s, validate, table, "halves", f"{root}/state"))
    return table.read().withColumnRenamed("provider_id", "id")
