"""Structured Streaming forms: validation of arriving files, runs that replace their issues, decisions on open issues, progress, and step counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rosterlane.operators.resolve import column_of
from rosterlane.operators.validate import validate_entities
from rosterlane.sources.versions import VersionedTable


def read_files(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def validate_stream(arriving: DataFrame) -> DataFrame:
    """Rule checks are one projection, so a stream is validated like a table."""
    return validate_entities(arriving)


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived and stop; files already seen are not processed again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reconcile_stream(arriving: DataFrame, validate: Callable[[DataFrame], DataFrame], table: VersionedTable, writer: str, checkpoint: str) -> StreamingQuery:
    """A validation run for each micro-batch of entities: its issues replace those of the same entities and runs, whichever batch wrote them.

    validate(batch) gives issues with the table's columns. A batch that fails leaves the table as it was and comes again; one that
    was committed is passed over.
    """

    def run(batch: DataFrame, n: int) -> None:
        with_keys = batch.persist()  # the stream's source would be read twice
        try:
            table.replace(validate(with_keys), with_keys.select(F.col("id").alias("provider_id"), "run_id"), writer, n)
        finally:
            with_keys.unpersist()

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What happens to issues: they arrive (kind "issue", with status, field and suggestion), and are decided upon (kind "decision").
EVENT = "issue_id long, kind string, at timestamp, provider_id long, field_name string, suggested_value string, status string, decision string, correct_value string"
_OUTCOME = "issue_id long, provider_id long, at long, field_name string, decision string, outcome string, value string"
#: Issues of one group, item by item; goes: the watermark, in milliseconds, behind which a decided one is dropped.
_STATE = "issue_id array<long>, provider_id array<long>, field_name array<string>, suggested_value array<string>, mapped array<boolean>, open array<boolean>, goes array<long>"


def decide(event: tuple, state: tuple | None) -> tuple[tuple | None, str, str | None]:
    """(state, outcome, value) of one decision: only an open issue takes it. The rules are those of resolve.accept_issues and reject_issues.

    event: (decision, correct_value). state: (provider_id, field_name, suggested_value, mapped, open).
    """
    if state is None:
        return None, "UNKNOWN", None
    decision, correct = event
    provider, field, suggested, mapped, is_open = state
    closed = (provider, field, suggested, mapped, False)
    if not is_open:
        return state, "NOT_OPEN", None
    if decision == "reject":
        return closed, "REJECTED BY PROVIDER", correct if mapped else None
    if suggested is None:
        return closed, "REJECTED", None
    return (closed, "ACCEPTED BY PROVIDER", suggested) if mapped else (state, "UNMAPPED", None)


def decisions_stream(events: DataFrame, keep: str = "30 days", groups: int | None = None) -> DataFrame:
    """(issue_id, provider_id, at, field_name, decision, outcome, value) of each decision in a stream of EVENT rows, for append mode.

    State is a row per issue, or one for each of `groups` groups of issues (by hash), which saves most of the time where batches hold many issues; the
    results are the same. An open issue stays until it is decided, a decided one until the watermark has passed the decision by `keep`, so that
    what arrives again in a later batch finds it closed; after that it is unknown, which changes nothing either. The watermark is the latest time less
    `keep`; rows behind it are dropped. In a batch, rows go by time, issues before decisions.
    """
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)

    columns = ["issue", "micros", "kind", "provider", "field_name", "suggested_value", "status", "decision", "correct_value", "mapped"]
    number = lambda x: None if x is None else int(x)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {x[0]: x[1:] for x in zip(*state.getOption, strict=True)} if state.exists else {}
        rows = [] if state.hasTimedOut else [r for batch in batches for r in zip(*(batch[c].tolist() for c in columns), strict=True)]
        rows.sort(key=lambda r: (r[0] or "", r[1], r[2] == "decision", r[7] or "", r[8] or ""))
        out, last = [], {}
        for issue, at, kind, provider, field, suggested, status, decision, correct, is_mapped in rows:
            i = number(issue)
            last[i] = at
            known = held.get(i)
            if kind == "issue":
                if known is None:  # an issue that arrives again is the same one
                    held[i] = (number(provider), field, suggested, is_mapped, status == "OPEN", None)
                continue
            now, outcome, value = decide((decision, correct), known[:5] if known else None)
            if known:
                held[i] = (*now, known[5])
            out.append((i, known[0] if known else None, at, known[1] if known else None, decision, outcome, value))
        for i, at in last.items():
            if i in held:
                held[i] = (*held[i][:5], None if held[i][4] else at // 1000 + millis + 1)
        passed = state.getCurrentWatermarkMs()
        held = {i: x for i, x in held.items() if i in last or x[5] is None or x[5] >= passed}
        if held:
            state.update(tuple(map(list, zip(*((i, *x) for i, x in held.items()), strict=True))))
            ends = [x[5] for x in held.values() if x[5] is not None]
            if ends:
                state.setTimeoutTimestamp(min(ends))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["issue_id", "provider_id", "at", "field_name", "decision", "outcome", "value"], dtype=object)

    mapped = F.coalesce(column_of(F.col("field_name")).isNotNull(), F.lit(False))
    group = F.col("issue_id") if groups is None else F.pmod(F.xxhash64("issue_id"), F.lit(groups))
    # numbers that may be null go to Python as text, which keeps all their digits
    told = events.withColumns({"mapped": mapped, "issue": F.col("issue_id").cast("string"), "provider": F.col("provider_id").cast("string"), "micros": F.unix_micros("at"), "group": group})
    rows = told.select("group", "at", *columns).withWatermark("at", keep)
    decided = rows.groupBy("group").applyInPandasWithState(fold, _OUTCOME, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.withColumn("at", F.timestamp_micros("at"))


def first_decisions(decisions: DataFrame) -> DataFrame:
    """(issue_id, decision, correct_value) of each issue's first decision in a table."""
    first = F.min(F.struct("at", "decision", "correct_value")).alias("d")
    return decisions.groupBy("issue_id").agg(first).select("issue_id", "d.decision", "d.correct_value")


def progress_stream(events: DataFrame) -> DataFrame:
    """Counts per run, for update or complete mode; state is a row per run."""
    return events.groupBy("run_id").agg(F.count("*").alias("processed"), F.count_if(F.col("route") == "approved").alias("success"), F.count_if(F.col("route") != "approved").alias("review"))


def step_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per node and tumbling window, for append mode: a window is written once, when the watermark has passed it, and its state goes.

    The watermark is the latest event's time less `late`; events whose window it has passed are dropped by design.
    """
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "name").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("at"), "name", "n")
