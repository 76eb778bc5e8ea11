"""Scoring at every threshold edge, fingerprints, and streams."""

from __future__ import annotations

import json
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codestrata.functions import scoring, text
from codestrata.operators import sinks, store, writes
from codestrata.operators.asof import last_before
from codestrata.sources.versions import VersionedTable
from codestrata.operators.intervals import periods_and_gaps
from codestrata.streaming import activity, intervals

EDGES = [(c, g, n, p, x) for c in (5, 6, 10, 11, 15, 16, 20, 21) for g in (7, 8, 15, 16, 20, 21, 25, 26) for n in (3, 4, 5, 6, 7, 8) for p, x in ((5, 150), (6, 199), (7, 200), (8, 351), (4, 51))]


@pytest.fixture(scope="module")
def scored(spark):
    m = [F.col(c) for c in "cgnpx"]
    df = spark.createDataFrame(EDGES, "c int, g int, n int, p int, x int")
    return df.select("*", scoring.severity(*m[:3]).alias("s"), scoring.severity_go(*m[:4]).alias("sg"), scoring.debt_minutes(*m).alias("d"), scoring.suggestions_go(*m).alias("a"), scoring.suggestions("c++", *m).alias("b"), scoring.suggestions("rust", *m).alias("r")).collect()


def test_edges(scored):
    for r in scored:
        c, g, n, p, x = (r[k] for k in "cgnpx")
        worst = "critical" if c > 20 or g > 25 or n > 5 else "high" if c > 15 or g > 20 or n > 4 else "medium" if c > 10 or g > 15 or n > 3 else "low"
        go = "critical" if c > 20 or n > 7 or g > 25 else "high" if c > 10 or n > 5 or p > 7 or g > 15 else "medium" if c > 5 or n > 4 or p > 5 or g > 7 else "low"
        debt = ((c - 20) * 15 if c > 20 else (c - 10) * 10 if c > 10 else max(0, c - 5) * 5) + max(0, g - 15) * 8 + ((n - 5) * 20 if n > 5 else max(0, n - 3) * 10)
        debt += ((p - 7) * 15 if p > 7 else max(0, p - 5) * 10) + ((x - 300) // 50 * 30 if x > 300 else max(0, x - 150) // 50 * 15)
        assert (r["s"], r["sg"], r["d"]) == (worst, go, debt)
        titles = (["Extract Method"] if c > 20 else ["Simplify Control Flow"] if c > 10 else []) + ["Reduce Nesting Depth"] * (n > 5) + ["Introduce Parameter Object"] * (p > 7) + ["Split Large Function"] * (x > 300) + ["Reduce Cognitive Complexity"] * (g > 15)
        assert [s["title"] for s in r["a"]] == titles
        assert len(r["b"]) == (c > 15) + (n > 3) + (p > 5) + (x > 50) + (g > 20) and len(r["r"]) == len(r["b"]) + (p == 5)
        assert all(s["type"] is None and s["reason"] is None for s in r["b"])


def test_nulls_and_pipeline_debt(spark):
    df = spark.createDataFrame([(None,), (10,), (11,), (133,)], "c int")
    assert [r[0] for r in df.select(scoring.pipeline_debt_minutes(F.col("c"))).collect()] == [0, 0, 30, 3690]
    assert rows(df.select(scoring.language_debt("rust", F.col("c"), F.lit(20), F.lit(44)).alias("d"))) == sorted([(14,), (14,), (16,), (260,)], key=repr)


def test_summary_of_nothing(spark):
    empty = scoring.summary(spark.createDataFrame([], "c int, s string, m int"), "c", "s", "m").first()
    assert empty["total_functions"] == 0 and empty["average_cyclomatic"] is None and empty["critical_count"] is None


def test_gates(spark):
    df = spark.createDataFrame([("HIGH",), ("odd",), (None,)], "severity string")
    assert [scoring.gate_fails(df, "severity", t).first()[0] for t in ("critical", "high", "low")] == [False, True, True]
    assert [scoring.lenient_gate_fails(df, "severity", t).first()[0] for t in ("none", "info", "whatever", "critical")] == [False, True, True, False]
    assert scoring.gate_fails(df.where("false"), "severity", "low").first()[0] is False
    with pytest.raises(ValueError):
        scoring.gate_fails(df, "severity", "odd")


def test_fingerprint(spark):
    df = spark.createDataFrame([("func Work() { doThing() }",), (" func  Work()\t{\n doThing()  }",), (None,)], "s string")
    one, two, none = [r[0] for r in df.select(text.fingerprint(F.lit("/src/work.go"), F.lit("complexity"), F.lit("complexity"), F.col("s"))).collect()]
    assert one == two == "362fa643800ba8b7d45d03dff69403723a294a80a900f0f35949381aac7aaf71" and none != one


def test_sinks(spark):
    assert sinks.json_array([]) == "[]" and json.loads(sinks.json_array([{"a": 1}])) == [{"a": 1}]
    df = spark.createDataFrame([("1", "high", "/a", 3, "", "m"), ("2", None, "/b", None, "r", None)], "id string, severity string, file_path string, line_number int, tool_rule_id string, message string")
    assert rows(sinks.text_rows(df)) == [("1", "HIGH", "/a:3", "N/A", "m"), ("2", None, "/b", "r", "")]
    assert json.loads(sinks.json_lines(df).first()[0])["severity"] == "high"


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(str(i), "high" if i % 2 else "low", None) for i in range(10)], "id string, severity string, created_at timestamp")
    assert store.filtered(df, severity="high", id=None).count() == 5 and store.filtered(df).count() == 10
    assert [r["id"] for r in store.page(df, store.by_severity(), 3, 3).collect()] == ["7", "9", "0"]
    assert store.page(df, store.by_severity(), 99, 3).count() == 0
    with pytest.raises(ValueError):
        writes.pending_syncs(df, "other", ["high"])
    assert writes.pending_syncs(df.withColumn("status", F.lit("open")).withColumn("jira_sync_status", F.lit("pending")), "jira", []).count() == 0


def test_last_before(spark):
    import datetime as dt

    at = lambda d: None if d is None else dt.datetime(2025, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=d)
    events = [("a", 1, 10), ("a", 1, 11), ("a", 50, 12), ("b", 3, 13), (None, 1, 14), ("a", None, 15)]
    asked = [("a", 0), ("a", 1), ("a", 1.5), ("a", 50), ("a", 90), ("b", 200), ("c", 5), (None, 5), ("a", None), ("a", 90)]
    e = spark.createDataFrame([(k, at(d), v) for k, d, v in events], "ek string, et timestamp, v int")
    r = spark.createDataFrame([(k, at(d), i) for i, (k, d) in enumerate(asked)], "k string, t timestamp, i int")
    expected = []
    for i, (k, d) in enumerate(asked):
        own = [(ed, v) for ek, ed, v in events if ek == k and k is not None and d is not None and ed is not None and ed < d]
        expected.append((i, max(own)[1] if own else None))
    for width in (1, 7, 400):
        assert rows(last_before(r, F.col("k"), F.col("t"), e, F.col("ek"), F.col("et"), ["v"], width), "i", "previous.v") == sorted(expected, key=repr)


STORE = "id string, user_id string, repository_id string, analysis_run_id string, file_path string, line_number int, column_number int, tool_name string, status string, code_snippet string, surrounding_context string, fingerprint_hash string, resolved_at timestamp, resolution_reason string, created_at timestamp, updated_at timestamp"


def issue(i, repo="r", run="1", line=1, tool="t", status="open", fp=None):
    return (i, "u", repo, run, "/f", line, None, tool, status, None, None, fp or i, None, None, None, None)


def test_reconcile(spark):
    now = F.lit("2025-04-01 00:00:00").cast("timestamp")
    held = spark.createDataFrame([issue("a"), issue("b"), issue("c", status="ignored"), issue("d", tool="other"), issue("e", repo="s"), issue("f", run=None), issue("g", status="resolved", fp="x")], STORE)
    batch = spark.createDataFrame([(*issue("n1", run="2", line=7, fp="a"), 1), (*issue("n2", run="2", line=9, fp="a"), 2), (*issue("n3", run="2", fp="x"), 3), (*issue("n4", run="2", fp="x"), 4)], STORE + ", ordinal int")
    after = writes.reconcile(held, batch, "t", now)
    got = {r["id"]: (r["status"], r["analysis_run_id"], r["line_number"]) for r in after.collect()}
    assert got == {"a": ("open", "2", 9), "b": ("resolved", "1", 1), "c": ("ignored", "1", 1), "d": ("open", "1", 1), "e": ("resolved", "1", 1), "f": ("resolved", None, 1), "g": ("resolved", "1", 1), "n3": ("open", "2", 1)}
    assert {r["id"] for r in after.where("resolution_reason = 'fixed_in_code'").collect()} == {"b", "e", "f"}
    again = writes.reconcile(after, batch, "t", now)
    assert rows(again) == rows(after)
    swept = writes.reconcile(held, batch.where("false"), "t", now)
    assert {r["id"] for r in swept.where("status = 'open'").collect()} == {"d"}


def test_users_of_a_table_are_exact(spark):
    sizes = {"a": 5000, "b": 7001, "c": 12345}
    events = spark.createDataFrame([(k, n) for k, n in sizes.items()], "event_type string, n int").selectExpr("timestamp '2025-01-01 00:10:00' as ts", "explode(sequence(1, n)) as user_id", "event_type")
    assert rows(activity.activity_counts(events), "event_type", "n", "users") == [(k, n, n) for k, n in sizes.items()]


def test_streams(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2025, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    schema = "ts timestamp, user_id long, event_type string"
    for n, part in enumerate(([(at(1), 1, "a"), (at(5), 2, "a"), (at(70), 1, "b")], [(at(65), 1, "a"), (at(300), 9, "z")], [(at(2), 1, "a"), (at(500), 9, "z")])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        (next((tmp_path / f"in{n}").glob("part-*.parquet"))).rename(tmp_path / f"{n}.parquet")
    (tmp_path / "events").mkdir()
    for n in range(3):
        (tmp_path / f"{n}.parquet").rename(tmp_path / "events" / f"{n}.parquet")
    stream = activity.stream_files(spark, str(tmp_path / "events"), schema)
    counts = activity.run_to_end(activity.activity_counts(stream), "counted")
    assert rows(counts.where("event_type = 'a'"), "n", "users") == [(1, 1), (2, 2)]  # the row at minute 2 came too late
    whole = activity.sessions(spark.read.schema(schema).parquet(str(tmp_path / "events")))
    assert rows(whole, "user_id", "n") == [(1, 2), (1, 2), (2, 1), (9, 1), (9, 1)]

    spans = "entity string, start_us long, end_us long"
    for n, part in enumerate(([("a", 0, 5), ("a", 10, 15), ("b", 1, 2)], [("a", 5, 10), ("b", 3, 3)])):
        spark.createDataFrame(part, spans).coalesce(1).write.parquet(str(tmp_path / f"span{n}"))
        (tmp_path / "spans").mkdir(exist_ok=True)
        (next((tmp_path / f"span{n}").glob("part-*.parquet"))).rename(tmp_path / "spans" / f"{n}.parquet")
    live = activity.run_to_end(intervals.live_periods(activity.stream_files(spark, str(tmp_path / "spans"), spans)), "live", "update")
    told = rows(live, "entity", "kind", "start_us", "end_us")
    assert ("a", "period", 0, 15) in told and ("a", "gap", 5, 10) in told and told.count(("b", "period", 1, 2)) == 1
    assert rows(intervals.joined_periods(live)) == [("a", "period", 0, 15), ("b", "period", 1, 2)]

    day = 86_400_000_000
    for n, part in enumerate(([("a", 0, 3 * day), ("a", 2 * day, 2 * day + 5), (None, 5, 6)], [("a", 4 * day, 9 * day), ("a", 3 * day, 3 * day + 1)], [("a", 30 * day, 31 * day)], [("a", 1, 40 * day), ("a", 40 * day, 41 * day)])):
        moved = [(e, a + 1000 * day, b + 1000 * day) for e, a, b in part]
        spark.createDataFrame(moved, spans).coalesce(1).write.parquet(str(tmp_path / f"long{n}"))
        (tmp_path / "long").mkdir(exist_ok=True)
        (next((tmp_path / f"long{n}").glob("part-*.parquet"))).rename(tmp_path / "long" / f"{n}.parquet")
    stream = lambda: activity.stream_files(spark, str(tmp_path / "long"), spans)
    whole = rows(periods_and_gaps(spark.read.schema(spans).parquet(str(tmp_path / "long")), F.col("entity"), F.col("start_us"), F.col("end_us")))
    assert rows(intervals.joined_periods(activity.run_to_end(intervals.live_periods(stream(), slice_days=2), "cut", "update"))) == whole
    kept = rows(intervals.joined_periods(activity.run_to_end(intervals.live_periods(stream(), slice_days=2, keep_days=1), "kept", "update")))
    assert ("a", "period", 1000 * day, 1003 * day + 1) in kept and ("a", "period", 1000 * day, 1041 * day) not in kept  # the interval from 1 came too late

    table = VersionedTable(spark, str(tmp_path / "store"))
    (tmp_path / "store").mkdir()
    table.write(spark.createDataFrame([issue("a"), issue("b")], STORE))
    found = spark.createDataFrame([(*issue("n", run="2", fp="a")[:-1], at(9), 1)], STORE + ", ordinal int")
    found.coalesce(1).write.parquet(str(tmp_path / "found"))
    query = activity.reconcile_stream(activity.stream_files(spark, str(tmp_path / "found"), STORE + ", ordinal int"), table, "t", f"found-{uuid.uuid4().hex}")
    query.awaitTermination()
    assert rows(table.read(), "id", "status") == [("a", "open"), ("b", "resolved")]
