"""Records by key, sessions, configurations, activity and caches on edge cases."""

from __future__ import annotations

import datetime as dt
import json

from conftest import rows
from pyspark.sql import functions as F

from codestrata.operators import entities
from codestrata.sources.versions import VersionedTable


def ts(n: int) -> dt.datetime:
    return dt.datetime(2025, 1, 1, tzinfo=dt.UTC) + dt.timedelta(days=n)


def now():
    return F.lit("2025-01-11 00:00:00").cast("timestamp")
THING = "id string, name string, error string, updated_at timestamp"


def things(spark, *data):
    return spark.createDataFrame([(*d, None) if len(d) == 3 else d for d in data], THING)


def test_look_ups(spark):
    table = things(spark, ("a", "x", "own"), ("b", None, None), ("b", "y", None), (None, "z", None)).drop("error")
    keys = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "id string")
    assert rows(entities.looked_up(table, keys, ["id"], "thing"), "id", "name", "error") == sorted([("a", "x", None), ("b", None, None), ("b", "y", None), ("c", None, "thing not found"), (None, None, "thing not found")], key=repr)
    assert {r["error"] for r in entities.looked_up(table, keys, ["id"], "thing", required=False).collect()} == {None}
    assert rows(entities.looked_up(table.where("false"), keys.where("id = 'a'"), ["id"], "thing"), "id", "error") == [("a", "thing not found")]
    assert rows(entities.looked_up(table, keys.where("false"), ["id"], "thing")) == []


def test_updates_and_removal(spark):
    table = things(spark, ("a", "x", None), ("b", "y", None), (None, "z", None))
    made, missing = entities.updated(table, spark.createDataFrame([("a", "p"), ("a", "q"), ("c", "r"), (None, "s")], "id string, name string"), now())
    assert rows(made, "id", "name") == sorted([("a", "q"), ("b", "y"), (None, "z")], key=repr)
    assert [r["updated_at"] is not None for r in made.orderBy("id").collect()] == [False, True, False]
    assert rows(missing) == sorted([("c", "not found"), (None, "not found")], key=repr)
    kept, missing = entities.removed(table, spark.createDataFrame([("a",), ("a",), ("c",)], "id string"))
    assert rows(kept, "id") == [("b",), (None,)] and rows(missing) == [("c", "not found")]
    grown = entities.created(table, spark.createDataFrame([("n", 1)], "id string, extra int"), now(), name=F.lit("new"))
    assert rows(grown.where("id = 'n'"), "id", "name", "error") == [("n", "new", None)] and grown.columns == table.columns


def test_sessions(spark):
    data = [("1", "u", "t1", ts(0), ts(20), ts(1), True), ("2", "u", "t2", ts(0), ts(5), ts(2), True), ("3", "v", "t3", ts(0), None, None, False)]
    df = spark.createDataFrame(data, "id string, user_id string, session_token string, created_at timestamp, expires_at timestamp, last_activity_at timestamp, is_active boolean")
    assert rows(entities.active_sessions(df, now()), "id") == [("1",)]
    assert rows(entities.without_expired(df, now()), "id") == [("1",), ("3",)]
    tokens = spark.createDataFrame([("t2",), ("t3",), (None,)], "session_token string")
    assert rows(entities.by_token(df, tokens), "session_token", "id", "error") == sorted([("t2", "2", None), ("t3", None, "session not found"), (None, None, "session not found")], key=repr)
    assert rows(entities.revoked(df, tokens, "session_token"), "id", "is_active") == [("1", True), ("2", False), ("3", False)]
    assert rows(entities.revoked(df, df.where("user_id = 'u'"), "user_id").where("is_active"), "id") == []
    touched = entities.seen(entities.revoked(df, df.where("id = '1'")), df, now())
    assert [r["last_activity_at"] for r in touched.orderBy("id").collect()][0] == df.orderBy("id").first()["last_activity_at"]
    fresh = entities.new_sessions(df, spark.createDataFrame([("9", "w")], "id string, user_id string"), now()).where("id = '9'").first()
    assert fresh["is_active"] and fresh["created_at"] == fresh["last_activity_at"]


def test_activity_escapes_and_names(spark):
    events = spark.createDataFrame([("1", "i", "u", "open", "closed", 'say "no"'), ("2", "i", None, "open", "x", "")], "id string, issue_id string, user_id string, old_status string, new_status string, reason string")
    log = entities.told_activity(entities.status_changes(events, now()), spark.createDataFrame([("u", "Name", None)], "id string, full_name string, email string")).collect()
    assert [json.loads(r["metadata"]) for r in log] == [{"old_status": "open", "new_status": "closed", "resolution_reason": 'say "no"'}, {"old_status": "open", "new_status": "x"}]
    assert [(r["user_name"], r["user_email"]) for r in log] == [("Name", ""), ("System", "")]


def test_cache(spark):
    cached = spark.createDataFrame([("a", "1", ts(9)), ("b", "1", ts(1)), ("d", "1", ts(0))], "cache_key string, value string, stored_at timestamp")
    new = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "2"), ("c", "3")], "cache_key string, value string")
    assert rows(entities.stored(cached, new, now(), 7), "cache_key", "value") == [("a", "1"), ("b", "2"), ("c", "3")]


def test_versions_are_whole_and_few(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.current() is None and table.versions() == []
    for n in range(4):
        table.write(spark.range(n + 1) if n < 2 else table.read().union(spark.range(1)))
    assert table.read().count() == 4 and len(table.versions()) == 3
    (tmp_path / "t" / "v-000000000099-dead").mkdir()  # a writer that died
    assert table.read().count() == 4
