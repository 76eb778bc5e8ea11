"""Snapshots, histories, orphans, rolling totals and intervals against brute force and on edge cases."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codestrata.operators import snapshots
from codestrata.operators.history import attribute_history
from codestrata.operators.intervals import IntervalMap, periods_and_gaps
from codestrata.operators.references import Reference, orphan_counts, orphan_references
from codestrata.operators.rolling import peak_days, trailing_totals
from codestrata.operators.snapshots import snapshot_changes
from codestrata.tables import NIL_UUID, folded, holding, reference

DAY = dt.date(2025, 1, 6)


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def ts(n: float) -> dt.datetime:
    return dt.datetime(2025, 1, 6, tzinfo=dt.UTC) + dt.timedelta(seconds=n)


# --- tables -------------------------------------------------------------------------------------


def test_reference_forms(spark):
    key = "fc7003e2-e0c5-428e-8650-ce3d49964e8a"
    forms = [key, key.upper(), f"{{{key}}}", f" {key}\t", f"\n{{{key.upper()}}} ", None, "", "  ", NIL_UUID, f"{{{NIL_UUID}}}"]
    df = spark.createDataFrame([(f,) for f in forms], "r string")
    assert [r[0] for r in df.select(reference("r")).collect()] == [key] * 5 + [None] * 5


def test_holding_takes_latest_and_settles_ties(spark):
    df = spark.createDataFrame([("a", 1, None, "old"), ("a", 2, 1, "x"), ("a", 2, 2, "y"), ("a", 2, 2, "z"), ("b", None, None, None)], "id string, u int, l int, v string")
    assert rows(holding(df, ["id"], ["u", "l"], ["v"])) == [("a", "z"), ("b", None)]


# --- snapshots ----------------------------------------------------------------------------------


def changes(df):
    return snapshot_changes(df, F.col("d"), F.col("repo"), folded("fp"), [F.col("path"), F.col("line")], F.col("at"))


SNAPSHOT = "d date, repo string, fp string, path string, line int, at timestamp, record string, hash string"


@pytest.mark.parametrize("sent", [200_000, 2])
def test_snapshot_changes(spark, monkeypatch, sent):
    monkeypatch.setattr(snapshots, "BROADCAST_DELIVERIES", sent)
    data = [
        (day(0), "r", "A", "/x", 1, ts(0), "", ""), (day(0), "r", "b", "/x", None, ts(0), "", ""), (day(0), "r", "c", "/x", 3, ts(0), "", ""),
        (day(7), "r", " a ", "/x", 1, ts(1), "", ""), (day(7), "r", "b", "/x", 5, ts(1), "", ""), (day(7), "r", "d", None, None, ts(1), "", ""), (day(7), "r", "d", None, None, ts(1), "", ""),
        (day(21), "r", "d", None, 9, ts(2), "", ""), (day(21), "r", "d", None, None, ts(3), "", ""),
        (day(7), "other", "a", "/x", 1, ts(1), "", ""), (None, "r", "z", "/x", 1, ts(9), "", ""),
        (day(7), None, "n", "/x", 1, ts(1), "", ""), (day(14), None, None, "/x", 1, ts(1), "", ""),
    ]
    found = rows(changes(spark.createDataFrame(data, SNAPSHOT)))
    expected = [(day(7), "r", "b", "changed"), (day(7), "r", "c", "removed"), (day(7), "r", "d", "added"), (day(21), "r", "a", "removed"), (day(21), "r", "b", "removed"), (day(14), None, "n", "removed"), (day(14), None, None, "added")]
    assert found == sorted(expected, key=repr)


def test_snapshot_empty(spark):
    assert rows(changes(spark.createDataFrame([], SNAPSHOT))) == []


def test_null_moving_between_columns_is_a_change(spark):
    data = [(day(0), "r", "a", None, 5, ts(0), "", ""), (day(7), "r", "a", "5", None, ts(0), "", "")]
    assert rows(changes(spark.createDataFrame(data, SNAPSHOT)), "change_kind") == [("changed",)]


# --- histories ----------------------------------------------------------------------------------

WRITE = "id string, at long, loaded int, status string, run string, entity string, slice int"
US = 86_400_000_000


def history(df, **more):
    return attribute_history([df] if not isinstance(df, list) else df, F.col("id"), F.col("at"), F.col("loaded"), {"status": F.col("status"), "run": F.col("run")}, **more)


def brute_history(data):
    latest = {}
    for i, at, loaded, status, run, *_ in data:
        if i is None or at is None:
            continue
        key = (loaded is not None, loaded or 0, status is not None, status or "", run is not None, run or "")
        if (i, at) not in latest or latest[i, at][0] < key:
            latest[i, at] = (key, (status, run))
    out = []
    for i in sorted({i for i, _ in latest}):
        versions = []
        for at in sorted(a for j, a in latest if j == i):
            value = latest[i, at][1]
            if not versions or versions[-1][1] != value:
                versions.append((at, value))
        for n, (at, value) in enumerate(versions):
            out.append((i, at, versions[n + 1][0] if n + 1 < len(versions) else None, *value))
    return sorted(out, key=repr)


def test_history_against_brute_force(spark):
    rng = random.Random(3)
    data = []
    for _ in range(1200):
        i = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", "d", None])
        data.append((i, rng.choice([None, *[rng.randrange(0, 200) * US // 2 for _ in range(9)]]), rng.choice([None, 1, 2]), rng.choice(["open", "closed", None]), rng.choice([None, "r1"]), "x", 1))
    expected = brute_history(data)
    df = spark.createDataFrame(data, WRITE)
    assert rows(history(df)) == expected
    assert rows(history(df, slice_days=1)) == expected
    assert rows(history(df, slice_days=100_000)) == expected
    half = len(data) // 2
    parts = [spark.createDataFrame(data[:half], WRITE), spark.createDataFrame(data[half:], WRITE)]
    assert rows(history(parts, slice_days=5)) == expected


def test_history_constant_over_many_slices(spark):
    df = spark.createDataFrame([("a", n * 10 * US, 1, "open", None, "", 0) for n in range(40)], WRITE)
    assert rows(history(df, slice_days=7)) == [("a", 0, None, "open", None)]


def test_history_empty(spark):
    assert rows(history(spark.createDataFrame([], WRITE))) == []


# --- references ---------------------------------------------------------------------------------


def test_orphans(spark):
    child = spark.createDataFrame([("c1", "K1", ts(5)), ("c1", "k1", ts(5)), ("c2", "gone", ts(0)), ("c3", "k2", ts(1)), ("c3", "k2", ts(9)), ("c4", "k2", ts(8)), ("c5", None, ts(1)), ("c6", "", ts(1)), (None, "gone", None)], "id string, fk string, loaded timestamp")
    parent = spark.createDataFrame([("k1", ts(5)), ("k2", ts(3)), ("k2", ts(7)), (None, ts(0))], "id string, loaded timestamp")
    refs = [Reference("child", "fk", child, F.col("id"), reference("fk"), F.col("loaded"), "parent", parent, reference("id"), F.col("loaded"))]
    found = orphan_references(refs)
    assert rows(found.drop("first_loaded")) == [("child", "fk", "c2", "gone", "missing"), ("child", "fk", "c3", "k2", "late"), ("child", "fk", None, "gone", "missing")]
    assert sum(r["n_rows"] for r in orphan_counts(found).collect()) == 3
    empty = parent.where("false")
    all_missing = orphan_references([Reference("child", "fk", child, F.col("id"), reference("fk"), F.col("loaded"), "parent", empty, reference("id"), F.col("loaded"))])
    assert {r["kind"] for r in all_missing.collect()} == {"missing"} and all_missing.count() == 5
    assert rows(orphan_references([Reference("child", "fk", child.where("false"), F.col("id"), reference("fk"), F.col("loaded"), "parent", parent, reference("id"), F.col("loaded"))])) == []


# --- rolling totals -----------------------------------------------------------------------------


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(5)
    amounts = {(e, n): rng.choice([None, 0.0, 0.25, 1.5, 4.0]) for e in ("a", "b", None) for n in rng.sample(range(60), 20)}
    df = spark.createDataFrame([(e, day(n), v, 1.0) for (e, n), v in amounts.items()] + [("a", None, 5.0, 1.0)], "entity string, day date, amount double, total_7 double")
    expected = []
    for e in ("a", "b", None):
        days = [n for k, n in amounts if k == e]
        for n in range(min(days), max(days) + 1):
            totals = [sum(amounts.get((e, m)) or 0.0 for m in range(n - span + 1, n + 1)) for span in (7, 30)]
            expected.append((e, day(n), totals[0], totals[0] / 7, totals[1], totals[1] / 30))
    made = trailing_totals(df, [7, 30])
    assert rows(made) == sorted(expected, key=repr)
    peaks = {}
    for e, d, t7, _, t30, _ in expected:
        for span, t in ((7, t7), (30, t30)):
            peaks.setdefault((e, span), []).append((t, d))
    assert rows(peak_days(made, [7, 30])) == sorted([(e, d, span) for (e, span), v in peaks.items() for t, d in v if t == max(v)[0] > 0], key=repr)
    assert rows(trailing_totals(df.where("false"), [7])) == []


def test_totals_do_not_depend_on_order(spark):
    tenths = [0.1, 0.2, 0.3, 1e15, 0.7]
    df = spark.createDataFrame([("a", day(n), tenths[n % 5]) for n in range(10)] + [("b", day(0), float("nan")), ("b", day(1), float("inf")), ("b", day(2), 0.1)], "entity string, day date, amount double")
    made = trailing_totals(df, [5])
    assert len({r["total_5"] for r in made.where("entity = 'a'").collect() if r["day"] >= day(4)}) == 1
    assert {r["day"] for r in peak_days(made, [5]).where("entity = 'a'").collect()} >= {day(n) for n in range(4, 10)}
    assert rows(made.where("entity = 'b'"), "total_5") == [(0.0,), (0.0,), (0.1,)]
    whole = trailing_totals(df.withColumn("amount", F.lit(3)), [5])
    assert max(r["total_5"] for r in whole.collect()) == 15.0


# --- intervals ----------------------------------------------------------------------------------


def brute_periods(spans):
    periods = []
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if periods and s <= periods[-1][1]:
            periods[-1][1] = max(periods[-1][1], e)
        else:
            periods.append([s, e])
    return [tuple(p) for p in periods]


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), max_size=40))
def test_interval_map(spans):
    state = IntervalMap()
    for s, n in spans:
        state.add(s, s + n)
        assert state.gaps == list(zip(state.ends[:-1], state.starts[1:], strict=True))
    assert list(zip(state.starts, state.ends, strict=True)) == brute_periods([(s, s + n) for s, n in spans])


def test_periods_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for e, n in (("hot", 400), ("b", 30), (None, 5)):
        for _ in range(n):
            s = rng.randrange(0, 300) * US // 3
            data.append((e, s, s + rng.choice([0, -5, US // 3, US // 3, 2 * US, 40 * US // 7])))
    data += [("d", 5, 250_000_000 * US // 100), ("d", 3 * US, 4 * US), ("d", 90 * US, 90 * US + 1)]  # an end in the year 8815
    data += [("b", None, 5), ("b", 5, None), ("c", 0, 200 * US), ("c", 0, 200 * US), ("c", 90 * US, 91 * US)]
    df = spark.createDataFrame(data, "entity string, start_us long, end_us long")
    expected = []
    for e in ("hot", "b", "c", "d", None):
        periods = brute_periods([(s, t) for k, s, t in data if k == e and s is not None and t is not None])
        expected += [(e, "period", *p) for p in periods] + [(e, "gap", a[1], b[0]) for a, b in zip(periods, periods[1:], strict=False)]
    for width in (32, 1, 7, 10_000):
        assert rows(periods_and_gaps(df, F.col("entity"), F.col("start_us"), F.col("end_us"), width)) == sorted(expected, key=repr), width
    assert rows(periods_and_gaps(df.where("false"), F.col("entity"), F.col("start_us"), F.col("end_us"))) == []
