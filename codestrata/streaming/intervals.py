"""Continuous periods per entity as a stream: the keyed state is a map of disjoint intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codestrata.operators.intervals import SLICE_DAYS, IntervalMap, periods_and_gaps

STATE = "starts array<long>, ends array<long>"
OUT = "entity string, slice int, version long, kind string, start_us long, end_us long"
_DAY = 86_400_000_000


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, slice_days: int, keep_days: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = state.getOption
    merged = IntervalMap(list(held[0]), list(held[1])) if held else IntervalMap()
    before = list(merged.starts), list(merged.ends)
    for frame in frames:
        for start, end in zip(frame["start_us"], frame["end_us"], strict=True):
            merged.add(int(start), int(end))
    state.update((merged.starts, merged.ends))
    if keep_days is not None:
        over = (int(key[1]) + 1) * slice_days * _DAY // 1000
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
    if before == (merged.starts, merged.ends):
        return
    spans = list(zip(merged.starts, merged.ends, strict=True))
    rows = [(*key, sum(e - s for s, e in spans), kind, a, b) for kind, found in (("period", spans), ("gap", merged.gaps)) for a, b in found]
    yield pd.DataFrame(rows, columns=["entity", "slice", "version", "kind", "start_us", "end_us"])


def live_periods(intervals: DataFrame, slice_days: int = SLICE_DAYS, keep_days: int | None = None) -> DataFrame:
    """The periods and gaps of each entity and time slice that a batch changed, as they stand after it (update mode).

    ``intervals`` has entity (string), start_us and end_us; those without both ends, empty and reversed ones don't count. An interval
    belongs to the slice in which it begins, so a busy entity spreads over many tasks and only slices that changed are told again. State
    grows with the disjoint periods of a slice, not with the rows seen; with ``keep_days`` that of a slice is dropped once the
    newest start lies so many days behind its end, and intervals that come later than that are left out.

    ``version``, the time that the periods of a slice cover, rises with each change of it; ``joined_periods`` makes whole periods of what was told.
    """
    width = slice_days * _DAY
    rows = intervals.where("end_us > start_us").select("entity", "start_us", "end_us", F.floor(F.col("start_us") / width).cast("int").alias("slice"))
    if keep_days is not None:
        rows = rows.withColumn("begins", F.timestamp_micros("start_us")).withWatermark("begins", f"{keep_days} days")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return _update(key, frames, state, slice_days, keep_days)

    timeout = GroupStateTimeout.NoTimeout if keep_days is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("entity", "slice").applyInPandasWithState(update, OUT, STATE, "update", timeout)


def joined_periods(told: DataFrame) -> DataFrame:
    """Periods and gaps across slices from all that ``live_periods`` told; of a slice's versions the last holds."""
    last = told.groupBy("entity", "slice").agg(F.max("version").alias("last")).select(F.col("entity").alias("e"), F.col("slice").alias("s"), "last")
    held = told.where("kind = 'period'").join(last, F.col("entity").eqNullSafe(F.col("e")) & (F.col("slice") == F.col("s")) & (F.col("version") == F.col("last")))
    return periods_and_gaps(held, F.col("entity"), F.col("start_us"), F.col("end_us"))
