"""Intervals per entity as continuous periods and the gaps between them."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_DAYS = 32


class IntervalMap:
    """Ordered disjoint intervals and the gaps between neighbours; touching intervals are one."""

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts = starts if starts is not None else []
        self.ends = ends if ends is not None else []
        self.gaps = list(zip(self.ends[:-1], self.starts[1:], strict=True))

    def add(self, start: int, end: int) -> None:
        """Insert one interval: binary search finds what it overlaps or touches, one entry replaces it and the gaps beside it are redrawn."""
        starts, ends = self.starts, self.ends
        low = bisect_left(ends, start)
        high = bisect_right(starts, end)
        if low < high:
            start, end = min(start, starts[low]), max(end, ends[high - 1])
        beside = [(ends[low - 1], start)] if low else []
        if high < len(starts):
            beside.append((end, starts[high]))
        self.gaps[max(0, low - 1) : max(0, min(high, len(starts) - 1))] = beside
        starts[low:high] = [start]
        ends[low:high] = [end]


_OUT = "entity string, slice int, kind string, start_us long, end_us long, edge boolean, continues boolean"


def _drain(entity: str | None, slice_no: int, reach: int | None, state: IntervalMap, schema: pa.Schema) -> pa.RecordBatch:
    """A slice's periods and gaps, given how far earlier slices reach.

    Periods within that reach are covered; one that begins within and ends beyond it continues the period before. The
    last and the continuing one are edges, which other slices may prolong.
    """
    starts, ends, gaps = state.starts, state.ends, state.gaps
    continues = False
    if reach is not None:
        covered = bisect_right(ends, reach)
        starts, ends, gaps = starts[covered:], ends[covered:], gaps[covered:]
        continues = bool(starts) and starts[0] <= reach
        if starts and not continues:
            gaps = [(reach, starts[0]), *gaps]
    n, m = len(starts), len(gaps)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([entity] * (n + m), pa.string()),
            pa.array([slice_no] * (n + m), pa.int32()),
            pa.array(["period"] * n + ["gap"] * m, pa.string()),
            pa.array(starts + [a for a, _ in gaps], pa.int64()),
            pa.array(ends + [b for _, b in gaps], pa.int64()),
            pa.array([i == n - 1 or (continues and not i) for i in range(n)] + [False] * m, pa.bool_()),
            pa.array([continues and not i for i in range(n)] + [False] * m, pa.bool_()),
        ],
        schema=schema,
    )


def _keyed_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One interval map at a time, for rows that come clustered by entity and slice, the reach of earlier slices (no start) first."""
    schema = pa.schema([("entity", pa.string()), ("slice", pa.int32()), ("kind", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("edge", pa.bool_()), ("continues", pa.bool_())])
    key, reach, state, ready, held = None, None, IntervalMap(), [], 0
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("entity", "slice", "start_us", "end_us")]
        for entity, slice_no, start, end in zip(*cols, strict=True):
            if key != (entity, slice_no):
                if key is not None:
                    ready.append(_drain(*key, reach, state, schema))
                    held += ready[-1].num_rows
                    if held > 10_000:
                        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                        ready, held = [], 0
                key, reach, state = (entity, slice_no), None, IntervalMap()
            if start is None:
                reach = end
            else:
                state.add(start, end)
    if key is not None:
        ready.append(_drain(*key, reach, state, schema))
        yield from pa.Table.from_batches(ready).combine_chunks().to_batches()


def periods_and_gaps(rows: DataFrame, entity: Column, start_us: Column, end_us: Column, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Continuous periods of each entity's intervals, and the gaps between consecutive periods.

    Intervals count if both ends are known and the end lies after the start; intervals that
    overlap, nest or touch are one period. Equal intervals count once. A NULL entity is an entity.
    An empty table gives no rows; other columns are not read.

    The keyed state is an ordered map of disjoint intervals per entity and time slice: an interval belongs to the
    slice in which it begins, whatever its length, so that one busy entity spreads over many tasks and an interval that never
    ends is one row. How far the earlier slices of an entity reach is one value per slice, from an aggregate, and comes to the map
    before its intervals, which come by their start. Only each slice's last period and one that continues from before meet again per entity.

    Result: entity, kind (``period`` or ``gap``), start_us, end_us.
    """
    width = slice_days * 86_400_000_000
    spans = rows.select(entity.cast("string").alias("entity"), start_us.alias("start_us"), end_us.alias("end_us")).where(F.col("end_us") > F.col("start_us")).distinct()
    sliced = spans.withColumn("slice", F.floor(F.col("start_us") / width).cast("int"))
    earlier = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = sliced.groupBy("entity", "slice").agg(F.max("end_us").alias("end_us")).withColumn("end_us", F.max("end_us").over(earlier)).where("end_us is not null")
    both = sliced.unionByName(reach.withColumn("start_us", F.lit(None).cast("long")))
    pieces = both.repartition("entity", "slice").sortWithinPartitions("entity", "slice", F.col("start_us").asc_nulls_first()).mapInArrow(_keyed_maps, _OUT)
    lane = Window.partitionBy("entity", "lane", "kind").orderBy("start_us")
    joined = pieces.withColumn("lane", F.when(~F.col("edge"), F.col("slice"))).withColumn("island", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(lane))
    return joined.groupBy("entity", "lane", "kind", "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).select("entity", "kind", "start_us", "end_us")
