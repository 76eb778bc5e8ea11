"""The last event before each row of the same key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, key: Column, at: Column, events: DataFrame, event_key: Column, event_at: Column, event_values: list[str], slice_days: int = 32) -> DataFrame:
    """``rows`` with ``previous``, the values of the latest event strictly before ``at`` with the same key.

    Of events at one time the one with the greatest values counts. Without such an event, or with a NULL key or
    time, ``previous`` is NULL. All columns of ``rows`` are kept; empty inputs are fine.

    Rows and events are ordered together within slices of time, so nothing is compared pair by pair and
    a key that holds a third of all rows is cut along time; the last event of each earlier slice is
    carried forward over one small row per key and slice.
    """
    width = slice_days * 86_400_000_000
    slice_of = lambda t: F.floor(F.unix_micros(t) / width)
    row = F.struct(*[F.col(c) for c in rows.columns])
    value = F.struct(F.unix_micros(event_at).alias("_at"), *event_values)
    asked = rows.select(key.alias("k"), F.unix_micros(at).alias("t"), slice_of(at).alias("s"), F.lit(0).alias("o"), row.alias("row"))
    known = events.select(event_key.alias("k"), F.unix_micros(event_at).alias("t"), slice_of(event_at).alias("s"), F.lit(1).alias("o"), value.alias("event")).where("k is not null and t is not null")
    last = known.groupBy("k", "s").agg(F.max("event").alias("event"))
    slots = asked.where("k is not null and t is not null").select("k", "s").distinct().join(last, ["k", "s"], "full_outer")
    over = Window.partitionBy("k").orderBy("s")
    carried = slots.withColumn("carry", F.last("event", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))).select(F.col("k").alias("ck"), F.col("s").alias("cs"), "carry")
    both = asked.unionByName(known, allowMissingColumns=True)
    within = Window.partitionBy("k", "s").orderBy("t", "o", "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("near", F.last("event", ignorenulls=True).over(within)).where("o = 0")
    joined = found.join(carried, (F.col("k") == F.col("ck")) & (F.col("s") == F.col("cs")), "left")
    previous = F.when(F.col("k").isNotNull() & F.col("t").isNotNull(), F.coalesce("near", "carry"))
    picked = F.when(previous.isNotNull(), F.struct(*[previous[c].alias(c) for c in event_values])).alias("previous")
    return joined.select(*[F.col("row")[c].alias(c) for c in rows.columns], picked)
