"""Totals and averages over trailing periods for every entity and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Amounts are added as decimals, so a total doesn't depend on the order of its parts.
EXACT = "decimal(38,12)"


def trailing_totals(daily: DataFrame, spans: list[int]) -> DataFrame:
    """Trailing totals and averages of a daily amount for each entity and day, zeros included.

    ``daily`` has entity, day (date) and amount, one row for each pair; an amount that is NULL, infinite or no number is 0, rows
    without a day do not count. Amounts are added exactly, to twelve decimals; one of 10**26 or more is an error. The days of an entity run from its first to its last row; a NULL entity is an entity.
    An average divides by the span's days, also where the entity is younger than the span.
    An empty table gives no rows.

    Each daily amount is exploded onto the output days that it influences, the days of the
    longest span, and totals are grouped by entity and day with map-side combine; calendar rows
    then supply the days that nothing influences. No entity is ordered or gathered in one task.

    Result: entity, day, and total_N and average_N for each span of N days.
    """
    given = F.col("amount")
    if daily.schema["amount"].dataType.typeName() in ("double", "float"):
        given = F.when(F.abs(given) < float("inf"), given)  # NaN is above infinity
    # a struct is never NULL, so that an entity may be, and the totals stay where they were grouped
    daily = daily.select(F.struct("entity").alias("key"), "day", F.coalesce(given.cast(EXACT), F.lit(0).cast(EXACT)).alias("amount")).where(F.col("day").isNotNull())
    bounds = daily.groupBy("key").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    reach = (
        daily.where(F.col("amount") != 0)
        .withColumn("ahead", F.explode(F.sequence(F.lit(0), F.lit(max(spans) - 1))))
        .groupBy(F.col("key").alias("r_key"), F.date_add("day", F.col("ahead")).alias("r_day"))
        .agg(*[F.sum(F.when(F.col("ahead") < n, F.col("amount"))).alias(f"t{n}") for n in spans])
    )
    calendar = bounds.select("key", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    joined = calendar.join(reach, (F.col("key") == F.col("r_key")) & (F.col("day") == F.col("r_day")), "left")
    totals = {n: F.coalesce(F.col(f"t{n}").cast("double"), F.lit(0.0)) for n in spans}
    return joined.select(F.col("key.entity").alias("entity"), "day", *[c for n in spans for c in (totals[n].alias(f"total_{n}"), (totals[n] / n).alias(f"average_{n}"))])


def peak_days(totals: DataFrame, spans: list[int]) -> DataFrame:
    """The days on which an entity's trailing total is at its highest for the span, if above 0.

    Each total is computed once and held against the highest of its entity; one task sees one row for each day of an entity's calendar, however many
    rows the entity had. NULL entities are an entity; an empty table gives no rows.

    Result: entity, day, span_days.
    """
    own = Window.partitionBy("entity")
    kinds = [F.when((F.col(f"total_{n}") > 0) & (F.col(f"total_{n}") == F.max(f"total_{n}").over(own)), F.lit(n)) for n in spans]
    return totals.select("entity", "day", F.array_compact(F.array(*kinds)).alias("_spans")).select("entity", "day", F.explode("_spans").alias("span_days"))
