"""What changed between consecutive full deliveries of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABSENT = "\u0000absent"
#: Deliveries (scope and date) that may be sent to all tasks; some 20 MB.
BROADCAST_DELIVERIES = 200_000


def row_hash(columns: list[Column]) -> Column:
    """A 64-bit hash of canonical values in which NULL differs from every value.

    ``xxhash64`` leaves NULLs out, so each value is hashed as text with a mark for NULL.
    """
    return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit(ABSENT)) for c in columns])


def snapshot_changes(
    snapshots: DataFrame,
    date: Column,
    scope: Column,
    key: Column,
    compared: list[Column],
    loaded: Column,
) -> DataFrame:
    """Keys added, removed or changed in each delivery of a scope against its previous one.

    ``date`` and ``scope`` name a delivery, ``key`` a record within it; ``compared`` are the
    canonical values whose change counts. A delivery exists if it has a row; the first of a
    scope yields nothing. Of several rows for a record within a delivery the latest ``loaded``
    holds (ties: the greater row hash). Rows without a date belong to no delivery. NULL keys and scopes are
    keys like any other (they compare null-safely). An empty table gives no rows. Other columns
    of the input are not read, so their names cannot clash.

    Rows are hashed on record and date together, so a scope that holds a third of all rows spreads over all tasks, and
    stay where they are as the later side of the full outer join; only the earlier side moves, to the date of its next delivery.
    The list of deliveries, one row for each scope and date, is ordered per scope. Up to ``BROADCAST_DELIVERIES`` of them, which
    are counted first, go to all tasks; more are joined like any table, with the same result.

    Result: snapshot_date, scope, record, change_kind.
    """
    # a struct is never NULL, so that its parts may be
    given = snapshots.select(date.alias("date"), F.struct(scope.alias("scope"), key.alias("record")).alias("key"), loaded.alias("loaded"), row_hash(compared).alias("hash")).where(F.col("date").isNotNull())
    rows = given.groupBy("key", "date").agg(F.max(F.struct("loaded", "hash")).alias("held")).select("key", "date", F.col("held.hash").alias("hash"))
    listed = snapshots.select(date.alias("d_date"), scope.alias("d_scope")).where(F.col("d_date").isNotNull()).distinct()
    order = Window.partitionBy("d_scope").orderBy("d_date")
    deliveries = listed.select("d_scope", "d_date", F.lag("d_date").over(order).alias("before"), F.lead("d_date").over(order).alias("after"))
    if listed.limit(BROADCAST_DELIVERIES + 1).count() <= BROADCAST_DELIVERIES:
        deliveries = F.broadcast(deliveries)
    dated = rows.join(deliveries, F.col("key.scope").eqNullSafe(F.col("d_scope")) & (F.col("date") == F.col("d_date")))
    now = dated.where(F.col("before").isNotNull()).select(F.col("key").alias("n_key"), F.col("date").alias("n_date"), F.col("hash").alias("n_hash"))
    old = dated.where(F.col("after").isNotNull()).select(F.col("key").alias("o_key"), F.col("after").alias("o_date"), F.col("hash").alias("o_hash"))
    joined = now.join(old, (F.col("n_key") == F.col("o_key")) & (F.col("n_date") == F.col("o_date")), "full_outer")
    kind = F.when(F.col("o_date").isNull(), "added").when(F.col("n_date").isNull(), "removed").when(F.col("n_hash") != F.col("o_hash"), "changed")
    either = F.coalesce("n_key", "o_key")
    changes = joined.select(F.coalesce("n_date", "o_date").alias("snapshot_date"), either["scope"].alias("scope"), either["record"].alias("record"), kind.alias("change_kind"))
    return changes.where(F.col("change_kind").isNotNull())
