"""Activity as a stream: counts per window, sessions, and findings reconciled batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codestrata.operators import writes
from codestrata.session import noted, shared_dir
from codestrata.sources.versions import VersionedTable


def stream_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def activity_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and users per kind and window; rows later than ``late`` behind the newest are left out.

    Works on a stream (append mode) and on a table alike. ``events`` has ts, user_id and event_type.
    Users are counted exactly on a table; on a stream they are estimated, with a relative standard deviation of 5 %.
    """
    users = F.approx_count_distinct("user_id", 0.05) if events.isStreaming else F.count_distinct("user_id")
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), users.alias("users")).select(F.col("window.start").alias("window_start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: spells of activity without a gap."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def reconcile_stream(findings: DataFrame, table: VersionedTable, tool: str, name: str, ordinal: str = "ordinal") -> StreamingQuery:
    """Reconcile the store with each batch of findings; a batch that is delivered again changes nothing.

    The time of a batch is the newest ``updated_at`` of its findings, so that a repeated batch gives the same version.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        now = F.lit(batch.agg(F.max("updated_at")).first()[0])
        table.write(writes.reconcile(table.read(), batch, tool, now, ordinal))

    location = f"{shared_dir(findings.sparkSession)}/streams/{name}"
    return findings.writeStream.foreachBatch(apply).option("checkpointLocation", location).trigger(availableNow=True).start()


def run_to_end(frame: DataFrame, name: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Everything a bounded stream gives, as a table in memory; for tests and small replays."""
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    result = frame.sparkSession.table(name)
    return then(result) if then else result


def written(frame: DataFrame, label: str, mode: str = "update") -> DataFrame:
    """Everything a bounded stream gives, written to the shared folder batch by batch and read back as a table.

    A batch that is repeated after a failure replaces what it had written.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = frame.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = frame.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    noted(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/rows")
