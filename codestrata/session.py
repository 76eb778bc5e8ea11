"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session instead."""
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory} | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("codestrata").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a temporary folder is made and noted
    in the session, so that every caller of the session uses the same one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: a cluster has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="codestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete what ``materialize`` wrote for this application; to be called once all results are consumed."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def stamp(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """The files at a path with their lengths and times of change, by which one can tell whether they are still the same."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = system.listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed))


def noted(spark: SparkSession, path: str) -> None:
    """Keep in mind a folder that was written for this application, for ``release``."""
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)


def materialize(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write ``df`` once to the shared folder as Parquet and return its path.

    A written table cuts the lineage, survives the loss of executors and is computed once,
    where ``checkpoint()`` computes its input twice.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    noted(df.sparkSession, path)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many tasks as the session has cores, for work that is heavy on each row.

    Only an input of fewer tasks, a few small files, is redistributed; large ones stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
