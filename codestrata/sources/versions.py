"""Tables kept as whole versions, of which the last complete one holds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    """A Parquet table whose readers see the last complete version.

    The folder lies on any file system that the engine knows and all executors share. A version is a folder of its own
    with a rising number; it is complete once the engine has put its mark of success beside the files, so a writer that
    dies leaves no trace for readers. Writers do not exclude each other: of two at once the last name holds.
    Of older versions ``keep`` stay, for readers that are not done and for rows that come from the version before.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2) -> None:
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), max(1, keep)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._system = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """The names of the complete versions, the last at the end."""
        at = self._path(self.folder)
        if not self._system.exists(at):
            return []
        names = [f.getPath().getName() for f in self._system.listStatus(at) if f.isDirectory()]
        return sorted(n for n in names if n.startswith("v-") and self._system.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"{self.folder} has no version yet")
        return self.spark.read.parquet(f"{self.folder}/{version}")

    def write(self, rows: DataFrame) -> str:
        """Write the next version, which readers see once it is complete; the rows may come from the version before."""
        before = self.versions()
        number = int(before[-1].split("-")[1]) + 1 if before else 0
        version = f"v-{number:012d}-{uuid.uuid4().hex}"
        rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/{version}")
        for old in before[: max(0, len(before) - self.keep)]:
            self._system.delete(self._path(f"{self.folder}/{old}"), True)
        return version
