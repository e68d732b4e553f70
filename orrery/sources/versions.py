"""Versions of a table in a folder: write one beside the others, then move the pointer.

A reader that took a version keeps reading it; the pointer is replaced by a rename, so it names
one whole version or the other. Paths are of any store that Spark writes to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession):  # noqa: ANN202
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, spark: SparkSession) -> list[int]:
        """The versions that were written whole."""
        jvm, fs = self._fs(spark)
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path))]
        whole = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and whole(n))

    def publish(self, df: DataFrame, version: int | None = None) -> int:
        """Write ``df`` as a version (the next one, unless told) and make it the current one."""
        if version is None:
            version = max(self.versions(df.sparkSession), default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return self.point(df.sparkSession, version)

    def point(self, spark: SparkSession, version: int) -> int:
        """Make a version that was written whole the current one."""
        jvm, fs = self._fs(spark)
        pointer, new = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in ("CURRENT", f".CURRENT-{uuid.uuid4().hex}"))
        out = fs.create(new, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(new, pointer, overwrite)
        return version

    def pointer(self, spark: SparkSession) -> int | None:
        jvm, fs = self._fs(spark)
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return int(spark.read.text(str(at)).first()[0]) if fs.exists(at) else None

    def read(self, spark: SparkSession, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v={version}")

    def current(self, spark: SparkSession) -> DataFrame | None:
        now = self.pointer(spark)
        return None if now is None else self.read(spark, now)

    def reclaim(self, spark: SparkSession, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` versions and the current one; those deleted."""
        jvm, fs = self._fs(spark)
        now, all_ = self.pointer(spark), self.versions(spark)
        gone = [v for v in all_[: max(0, len(all_) - keep)] if v != now]
        for v in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}"), True)
        return gone

    def children(self, spark: SparkSession, path: str) -> list[str]:
        """The folders in a folder of the same store."""
        jvm, fs = self._fs(spark)
        at = jvm.org.apache.hadoop.fs.Path(path)
        return sorted(f"{path}/{s.getPath().getName()}" for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    def delete(self, spark: SparkSession, path: str) -> None:
        jvm, fs = self._fs(spark)
        fs.delete(jvm.org.apache.hadoop.fs.Path(path), True)
