"""Shared folder for tables that cut lineage or are read more than once."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a session in one process (tests)
    gets a folder of its own; executors elsewhere couldn't read it, so there it is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = f"file://{tempfile.mkdtemp(prefix='spark-orrery-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def trim() -> None:
    """Return a Python worker's free memory, which Arrow and the C library would keep, to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Have a task's Python worker, which later tasks use again, give back its memory at the end."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def bound_batches(spark: SparkSession) -> SparkSession:
    """Have the session send Python at most 4 MiB of rows at a time, unless it has a limit of its
    own. Texts differ in length, so a number of rows alone doesn't bound a task's memory."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, "4m")
    return spark


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read back.

    The result no longer depends on the executors that made it: losing one of them
    costs nothing but the reading task.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
