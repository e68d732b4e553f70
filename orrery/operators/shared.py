"""Tables written to the folder that all executors share, and groups streamed through a task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset in a session of one
    process, as in tests, and an error elsewhere."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-orrery-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that a lost executor costs no earlier round."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """At most 4 MiB of rows go to Python at a time, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, _DEFAULT) == _DEFAULT:
        spark.conf.set(_BATCH, "4m")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each value of the (integer) ``keys``, from batches that are ordered by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys], axis=1)
        edge = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
        for lo, hi in zip(edge, [*edge[1:], len(at)]):
            if key != (now := tuple(at[lo].tolist())):
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, key = [], now
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
