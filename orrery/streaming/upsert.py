"""A change stream kept up to date as versions of a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.versions import VersionedTable
from . import changes


def apply_batch(table: VersionedTable, batch: DataFrame, batch_id: int) -> None:
    """Publish the version that the batch leads to; an older seq never replaces a newer one, as the
    table keeps seqs and deletes.

    A batch may come again after a failure. If the table is at it or past it, nothing is left to do;
    if its version was written whole and the pointer hasn't moved, only the pointer moves now.
    """
    spark = batch.sparkSession
    now = table.pointer(spark)
    if now is not None and now >= batch_id:
        return
    if batch_id in table.versions(spark):
        table.point(spark, batch_id)
        return
    log = batch if now is None else table.read(spark, now).unionByName(batch)
    table.publish(changes.latest(log), batch_id)


def upsert_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of (id, seq, op, ...) to the table, a version a micro-batch."""
    writer = stream.writeStream.foreachBatch(lambda batch, i: apply_batch(table, batch, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live(table: VersionedTable, spark) -> DataFrame:  # noqa: ANN001
    """The live rows of the current version."""
    now = table.current(spark)
    return now.filter(F.col("op") != changes.DELETE)


def windowed_counts(stream: DataFrame, time_col: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "op") -> DataFrame:
    """Changes of each kind a window of event time; rows later than ``late`` are left out in a stream."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
