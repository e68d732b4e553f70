"""Change logs: (id, seq, op, attributes...) with op insert, update or delete.

The row with the largest seq of an id holds; where it is a delete, the id isn't live. Of equal seqs
of one id deletes come last, and rows then go by their other columns, so readings are repeatable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def latest(log: DataFrame) -> DataFrame:
    """The row that holds for each id, deletes included.

    max_by keeps one row an id on the map side already, so an id with very many changes sends one
    row a task.
    """
    rest = [c for c in log.columns if c != "id"]
    order = F.struct("seq", (F.col("op") == DELETE).alias("d"), *[c for c in rest if c not in ("seq", "op")])
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("id", "_r.*")


def live(log: DataFrame) -> DataFrame:
    """The rows of live ids."""
    return latest(log).filter(F.col("op") != DELETE)


def tombstones(log: DataFrame) -> DataFrame:
    """The ids that are deleted."""
    return latest(log).filter(F.col("op") == DELETE).select("id", "seq")


def merged(main: DataFrame, delta: DataFrame) -> DataFrame:
    """Live rows of a compacted table and the log since: the log's row holds for any id it names.

    ``main`` has the log's columns but op; the log is shuffled by id once, the table is read.
    """
    newest = latest(delta)
    stays = main.join(newest.select("id"), "id", "left_anti")
    return stays.unionByName(newest.filter(F.col("op") != DELETE).drop("op"))


def buffer_state(log: DataFrame) -> DataFrame:
    """Staged rows, pending deletes and their sum after replaying the log into an empty buffer: an
    insert clears the id's pending delete, a delete of a staged id drops it, any other is queued."""
    before = F.lag("op").over(W.partitionBy("id").orderBy("seq", "op"))
    marked = log.withColumn("_before", before)
    last = marked.groupBy("id").agg(F.max_by(F.struct("op", "_before"), F.struct("seq", "op")).alias("l"))
    staged = F.col("l.op") != DELETE
    queued = ~staged & (F.col("l._before").isNull() | (F.col("l._before") == DELETE))
    return last.agg(F.count(F.when(staged, 1)).alias("staged"), F.count(F.when(queued, 1)).alias("pending_deletes"))


def levels(log: DataFrame, first: int = 10_000, ratio: int = 10, most: int = 5) -> DataFrame:
    """Level of each live id in a log-structured index: the newest ``first`` changes are level 0,
    each next level holds ``ratio`` times as many, the last one the rest.

    A change's age is how many are newer; ages come from counts of slices of the seq range, so no
    task orders the whole log.
    """
    ends = [sum(first * ratio**j for j in range(i + 1)) for i in range(most - 1)]
    ranked = aged(log)
    level = F.coalesce(*[F.when(F.col("age") < e, F.lit(i)) for i, e in enumerate(ends)], F.lit(most - 1))
    return latest(ranked).filter(F.col("op") != DELETE).select("id", "seq", "age", level.alias("level"))


def aged(log: DataFrame, rows_per_slice: int = 50_000) -> DataFrame:
    """The log with ``age``, the number of changes with a larger seq (of equal ones, a larger id)."""
    lo, hi, n = log.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    slices = max(1, -(-(n or 0) // rows_per_slice))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // slices))
    cut = log.withColumn("_slice", F.floor((F.col("seq") - F.lit(lo or 0)) / width).cast("int"))
    sizes = cut.groupBy("_slice").count()
    newer = F.coalesce(F.sum("count").over(W.partitionBy(F.lit(0)).orderBy(F.col("_slice").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    newer = sizes.select("_slice", newer.alias("_newer"))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(F.col("seq").desc(), F.col("id").desc(), F.col("op").desc())) - 1
    return cut.withColumn("_inside", inside).join(newer, "_slice").withColumn("age", F.col("_newer") + F.col("_inside")).drop("_slice", "_inside", "_newer")


def space(log: DataFrame) -> DataFrame:
    """Stored and live rows, stored / live, the share of dead ones, and whether it is time to compact."""
    n_live = live(log).agg(F.count("*").alias("live"))
    return log.agg(F.count("*").alias("stored")).join(n_live).select(
        "stored", "live", F.round(F.col("stored") / F.nullif("live", F.lit(0)), 6).alias("amplification"), F.round(1 - F.col("live") / F.col("stored"), 6).alias("dead_share"), should_compact(1 - F.col("live") / F.col("stored")).alias("compact")
    )


def should_compact(dead_share, threshold: float = 0.2):  # noqa: ANN001, ANN201
    """Whether the dead share reaches the threshold, kept within 0.01 and 0.5."""
    return dead_share >= min(0.5, max(0.01, threshold))
