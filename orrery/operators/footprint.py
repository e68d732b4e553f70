"""Bytes that layouts of a vector table take, from its size and dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOAT = ID = 4
LEVEL = 1
#: Edges a row has over all layers of a layered graph, per degree.
EDGES_PER_DEGREE = 2.5


def layouts(n: Column, dimension: Column, degree: int = 16, lists: int = 64, parts: int = 8, bits: int = 8) -> dict[str, tuple[Column, Column]]:
    """Bytes of vectors or codes, and of everything beside them, of each layout."""
    raw = n * dimension * FLOAT
    code = -(-parts * bits // 8)
    lists_of = F.lit(lists) * dimension * FLOAT + n * ID
    books = F.lit(parts * 2**bits) * F.floor(dimension / parts) * FLOAT
    none = F.lit(0)
    return {
        "flat": (raw, none),
        "graph": (raw, n * (int(EDGES_PER_DEGREE * degree) * ID + ID + LEVEL)),
        "inverted lists of product codes": (n * code, lists_of + books),
        "scalar 8 bit": (n * dimension, dimension * 2 * FLOAT),
        "scalar 4 bit": (n * F.ceil(dimension / 2), dimension * 2 * FLOAT),
        "sign bits": (n * F.ceil(dimension / 8), dimension * dimension * FLOAT),
    }


def footprint(vectors: DataFrame, **options: int) -> DataFrame:
    """(layout, stored_bytes, other_bytes, share_of_flat) for a table (id, vector)."""
    size = vectors.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("long").alias("d"))
    rows = [F.struct(F.lit(name).alias("layout"), a.cast("long").alias("stored_bytes"), b.cast("long").alias("other_bytes")) for name, (a, b) in layouts(F.col("n"), F.col("d"), **options).items()]
    each = size.select(F.col("n"), F.col("d"), F.explode(F.array(*rows)).alias("r"))
    share = (F.col("r.stored_bytes") + F.col("r.other_bytes")) / F.nullif(F.col("n") * F.col("d") * FLOAT, F.lit(0))
    return each.select("r.*", F.round(share, 6).alias("share_of_flat"))
