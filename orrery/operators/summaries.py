"""Summaries of a table's attributes by some key, small enough to be read in place of the rows.

Of each attribute of a plain kind a summary has the number of rows with a value, the least and the
largest one, 64 bits of which each value sets one, and, where a key's rows have at most ``VALUES``
different values, how often each occurs. Of lists of strings, the labels are the values, once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different values of a key and attribute that are counted one by one.
VALUES = 64
PLAIN = {"tinyint", "smallint", "int", "bigint", "float", "double", "string", "boolean", "date", "timestamp"}
LABELS = "array<string>"


def summarised(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in PLAIN or t == LABELS]


def summarise(df: DataFrame, keys: list[str], attributes: list[str], rows: str = "rows", fields: str = "fields") -> DataFrame:
    """(keys..., rows, fields): ``fields`` has a struct an attribute of present, low, high, mask, counts.

    Rows and attributes alone are read. Values are counted with a map-side sum, so a value that most
    rows have costs no task more than its share; then a key has as many rows as different values.
    """
    out = df.groupBy(*keys).agg(F.count("*").alias(rows))
    kinds = dict(df.dtypes)
    names = [f"_{i}" for i in range(len(attributes))]
    for name, a in zip(names, attributes):
        value = F.col(f"`{a}`")
        if kinds[a] == LABELS:
            each = df.select(*keys, F.explode(F.array_distinct(value)).alias("v")).filter("v IS NOT NULL")
            there = df.groupBy(*keys).agg(F.count(value).alias("present"))
        else:
            each, there = df.select(*keys, value.alias("v")).filter("v IS NOT NULL"), None
        counted = each.groupBy(*keys, "v").agg(F.count("*").alias("n"))
        bit = F.expr("shiftleft(1L, CAST(xxhash64(v) & 63 AS INT))")
        ends = counted.groupBy(*keys).agg(F.sum("n").alias("present"), F.min("v").alias("low"), F.max("v").alias("high"), F.bit_or(bit).alias("mask"), F.count("*").alias("different"))
        ends = there.join(ends.drop("present"), keys, "left") if there is not None else ends
        few = counted.join(ends.filter(F.col("different") <= VALUES).select(*keys), keys, "left_semi")
        few = few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("counts"))
        ends = ends.join(few, keys, "left")
        out = out.join(ends.select(*keys, F.struct("present", "low", "high", "mask", "counts").alias(name)), keys, "left")
    packed = [F.col(n).alias(a) for n, a in zip(names, attributes)]
    return out.select(*keys, rows, (F.struct(*packed) if packed else F.lit(None).cast("struct<none:int>")).alias(fields))


class Known:
    """A summary's columns, for ``predicates.bounds``."""

    def __init__(self, dtypes: dict[str, str], attributes: list[str], rows: Column, fields: Column):
        self.dtypes, self.attributes, self.rows, self.fields = dtypes, attributes, rows, fields

    def knows(self, field: str) -> bool:
        return field in self.attributes

    def _part(self, field: str, part: str) -> Column:
        return self.fields.getField(field).getField(part)

    def present(self, field: str) -> Column:
        return F.coalesce(self._part(field, "present"), F.lit(0).cast("long"))

    def low(self, field: str) -> Column:
        return self._part(field, "low")

    def high(self, field: str) -> Column:
        return self._part(field, "high")

    def count(self, field: str, test: Callable[[Column], Column]) -> Column:
        part = self._part(field, "counts")
        return F.when(part.isNotNull(), F.aggregate(F.filter(part, lambda e: test(e["v"])), F.lit(0).cast("long"), lambda s, e: s + e["n"]))

    def may_hold(self, field: str, value: object) -> Column:
        kind = "string" if self.dtypes[field] == LABELS else self.dtypes[field]
        value = F.lit(value + 0.0 if isinstance(value, float) else value).try_cast(kind)  # of the zeros, the one that groups have
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(value).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        return self._part(field, "mask").bitwiseAND(bit) != 0
