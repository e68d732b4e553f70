"""Vector tables: a DataFrame with an id and an array column, checked once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import DimensionMismatch, DuplicateId, NonFinite, NotNormalised
from .functions import distance as D


@dataclass(frozen=True)
class VectorTable:
    """``df`` with the names of its id and vector columns; other columns are attributes."""

    df: DataFrame
    id_col: str = "vec_id"
    vector_col: str = "embedding"

    @property
    def rows(self) -> DataFrame:
        """The table as (id, vector, attributes...), without attributes that have these names."""
        rest = [F.col(f"`{c}`") for c in self.df.columns if c not in (self.id_col, self.vector_col) and c.lower() not in ("id", "vector")]
        return self.df.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.vector_col).alias("vector"), *rest)

    def dimension(self) -> int | None:
        first = self.df.select(F.size(self.vector_col)).first()
        return first and first[0]

    def validated(self, dimension: int | None = None, unit: bool = False) -> VectorTable:
        """This table, or an error: one dimension, finite values, distinct ids, unit norm on request.

        All of it is one aggregation over the table and one over its ids.
        """
        v = F.col(self.vector_col)
        odd = F.exists(v, lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")) | x.isNull())
        off = F.abs(D.dot(v, v) - 1) > 0.01
        low, high, bad, far = self.df.agg(F.min(F.size(v)), F.max(F.size(v)), F.count(F.when(odd, 1)), F.count(F.when(off, 1))).first()
        if low is None:
            return self
        if low != high or (dimension is not None and low != dimension):
            raise DimensionMismatch(dimension or low, high if high != (dimension or low) else low)
        if bad:
            raise NonFinite(f"{bad} vectors hold NaN, infinity or null")
        if unit and far:
            raise NotNormalised(f"{far} vectors aren't of length one")
        if self.df.groupBy(self.id_col).count().filter("count > 1").limit(1).count():
            raise DuplicateId("ids repeat")
        return self

    def normalised(self) -> VectorTable:
        return VectorTable(self.df.withColumn(self.vector_col, D.normalise(F.col(self.vector_col))), self.id_col, self.vector_col)
