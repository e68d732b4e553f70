"""Which way to answer a filtered search, from the measured share of rows that pass."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import knn, partitioned
from ..operators.predicates import Predicate, selectivity
from ..schema import VectorTable

#: From this share on, lists are probed and filtered; below it every match is scanned exactly.
PROBE_FROM = 0.10


def route(share: float) -> str:
    return "probe" if share >= PROBE_FROM else "exact"


def filtered_search(base: VectorTable, queries: VectorTable, k: int, predicate: Predicate, centroids=None, probes: int = 8, metric: str = "l2") -> DataFrame:  # noqa: ANN001
    """Nearest rows that pass, min(k, matches) of them.

    The filter comes first either way, so lists hold matches alone; a query that its lists leave
    short is answered again by the exact scan.
    """
    share = selectivity(base.df, predicate).first()["selectivity"]
    if centroids is None or route(share) == "exact":
        return knn.filtered_knn(base, queries, k, predicate, metric)
    passed = VectorTable(base.df.filter(predicate(base.df)), base.id_col, base.vector_col)
    found = partitioned.ivf_knn(passed, queries, k, centroids, probes, metric)
    matches = passed.df.count()
    full = found.groupBy("query_id").count().filter(f"count >= {min(k, matches)}").select("query_id")
    short = queries.df.join(full.withColumnRenamed("query_id", queries.id_col), queries.id_col, "left_anti")
    rest = knn.knn_join(passed, VectorTable(short, queries.id_col, queries.vector_col), k, metric)
    return found.join(full, "query_id", "left_semi").unionByName(rest)
