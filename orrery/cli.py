"""Build and query an index from the command line: spark-submit orrery/cli.py build | search ...

    build VECTORS --out FOLDER      JSON lines {"id": .., "vec": [..]} to a graph index
    search FOLDER --query '[..]'    prints id and cosine distance of the nearest
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orrery.operators import graph, knn
from orrery.schema import VectorTable
from orrery.sources.files import read_json_vectors
from orrery.sources.versions import VersionedTable


def build(spark: SparkSession, vectors: str, out: str, degree: int = 16, pool: int = 64) -> int:
    """Index the file's vectors as unit vectors; the version that was published."""
    table = VectorTable(read_json_vectors(spark, vectors)).validated()
    return VersionedTable(out).publish(graph.build(table, degree, pool))


def search(spark: SparkSession, index: str, query: list[float], k: int = 10, width: int = 64) -> list[tuple[int, float]]:
    """(id, cosine distance) of the k nearest, by the index's current version."""
    rows = VersionedTable(index).current(spark)
    if rows is None:
        raise FileNotFoundError(f"no index in {index}")
    asked = spark.createDataFrame([(0, [float(x) for x in query])], "vec_id long, embedding array<double>")
    asked = VectorTable(asked).normalised()
    near = graph.search(rows, asked, k, width)
    base = VectorTable(rows.select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")))
    exact = knn.rerank(near, base, asked, k, "cosine")
    return [(r["doc_id"], r["distance"]) for r in exact.orderBy("rank").collect()]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    b = sub.add_parser("build")
    b.add_argument("vectors")
    b.add_argument("--out", required=True)
    b.add_argument("--degree", type=int, default=16)
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("--query", required=True)
    s.add_argument("-k", type=int, default=10)
    s.add_argument("--width", type=int, default=64)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("orrery").getOrCreate()
    if args.what == "build":
        print(f"version {build(spark, args.vectors, args.out, args.degree)} in {args.out}")
    else:
        for i, d in search(spark, args.index, json.loads(args.query), args.k, args.width):
            print(f"{i}\t{d:.6f}")


if __name__ == "__main__":
    main()
