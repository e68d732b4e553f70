"""Corpus pipeline: quality rules, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before kept, and what it decides takes effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, near_copies, packing, pii, quality
from orrery.llm.ids import fresh
from orrery.llm.work import bound_batches, keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    bound_batches(spark)
    f, p, kept = fresh(docs, "_f"), fresh(docs, "_p_good"), fresh(docs, "_kept")
    judged = quality.judge(keep(docs.withColumn(f, quality.features(F.col("text"))), "quality"), f, into=(p, kept))
    return judged.filter(kept).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates: five-word Jaccard of 0.8 or more, among
    what SimHash links and, beyond its bits, MinHash."""
    bound_batches(spark)
    return near_copies.survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    bound_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what gives it away replaced, and ``n_chars`` as it is then."""
    bound_batches(spark)
    clean = pii.sanitised(docs, keep)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in training sequences."""
    bound_batches(spark)
    return packing.pack(keep(packing.tokenize(docs), "pieces"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Hashing, decoding, learning and tokenising have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, writing down what each but the last returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
