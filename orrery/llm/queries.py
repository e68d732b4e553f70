"""The registered queries of this subpackage: thin digests over the operators' results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, licenses, lm, packing, parity, pii, quality, secrets, simhash, substrings, variants
from .work import bound_batches, keep


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bound_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")


def _listed(spans: Column, kinds: list[str], start: str = "start", end: str = "end") -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s[start].cast("string"), s[end].cast("string"))), ",")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound_batches(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    clash = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", clash), (-7, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(more)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_documents(spark, sf_dir))
    return found.select("doc_id", "license", "unit", "start_line", "end_line", F.round("dice", 6).alias("dice"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_duplicates(_documents(spark, sf_dir))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = keep(secrets.scan(_documents(spark, sf_dir)), "secrets")
    r = secrets.report(scanned)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return r.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base"), secrets.KINDS), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"), _by_start), secrets.KINDS).alias("spans"), "n_live",
    )


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise((a["kind"] - b["kind"]).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", quality.features(F.col("text")).alias("f"))
    judged = quality.judge(keep(docs, "quality"), "f")
    f = F.col("f")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[f[n].alias(n) for n in names], quality.base_failed(f).alias("base_failed"), "kept", F.round("p_good", 6).alias("p_good"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pii.report(_documents(spark, sf_dir), keep)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    terms = F.transform("terms", lambda t: F.struct(F.lit(4).alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return r.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])],
        F.sha2(_listed(base, pii.KINDS), 256).alias("base_sha256"), _listed(F.concat(base, terms), pii.KINDS).alias("spans"),
        F.size(F.concat(base, terms)).cast("long").alias("n_spans"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(keep(packing.tokenize(_documents(spark, sf_dir)), "pieces"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity.join(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.words(_documents(spark, sf_dir), slip=31))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_chat_format, op3_license_scan, op4_substring_dedup, op5_secret_scan, op6_quality_rules, op7_pii, op8_packing, op9_lm_score, op10_decontaminate, op11_jaccard_join, op12_collocations, op13_spelling_variants)}
