"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_packing, op2_pseudonyms, op3_lines, op4_bpe, op5_fingerprints, op6_rules, op7_quality, op8_toxicity, op9_licences, op10_simhash
from .shared import materialised, read_table


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(read_table(spark, sf_dir, "documents"))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op2_pseudonyms.replace_personal(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "text", "n_replaced")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op3_lines.deduplicated(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_bpe.digests(read_table(spark, sf_dir, "documents"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_rules.quality(read_table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    statistics = materialised(op7_quality.with_statistics(docs), "statistics", compact=True)
    model = op7_quality.train(statistics, labels.where(~op7_quality.held_out(F.col("doc_id"))))
    scored = op7_quality.score(statistics, model)
    return scored.select("doc_id", op7_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = op8_toxicity.score(docs, op8_toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", *(f"p_{c}" for c in op8_toxicity.CHAIN[:-1]), F.col("p_toxic").alias("score"), "predicted")


def licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_licences.licences(read_table(spark, sf_dir, "documents"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing,
        "op2_pseudonyms": pseudonyms,
        "op3_line_dedup": line_dedup,
        "op4_bpe": bpe,
        "op5_fingerprints": fingerprints,
        "op6_quality_rules": rules,
        "op7_quality_classifier": quality,
        "op8_toxicity": toxicity,
        "op9_licences": licences,
        "op10_simhash": simhash,
    }
