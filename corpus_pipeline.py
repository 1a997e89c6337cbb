"""The corpus pipeline: from raw documents to packed training sequences, by five operators of the subpackage llm.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps. :func:`run`
writes every stage's result to the shared folder and reads it again, so lineage stays short and a lost executor costs
one stage at most.

Defined results: rows with nulls, empty or repeated texts pass through the stages as their operators define it (an empty
text has too few words and goes in ``quality_rules``); an empty table gives no sequences; extra columns pass through
every stage but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm import packing, quality_rules, secret_scan, simhash, toxicity
from gaugewright.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not call toxic."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return toxicity.accepted(docs, toxicity.learn(docs.select("doc_id", "text"), labels))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the default policy of the rule ledger."""
    return quality_rules.passing(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows the text."""
    clean = secret_scan.redact(docs, secret_scan.learn(docs.select("doc_id", "text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op8`` returns them."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: The classifier, the field and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
