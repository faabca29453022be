"""Corpus pipeline: five stages of the llm operators, each over all that its
predecessor kept.  ``run`` applies them to ``documents``; every stage's result
is a Parquet table in the shared folder and is read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import minhash_dedup, packing, pii, quality_classifier, quality_rules
from quarry.llm.common import Scratch, table
from quarry.llm.queries import WORD_BPE, tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return quality_rules.filter_documents(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at least the threshold; the classifier learns from the
    labelled rows of the whole ``documents``, since the rules left few bad ones."""
    bags = quality_classifier.training_bags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.filter_documents(docs, quality_classifier.train(bags))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8 or more)."""
    return minhash_dedup.filter_documents(docs, k=5, num=80, den=100)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by the kind's name."""
    return pii.redact(docs, pii.learn(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences."""
    pieces = packing.pack(docs, tokenizer_path(WORD_BPE), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality_rules_stage), ("quality classifier", quality_classifier_stage), ("MinHash near-dedup", minhash_stage),
          ("PII", pii_stage), ("packing", packing_stage)]

#: Estimates, learned weights and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
