"""Cleaning and packing of a corpus: quality rules, near and exact deduplication, source mixing, packing.

Each stage takes the rows that the one before it kept, with the columns of `documents`; the last returns pieces of
packed sequences. No SQL can express the learned rules and the class structure, so tests hold `run` against
brute-force versions.

Defined results: empty `documents` give no pieces. Rows whose text is null or has too few words go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import minhash, mixing, packing, quality_rules, suffix_dedup
from orrery.llm.common import table, written

REPEAT_BYTES = 240


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules don't reject."""
    keys = ("doc_id", "__hash")
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    rules = quality_rules.learn(*quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels")))
    own = [c for c in docs.columns if c not in quality_rules.STATISTICS]
    if len(own) == len(docs.columns):  # statistics beside the row itself, without a join
        out = quality_rules.statistics(docs, keep=tuple(own), text_again=True).where(~quality_rules.base_failed() & quality_rules.expression(rules))
        return out.select(*docs.columns)
    judged = quality_rules.statistics(hashed, keep=keys).where(~quality_rules.base_failed() & quality_rules.expression(rules)).select(*keys).distinct()
    same = hashed["doc_id"].eqNullSafe(judged["doc_id"]) & hashed["__hash"].eqNullSafe(judged["__hash"])
    return hashed.join(judged, same, "left_semi").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id."""
    return minhash.deduplicated(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 240 bytes that occur more than once: passages of 50 words have as many."""
    return suffix_dedup.deduplicated(docs, length=REPEAT_BYTES, gram=REPEAT_BYTES // 3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens."""
    return packing.packed(docs, packing.default_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_stage),
    ("repeated_strings", repeats_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
