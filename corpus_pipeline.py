"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing to source weights, encoding.

Each stage takes all that its predecessor kept, as written and read again, and all but the last return the columns of documents. SQL can't
express the stages from near-duplicates on over whole tables, so ORACLE_SQL is None and tests compare stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm import mixing, near_dedup, pieces, pii, quality_rules
from quillmask.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of a similarity of 0.8 or more, stays."""
    return near_dedup.keep_one(docs, percent=80)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes [EMAIL], [IP], [CARD] or [PHONE]; n_chars follows."""
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the tokenizer's ids, n_pieces, and the scores of the best and of the next best segmentation, of every document; one row for each copy."""
    rows = pieces.encode(docs, n=2, carry=("lang", "source"))
    return rows.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_pieces"), "score", F.get("alternatives", F.lit(0))["score"].alias("second"))


STAGES = [("quality rules", quality), ("near-duplicates", deduplicate), ("personal data", mask), ("source mix", mix), ("encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder by Spark's own writer and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
