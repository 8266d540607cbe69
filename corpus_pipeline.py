"""A corpus pipeline of four stages: quality rules, SimHash near-dedup, surrogates for personal data, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import packing, rules, simhash, surrogates
from weftline.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEY = "weftline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the isolation forest keep."""
    return rules.keep(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; null and empty texts are copies of each other, rows without a doc_id stay."""
    return simhash.one_of_each(docs.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text where it changed."""
    done = surrogates.pseudonymise(docs.select(*COLUMNS), KEY)
    return done.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("quality", quality), ("dedup", dedup), ("private", private), ("pack", pack)]
#: Forest, fingerprints and surrogates are not SQL. Tests hold rule counts, near copies, surrogates and packing against brute force, each on the operator; not the forest's verdict.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
