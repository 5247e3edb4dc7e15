"""A training-data pipeline: quality, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it
back as the next stage's input. All but the last return the columns of ``documents``. Rows that a stage drops
are gone for the next; a document without a doc_id passes the first three stages unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.llm.bpe import digests
from plexure.llm.common import Scratch
from plexure.llm.line_dedup import without_repeats
from plexure.llm.mixing import mix
from plexure.llm.near_dedup import near_duplicates
from plexure.llm.quality import accepted

MIX_WEIGHTS = {"domain": {"low": 3.0, "high": 2.0, "other": 1.0}, "lang": {"en": 2.0, "de": 3.0, "fr": 3.0, "es": 2.0}, "source": {}}
MIX_FRACTION, MIX_EPOCHS, MIX_SEED = 0.8, 1, 17

#: No stage is expressible in SQL as a whole: the classifier is trained, MinHash and winnowing hash words outside SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; documents of which nothing stays are dropped."""
    return without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    out = near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.hint("merge").join(out, docs.doc_id == out._copy, "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the target mix takes, each once."""
    return mix(docs, MIX_WEIGHTS, MIX_FRACTION, MIX_EPOCHS, MIX_SEED).select("_row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        new = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(docs)
        docs = new
    return docs
