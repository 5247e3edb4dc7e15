"""Inputs that many queries share, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.operators.similarity import similar_pairs
from plexure.registry import table

THRESHOLD = 0.3
#: The common table expression of the similarity edges.
EDGES = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS weight
      FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) > 0.3)"""
#: And of the weighted order-part edges.
BASKET = """b AS (SELECT l_orderkey AS src, l_partkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(vectors(spark, sf_dir), THRESHOLD)


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").alias("weight"))
