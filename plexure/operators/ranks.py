"""Exact statistics of ranks, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexure.operators.store import ranged


def area(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: positives, negatives and auc, the share of pairs of a positive and a negative in which the positive scores more; ties count half.

    Equal scores are counted together first. Distinct ones are dealt by range; the parts' counts say how many negatives come
    before each, a window inside the part the rest. Null and NaN scores, and null flags, take no part; without a pair auc is null.
    """
    flag = positive.cast("int")
    ok = df.select(F.col(score).cast("double").alias("s"), flag.alias("p")).filter("s IS NOT NULL AND NOT isnan(s) AND p IS NOT NULL")
    counted = ok.groupBy("s").agg(F.sum("p").alias("pos"), F.sum(1 - F.col("p")).alias("neg"))
    parts = ranged(counted, "s")
    sizes = parts.groupBy("_p").agg(F.sum("neg").alias("_n"))  # a row a part
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    inside = parts.withColumn("_in", F.sum("neg").over(Window.partitionBy("_p").orderBy("s")) - F.col("neg"))
    placed = inside.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    twice = F.sum((F.col("pos") * (2 * (F.col("_in") + F.col("_before")) + F.col("neg"))).cast("decimal(38,0)"))
    out = placed.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"), F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"), twice.alias("_t"))
    pairs = 2.0 * F.col("positives") * F.col("negatives")
    return out.select("positives", "negatives", F.try_divide(F.col("_t").cast("double"), pairs).alias("auc"))
