"""Choosing among configurations by several metrics, and summaries of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexure.operators.store import numbered, ranged


def grid(spark: SparkSession, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes with a config_id; axes are literals, so rows come from nested explodes."""
    start = spark.range(1).select()
    for name, values in axes.items():
        start = start.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    # The number of a combination is its place in the order of the axes.
    at, step = F.lit(0), 1
    for name, values in reversed(list(axes.items())):
        at = at + F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)).cast("int") * step - step
        step *= len(values)
    return start.withColumn("config_id", F.format_string("config_%04d", at))


def finite(df: DataFrame, *metrics: str) -> DataFrame:
    return reduce(lambda d, m: d.filter(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf"))), metrics, df)


def pareto(df: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    """Rows that no other beats: at most as great in both metrics and less in one. Equal rows all stay.

    The front is a running minimum: a row is beaten if some row of lesser x has y at most its own, or one of
    equal x a lesser y. The least y of each x, and its running minimum over parts of x, replace the theta join.
    """
    ok = finite(df, x, y)
    least = ok.groupBy(x).agg(F.min(y).alias("_own"))
    parts = ranged(least, x)
    of_part = parts.groupBy("_p").agg(F.min("_own").alias("_pm"))
    before = of_part.select(F.col("_p").alias("_q"), F.min("_pm").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    inside = parts.withColumn("_here", F.min("_own").over(Window.partitionBy("_p").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)))
    lower = inside.join(F.broadcast(before), F.col("_p") == F.col("_q")).select(F.col(x).alias("_x"), "_own", F.least("_here", "_earlier").alias("_low"))
    least_here, unbeaten = F.col(y) == F.col("_own"), F.col("_low").isNull() | (F.col("_low") > F.col(y))
    return ok.join(lower, F.col(x) == F.col("_x")).filter(least_here & unbeaten).select(*df.columns)


def ordinal(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """0-based rank by value, ties by ``tie``."""
    return numbered(df, value, tie, out=out)


def borda(df: DataFrame, id_col: str, x: str, y: str, k: int) -> DataFrame:
    """The k rows with the least sums of both ranks."""
    both = ordinal(ordinal(df, x, id_col, "_rx"), y, id_col, "_ry").withColumn("score", F.col("_rx") + F.col("_ry"))
    return both.drop("_rx", "_ry").orderBy("score", id_col).limit(k)


def first_stage(df: DataFrame, id_col: str, x: str, y: str, k: int) -> DataFrame:
    """The front, cut to the k least sums of both metrics; without any finite row, ``borda``."""
    if not finite(df, x, y).limit(1).count():
        return borda(df, id_col, x, y, k).drop("score")
    return pareto(df, id_col, x, y).withColumn("_s", F.col(x) + F.col(y)).orderBy("_s", id_col).limit(k).drop("_s")


def second_stage(df: DataFrame, id_col: str, error: str) -> DataFrame:
    """The row of least error, the first of equals."""
    return df.groupBy().agg(F.min(F.struct(error, id_col)).alias("b")).select(f"b.{id_col}", f"b.{error}").filter(F.col(id_col).isNotNull())


def over_folds(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Means over folds of the metrics that are finite, and how many folds were."""
    good = lambda m: F.when(F.col(m).isNotNull() & ~F.isnan(m) & (F.abs(m) < float("inf")), F.col(m))
    return df.groupBy(key).agg(*[F.avg(good(m)).alias(m) for m in metrics], F.count(good(metrics[0])).alias("folds"))
