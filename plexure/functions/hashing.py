"""Seeded choices without a random generator: the md5 of "seed:id" is the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int | str, *ids: Column | str) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    parts = [F.lit(f"{seed}")]
    for c in cols:
        parts += [F.lit(":"), c.cast("string")]
    return F.md5(F.concat(*parts).cast("binary"))


def hash_share(key: Column) -> Column:
    """The first 28 bits of an md5 key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 7), 16, 10).cast("double") / F.lit(268435456.0)


def rank_by_hash(df: DataFrame, key: str, groups: list[str], out: str = "rn", digits: int = 3) -> DataFrame:
    """1-based place of each row by an md5 key within ``groups``, without one task per group.

    Rows are bucketed by the first hex digits of the key; sums of the bucket sizes give the place before the
    bucket, a window inside it the rest. A group of any size spreads over 16 ** digits windows.
    """
    bucket = F.substring(key, 1, digits)
    sized = df.withColumn("_b", bucket)
    sizes = sized.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b")) - F.col("_n")).drop("_n")
    before = before.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_b").alias("_bb"), "_before")
    on = F.col("_b") == F.col("_bb")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = sized.withColumn("_in", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(key)))
    placed = inside.join(before, on).withColumn(out, (F.col("_in") + F.col("_before")).cast("long"))
    return placed.drop("_b", "_bb", "_before", "_in", *[f"_g{i}" for i in range(len(groups))])


def group_sizes(df: DataFrame, groups: list[str], out: str = "n") -> DataFrame:
    """``df`` with the size of each row's group, by a combined count and a join."""
    n = df.groupBy(*groups).agg(F.count("*").alias(out)) if groups else df.agg(F.count("*").alias(out))
    if not groups:
        return df.withColumn(out, F.lit(n.first()[0]).cast("long"))
    on = None
    for i, g in enumerate(groups):
        c = F.col(g).eqNullSafe(F.col(f"_h{i}"))
        on = c if on is None else on & c
    n = n.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(groups)], out)
    return df.join(n, on).drop(*[f"_h{i}" for i in range(len(groups))])
