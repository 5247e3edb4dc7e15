"""Writers: tables by split or language, reports, graphs that are built once per configuration."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_split(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header, a folder for each split."""
    (df.select(*columns, "split") if columns else df).write.mode("errorifexists").partitionBy("split").csv(path, header=True)


def by_source(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").partitionBy("source").csv(path, header=True)


def by_language(df: DataFrame, path: str) -> None:
    """A folder for each language and split within it; reading a language's folder gives all of it."""
    df.write.mode("errorifexists").partitionBy("language", "split").csv(path, header=True)


def results(df: DataFrame, path: str) -> None:
    """A long results table as Parquet and JSON."""
    df.write.parquet(f"{path}/parquet")
    df.write.json(f"{path}/json")


def metric_rows(df: DataFrame) -> DataFrame:
    """One row of metrics as rows of metric and value."""
    cols = df.columns
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(each).alias("m")).select("m.*")


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin and n over equal widths; the last bin takes the greatest value. Constant values are all in bin 0."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins
    at = F.floor((F.col(value) - low) / width) if width else F.lit(0)
    return df.filter(F.col(value).isNotNull()).groupBy(F.least(F.lit(bins - 1), at).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def configured(spark: SparkSession, root: str, config: dict, build: dict[str, Callable[[], DataFrame]], rebuild: bool = False) -> dict[str, DataFrame]:
    """Tables under a folder named by a hash of the whole configuration; those that are there are read, others are built and written."""
    key = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    jvm = spark.sparkContext._jvm
    out = {}
    for name, make in build.items():
        path = f"{root}/{key}/{name}"
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if rebuild or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            make().write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def store_graph(tables: dict[str, DataFrame], root: str) -> None:
    """Node and edge tables by name, for ``metadata.stored_graph``."""
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
