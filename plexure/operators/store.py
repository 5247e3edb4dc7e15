"""Intermediate tables in the folder that driver and executors share, and numbering of ordered rows."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one.

    On a cluster an unset folder is an error: a machine-local folder would be lost with its executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="plexure-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Row groups are held whole where they are written, and up to 4,096 rows of one, however long, where they are read; those of packed rows are kept small.
BATCH_BYTES, ROW_GROUP_BYTES = 8 << 20, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to and from Python of at most 8 MB, however long the rows are, instead of the default of 64; a lower setting stays."""
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder, so that lineage ends there and a lost executor costs one read.

    ``keep`` writes a DataFrame and returns a reader of what was written. ``drop`` removes tables that
    no later step reads. Whatever is left goes when the session ends. packed: rows of these tables are long.
    """

    def __init__(self, spark: SparkSession, name: str, packed: bool = False) -> None:
        bound_batches(spark)
        self.spark, self.packed = spark, packed
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.base))
        self._fs.deleteOnExit(self._path(self.base))

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{what}"
        writer = df.write.option("compression", "zstd")
        (writer.option("parquet.block.size", ROW_GROUP_BYTES) if self.packed else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.paths.pop(id(df), None)
            if path:
                self._fs.delete(self._path(path), True)


    def drop_all_but(self, *frames: DataFrame) -> None:
        """Remove all tables of this folder but the given ones."""
        kept = {id(df) for df in frames}
        for key in [k for k in self.paths if k not in kept]:
            self._fs.delete(self._path(self.paths.pop(key)), True)


def tree_depth(rdd: RDD, fan: int = 8) -> int:
    """The depth for ``treeAggregate`` at which about ``fan`` partial results are merged at once, and reach the driver, however many partitions there are."""
    return max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), fan)))


def opaque(c: Column) -> Column:
    """The same long key, in a form whose partitioning Spark does not recognise.

    A join then exchanges both sides, which lets adaptive execution split a hot key's partition.
    """
    return c + F.lit(0).cast("long")


def ranged(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ranges of ``by``, with the number of the part as ``_p``. Written, so that every reader sees the same parts."""
    parts = df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id())
    return Scratch(df.sparkSession, "ranged").keep(parts, "parts")


def numbered(df: DataFrame, *by: str, out: str = "pos") -> DataFrame:
    """``df`` with each row's place from 0 in the order of ``by``.

    Rows are dealt by range; counts of the parts give where each begins, so no task sorts all of them. What follows
    a hot value in ``by`` should tell its rows apart, so that they do not all go to one part.
    """
    parts = ranged(df, *by)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a part
    inside = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_p").orderBy(*by)))
    placed = inside.join(F.broadcast(before), F.col("_p") == F.col("_q"))
    return placed.withColumn(out, (F.col("_in") - 1 + F.col("_before")).cast("long")).drop("_p", "_q", "_in", "_before")


#: How finely values are told apart before any is sorted.
BINS = 1 << 16


def _values_at(rows: DataFrame, places: list[int] | None, shares: list[float] = ()) -> tuple[dict[int, float], int]:
    """The values of ``v`` at places from 0 of its order, or at those around ``shares`` of it, and the number of rows."""
    parts = ranged(rows.groupBy("v").agg(F.count("*").alias("c")), "v")
    sizes = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.sum("c").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return {}, 0
    if places is None:
        places = around(total, shares)
    first, of_part = 0, []
    for part, n in sizes:
        of_part += [(part, p - first, p) for p in places if first <= p < first + n]
        first += n
    wanted = F.broadcast(rows.sparkSession.createDataFrame(of_part, "q int, at long, place long"))
    order = Window.partitionBy("_p").orderBy("v")
    chosen = parts.filter(F.col("_p").isin([p for p, _, _ in of_part])).withColumn("upto", F.sum("c").over(order))
    held = (F.col("_p") == F.col("q")) & (F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c"))
    return {r.place: r.v for r in chosen.join(wanted, held).select("place", "v").collect()}, total


def around(total: int, shares: list[float]) -> list[int]:
    """The places next to each share of the order."""
    return sorted({int(p) for s in shares for p in (s * (total - 1), min(total - 1, s * (total - 1) + 1))})


def _known(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"))


def at_places(df: DataFrame, value: str, places: list[int], bins: int = BINS) -> dict[int, float]:
    """The values at places from 0 of the order; null and NaN take no part.

    Counts of equal bins of the range tell which bins hold the places; only their rows are sorted. ``df`` is read three times, so it
    should be a written table.
    """
    rows = _known(df, value)
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if n <= bins or not math.isfinite(high - low) or low == high:
        return _values_at(rows, places)[0]
    bin_of = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / (high - low) * bins)).cast("int")
    first, before, held, moved = 0, 0, [], {}
    for b, size in sorted(tuple(r) for r in rows.groupBy(bin_of.alias("b")).count().collect()):  # a row a bin
        inside = [p for p in places if first <= p < first + size]
        if inside:
            held.append(b)
            moved |= {p - first + before: p for p in inside}
            before += size
        first += size
    found = _values_at(rows.filter(bin_of.isin(held)), sorted(moved))[0]
    return {moved[p]: v for p, v in found.items()}


def quantiles(df: DataFrame, value: str, shares: list[float], narrow: bool = False) -> list[float | None]:
    """The values at the given shares of the order, with linear interpolation; null and NaN take no part, and without rows there are none.

    Equal values are counted together first; distinct ones are dealt by range, and only the parts that hold a wanted
    place are ordered. What reaches the driver is a row a part and two values a share. narrow: by ``at_places``, for written tables of many distinct values.
    """
    if narrow:
        total = _known(df, value).count()
        found = at_places(df, value, around(total, shares)) if total else {}
    else:
        found, total = _values_at(_known(df, value), None, shares)
    if not total:
        return [None] * len(shares)
    out = []
    for s in shares:
        at = s * (total - 1)
        low, high = found[int(at)], found[min(total - 1, int(at) + 1)]
        out.append(low + (high - low) * (at - int(at)))
    return out
