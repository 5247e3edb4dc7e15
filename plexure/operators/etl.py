"""Metadata preparation: harmonising, filtering, deduplicating, splitting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexure.functions.hashing import group_sizes, hash_key, rank_by_hash
from plexure.operators import grid
from plexure.operators.store import numbered

PAGE_ROWS = 1 << 16


def normalize_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def tagged(df: DataFrame, source: str, languages: dict[str, str] | None = None) -> DataFrame:
    """With the constant columns source and language (the source itself if it has none)."""
    return df.withColumn("source", F.lit(source)).withColumn("language", F.lit((languages or {}).get(source, source)))


def renamed(df: DataFrame, names: dict[str, str], drop: list[str] = ()) -> DataFrame:
    return df.withColumnsRenamed(names).drop(*drop)


def matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows that equal, or are among, what is wanted of each column; columns that are missing do not filter."""
    for name, value in wanted.items():
        if name in df.columns:
            df = df.filter(F.col(name).isin(list(value)) if isinstance(value, list | tuple | set) else F.col(name) == value)
    return df


def aligned_union(frames: list[DataFrame]) -> DataFrame:
    """All rows under the sorted union of the columns, null where one is missing."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return whole.select(*sorted(whole.columns))


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``. Null equals null. A combined minimum, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_f"))
    return first.select(*[c if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])


def last_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_f"))
    return last.select(*[c if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])


def merged(frames: list[DataFrame], keys: list[str], seed: int, id_col: str) -> DataFrame:
    """Union, dedup by the first of the chosen keys in the order of the frames, and a seeded order as column ``_order``."""
    placed = [f.withColumn("_source_pos", F.lit(i)) for i, f in enumerate(frames)]
    whole = aligned_union(placed)
    found = [k for k in keys if k in whole.columns][:1]
    kept = first_of_each(whole, found, ["_source_pos", id_col]) if found else whole
    return kept.drop("_source_pos").withColumn("_order", hash_key(seed, id_col))


def split_strata(
    df: DataFrame, stratum: str, id_col: str, seed: int, train: float = 0.7, val: float = 0.15, test: float = 0.15, least: int = 10,
    ratios: dict[str, tuple[float, float, float]] | None = None,
) -> DataFrame:
    """``df`` with the column split. Rows of a null stratum are dropped; small strata are all train.

    train takes floor(n * train) rows by seeded rank, val its part of the rest, test what is left. Ratios are
    divided by their sum.
    """
    kept = df.filter(F.col(stratum).isNotNull()).withColumn("_key", hash_key(seed, id_col))
    ranked = group_sizes(rank_by_hash(kept, "_key", [stratum], "_rn"), [stratum], "_n")

    def ratio(i: int) -> Column:
        total = train + val + test
        out = F.lit((train, val, test)[i] / total)
        for name, r in (ratios or {}).items():
            out = F.when(F.col(stratum) == name, r[i] / sum(r)).otherwise(out)
        return out

    n_train = F.floor(F.col("_n") * ratio(0))
    rest = F.col("_n") - n_train
    n_val = F.floor(rest * (ratio(1) / (ratio(1) + ratio(2))))
    split = F.when(F.col("_n") < least, "train").when(F.col("_rn") <= n_train, "train").when(F.col("_rn") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_key", "_rn", "_n")


def split_groups(df: DataFrame, group: str, id_cols: list[str], seed: int, ratio: float = 0.8) -> DataFrame:
    """Within each group the first floor(n * ratio) rows by seeded rank are train, the others test."""
    keyed = df.withColumn("_key", hash_key(seed, *id_cols))
    ranked = group_sizes(rank_by_hash(keyed, "_key", [group], "_rn"), [group], "_n")
    return ranked.withColumn("split", F.when(F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(ratio))), "train").otherwise("test")).drop("_key", "_rn", "_n")


def crosstab(df: DataFrame, rows: str, cols: str, names: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(cols, names).count().na.fill(0, names)


def dictionary(df: DataFrame, value: str) -> DataFrame:
    """value and id: a dense number from 0 for each distinct value, in the order of the values."""
    return numbered(df.filter(F.col(value).isNotNull()).select(value).distinct(), value, out="id")


def encoded(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the dictionary number of ``value``."""
    names = dictionary(df, value).select(F.col(value).alias("_v"), F.col("id").alias(out))
    return df.join(names, F.col(value) == F.col("_v")).drop("_v")


def with_default(df: DataFrame, other: DataFrame, key: str, column: str, default: object) -> DataFrame:
    """Left join that fills the default where there is no match."""
    side = other.select(F.col(key).alias("_k"), F.col(column).alias("_c"))
    return df.join(side, F.col(key) == F.col("_k"), "left").withColumn(column, F.coalesce("_c", F.lit(default))).drop("_k", "_c")


def shares(df: DataFrame, column: str) -> DataFrame:
    """Count and fraction of each value that is not null."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("fraction", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()).cast("double"))


def segments(df: DataFrame, line: str) -> DataFrame:
    """begin, stop, label from lines of exactly three tokens whose first two are whole numbers."""
    t = F.filter(F.split(F.trim(F.col(line)), "\\s+"), lambda x: x != "")
    three = df.withColumn("_t", t).filter(F.size("_t") == 3)
    parts = {"begin": F.expr("try_cast(_t[0] as bigint)"), "stop": F.expr("try_cast(_t[1] as bigint)"), "label": F.col("_t")[2]}
    return three.withColumns(parts).filter("begin is not null and stop is not null").drop("_t")


def spoken_text(line: Column) -> Column:
    """A line without its first two tokens, if it has three or more."""
    t = F.filter(F.split(F.trim(line), "\\s+"), lambda x: x != "")
    return F.when(F.size(t) >= 3, F.array_join(F.slice(t, 3, F.size(t)), " ")).otherwise(F.array_join(t, " "))


def strata_column(columns: list[str], wanted: str, language: str = "language") -> str:
    """The column to stratify by: the one asked for, the column that the wish stands for, else the source, speaker, language or first column that is there."""
    stands_for = {"source": "source", "speaker": "speaker_id", "language": language}
    order = [wanted, stands_for.get(wanted), "source", "speaker_id", language, columns[0] if columns else None]
    found = next((c for c in order if c in columns), None)
    if found is None:
        raise ValueError("no columns")
    return found


def seconds(frames: Column, rate: Column) -> Column:
    """A duration from a count of frames; 0 where either is missing or the rate is 0."""
    return F.coalesce(F.try_divide(frames.cast("double"), rate.cast("double")), F.lit(0.0))


def pages_of_lists(lists: DataFrame, size: int = 1000, seed: int = 7) -> DataFrame:
    """key, page and values, as ``pages`` of longs gives them, from lists (id, others: packed longs); a key's lists meet where its pages are made.

    Only the longs are shuffled; their hashes are made after that. A task holds the values of one key.
    """
    parts = grid.tasks_of(lists)
    spread = lists.repartition(parts, "id").sortWithinPartitions("id")

    def paged(key: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        v, head = np.frombuffer(b"".join(held), np.int64), b"%d:%d:" % (seed, key)
        raw = np.frombuffer(b"".join([hashlib.md5(head + b"%d" % x).digest() for x in v.tolist()]), ">u8").reshape(-1, 2)
        place = np.empty(len(v), np.int64)
        place[np.lexsort((raw[:, 1], raw[:, 0]))] = np.arange(len(v))
        v = v[np.lexsort((v, place // size))]
        for at in range(0, len(v), max(1, PAGE_ROWS // size) * size):
            some = v[at : at + max(1, PAGE_ROWS // size) * size]
            cuts = np.append(np.arange(0, len(some), size), len(some))
            values = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(some))
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(values), pa.int64()), pa.array(at // size + np.arange(len(values))), values], names=["key", "page", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for key, others in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    if held:
                        yield from paged(now, held)
                    now, held = key, []
                held.append(others)
        if held:
            yield from paged(now, held)

    return spread.select("id", "others").mapInArrow(run, "key long, page long, values array<long>")


def pages(df: DataFrame, key: str, value: str, size: int = 1000, seed: int = 7) -> DataFrame:
    """key, page and values: the values of each key in sorted lists of ``size`` at most, so that a hot key is many rows.

    Which page a value is on follows its place by a seeded hash; pages count from 0, and only a key's last one is short. Repeated
    values stay; null keys and values take no part.
    """
    rows = df.select(key, value).filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    ranked = rank_by_hash(rows.withColumn("_key", hash_key(seed, key, value)), "_key", [key], "_rn")
    page = F.floor((F.col("_rn") - 1) / size).cast("long").alias("page")
    return ranked.select(key, page, value).groupBy(key, "page").agg(F.sort_array(F.collect_list(value)).alias("values"))
