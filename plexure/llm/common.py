"""What the operators of this subpackage share: durable intermediate tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexure.operators.store import Scratch, bound_batches, opaque, shared_dir, tree_depth


__all__ = ["Scratch", "arrow_map", "column", "fresh", "opaque", "record", "schema_of", "shared_dir", "slices", "small_crc", "texts_of", "tree_depth"]


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema_of(ddl))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text as a string; other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` holds about ``most`` bytes in each: Python copies stay small with long texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, batch.num_rows * most // max(size, 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def record(names: str, *columns) -> pa.RecordBatch:
    """A batch from Python lists or Arrow arrays; names like ``"doc_id:int64 key:binary"``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds |= {"longs": pa.list_(pa.int64()), "ints": pa.list_(pa.int32()), "doubles": pa.list_(pa.float64())}
    fields = [x.split(":") for x in names.split()]
    arrays = [c.cast(kinds[k]) if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for (_, k), c in zip(fields, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def small_crc(c: Column) -> Column:
    """crc32 of a column's text form, as the label splits are defined."""
    return F.crc32(c.cast("string").cast("binary"))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with as many underscores before it as make it new among ``taken``."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name
