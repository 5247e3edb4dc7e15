"""Sequences in padded batches of bounded size, and frame features of them.

Sequences of like lengths share a batch: lengths fall into buckets whose bounds grow by a fixed ratio, so that padding a batch to
its longest sequence wastes a bounded share, and no task pads to the longest of all. A batch holds as many sequences as its bucket's bound
fits into a budget of padded numbers; where in its bucket a sequence stands comes from written ranges, so a bucket of any size
spreads over the tasks.

Defined results: null and empty sequences are in no batch. A sequence longer than the budget is a batch of its own. Ids need not be unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexure.operators.store import numbered

#: Takes padded rows and their lengths; gives for each row a matrix of frames by features.
Encode = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def in_batches(df: DataFrame, id_col: str, samples: str, budget: int = 1 << 20, ratio: float = 1.1) -> DataFrame:
    """id, samples, bucket and batch: each batch's rows times its longest are ``budget`` at most, unless it is one row."""
    rows = df.select(F.col(id_col).alias("id"), F.col(samples).cast("array<double>").alias("samples")).filter(F.size("samples") > 0)
    rows = rows.withColumn("bucket", F.floor(F.log(F.size("samples").cast("double")) / F.lit(math.log(ratio)) + 1e-9).cast("int"))
    placed = numbered(rows.withColumn("_h", F.xxhash64("id", "samples")), "bucket", "_h", out="_at").drop("_h")
    starts = placed.groupBy(F.col("bucket").alias("_b")).agg(F.min("_at").alias("_start"), F.max(F.size("samples")).alias("_long"))  # a row a bucket
    placed = placed.join(F.broadcast(starts), F.col("bucket") == F.col("_b"))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_long")))
    return placed.withColumn("batch", F.floor((F.col("_at") - F.col("_start")) / each).cast("long")).select("id", "samples", "bucket", "batch")


def padding(batches: DataFrame) -> DataFrame:
    """One row: rows, batches, the padded numbers in all of them, and the share that is padding."""
    each = batches.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.max(F.size("samples")).alias("longest"), F.sum(F.size("samples")).alias("held"))
    padded = F.sum(F.col("n") * F.col("longest"))
    return each.agg(F.sum("n").alias("rows"), F.count("*").alias("batches"), padded.alias("padded"), (1 - F.sum("held") / padded).alias("share"))


def frame_features(batches: DataFrame, encode: Encode) -> DataFrame:
    """id, frame and features of each sequence: ``encode`` sees one padded batch at a time."""

    def run(t: pa.Table) -> pa.Table:
        rows = [np.array(r) for r in t["samples"].to_pylist()]
        size = np.array([len(r) for r in rows])
        x = np.zeros((len(rows), int(size.max())))
        for i, r in enumerate(rows):
            x[i, : len(r)] = r
        made = encode(x, size)
        count = [len(m) for m in made]
        at = pa.array(np.repeat(np.arange(len(rows)), count))
        frames = pa.array(np.concatenate([np.arange(n) for n in count]), pa.int32())
        flat = [v for m in made for v in np.asarray(m, float)]
        return pa.table({"id": t["id"].take(at), "frame": frames, "features": pa.array(flat, pa.list_(pa.float64()))})

    kind = batches.schema["id"].dataType.simpleString()
    return batches.groupBy("bucket", "batch").applyInArrow(run, f"id {kind}, frame int, features array<double>")


def moments(window: int, hop: int) -> Encode:
    """An encoder by definition: mean and energy of windows of ``window`` samples every ``hop``; shorter sequences have one window."""

    def encode(x: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        out = []
        for row, n in zip(x, size.tolist(), strict=True):
            w = min(window, n)
            frames = np.lib.stride_tricks.sliding_window_view(row[:n], w)[::hop]
            out.append(np.stack([frames.mean(axis=1), (frames**2).mean(axis=1)], axis=1))
        return out

    return encode


def pooled_tokens(df: DataFrame, id_col: str, flat: str, mask: str) -> DataFrame:
    """id and vec: the mean of each row's unmasked token vectors, brought to length one.

    flat: all token vectors of a row, one after the other; mask: a number for each token, 0 for those left out. The vectors are summed
    by offsets in the flat Arrow values; no nested lists are made. Without an unmasked token the vector is zero; a row without
    tokens has none.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(flat).cast("array<double>").alias("flat"), F.col(mask).cast("array<double>").alias("mask"))
    rows = rows.filter((F.size("mask") > 0) & (F.size("flat") > 0) & (F.size("flat") % F.size("mask") == 0))
    kind = T._parse_datatype_string(f"id {rows.schema['id'].dataType.simpleString()}, vec array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, masks = (batch.column(batch.schema.get_field_index(c)) for c in ("flat", "mask"))
            ends, tokens = lists.offsets.to_numpy(), masks.offsets.to_numpy()
            x, m = lists.flatten().to_numpy(zero_copy_only=False), masks.flatten().to_numpy(zero_copy_only=False)
            ends, tokens = ends - ends[0], tokens - tokens[0]
            dims = np.diff(ends) // np.diff(tokens)
            for d in np.unique(dims).tolist():  # rows of one size of vectors together
                pick = np.flatnonzero(dims == d)
                count = np.diff(tokens)[pick]
                first = np.cumsum(count) - count
                within = np.arange(int(count.sum())) - np.repeat(first, count)
                values = x[(np.repeat(ends[:-1][pick], count) + within * d)[:, None] + np.arange(d)]
                weight = m[np.repeat(tokens[:-1][pick], count) + within]
                total = np.add.reduceat(values * weight[:, None], first)
                mean = total / np.maximum(np.add.reduceat(weight, first), 1e-9)[:, None]
                unit = mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-12)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, d), pa.int32()), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("id")).take(pa.array(pick)), vec], names=["id", "vec"])

    return rows.mapInArrow(run, kind)
