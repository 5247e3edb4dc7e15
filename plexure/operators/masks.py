"""Seeded masks and samples of nodes and edges; every choice is a function of (seed, id)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexure.functions import digests
from plexure.functions.hashing import group_sizes, hash_key, hash_share, rank_by_hash
from plexure.operators.similarity import similar_ends
from plexure.operators.store import Scratch, numbered


def folds(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """``df`` with fold 0 to k - 1 by seeded rank; the first n mod k folds have one row more."""
    ranked = group_sizes(rank_by_hash(df.withColumn("_key", hash_key(seed, id_col)), "_key", [], "_rn"), [], "_n")
    size, more = F.expr(f"_n div {k}"), F.col("_n") % k
    at = F.col("_rn") - 1
    later = F.coalesce(more + F.floor(F.try_divide(at - more * (size + 1), size)), F.lit(0))
    fold = F.when(at < more * (size + 1), F.floor(F.try_divide(at, size + 1))).otherwise(later)
    return ranked.withColumn("fold", fold.cast("long")).drop("_key", "_rn", "_n")


def grouped_folds(df: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """``df`` with a fold for each group: n div k groups a fold by seeded rank, the last takes the rest. With under k groups all are in the last."""
    keys = df.select(group).distinct()
    ranked = group_sizes(rank_by_hash(keys.withColumn("_key", hash_key(seed, group)), "_key", [], "_rn"), [], "_n")
    size = F.expr(f"_n div {k}")
    fold = F.when(size == 0, k - 1).otherwise(F.least(F.lit(k - 1), F.floor(F.try_divide(F.col("_rn") - 1, size))))
    side = ranked.select(F.col(group).alias("_g"), fold.cast("long").alias("fold"))
    return df.join(side, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def exact_sample(df: DataFrame, ids: list[str], fraction: float, seed: int, out: str = "chosen") -> DataFrame:
    """``df`` with a flag on exactly floor(n * fraction) rows, by seeded rank."""
    ranked = group_sizes(rank_by_hash(df.withColumn("_key", hash_key(seed, *ids)), "_key", [], "_rn"), [], "_n")
    return ranked.withColumn(out, F.col("_rn") <= F.floor(F.col("_n") * F.lit(float(fraction)))).drop("_key", "_rn", "_n")


#: Bits of the keys by which pairs are counted.
BIN_BITS = 16


def similar_sample(nodes: DataFrame, threshold: float, fraction: float, seed: int, id_col: str = "vec_id", vec: str = "embedding", only: bool | None = None) -> DataFrame:
    """src, dst and chosen: ``exact_sample`` of the pairs with a cosine over ``threshold``. only: none but those that are chosen, or that are not.

    Pairs are found in each of three passes and none is shuffled: counts by the first bits of their keys tell in which bin the last chosen pair is, the keys
    of that bin which it is, and a key tells by itself on which side of it its pair is.
    """
    ids = nodes.select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    spark, shift, none = nodes.sparkSession, np.uint32(32 - BIN_BITS), 1 << BIN_BITS
    held = np.zeros(none, np.int64)

    def count(src: np.ndarray, dst: np.ndarray) -> None:
        held[:] += np.bincount(digests.of_pairs(seed, src, dst) >> shift, minlength=none)

    def counts() -> Iterator[dict[str, np.ndarray]]:
        some = np.flatnonzero(held)
        yield {"bin": some.astype(np.int32), "n": held[some]}
        held[:] = 0

    sizes = sorted(tuple(r) for r in similar_ends(ids, threshold, count, "bin int, n long", "id", "v", counts).groupBy("bin").agg(F.sum("n")).collect())  # a row a bin
    wanted = math.floor(sum(n for _, n in sizes) * float(fraction))
    cut, left = "", wanted
    for number, n in sizes if wanted > 0 else ():
        if n >= left:

            def of_bin(src: np.ndarray, dst: np.ndarray, number: int = number) -> dict[str, np.ndarray]:
                here = digests.of_pairs(seed, src, dst) >> shift == number
                return {"src": src[here], "dst": dst[here]}

            keys = similar_ends(ids, threshold, of_bin, "src long, dst long", "id", "v").select(hash_key(seed, "src", "dst").alias("key"))
            cut = Scratch(spark, "sample").keep(keys, "keys").orderBy("key").offset(left - 1).first()["key"]
            break
        left -= n
    first = int(cut[:8] or "0", 16)

    def sided(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
        bits = digests.of_pairs(seed, src, dst)
        chosen = bits < first
        for e in np.flatnonzero(bits == first).tolist():
            chosen[e] = hashlib.md5(f"{seed}:{src[e]}:{dst[e]}".encode()).hexdigest() <= cut
        if only is not None:
            here = chosen == only
            src, dst, chosen = src[here], dst[here], chosen[here]
        return {"src": src, "dst": dst, "chosen": chosen}

    return similar_ends(ids, threshold, sided, "src long, dst long, chosen boolean", "id", "v")


def draw(df: DataFrame, id_col: str, fraction: float, seed: int, epoch: int = 0) -> DataFrame:
    """Rows drawn with probability ``fraction`` each, anew in each epoch."""
    return df.filter(hash_share(hash_key(f"{seed}:{epoch}", id_col)) < fraction)


def without_sources(edges: DataFrame, orphans: DataFrame, id_col: str) -> DataFrame:
    return edges.join(orphans.select(F.col(id_col).alias("src")), "src", "left_anti")


def of_sources(edges: DataFrame, orphans: DataFrame, id_col: str) -> DataFrame:
    return edges.join(orphans.select(F.col(id_col).alias("src")), "src", "left_semi")


def without_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return edges.join(pairs.select("src", "dst"), ["src", "dst"], "left_anti")


def within(edges: DataFrame, nodes: DataFrame, id_col: str, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges whose ends (or the given ones) are all among the nodes."""
    for end in ends:
        edges = edges.join(nodes.select(F.col(id_col).alias(end)), end, "left_semi")
    return edges


def negatives(nodes: DataFrame, edges: DataFrame, id_col: str, tries: int, wanted: int, seed: int) -> DataFrame:
    """``wanted`` pairs that are no edges, from ``tries`` seeded draws a node: the draw's partner is a node by its place in id order.

    Draws are rows of the nodes, never a product of them.
    """
    n = nodes.count()
    placed = nodes.select(F.col(id_col).alias("id"))
    pos = numbered(placed, "id")
    drawn = placed.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).withColumn("key", hash_key(seed, "id", "t"))
    drawn = drawn.withColumn("at", F.floor(hash_share(F.col("key")) * n).cast("long"))
    pairs = drawn.join(pos.select(F.col("id").alias("other"), "pos"), F.col("at") == F.col("pos")).filter("id <> other")
    pairs = pairs.select(F.col("id").alias("src"), F.col("other").alias("dst"), "key")
    return without_pairs(pairs, edges).orderBy("key", "src").limit(wanted).select("src", "dst")


def negatives_each(pairs: DataFrame, nodes: DataFrame, id_col: str, seed: int, each: Column | int = 1) -> DataFrame:
    """src, dst, m and neg: for each pair ``each`` seeded nodes that are neither end (drawn anew for every m from 0).

    A draw is a place in id order; the next two places stand in where it is an end. ``each`` may be a column of ``pairs``,
    as where an anchor wants as many negatives as it has positives.
    """
    n = nodes.count()
    pos = numbered(nodes.select(F.col(id_col).alias("id")), "id")
    count = F.lit(each) if isinstance(each, int) else each
    drawn = pairs.select("src", "dst", F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("m"))
    at = F.floor(hash_share(hash_key(seed, "src", "dst", "m")) * n).cast("long")
    tried = drawn.withColumn("at", at).withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    found = tried.join(pos, ((F.col("at") + F.col("step")) % n) == F.col("pos")).filter("id <> src and id <> dst")
    return found.groupBy("src", "dst", "m").agg(F.min_by("id", "step").alias("neg"))


def negative_each(pairs: DataFrame, nodes: DataFrame, id_col: str, seed: int) -> DataFrame:
    """src, dst and neg: for each pair one seeded node that is neither end; the next two places stand in where it is."""
    n = nodes.count()
    pos = numbered(nodes.select(F.col(id_col).alias("id")), "id")
    at = F.floor(hash_share(hash_key(seed, "src", "dst")) * n).cast("long")
    tried = pairs.select("src", "dst", at.alias("at")).withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    found = tried.join(pos, ((F.col("at") + F.col("step")) % n) == F.col("pos")).filter("id <> src and id <> dst")
    return found.groupBy("src", "dst").agg(F.min_by("id", "step").alias("neg"))


def negatives_of(anchors: DataFrame, nodes: DataFrame, id_col: str, group: str, seed: int) -> DataFrame:
    """anchor, m and neg: for each row of ``anchors`` (anchor, n) as many seeded nodes of other groups than the anchor's own (its number).

    Nodes stand in the order of (group, id). A draw is one of the places outside the anchor's group, whose own are skipped, so that
    every draw gives a node; only where there is no other group there is none. Nodes without a group are not drawn.
    """
    known = nodes.select(F.col(id_col).alias("id"), F.col(group).alias("_group")).filter("_group IS NOT NULL")
    pos = numbered(known, "_group", "id")
    n = pos.count()
    sizes = pos.groupBy(F.col("_group").alias("_g")).agg(F.count("*").alias("_own"), F.min("pos").alias("_start"))
    sized = anchors.select("anchor", "n").join(sizes, F.col("anchor") == F.col("_g"), "left")
    other = F.lit(n) - F.coalesce("_own", F.lit(0))
    drawn = sized.filter((F.col("n") > 0) & (other > 0)).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    at = F.floor(hash_share(hash_key(seed, "anchor", "m")) * other).cast("long")
    placed = drawn.withColumn("at", F.when(at >= F.col("_start"), at + F.col("_own")).otherwise(at)).select("anchor", "m", "at")
    return placed.join(pos, F.col("at") == F.col("pos")).select("anchor", "m", F.col("id").alias("neg"))


def redraw(df: DataFrame, ids: list[str], fraction: float, seed: int, epochs: int) -> DataFrame:
    """ids and epoch: the rows drawn in each of ``epochs`` epochs, with probability ``fraction`` in each.

    A row's draws are a sequence of gaps: the kth is how many epochs without a draw come first, from the kth hash of the row's ids, by the
    geometric distribution. Work follows what is drawn, not rows times epochs; any epoch of the plan is the same whatever their
    number.
    """
    if fraction <= 0 or epochs <= 0:
        return df.select(*ids, F.lit(0).cast("int").alias("epoch")).limit(0)
    keyed = df.select(*ids, F.concat_ws(":", *[F.col(c).cast("string") for c in ids]).alias("_key"))
    schema = T.StructType([*keyed.schema.fields[:-1], T.StructField("epoch", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, when = [], []
            for i, key in enumerate(batch.column(len(ids)).to_pylist()):
                epoch, k = -1, 0
                while True:
                    share = int(hashlib.md5(f"{seed}:{key}:{k}".encode()).hexdigest()[:7], 16) / 268435456.0
                    epoch += 1 + (int(math.log(1 - share) / math.log(1 - fraction)) if fraction < 1 else 0)
                    if epoch >= epochs:
                        break
                    rows.append(i)
                    when.append(epoch)
                    k += 1
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(ids)]), pa.array(when, pa.int32())], names=schema.names)

    return keyed.mapInArrow(run, schema)
