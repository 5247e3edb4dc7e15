"""Connected components of a graph in a DataFrame, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import Scratch, opaque


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least of u and all its v. The least is a map-side combined aggregate, so a hub costs one row a task."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).select(opaque(F.col("u")).alias("k"), "m")
    return pairs.join(least, pairs.u == least.k).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_least(down)
    return found.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def connected_components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node it reaches.

    ``edges``: long columns u and v in any direction; null ends and self-loops are dropped. Each round
    is two shuffles and a written table, so lineage never grows; the count of rounds is logarithmic in
    the longest chain. An empty graph gives an empty result.
    """
    now = scratch.keep(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        new = scratch.keep(small_star(large_star(now)), "stars")
        scratch.drop(now)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
