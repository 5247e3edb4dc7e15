"""Retrieval over a graph: query edges, insertion of new nodes, top-k, recall."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.functions.vectors import linear
from plexure.operators.propagate import layer, long_form, vector_form
from plexure.operators.similarity import block_join, packed, top_of, top_similar
from plexure.operators.store import Scratch


def query_edges(queries: DataFrame, reference: DataFrame, threshold: float, k: int | None = None, **cols: str) -> DataFrame:
    """query_id, vec_id, score: the reference rows over the threshold (``k`` at most), or the best one where there is none."""
    id_col, vec = cols.get("id_col", "vec_id"), cols.get("vec", "embedding")
    if k is not None:
        return top_similar(queries, reference, k, id_col, vec, threshold, or_best=True, without_self=False).drop("rank")

    def kernel(a: dict, b: dict, s: np.ndarray, same: bool) -> dict[str, np.ndarray]:
        order = np.argsort(b["id"], kind="stable")
        ids, s = b["id"][order], s[:, order]
        keep = s > threshold
        best = s.argmax(axis=1)
        keep[np.arange(len(s)), best] = True
        i, j = np.nonzero(keep)
        return {"query_id": a["id"][i], "vec_id": ids[j], "score": s[i, j]}

    found = block_join(packed(queries, id_col, vec), packed(reference, id_col, vec), kernel, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("b"))
    best = best.select(F.col("query_id").alias("_q"), F.col("b.vec_id").alias("_v"))
    joined = found.join(best, F.col("query_id") == F.col("_q"))
    return joined.filter((F.col("score") > threshold) | (F.col("vec_id") == F.col("_v"))).select("query_id", "vec_id", "score")


def inserted(state: DataFrame, queries: DataFrame, audio_edges: DataFrame, word_edges: DataFrame | None = None) -> DataFrame:
    """node, dim, x of all queries put into the graph at once and given one round of messages.

    ``audio_edges``: query_id, vec_id. Option one has those alone; ``word_edges`` (query_id, vec_id) is the second relation.
    """
    relations = [audio_edges.select(F.col("vec_id").alias("src"), F.col("query_id").alias("dst"))]
    if word_edges is not None:
        relations.append(word_edges.select(F.col("vec_id").alias("src"), F.col("query_id").alias("dst")))
    out = layer(state.unionByName(queries), relations)
    return out.join(queries.select(F.col("node").alias("_n")).distinct(), F.col("node") == F.col("_n"), "left_semi")


def reconnected(scores: DataFrame, first: DataFrame, k: int, threshold: float) -> DataFrame:
    """The second pass: each query's top k candidates strictly over the threshold; a query with none keeps its first pass.

    ``scores``: query_id, vec_id, score, rank. ``first``: query_id and what the first pass gave.
    """
    over = scores.filter((F.col("rank") <= k) & (F.col("score") > threshold))
    good = over.groupBy("query_id").agg(F.count("*").alias("n"), F.min_by("vec_id", "rank").alias("best"))
    return first.join(good.withColumnRenamed("query_id", "_q"), F.col("query_id") == F.col("_q"), "left").drop("_q")


def proposed(queries: DataFrame, candidates: DataFrame, hidden: list[list[float]], last: list[float], k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k candidates that a link predictor (see ``propagate.link_score``) holds likeliest for each query.

    ``queries``, ``candidates``: node and vec. k is clamped to what there is; without candidates there are no rows. The first
    layer is linear, so each side goes through its half of it alone; pairs only add, cut and weigh the hidden units.
    """
    width = len(hidden[0]) // 2
    first = queries.select("node", F.array(*linear([row[:width] for row in hidden], F.col("vec"))).alias("h"))
    second = candidates.select("node", F.array(*linear([row[width:] for row in hidden], F.col("vec"))).alias("h"))

    def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.zeros((len(x), len(y)))
        for i, weight in enumerate(last):
            z += weight * np.maximum(x[:, i, None] + y[None, :, i], 0.0)
        return 1 / (1 + np.exp(-z))

    sides = packed(first, "node", "h", unit=False), packed(second, "node", "h", unit=False)
    return top_of(*sides, k, without_self=False, product=product)


def reconnected_state(
    state: DataFrame, queries: DataFrame, audio_edges: DataFrame, words: DataFrame, hidden: list[list[float]], last: list[float], k: int, threshold: float
) -> DataFrame:
    """node, dim, x of all queries after a second pass with predicted links; a query without a confident one keeps its first pass.

    The first pass knows ``audio_edges`` (query_id, vec_id) alone. The link predictor proposes k of the ``words`` (node, vec) for
    what it gives; those with a score over the threshold are the second relation of the second pass.
    """
    first = Scratch(state.sparkSession, "reconnect").keep(inserted(state, queries, audio_edges), "first")
    found = proposed(vector_form(first), words, hidden, last, k).filter(F.col("score") > threshold).select("query_id", "vec_id")
    word_state = long_form(words, "node", "vec").select((-F.col("node") - 1).alias("node"), "dim", "x")  # a name space of their own
    second = inserted(state.unionByName(word_state), queries, audio_edges, found.withColumn("vec_id", -F.col("vec_id") - 1))
    linked = found.select(F.col("query_id").alias("_q")).distinct()
    again = second.join(linked, F.col("node") == F.col("_q"), "left_semi")
    return again.unionByName(first.join(linked, F.col("node") == F.col("_q"), "left_anti"))


def recall_at(ranked: DataFrame, truth: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall, n: the share of queries with a true candidate among their first k. Queries without truth count as misses; no queries give 0.

    ``ranked``: query_id, vec_id, rank. ``truth``: query_id, vec_id.
    """
    true = truth.select(F.col("query_id").alias("_q"), F.col("vec_id").alias("_v")).distinct()
    hits = ranked.join(true, (F.col("query_id") == F.col("_q")) & (F.col("vec_id") == F.col("_v"))).groupBy("query_id").agg(F.min("rank").alias("first"))
    each = queries.select(F.col("query_id")).distinct().join(hits.select(F.col("query_id").alias("_h"), "first"), F.col("query_id") == F.col("_h"), "left")
    spread = each.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    hit = F.when(F.col("first") <= F.col("k"), 1.0).otherwise(0.0)
    return spread.groupBy(F.col("k").cast("long").alias("k")).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("recall"), F.count("*").alias("n"))


def wide(ranked: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """One row a query: its first k values joined with a bar, and the first one."""
    top = ranked.filter(F.col("rank") <= k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(value).alias("v")))).alias("l"))
    return top.select(key, F.array_join(F.transform("l", lambda r: r["v"].cast("string")), "|").alias("top"), F.col("l")[0]["v"].alias("first"))
