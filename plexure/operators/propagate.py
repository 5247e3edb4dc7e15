"""Message passing and scores over node vectors in long form: node, dim, x."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexure.functions.vectors import dot, linear
from plexure.operators.similarity import similar_sums


def long_form(nodes: DataFrame, id_col: str, vec: str) -> DataFrame:
    return nodes.select(F.col(id_col).alias("node"), F.posexplode(vec).alias("dim", "x"))


def vector_form(rows: DataFrame) -> DataFrame:
    """node and vec from long form."""
    return rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda r: r["x"]).alias("vec"))


def neighbour_mean(state: DataFrame, edges: DataFrame) -> DataFrame:
    """node, dim, x: the mean of each node's in-neighbours; nodes without any are absent. Dimensions are averaged map-side."""
    sent = edges.select("src", "dst").join(state, F.col("src") == F.col("node"))
    return sent.groupBy(F.col("dst").alias("node"), "dim").agg(F.avg("x").alias("x"))


def similar_mean(nodes: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", payload: str | None = None) -> DataFrame:
    """node and vec: ``neighbour_mean`` over the graph of cosines over ``threshold``, both ways, in cells of a grid, where its edges are found (see ``similar_sums``)."""
    sums = similar_sums(nodes, threshold, id_col, vec, payload)
    return sums.select(F.col("id").alias("node"), F.transform("total", lambda x: x / F.col("n")).alias("vec"))


def _near(state: DataFrame, relation: DataFrame) -> DataFrame:
    """What a relation brings: the means over its edges (src, dst), or means that are given (node, dim, x)."""
    return neighbour_mean(state, relation) if "src" in relation.columns else relation


def layer(state: DataFrame, relations: list[DataFrame], self_weight: float = 1.0, neighbour_weight: float = 1.0, relu: bool = False) -> DataFrame:
    """One round: self_weight * self + neighbour_weight * mean of each relation, averaged over the relations (edges, or their means); missing messages are zero."""
    out = None
    for edges in relations:
        near = _near(state, edges).select(F.col("node").alias("_n"), F.col("dim").alias("_d"), F.col("x").alias("_x"))
        one = state.join(near, (F.col("node") == F.col("_n")) & (F.col("dim") == F.col("_d")), "left")
        one = one.select("node", "dim", (F.col("x") * self_weight + F.coalesce("_x", F.lit(0.0)) * neighbour_weight).alias("x"))
        out = one if out is None else out.unionByName(one)
    mean = out.groupBy("node", "dim").agg(F.avg("x").alias("x"))
    return mean.withColumn("x", F.greatest("x", F.lit(0.0))) if relu else mean


def propagate(state: DataFrame, relations: list[DataFrame], layers: int, **weights: float) -> DataFrame:
    """Rounds of ``layer``, with relu between them but not after the last."""
    for i in range(layers):
        state = layer(state, relations, relu=i < layers - 1, **weights)
    return state


def _with_top(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with the greatest ``value`` of their key as ``_m``: a combined maximum and a join, so that a hot key is not one task."""
    top = rows.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_m"))
    return rows.join(top, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def attention_pool(frames: DataFrame, key: str, score: Column, values: list[str]) -> DataFrame:
    """Softmax of ``score`` over each key's frames, and the weighted sums of ``values``; the greatest score is taken off first."""
    e = attention_weights(frames, key, score, "_e")
    return e.groupBy(key).agg(*[(F.sum(F.col("_e") * F.col(v)) / F.sum("_e")).alias(v) for v in values])


def attention_weights(frames: DataFrame, key: str, score: Column, out: str, total: bool = False) -> DataFrame:
    """``frames`` with exp(score - greatest of the key) as ``out``; ``total``: divided by the key's sum, so that weights sum to one."""
    raw = _with_top(frames.withColumn("_s", score), key, "_s")
    e = raw.withColumn(out, F.exp(F.col("_s") - F.col("_m"))).drop("_s", "_m")
    if not total:
        return e
    sums = e.groupBy(F.col(key).alias("_key")).agg(F.sum(out).alias("_t"))
    return e.join(sums, F.col(key).eqNullSafe(F.col("_key"))).withColumn(out, F.col(out) / F.col("_t")).drop("_key", "_t")


def link_score(a: Column, w: Column, hidden: list[list[float]], last: list[float]) -> Column:
    """sigmoid(last . relu(hidden . [a; w]))."""
    h = linear(hidden, F.concat(a, w))
    z = sum((F.greatest(x, F.lit(0.0)) * float(c) for x, c in zip(h, last, strict=True)), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def link_scores(a: np.ndarray, b: np.ndarray, hidden: list[list[float]], last: list[float]) -> np.ndarray:
    """``link_score`` of rows of vectors."""
    w = np.array(hidden)
    h = a @ w[:, : a.shape[1]].T + b @ w[:, a.shape[1] :].T
    return 1 / (1 + np.exp(-(np.maximum(h, 0.0) @ np.array(last))))


def info_nce(rows: DataFrame, anchor: str, logit: str, positive: str) -> DataFrame:
    """One row: the mean over anchors of the log-sum-exp of their logits less the positive's. Sums are combined map-side, whatever the number of negatives."""
    shifted = _with_top(rows, anchor, logit)
    good = F.max(F.when(F.col(positive), F.col(logit))).alias("_p")
    per = shifted.groupBy(anchor).agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_e"), good)
    return per.agg(F.avg(F.col("_m") + F.log("_e") - F.col("_p")).alias("loss"), F.count("*").alias("anchors"))


def contrastive(positives: DataFrame, negatives: DataFrame, anchor: str, logit: str) -> DataFrame:
    """One row: the mean over positive pairs of the log-sum-exp of their logit and their anchor's negatives, less the logit.

    The negatives belong to an anchor and serve all its pairs, so each is scored once; they are summed before they meet the
    pairs. A pair whose anchor has no negatives has no loss.
    """
    shifted = _with_top(negatives, anchor, logit)
    sums = shifted.groupBy(F.col(anchor).alias("_a")).agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(logit) - F.col("_m"))).alias("_e"))
    both = positives.join(sums, F.col(anchor).eqNullSafe(F.col("_a")), "left")
    top = F.greatest(F.col(logit), F.col("_m"))
    loss = top + F.log(F.exp(F.col(logit) - top) + F.coalesce(F.col("_e") * F.exp(F.col("_m") - top), F.lit(0.0))) - F.col(logit)
    return both.agg(F.avg(loss).alias("loss"), F.count("*").alias("pairs"))


def projected(state: DataFrame, weights: DataFrame) -> DataFrame:
    """node, dim, x: each node's vector through a matrix, given as rows (out, dim, w); its size bounds what is broadcast."""
    w = F.broadcast(weights.select(F.col("out").alias("_o"), F.col("dim").alias("_d"), F.col("w").alias("_w")))
    joined = state.join(w, F.col("dim") == F.col("_d"))
    return joined.groupBy("node", F.col("_o").alias("dim")).agg(F.sum(F.col("x") * F.col("_w")).alias("x"))


def weighted_layer(state: DataFrame, relations: list[tuple[DataFrame, DataFrame]], own: DataFrame, relu: bool = False) -> DataFrame:
    """One round with learned weights: own * self + matrix * mean of the neighbours, averaged over the relations (edges or their means, matrix)."""
    mine = projected(state, own)
    out = mine.select("node", "dim", "x", F.lit(1.0).alias("_part"))
    for edges, matrix in relations:
        near = projected(_near(state, edges), matrix)
        out = out.unionByName(near.select("node", "dim", (F.col("x") / len(relations)).alias("x"), F.lit(0.0).alias("_part")))
    total = out.groupBy("node", "dim").agg(F.sum("x").alias("x"), F.max("_part").alias("_part")).filter("_part = 1").drop("_part")
    return total.withColumn("x", F.greatest("x", F.lit(0.0))) if relu else total


def total_loss(acoustic: Column, contrast: Column, link: Column, alpha: float, beta: float) -> Column:
    return acoustic * alpha + contrast * beta + link


__all__ = [
    "attention_pool", "attention_weights", "contrastive", "dot", "info_nce", "layer", "link_score", "link_scores", "long_form", "neighbour_mean", "projected",
    "propagate", "similar_mean", "total_loss", "vector_form", "weighted_layer",
]
