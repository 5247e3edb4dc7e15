"""Document quality by a generalised additive model with pairwise interactions.

Method: every feature has a lookup table over quantile bins. Shallow regression trees on one feature's
bins are boosted in a cycle over the features and added into the tables; then the pairs of features that
best explain what is left get tables of their own the same way. A score is the logistic sum of lookups,
read for a whole batch at once.

The model is fitted on at most ``most_rows`` labelled documents, those with the least hash of doc_id: a
documented bound, so what reaches the driver (a few dozen numbers a row) does not grow with the corpus.
Everything else covers all documents and whole texts.

Defined results: null is the empty text, which is scored like any other. Without a learnable label every
score is 0.5; with labels of one class only, scores follow from that class. Null labels are not learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexure.llm.common import Scratch, arrow_map, column, record, slices, small_crc
from plexure.llm.near_dedup import shingles

FEATURES = (
    "log_words", "log_bytes", "mean_word", "sd_word", "short_words", "long_words", "longest_word", "upper", "digits", "marks", "commas_stops", "symbols",
    "bangs", "pipes", "beyond_ascii", "lines_a_word", "words_a_line", "repeated_lines", "repeated_words", "top_word", "top_end", "repeated_trigrams", "byte_entropy", "brackets",
)
_IS = {k: np.frombuffer(bytes(i in v for i in range(256)), bool) for k, v in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".,;:", "symbol": b"#$%&*@^~+=_\\/", "bang": b"!?", "pipe": b"|", "bracket": b"()[]{}<>", "beyond": range(128, 256), "blank": b" \t\n\r\x0b\x0c",
}.items()}
_TABLE = np.array([_IS[k] for k in ("upper", "lower", "digit", "stop", "symbol", "bang", "pipe", "bracket", "beyond", "blank")], float)


def features(text: str | None) -> np.ndarray:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, nw = len(data), len(words)
    if not nw:
        return np.zeros(len(FEATURES))
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    upper, lower, digit, stop, symbol, bang, pipe, bracket, beyond, blank = _TABLE @ count
    sizes = np.fromiter(map(len, words), np.int64, nw)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = count[count > 0] / n
    common = Counter(words)
    ends = Counter(w[-1] for w in words)
    grams = max(nw - 2, 1)
    return np.array([
        np.log1p(nw), np.log1p(n), sizes.mean(), sizes.std(), (sizes <= 3).mean(), (sizes >= 13).mean(), np.log(sizes.max()), upper / max(upper + lower + beyond / 2, 1), digit / n, (n - upper - lower - digit - beyond - blank) / n, stop / n, symbol / n,
        bang / n, pipe / n, beyond / n, len(lines) / nw, np.log(nw / len(lines)), 1 - len(set(lines)) / len(lines), 1 - len(common) / nw, max(common.values()) / nw, max(v for k, v in ends.items()) / nw, 1 - min(len(shingles(text, 3)), grams) / grams, float(-(p * np.log(p)).sum()), bracket / n,
    ])


@dataclass
class AdditiveModel:
    """Bin edges of each feature, a table for each, and tables for pairs."""

    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        for i, j, t in self.pairs:
            out += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _edges(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """Leaf values by bin of a tree on one feature: the best cut of the gradient histogram, and again within each side."""
    total = g.sum() ** 2 / (h.sum() + ridge)
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total, -1)
        k = int(gain.argmax())
        if gain[k] > 1e-9:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _tree(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)])
    return np.full(len(g), -g.sum() / (h.sum() + ridge))


def _cut_pair(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """The best crossing of one cut on each feature of a pair: its gain and the values of the four quarters on the grid."""
    best, out = 0.0, np.zeros_like(g)
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return best, out
    part = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gs, hs = part(gc), part(hc)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs, strict=True)) - gc[-1, -1] ** 2 / (hc[-1, -1] + ridge)
    gain = np.where(np.minimum.reduce(hs) >= least, gain, -1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] > 1e-9:
        best = float(gain[i, j])
        v = [-a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs, strict=True)]
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, bins: int = 48, pair_bins: int = 12, n_pairs: int = 12, pair_rounds: int = 15, ridge: float = 1.0, least: float = 2.0) -> AdditiveModel:
    """Fit on features and 0/1 labels. Each round is one cycle over all features; pairs follow on what is left."""
    if not len(y):
        return AdditiveModel(0.0)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    m = AdditiveModel(float(np.log(rate_1 / (1 - rate_1))))
    d = x.shape[1]
    m.edges = [_edges(x[:, j], bins) for j in range(d)]
    m.pair_edges = [_edges(x[:, j], pair_bins) for j in range(d)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    if y.min() == y.max():
        return m
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    f = np.full(len(y), m.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(m.tables[j])), np.bincount(at[j], h, len(m.tables[j])), 2, ridge, least)
            m.tables[j] += step
            f += step[at[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.pair_edges)]
    shape = [len(e) + 1 for e in m.pair_edges]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = coarse[i] * shape[j] + coarse[j]
        return np.bincount(cell, g, shape[i] * shape[j]).reshape(shape[i], shape[j]), np.bincount(cell, h, shape[i] * shape[j]).reshape(shape[i], shape[j])

    g, h = slopes()
    ranked = sorted(((_cut_pair(*grids(i, j, g, h), ridge, least)[0], i, j) for i in range(d) for j in range(i)), reverse=True)[:n_pairs]
    tables = {(i, j): np.zeros((shape[i], shape[j])) for gain, i, j in ranked if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), t in tables.items():
            g, h = slopes()
            _, step = _cut_pair(*grids(i, j, g, h), ridge, least)
            t += rate * step
            f += rate * step[coarse[i], coarse[j]]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


def featurize(docs: DataFrame) -> DataFrame:
    """doc_id and f, the features of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record("doc_id:long f:doubles", column(batch, "doc_id"), [features(t) for t in column(batch, "text").to_pylist()])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, f array<double>")


def sampled_labels(labels: DataFrame, most_rows: int) -> DataFrame:
    """k and y of the labelled doc_ids with the least hashes, ``most_rows`` at most."""
    return labels.select(F.col("doc_id").cast("long").alias("k"), F.col("quality").cast("int").alias("y")).filter("k is not null and y in (0, 1)").orderBy(F.xxhash64("k"), "k", "y").limit(most_rows)


def learn(featured: DataFrame, chosen: DataFrame) -> AdditiveModel:
    """A model from the rows of ``featured`` (doc_id, f) that ``sampled_labels`` chose."""
    rows = featured.join(F.broadcast(chosen), featured.doc_id == chosen.k).select("doc_id", "y", "f").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.f))
    return fit(np.array([r.f for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r.y) for r in rows]))


def score_documents(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Labels are learned only where crc32(doc_id as text) mod ``folds`` is not 0; those rows are ``held_out``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    featured = scratch.keep(featurize(docs), "features")
    model = spark.sparkContext.broadcast(learn(featured, sampled_labels(labels.filter(small_crc(F.col("doc_id")) % folds != 0), most_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = column(batch, "f").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            score = model.value.score(x)
            yield record("doc_id:long score:double predicted:int", column(batch, "doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)))

    scored = arrow_map(featured, run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(small_crc(F.col("doc_id")) % folds == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns. Rows without a doc_id stay.

    Learns as ``score_documents`` does, then scores and drops rows in one pass, without a join.
    """
    chosen = sampled_labels(labels.filter(small_crc(F.col("doc_id")) % folds != 0), most_rows)
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(learn(featurize(few.join(F.broadcast(chosen.select("k").distinct()), few.doc_id == F.col("k"), "left_semi")), chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in column(batch, "text").to_pylist()])
            keep = (model.value.score(x) >= threshold) | ~column(batch, "doc_id").is_valid().to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
