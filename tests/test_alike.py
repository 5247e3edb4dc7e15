"""The relation of similar nodes, found in cells, against its edges and tuples as tables."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plexure import registry
from plexure.operators import alike as A
from plexure.operators import graph as G
from plexure.operators import masks as M
from plexure.operators import network as N
from plexure.operators.similarity import matrix, similar_pairs
from plexure.operators.store import Scratch

MODEL = N.Model((N.Relation("aa", "audio", "audio"), N.Relation("aw", "audio", "word"), N.Relation("wa", "word", "audio")))
SHARES = {"cross": 1.0, "near": 0.5, "acoustic": 0.7, "align": 0.3}


@pytest.fixture(scope="module")
def both(spark):
    """Means and gradients of a random graph, with its similar pairs as tables and as a relation found in cells."""
    rng = np.random.default_rng(8)
    audio = [(i * 3 + 1, rng.normal(size=4).tolist() if i != 5 else None, i % 4 if i % 7 else None) for i in range(300)]
    v = spark.createDataFrame(audio, "id long, vec array<double>, w long").repartition(3)
    nodes = {"audio": v.select("id", "vec"), "word": spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(3)], "id long, vec array<double>")}
    cross = v.filter("w IS NOT NULL").select(F.col("id").alias("a"), "w")
    weights = N.drawn(MODEL, {"audio": 4, "word": 3}, 5, 5)
    scratch = Scratch(spark, "test")
    places = scratch.keep(N.placed(nodes, rows=64), "places")
    state = scratch.keep(N.packed(places), "state")
    near = scratch.keep(similar_pairs(nodes["audio"], 0.4, "id", "vec"), "near")
    way = lambda df, name, a, b: df.select(F.lit(name).alias("relation"), F.col(a).alias("src"), F.col(b).alias("dst"))
    between = way(cross, "aw", "a", "w").unionByName(way(cross, "wa", "w", "a"))
    edges = between.unionByName(way(G.symmetrized(near.select("src", "dst")), "aa", "src", "dst"))
    other = M.negative_each(near, nodes["audio"], "id", 31)
    rows = lambda df, term, a, b, *c: df.selectExpr(f"'{term}' AS term", "true AS learns", f"'{a}' AS a_kind", f"'{b}' AS b_kind", *c)
    links = rows(cross, "cross", "audio", "word", "a", "w AS b", "cast(null AS long) AS c", "1.0d AS y")
    tuples = links.unionByName(rows(near, "near", "audio", "audio", "src AS a", "dst AS b", "cast(null AS long) AS c", "weight AS y"))
    tuples = tuples.unionByName(rows(other, "acoustic", "audio", "audio", "src AS a", "dst AS b", "neg AS c", "0.0d AS y"))
    tuples = tuples.unionByName(rows(other.join(cross, F.col("src") == F.col("a")), "align", "word", "audio", "w AS a", "src AS b", "neg AS c", "0.0d AS y"))

    def run(edges, tuples, **more):
        listed = scratch.keep(N.linked(edges, places, MODEL), "links")
        pair = scratch.keep(N.adjacency(listed), "there"), scratch.keep(N.adjacency(listed, back=True), "back")
        inner = Scratch(spark, "inner")
        return N.gradients(inner, state, pair, scratch.keep(N.counted(tuples, SHARES, places), "tuples"), MODEL, weights, **more)

    terms = A.Terms("near", "acoustic", "align", "word", cross.select(F.col("a").alias("id"), F.col("w").alias("partner")), 31)
    similar = A.prepared(scratch, A.Similar("aa", 0.4, terms), places, nodes, MODEL)
    alone = lambda: A.losses(scratch, similar, N.forward(scratch, state, N.adjacency(N.linked(between, places, MODEL)), MODEL, weights, similar=similar)[-1], MODEL, weights, SHARES, learns=False)[1]
    return near.count(), similar, run(edges, tuples), run(between, links, similar=similar, shares=SHARES), alone


def test_similar_nodes_give_the_means_and_gradients_of_their_edges(both):
    pairs, similar, (means, grads), (found, own), _ = both
    assert similar.pairs == pairs > 1000 and similar.nodes == 300
    assert set(found) == set(means) == set(SHARES) and all(abs(found[t] - m) < 1e-9 for t, m in means.items())
    assert set(own) == set(grads) and all(np.abs(own[n] - g).max() < 1e-9 for n, g in grads.items())


def test_means_alone_are_those_of_learning(both):
    *_, (found, _), alone = both
    assert all(abs(m - found[t]) < 1e-12 for t, m in alone().items())


def test_small_cells_spans_and_slices_change_nothing(both, monkeypatch):
    *_, (found, _), alone = both
    for name, size in (("CELL_BYTES", 4096), ("TILE", 16), ("AT_ONCE", 50)):
        monkeypatch.setattr(A, name, size)
    assert all(abs(m - found[t]) < 1e-9 for t, m in alone().items())


@pytest.mark.parametrize("name", ["network_forward", "network_losses", "network_training", "network_evaluation", "test_edge_scores"])
def test_network_queries_make_no_table_of_similar_pairs(spark, monkeypatch, name):
    def made(*_, **__):
        raise AssertionError("a row for each similar pair")

    monkeypatch.setattr(registry.network.shared, "edges", made)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_cell_orders_its_pairs_in_little_memory():
    cell, n, m = A.Cell.__new__(A.Cell), 2000, 400_000
    cell.id, cell.ord, cell.held, cell.drawn = np.arange(n) * 3, np.arange(n), [], None
    rng = np.random.default_rng(3)
    s, d = rng.integers(0, n // 2, m), rng.integers(n // 2, n, m)
    tracemalloc.start()
    try:
        for at in range(0, m, 50_000):
            cell.draw(s[at : at + 50_000], d[at : at + 50_000], 31, n)
        held = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        c, i, j = cell.ordered()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 9 * m and peak < 28 * m
    assert (np.diff(c) >= 0).all() and len(c) == m and (c != i).all() and (c != j).all()
    at = [int(int(hashlib.md5(f"31:{3 * x}:{3 * y}".encode()).hexdigest()[:7], 16) / 268435456.0 * n) for x, y in zip(s[:50].tolist(), d[:50].tolist(), strict=True)]
    known = set(zip(c.tolist(), i.tolist(), j.tolist(), strict=True))
    assert all((next(v for v in ((a + k) % n for k in range(3)) if v not in (x, y)), x, y) in known for a, x, y in zip(at, s[:50].tolist(), d[:50].tolist(), strict=True))


def test_tables_of_long_rows_have_small_row_groups(spark):
    rows = spark.range(0, 300, 1, 1).select("id", F.expr("concat_ws('', transform(sequence(1, 2000), i -> sha2(concat(id, ':', i), 512)))").alias("x"))
    scratch = Scratch(spark, "groups", packed=True)
    made = scratch.keep(rows, "rows")
    files = [f.removeprefix("file:") for f in made.inputFiles()]
    assert made.count() == 300 and max(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1


def test_vectors_of_several_lengths_are_refused():
    assert matrix(pa.chunked_array([[[1.0, None]], [[3.0, 4.0]]])).tolist()[1] == [3.0, 4.0]
    with pytest.raises(ValueError):
        matrix(pa.chunked_array([[[1.0, 2.0], [3.0]]]))
