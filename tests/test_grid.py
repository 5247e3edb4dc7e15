"""Grids of cells, numbering by ranges, joins of neighbouring components and warping, against brute force."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plexure.functions import digests
from plexure.operators import contrast, graph, grid, masks, sequences, similarity, store
from plexure.operators.masks import negatives_each
from plexure.operators.propagate import attention_weights
from plexure.operators.similarity import pair_mean, similar_pairs, top_similar
from plexure.operators.store import numbered, quantiles


def vectors(spark, rng, n, dims=6, start=0):
    x = rng.normal(size=(n, dims))
    return x, spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)


def test_sides_of_the_grid_follow_the_sizes():
    assert grid.square(10, 80, 8) == 1 and grid.square(100_000, 1 << 20, 8) == 4
    assert grid.square(10**8, 50 << 30, 200) == math.ceil((50 << 30) / grid.GROUP_BYTES)
    i, j = grid.rectangle((1000, 512_000), (100_000, 51_200_000), 100)
    assert i == 1 and 10 < j <= 100
    assert grid.rectangle((0, 0), (0, 0), 8) == (1, 1)


@pytest.mark.parametrize(("n", "groups"), [(900, 3), (900, 1), (5, 4), (1, 3)])
def test_every_pair_of_rows_meets_once(spark, n, groups, monkeypatch):
    """Also where groups are empty, so that a cell off the diagonal has one side only."""
    x, rows = vectors(spark, np.random.default_rng(n), n)
    monkeypatch.setattr(grid, "square", lambda *a: groups)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.src, r.dst): r.weight for r in similar_pairs(rows, 0.2).collect()}
    want = {(i, j): u[i] @ u[j] for j in range(n) for i in range(j) if u[i] @ u[j] > 0.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert pair_mean(rows, np.ones_like).first().pairs == n * (n - 1) // 2


def test_two_tables_meet_once_and_ties_go_to_the_smaller_id(spark, monkeypatch):
    _, left = vectors(spark, np.random.default_rng(1), 40)
    x, right = vectors(spark, np.random.default_rng(2), 700, start=1000)
    right = right.unionByName(right.withColumn("vec_id", F.col("vec_id") - 990))  # each score twice
    monkeypatch.setattr(grid, "rectangle", lambda *a: (2, 5))
    q = np.array([r.embedding for r in left.orderBy("vec_id").collect()])
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    got = {}
    for r in top_similar(left, right, 5, without_self=False).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for i in range(40):
        best = np.argsort(-s[i], kind="stable")[:3].tolist()
        assert [got[i][k] for k in range(1, 6)] == [10 + best[0], 1000 + best[0], 10 + best[1], 1000 + best[1], 10 + best[2]]
    assert top_similar(left, right.limit(0), 5).count() == 0


def test_places_in_order(spark):
    rows = [(v, i) for i, v in enumerate([3, 1, None, 1, 1, 2, 9, 1] * 30)]
    got = {r.i: r.pos for r in numbered(spark.createDataFrame(rows, "v int, i int").repartition(5), "v", "i").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [got[i] for _, i in order] == list(range(len(rows)))


def test_quantiles_of_hot_and_spread_values(spark):
    rng = np.random.default_rng(9)
    for values in (np.concatenate([np.full(500, 0.25), rng.normal(size=900)]), rng.normal(size=1), np.array([2.0, 1.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double").repartition(4)
        shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
        assert np.allclose(quantiles(df, "x", shares), np.quantile(values, shares))
    assert quantiles(df.limit(0), "x", [0.5]) == [None]


def test_bridges_between_a_large_and_small_components(spark):
    x, rows = vectors(spark, np.random.default_rng(3), 300)
    label = {i: 0 if i % 3 == 0 else 1 if i % 3 == 1 else i for i in range(300)}
    labels = spark.createDataFrame(list(label.items()), "node long, component long")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = sorted(set(label.values()))
    want = set()
    for a, b in zip(order, order[1:], strict=False):
        pairs = [(-round(float(u[i] @ u[j]), 12), min(i, j), max(i, j)) for i in label for j in label if label[i] == a and label[j] == b]
        want.add(min(pairs)[1:])
    assert {(r.src, r.dst) for r in graph.bridges(rows, labels, "vec_id", "embedding", size=40).collect()} == want


def plain_warp(a, b):
    unit = lambda v: np.array(v) / max(1e-12, math.sqrt(sum(c * c for c in v)))
    table = {(0, 0): (0.0, 0)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            options = [table.get((i - 1, j - 1)), table.get((i, j - 1)), table.get((i - 1, j))]
            total, _, steps = min((t[0], k, t[1]) for k, t in enumerate(options) if t)
            table[i, j] = (total + 1 - float(unit(a[i - 1]) @ unit(b[j - 1])), steps + 1)
    total, steps = table[len(a), len(b)]
    return total / steps


def test_warping_of_many_pairs_equals_that_of_each(spark):
    rng = np.random.default_rng(5)
    seqs = [rng.normal(size=(int(n), 3)) for n in rng.integers(1, 9, 24)]
    got = sequences.warp_distances(seqs[:12], seqs[12:])
    assert np.allclose(got, [plain_warp(a.tolist(), b.tolist()) for a, b in zip(seqs[:12], seqs[12:], strict=True)])
    rows = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(seqs)], "id long, frames array<array<double>>")
    got = {(r.a, r.b): r.similarity for r in sequences.warp_similarity(rows).collect()}
    assert got.keys() == {(i, j) for j in range(24) for i in range(j + 1)}
    assert all(abs(s - math.exp(-plain_warp(seqs[i].tolist(), seqs[j].tolist()))) < 1e-9 for (i, j), s in got.items())
    got = {(r.a, r.b) for r in sequences.warp_similarity(rows.filter("id < 5"), rows.filter("id >= 5")).collect()}
    assert got == {(i, j) for i in range(5) for j in range(5, 24)}


def test_probe_tells_separable_classes_and_not_noise(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) + (4 if i % 2 else -4)).tolist(), i % 2, int(rng.integers(0, 2))) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, noise int")
    probe = sequences.linear_probe(df, "vec_id", "embedding", "label").collect()
    assert [r.fold for r in sorted(probe)] == [0, 1, 2] and all(r.accuracy == 1.0 for r in probe)
    noise = [r.accuracy for r in sequences.linear_probe(df, "vec_id", "embedding", "noise").collect()]
    assert 0.3 < sum(noise) / 3 < 0.7


def test_weights_of_frames_sum_to_one_for_null_keys_too(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 700.0), (None, 2.0), (None, 2.0)], "k string, s double")
    got = attention_weights(rows, "k", F.col("s"), "w", total=True).collect()
    assert sorted(round(r.w, 6) for r in got) == [0.0, 0.5, 0.5, 1.0]


def test_as_many_negatives_as_asked_for_none_an_end(spark):
    nodes = spark.range(50).withColumnRenamed("id", "n")
    pairs = spark.createDataFrame([(i, i + 1, i % 4) for i in range(40)], "src long, dst long, k int").filter("k > 0")
    got = negatives_each(pairs, nodes, "n", 3, F.col("k")).collect()
    assert all(r.neg not in (r.src, r.dst) for r in got)
    assert {(r.src, r.m) for r in got} == {(i, m) for i in range(40) for m in range(i % 4)}


def test_warping_in_tiles_equals_pair_by_pair_and_keeps_ties(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # Few distinct frames, so that many alignments cost the same and which one is taken shows in the number of steps.
    frames = [[float(x) for x in f] for f in ((1, 0), (0, 1), (1, 1), (-1, 0))]
    seqs = [[frames[k] for k in rng.integers(0, 4, n)] for n in rng.integers(1, 5, 90)] + [[frames[0]] * 70]
    rows = spark.createDataFrame([(int(k), f) for k, f in zip(rng.permutation(len(seqs)), seqs, strict=True)], "id long, frames array<array<double>>")
    tiles = []
    kept = sequences._tile_distances
    monkeypatch.setattr(sequences, "_tile_distances", lambda a, b: tiles.append(len(a) * len(b)) or kept(a, b))
    table = pa.table({"id": pa.array([r.id for r in rows.collect()]), "frames": [r.frames for r in rows.collect()]})
    for n, (_, a) in sequences._by_length(table).items():
        for m, (_, b) in sequences._by_length(table).items():
            if n * m <= sequences.LONG_CELLS:
                each = sequences.warp_distances([x for x in a for _ in b], [y for _ in a for y in b])
                assert (sequences._tile_distances(a, b).ravel() == each).all()
    assert max(tiles) > sequences.LEAST_TILE
    by_id = {r.id: np.array(r.frames) for r in rows.collect()}
    got = {(r.a, r.b): r.similarity for r in sequences.warp_similarity(rows).collect()}
    assert len(got) == len(seqs) * (len(seqs) + 1) // 2
    assert all(i <= j and s == np.exp(-sequences.warp_distance(by_id[i], by_id[j])) for (i, j), s in got.items())


def test_sums_and_terms_of_similar_pairs_equal_brute_force_without_a_shuffle_of_pairs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (150, 1))])  # sparse tiles, and one that is full
    m = rng.normal(size=(300, 6))
    rows = spark.createDataFrame([(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(x, m, strict=True))] + [(900, None, None)], "vec_id long, embedding array<double>, m array<double>")
    u = similarity.unit_rows(x)
    link = (u @ u.T > 0.6) & ~np.eye(300, dtype=bool)
    for payload, y in ((None, x), ("m", m)):
        made = similarity.similar_sums(rows, 0.6, payload=payload)
        got = {r.id: (r.n, np.array(r.total)) for r in made.collect()}
        assert set(got) == set(np.flatnonzero(link.any(axis=1)).tolist())
        assert all(n == link[i].sum() and np.allclose(t, link[i].astype(float) @ y) for i, (n, t) in got.items())
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    term = lambda a, b, w, p, q: {"src": a["id"], "dst": b["id"], "t": w + p[:, 0] - q[:, 1]}
    made = similarity.similar_terms(rows, 0.6, term, "src long, dst long, t double")
    got = {(r.src, r.dst): r.t for r in made.collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(np.triu(link)), strict=True)}
    assert all(abs(t - (u[i] @ u[j] + x[i, 0] - x[j, 1])) < 1e-9 for (i, j), t in got.items())
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_strongest_edges_and_places_are_found_without_sorting_all(spark):
    rng = np.random.default_rng(6)
    w = np.round(rng.random(3000), 2)
    edges = [(int(i), int(i) + 1 + int(k), float(v)) for i, k, v in zip(rng.permutation(3000), rng.integers(0, 9, 3000), w, strict=True)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double").repartition(5)
    want = sorted(edges, key=lambda e: (-e[2], e[0], e[1]))
    for part in (10, 7, 1, 5000):
        made = graph.strongest(df, part)
        assert sorted(map(tuple, made.collect())) == sorted(want[: max(1, 3000 // part)])
        assert "Limit" not in made._jdf.queryExecution().executedPlan().toString()
    assert graph.strongest(df.limit(0)).count() == 0
    values = sorted(w.tolist())
    assert store.at_places(df, "weight", [0, 1, 1500, 2999], bins=16) == {p: values[p] for p in (0, 1, 1500, 2999)}
    assert store.quantiles(df, "weight", [0.25, 0.9], narrow=True) == store.quantiles(df, "weight", [0.25, 0.9])


def test_pruned_edges_hold_the_spanning_forest_and_few_others(spark, monkeypatch):
    rng = np.random.default_rng(7)
    pairs = sorted({(min(p), max(p)) for p in rng.integers(0, 60, (1500, 2)).tolist() if p[0] != p[1]})
    edges = [(a, b, float(w)) for (a, b), w in zip(pairs, rng.integers(0, 6, len(pairs)), strict=True)]
    monkeypatch.setattr(graph, "PRUNED_ROWS", 100)
    df = spark.createDataFrame([e if k % 2 else (e[1], e[0], e[2]) for k, e in enumerate(edges)], "src long, dst long, weight double").repartition(3)
    left = {tuple(r) for r in graph.pruned(df).collect()}
    root = list(range(60))

    def top(i):
        return i if root[i] == i else top(root[i])

    forest = set()
    for a, b, w in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if top(a) != top(b):
            root[top(a)] = top(b)
            forest.add((a, b, w))
    assert forest <= left and len(left) <= 3 * 59
    assert {tuple(r) for r in graph.spanning_forest(df).collect()} == forest


def test_pairs_within_a_hot_group_spread_over_tasks(spark):
    rows = spark.createDataFrame([(i, None if i < 3 else 1 if i < 300 else i % 5) for i in range(330)], "id long, g int")
    made = graph.within_groups(rows, "id", "g", rows=40)
    held = {r.id: r.g for r in rows.collect() if r.g is not None}
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in held for b in held if a != b and held[a] == held[b]}
    assert len([n for n in made.rdd.glom().map(len).collect() if n > 9000]) > 1


@pytest.mark.parametrize("size", [3, 90])
def test_contrasts_in_cells_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(grid, "GROUP_BYTES", 1024)  # several columns of vectors
    rng = np.random.default_rng(size)
    x = rng.normal(size=(size, 5)) + 1.0
    ids = sorted(rng.choice(1000, size, replace=False).tolist())
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(2000, None)], "vec_id long, embedding array<double>").repartition(3)
    u, n = similarity.unit_rows(x), size + 1
    pairs = [(i, j) for i in range(size) for j in range(i + 1, size) if u[i] @ u[j] > 0.3]

    def drawn(text, i, j):
        at = int(int(hashlib.md5(text.encode()).hexdigest()[:7], 16) / 268435456.0 * n)
        return next(c for c in ((at + s) % n for s in range(3)) if c not in (i, j))

    def loss(i, j, others):
        logits = [x[i] @ x[c] / 0.1 for c in [j, *(c for c in others if c < size)]]
        return np.logaddexp.reduce(logits) - logits[0]

    p = contrast.placed(nodes)
    one = {(i, j): drawn(f"15:{ids[i]}:{ids[j]}", i, j) for i, j in pairs}
    got = contrast.one_each(p, 0.3, 15, 0.1).first()
    assert got.anchors == len(pairs) and abs(got.loss - np.mean([loss(i, j, [c]) for (i, j), c in one.items() if c < size])) < 1e-9
    count = Counter(i for i, _ in pairs)
    want = [loss(i, j, [drawn(f"19:{ids[i]}:{ids[j]}:{m}", i, j) for m in range(count[i])]) for i, j in pairs]
    got = contrast.as_many_each(p, 0.3, 19, 0.1).first()
    assert got.anchors == len(pairs) and abs(got.loss - np.mean(want)) < 1e-9
    assert contrast._shape(p, contrast.WIDE_BYTES)[1] == 1
    monkeypatch.setattr(contrast, "WIDE_BYTES", 1024)
    monkeypatch.setattr(contrast, "PACKED", 5)
    monkeypatch.setattr(contrast, "PART", 2)
    got = contrast.as_many_each(p, 0.3, 19, 0.1).first()
    assert got.anchors == len(pairs) and abs(got.loss - np.mean(want)) < 1e-9
    got = contrast.one_each(p, 0.3, 15, 0.1).first()
    assert got.anchors == len(pairs) and abs(got.loss - np.mean([loss(i, j, [c]) for (i, j), c in one.items() if c < size])) < 1e-9


def test_contrasts_far_below_a_sources_best_keep_their_digits(spark):
    """Vectors so long that what one draw adds is nothing beside another's."""
    x = np.array([[1.0, 0.0], [0.9, 0.1], [0.8, 0.3], [0.95, 0.05], [-40.0, 0.0], [-90.0, 1.0], [70.0, 5.0]]) * 10
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u, n, want = similarity.unit_rows(x), len(x), []
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if u[i] @ u[j] > 0.3]
    for i, j in pairs:
        at = [int(int(hashlib.md5(f"19:{i}:{j}:{m}".encode()).hexdigest()[:7], 16) / 268435456.0 * n) for m in range(sum(p[0] == i for p in pairs))]
        c = [next(c for c in ((a + s) % n for s in range(3)) if c not in (i, j)) for a in at]
        logits = x[i] @ x[[j, *c]].T / 0.1
        want.append(np.logaddexp.reduce(logits) - logits[0])
    got = contrast.as_many_each(contrast.placed(nodes), 0.3, 19, 0.1).first()
    assert got.anchors == len(pairs) and abs(got.loss - np.mean(want)) < 1e-9 * np.mean(want)


@pytest.mark.parametrize("fraction, bits", [(0.2, 16), (0.2, 2), (0.0, 16), (1.0, 3)])
def test_sample_of_similar_pairs_equals_that_of_their_table(spark, monkeypatch, fraction, bits):
    monkeypatch.setattr(masks, "BIN_BITS", bits)
    x = np.random.default_rng(5).normal(size=(300, 6))
    nodes = spark.createDataFrame([(i * 37, v.tolist()) for i, v in enumerate(x)] + [(7, None)], "vec_id long, embedding array<double>").repartition(3)
    table = masks.exact_sample(similarity.similar_pairs(nodes, 0.3).select("src", "dst"), ["src", "dst"], fraction, 5)
    want = sorted(map(tuple, table.collect()))
    made = masks.similar_sample(nodes, 0.3, fraction, 5)
    assert sorted(map(tuple, made.collect())) == want and len(want) > 1000
    assert sum(r[2] for r in want) == int(len(want) * fraction)
    assert sorted(map(tuple, masks.similar_sample(nodes, 0.3, fraction, 5, only=False).collect())) == [r for r in want if not r[2]]
    assert "Window" not in made._jdf.queryExecution().toString() and "Join" not in made._jdf.queryExecution().toString()


def test_digests_of_many_texts_are_md5():
    bits = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    for k in (1, 11, 150):
        ids = [3, 99, 12345, -7, 10**18, *range(100, 170)]
        got: list[list[int]] = [[] for _ in ids]
        for rows, found in digests.numbered([f"19:8:{i}:".encode() for i in ids], k):
            for r, b in zip(rows.tolist(), found.tolist(), strict=True):
                got[r] += b
        assert got == [[bits(f"19:8:{i}:{m}") for m in range(k)] for i in ids]
    rng = np.random.default_rng(1)
    a = np.concatenate([*(rng.integers(0, 10**d, 5000) for d in (1, 5, 9, 10, 18)), [-5, 0, 2**62]])
    b = rng.permutation(a)
    assert digests.of_pairs(15, a, b).tolist() == [bits(f"15:{x}:{y}") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert not len(digests.of_pairs(15, a[:0], b[:0]))
