"""Vector operators against brute force."""

from __future__ import annotations

import numpy as np

from plexure.llm import vector_dedup
from plexure.llm.common import Scratch
from plexure.llm.components import connected_components
from plexure.llm.topk import top_products

from plexure.llm.vector_dedup import block_links, candidates, fitted, near_vectors, shared_counts, thinned


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string").repartition(3)


def odd_rows(rng):
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + rng.normal(size=16) * 0.05 * (i % 3)).tolist()) for i in range(400)]
    return [*rows, (900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [float("inf")] * 16), (905, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (906, rows[0][1]), (906, rows[0][1]), (1000, [2.0, 1.0])]


def test_near_vectors_against_brute_force(spark):
    rows = odd_rows(np.random.default_rng(1))
    good = [(i, v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    got = near_vectors(table(spark, rows)).collect()
    assert len(got) == len(rows)
    links, root = {}, {i: i for i, _ in good}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v) in enumerate(good):
        for j, w in good[:a]:
            if len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    by = {r.vec_id: r for r in got}
    for i, _ in good:
        if i != 906:
            assert by[i].component_id == find(i) and by[i].n_links <= links.get(i, 0)
    assert sum(by[i].n_links for i in root if i != 906) >= 0.98 * sum(n for i, n in links.items() if i != 906)
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in range(900, 906))
    assert near_vectors(table(spark, rows).limit(0)).count() == 0


def test_a_dense_group_of_near_copies_keeps_its_links(spark):
    """A third of the rows in one group, all pairs of it linked."""
    rng = np.random.default_rng(4)
    n, dims = 9000, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(rng.normal(size=(n, dims)))
    x[: n // 3] = unit(x[0] + rng.uniform(0.05, 0.2, (n // 3, 1)) * x[: n // 3])
    want = ((x @ x.T) >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in near_vectors(table(spark, list(enumerate(x.tolist())))).collect()}
    links = np.array([got[i].n_links for i in range(n)])
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    assert {got[i].component_id for i in range(n // 3)} == {0}


def _narrow(rng, n, dims, mean):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit(np.sqrt(mean) * unit(rng.normal(size=(1, dims))) + np.sqrt(1 - mean) * unit(rng.normal(size=(n, dims))))


def _copies(rng, x, cosine):
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    return cosine * x + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1, keepdims=True)


def test_the_index_holds_on_narrow_tables():
    """Mean cosines from 0 to 0.9: many points stay, and pairs at the least cosine are found, at the measured depth."""
    rng = np.random.default_rng(11)
    deep = []
    for mean in (0.0, 0.5, 0.8, 0.9):
        x = _narrow(rng, 2548, 64, mean)
        index = fitted(x[:2048], 0.7, 0.95, 4, 0.99)
        a, b = (index.codes(index.near(v)) for v in (x[2048:], _copies(rng, x[2048:], 0.951)))
        assert len(index.points) > 100 and candidates(a, b, index.heads, 4).mean() >= 0.97
        deep.append(index.depth)
    assert deep == sorted(deep) and deep[0] == 16
    assert fitted(np.ones((300, 4)) / 2, 0.7, 0.95, 4, 0.99).depth == 1 and fitted(x[:1], 0.7, 0.95, 4, 0.99).depth == 1


def test_near_vectors_of_a_narrow_table(spark, monkeypatch):
    """Mean cosine 0.8, blocks of several tiles in long lists: all links are true, nearly all are found, groups are joined."""
    rng = np.random.default_rng(12)
    monkeypatch.setattr(vector_dedup, "TILE", 32)
    x = _narrow(rng, 3000, 32, 0.8)
    x = np.vstack([x, _copies(rng, x[:400], 0.96), _copies(rng, np.repeat(x[:1], 500, axis=0), 0.985)])
    cosines = x @ x.T
    want = (cosines >= 0.95).sum(axis=1) - 1
    got = {r.vec_id: r for r in near_vectors(table(spark, list(enumerate(x.tolist()))), block=64).collect()}
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.95 * want.sum()
    assert sum(got[3000 + i].component_id == got[i].component_id for i in range(400)) >= 380


def test_shared_points_are_counted_and_decide_what_is_verified():
    rng = np.random.default_rng(7)
    codes = np.array([rng.permutation(40)[:6] for _ in range(90)] + [np.arange(6)] * 30, np.int32)
    want = np.array([[len(set(a) & set(b)) for b in codes[50:]] for a in codes[:70]])
    assert np.array_equal(shared_counts(codes[:70], codes[50:]), want)
    assert np.array_equal(shared_counts(codes[:0], codes), np.zeros((0, len(codes))))
    x = rng.normal(size=(len(codes), 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, found = np.arange(len(codes)), set()
    for point in range(40):
        mine = rows[(codes[:, :3] == point).any(axis=1)]
        half = mine[: len(mine) // 2], mine[len(mine) // 2 :]
        for first, second in ((half[0], half[0]), half, (half[1], half[1])):
            pairs = list(zip(*(y.tolist() for y in block_links(x, codes, first, first if first is second else second, point, 3, 2, 0.5)), strict=True))
            assert not found & set(pairs)  # each pair counts in one list
            found |= set(pairs)
    heads = [set(c[:3]) for c in codes.tolist()]
    near = lambda i, j: codes[i, 0] == codes[j, 0] or heads[i] & heads[j] and len(set(codes[i]) & set(codes[j])) >= 2
    assert {tuple(sorted(p)) for p in found} == {(i, j) for j in range(len(codes)) for i in range(j) if x[i] @ x[j] >= 0.5 and near(i, j)}


def test_thinned_points_lie_apart_whatever_the_step():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.array_equal(thinned(x, 0.7, 7), thinned(x, 0.7)) and (np.triu(thinned(x, 0.7) @ thinned(x, 0.7).T, 1) <= 0.7).all()


def test_top_products_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [*[(i, v) for i, v in odd_rows(rng) if i != 906], (300000, [1e18] * 16), (700, [1e200] * 16), (1100, (rng.integers(0, 2, 16) * rng.normal(size=16)).tolist())]
    floor = lambda v: [int(np.floor(float(1024) * x)) if abs(x) < 1e300 else int(x) * 1024 for x in v]
    good = {i: floor(v) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    got = {}
    for r in top_products(table(spark, rows), k=7, block=100).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    asked = [i for i in good if i % 100 == 0]
    assert sorted(got) == sorted(asked)
    for q in asked:
        score = {i: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(good[q], v, strict=False)))) for i, v in good.items() if i != q}
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [got[q][r] for r in range(1, 8)] == want
    assert top_products(table(spark, rows).limit(0)).count() == 0
    plain = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(0, 900)]  # many ties, several blocks a cell
    values = np.array([v for _, v in plain]) * 1024
    score = (values @ values.T).astype(int)
    got = {}
    for r in top_products(table(spark, plain), k=5, block=16).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, 900, 100):
        want = sorted(((int(s), i) for i, s in enumerate(score[q]) if i != q), key=lambda x: (-x[0], x[1]))[:5]
        assert [got[q][r] for r in range(1, 6)] == [(i, s) for s, i in want]
    assert top_products(table(spark, [(100, [1.0])])).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(0, 400)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3), (2000, 1999)], "u long, v long")
    got = {r.node: r.component for r in connected_components(Scratch(spark, "test"), edges).collect()}
    assert all(got[i] == 0 for i in range(401)) and all(got[i] == 1000 for i in range(1000, 1300)) and got[2000] == 1999 and len(got) == 703
    assert connected_components(Scratch(spark, "test"), edges.limit(0)).count() == 0
