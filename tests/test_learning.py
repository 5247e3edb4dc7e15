"""Probes from sums, ranks, versions, pages, draws over epochs and negatives: against plain code."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from plexure.operators import etl, network, probes, ranks, runs
from plexure.operators import graph as G
from plexure.operators import masks as M
from plexure.sources import metadata
from plexure.sources.versions import Versions, merged


def test_probes_equal_refits(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 3, 90)
    x[:, 0] += 2 * y
    rows = [(i, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(x, y, strict=True))] + [(900, None, "c1"), (901, [1.0] * 5, None), (902, [1.0], "c0")]
    p = probes.statistics(spark.createDataFrame(rows, "id long, vec array<double>, label string").repartition(4), "id", "vec", "label", 4)
    fold = {r.id: r.fold for r in M.folds(spark.createDataFrame([(i,) for i in range(90)], "id long"), "id", 4, 1).collect()}
    f, one, hot = np.array([fold[i] for i in range(90)]), np.c_[x, np.ones(90)], np.eye(3)[y]
    for penalty in (0.5, 3.0):
        got = {r.fold: r for r in probes.accuracies(p, [0.5, 3.0]).filter(f"penalty = {penalty}").collect()}
        for k in range(4):
            a, b = one[f != k], hot[f != k]
            own = np.diag([penalty] * 5 + [0.0])
            w = np.linalg.solve(a.T @ a + own, a.T @ b)
            total = sum(p.sums.values(), start=probes.Sums(0, 0, 0))
            assert np.abs(probes.solved(total - p.sums[k], penalty) - w).max() < 1e-9
            assert got[k].n == (f == k).sum() and got[k].accuracy == pytest.approx(((one[f == k] @ w).argmax(axis=1) == y[f == k]).mean())
    with pytest.raises(ValueError, match="classes"):
        probes.statistics(p.rows.withColumn("id", p.rows.fold), "id", "vec", "label", most_classes=2)
    empty = probes.statistics(p.rows.limit(0).withColumnRenamed("fold", "id"), "id", "vec", "label")
    assert probes.accuracies(empty, [1.0]).count() == 0


def test_area_counts_ties_half(spark):
    rng = np.random.default_rng(2)
    s, good = rng.integers(0, 12, 200) / 4, rng.random(200) < 0.4
    rows = [(float(v), bool(g)) for v, g in zip(s, good, strict=True)] + [(None, True), (float("nan"), False), (1.0, None)]
    df = spark.createDataFrame(rows, "s double, g boolean").repartition(5)
    got = ranks.area(df, "s", df.g).first()
    pairs = [1.0 if a > b else 0.5 if a == b else 0.0 for a in s[good] for b in s[~good]]
    assert (got.positives, got.negatives) == (good.sum(), (~good).sum()) and got.auc == pytest.approx(np.mean(pairs), abs=1e-12)
    assert ranks.area(df.filter("g"), "s", df.g).first().auc is None and ranks.area(df.limit(0), "s", df.g).first().positives == 0


def test_versions_are_whole_or_not_there(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "store"))
    assert store.read() is None and store.numbers() == []
    store.commit({"t": spark.range(3)}, {"a": {"b": 1, "c": 2}})

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit({"t": spark.range(9)}, {"a": 0}, before_rename=stop)
    tables, settings = store.read()
    assert store.numbers() == [1] and tables["t"].count() == 3 and settings == {"a": {"b": 1, "c": 2}}
    # Another writer takes the number while this one is about to.
    assert store.commit({"t": spark.range(5)}, before_rename=lambda: store.commit({"t": spark.range(4)})) == 3
    numbers = store.numbers
    try:
        store.numbers = lambda: numbers()[:1]  # a listing that is behind
        assert store.commit({"t": spark.range(6)}) == 4
    finally:
        store.numbers = numbers
    assert [store.read(n)[0]["t"].count() for n in store.numbers()] == [3, 4, 5, 6]
    store.clean(2)
    assert store.numbers() == [3, 4] and len(list((tmp_path / "store" / "data").iterdir())) == 2
    store.update_settings({"a": {"b": 5, "d": None}})
    assert store.read()[1] == {"a": {"b": 5}} and merged({"a": 1, "b": {"c": 2}}, {"b": {"c": None, "d": 3}}) == {"a": 1, "b": {"c": 2, "d": 3}}


def test_weights_come_back_from_their_tables(spark, tmp_path):
    model = network.Model((network.Relation("r", "x", "x"),))
    weights = network.drawn(model, {"x": 3}, 2, 1)
    moments = network.Moments({n: w * 2 for n, w in weights.items()}, {n: w * w for n, w in weights.items()}, 7)
    store = Versions(spark, str(tmp_path / "weights"))
    store.commit({"weights": network.to_rows(spark, weights, moments)}, {"epoch": 6})
    tables, settings = store.read()
    back, state = network.from_rows(tables["weights"])
    assert settings["epoch"] == 6 and state.steps == 7 and all((back[n] == w).all() and (state.second[n] == w * w).all() for n, w in weights.items())
    assert network.from_rows(network.to_rows(spark, weights))[1] is None


def test_pages_rejoin_to_the_lists(spark):
    rows = [("hot", i % 700) for i in range(1000)] + [("cold", 5), (None, 1), ("cold", None)]
    got = etl.pages(spark.createDataFrame(rows, "k string, v long").repartition(4), "k", "v", 64).collect()
    assert sorted(v for r in got if r.k == "hot" for v in r["values"]) == sorted(i % 700 for i in range(1000))
    sizes = [len(r["values"]) for r in sorted(got, key=lambda r: r.page) if r.k == "hot"]
    assert sizes == [64] * 15 + [40] and [r["values"] for r in got if r.k == "cold"] == [[5]]


def test_draws_over_epochs(spark):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(3000)], "a long, b string").repartition(4)
    got = {(r.a, r.epoch) for r in M.redraw(df, ["a", "b"], 0.2, 9, 30).collect()}
    want = set()
    for i in range(3000):
        epoch, k = -1, 0
        while True:
            share = int(hashlib.md5(f"9:{i}:x{i}:{k}".encode()).hexdigest()[:7], 16) / 2**28
            epoch += 1 + math.floor(math.log(1 - share) / math.log(0.8))
            if epoch >= 30:
                break
            want.add((i, epoch))
            k += 1
    assert got == want and abs(len(got) / 90_000 - 0.2) < 0.01
    per = np.bincount([e for _, e in got], minlength=30) / 3000
    assert np.abs(per - 0.2).max() < 0.04
    both = len({i for i, e in got if e == 3} & {i for i, e in got if e == 4}) / 3000
    assert abs(both - 0.04) < 0.02  # epochs do not depend on each other
    short = {(r.a, r.epoch) for r in M.redraw(df, ["a", "b"], 0.2, 9, 10).collect()}
    assert short == {(i, e) for i, e in got if e < 10}
    assert M.redraw(df, ["a"], 1.0, 9, 2).count() == 6000 and M.redraw(df, ["a"], 0.0, 9, 2).count() == 0


def test_negatives_of_give_all_that_are_asked_for(spark):
    nodes = spark.createDataFrame([(i, 0 if i < 800 else 1 + i % 9) for i in range(1000)] + [(5000, None)], "id long, g long")
    sizes = nodes.filter("g IS NOT NULL").groupBy(nodes.g.alias("anchor")).count().withColumnRenamed("count", "n")
    got = M.negatives_of(sizes, nodes, "id", "g", 3).collect()
    group = {i: 0 if i < 800 else 1 + i % 9 for i in range(1000)}
    assert len(got) == 1000 and all(group[r.neg] != r.anchor for r in got) and len({(r.anchor, r.m) for r in got}) == 1000
    assert M.negatives_of(sizes.filter("anchor = 0"), nodes.filter("g = 0"), "id", "g", 3).count() == 0


def test_bridges_of_large_components_on_a_grid(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    part = np.repeat([0, 120, 260], [120, 140, 40])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    label = spark.createDataFrame([(i, int(c)) for i, c in enumerate(part)], "node long, component long")
    got = {(r.src, r.dst) for r in G.bridges(v, label, "vec_id", "embedding", size=16, group_rows=25).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for a, b in ((0, 120), (120, 260)):
        i, j = np.flatnonzero(part == a), np.flatnonzero(part == b)
        at = np.unravel_index((u[i] @ u[j].T).argmax(), (len(i), len(j)))
        want.add((int(i[at[0]]), int(j[at[1]])))
    assert got == want


def test_the_last_of_an_id_is_the_last_by_file_and_line(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    (folder / "a.csv").write_text("id;text\n" + "".join(f"{i};first file, which is long\n" for i in range(2000)) + "7;end of the first\n")
    (folder / "b.csv").write_text("id;text\n3;second\n3;third\n")
    (folder / "c.csv").write_text("id;text\n4;fourth\n")
    got = {r.audio_id: r.text for r in metadata.transcriptions(spark, str(folder)).collect()}
    assert (got["3"], got["4"], got["7"], len(got)) == ("third", "fourth", "end of the first", 2000)


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    store, seen = Versions(spark, str(tmp_path / "runs")), []
    configs = {"a": {"x": 2.0}, "b": {"x": None}, "c": {"x": 3.0}}

    def run(config, fold):
        seen.append((config["x"], fold))
        if len(seen) == 4:
            raise KeyboardInterrupt  # the driver is stopped
        return {"m": config["x"] * fold, "other": 1.0}

    with pytest.raises(KeyboardInterrupt):
        runs.run_grid(spark, configs, 2, run, ["m"], store)
    out = runs.run_grid(spark, configs, 2, run, ["m"], store)
    assert seen == [(2.0, 0), (2.0, 1), (None, 0), (None, 1), (None, 1), (3.0, 0), (3.0, 1)]
    assert sorted((r.config_id, r.fold, r.m) for r in out.collect()) == [("a", 0, 0.0), ("a", 1, 2.0), ("b", 0, math.inf), ("b", 1, math.inf), ("c", 0, 0.0), ("c", 1, 3.0)]
    assert {r.config_id: (r.folds, r.m) for r in runs.averaged(out, ["m"]).collect()} == {"a": (2, 1.0), "b": (0, math.inf), "c": (2, 1.5)}
