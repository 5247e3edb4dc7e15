"""Operators on hand-made rows: the cases that the tables do not hold."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexure.functions import text as X
from plexure.functions.hashing import hash_key, rank_by_hash
from plexure.functions.vectors import cosine, mask_of, pad_or_cut, peak_normalized
from plexure.operators import etl, masks, selection
from plexure.operators import graph as G
from plexure.operators import retrieval as R
from plexure.operators.sequences import bins, warp_distance, warp_similarity
from plexure.operators.similarity import similar_pairs, top_similar
from plexure.sources import metadata, sinks
from plexure.streaming.retrieval import stream_edges


def test_zero_vectors_and_padding(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>, c array<double>")
    r = row.select(cosine(F.col("a"), F.col("b")).alias("z"), pad_or_cut(F.col("c"), 2).alias("cut"), pad_or_cut(F.col("c"), 5).alias("pad"), mask_of(F.col("c"), 5).alias("m"), peak_normalized(F.col("a")).alias("p"), peak_normalized(F.col("c")).alias("q")).first()
    assert r.z == 0 and r.cut == [1, 2] and r.pad == [1, 2, 3, 0, 0] and r.m == [1, 1, 1, 0, 0] and r.p == [0, 0] and r.q == [1 / 3, 2 / 3, 1]


def test_similarity_on_small_inputs(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [1.0, 0.1], 5), (3, [0.0, 1.0], 6), (4, [0.0, 0.0], None), (5, None, 6)], "vec_id long, embedding array<double>, label int")
    assert [(r.src, r.dst) for r in similar_pairs(v, 0.9).collect()] == [(1, 2)]
    assert sorted((r.src, r.dst, round(r.weight, 3)) for r in similar_pairs(v, 0.99, tag="label").collect()) == [(1, 2, 1.0)]
    assert similar_pairs(v.limit(0), 0.1).count() == 0
    best = R.query_edges(v.filter("vec_id = 3"), v.filter("vec_id < 3"), 0.9).collect()
    assert [(r.query_id, r.vec_id) for r in best] == [(3, 2)]
    assert top_similar(v.filter("vec_id = 1"), v, 10).count() == 3  # clamped to what there is


def test_union_dedup_and_last_wins(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "k")], "id long, t string, u string")
    b = spark.createDataFrame([(3, "x"), (4, None)], "id long, t string")
    out = etl.aligned_union([a, b])
    assert out.columns == ["id", "t", "u"] and out.count() == 4
    assert sorted(r.id for r in etl.first_of_each(out, ["t"], ["id"]).collect()) == [1, 2]
    assert sorted(r.id for r in etl.last_of_each(out, ["t"], ["id"]).collect()) == [3, 4]
    assert etl.matching(out, {"nothing": 1, "t": "x"}).count() == 2


def test_splits_of_small_and_null_strata(spark):
    df = spark.createDataFrame([(i, "big" if i < 100 else "small" if i < 105 else None) for i in range(110)], "id long, s string")
    out = etl.split_strata(df, "s", "id", 1)
    n = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert n == {("big", "train"): 70, ("big", "val"): 15, ("big", "test"): 15, ("small", "train"): 5}
    ranks = rank_by_hash(df.withColumn("key", hash_key(3, "id")), "key", []).collect()
    assert [r.key for r in sorted(ranks, key=lambda r: r.rn)] == sorted(r.key for r in ranks)


def test_folds(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    sizes = sorted(r["count"] for r in masks.folds(df, "x", 4, 1).groupBy("fold").count().collect())
    assert sizes == [2, 2, 3, 3]
    few = masks.grouped_folds(df.withColumn("g", F.col("x") % 2), "g", 5, 1)
    assert {r.fold for r in few.collect()} == {4}


def brute_forest(edges):
    root, out = {}, set()
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for w, a, b in sorted((-w, a, b) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.add((a, b, -w))
    return out


def test_forest_and_components_against_brute_force(spark):
    rng = random.Random(1)
    edges = {(a, b): rng.choice([0.2, 0.5, 0.9]) for _ in range(60) for a, b in [sorted(rng.sample(range(40), 2))]}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame(rows, "src long, dst long, weight double")
    assert {tuple(r) for r in G.spanning_forest(df).collect()} == brute_forest(rows)
    label = {r.node: r.component for r in G.components(spark.range(45).withColumnRenamed("id", "n"), df, "n").collect()}
    assert len(label) == 45 and all(label[a] == label[b] for a, b, _ in rows) and len(set(label.values())) == 45 - len(brute_forest(rows))
    assert all(c == min(n for n, d in label.items() if d == c) for c in label.values())
    assert G.spanning_forest(df.limit(0)).count() == 0


def test_published_degree_and_density_of_a_tree(spark):
    """29 nodes and 28 edges stored both ways: mean degree 3.862, density 0.1379."""
    tree = spark.createDataFrame([(i // 2, i, 0.9) for i in range(1, 29)], "src long, dst long, weight double")
    both = G.symmetrized(tree)
    d = G.degrees(spark.range(29).withColumnRenamed("id", "n"), both, "n").agg(F.avg("degree")).first()[0]
    assert both.count() == 56 and math.isclose(d, 3.8620689, rel_tol=1e-6)
    assert math.isclose(spark.range(1).select(G.density(F.lit(56), F.lit(29)).alias("d")).first().d, 0.13793, rel_tol=1e-4)


def test_backbones_fall_back_to_the_strongest(spark):
    df = spark.createDataFrame([(i, i + 1, 0.1 * i) for i in range(5)], "src long, dst long, weight double")
    kept = G.backbone(df, "threshold", threshold=2.0).collect()
    assert {(r.src, r.dst) for r in kept} == {(4, 5), (5, 4)}
    one = df.filter("src = 4")
    assert G.disparity(one).count() == 0  # an end of degree 1 never decides
    assert G.disparity(df.filter("src = 0")).count() == 0 and G.noise_corrected(df.filter("src = 0")).count() == 0  # no weight at all


def test_pareto_ties_and_values_that_are_no_numbers(spark):
    rng = random.Random(2)
    pts = [(i, float(rng.randint(0, 9)), float(rng.randint(0, 9))) for i in range(60)] + [(98, float("nan"), 0.0), (99, float("inf"), 0.0)]
    front = {i for i, x, y in pts[:60] if not any(a <= x and b <= y and (a < x or b < y) for _, a, b in pts[:60])}
    df = spark.createDataFrame(pts, "id long, x double, y double")
    assert {r.id for r in selection.pareto(df, "id", "x", "y").collect()} == front
    assert selection.second_stage(df.limit(0), "id", "x").count() == 0
    assert selection.first_stage(df.filter("id > 90"), "id", "x", "y", 5).count() == 2


def test_recall_counts_queries_without_truth(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (2, 9, 1)], "query_id long, vec_id long, rank int")
    truth = spark.createDataFrame([(1, 8)], "query_id long, vec_id long")
    got = {r.k: r.recall for r in R.recall_at(ranked, truth, spark.createDataFrame([(1,), (2,)], "query_id long"), [1, 2]).collect()}
    assert got == {1: 0.0, 2: 0.5}


def test_warping(spark):
    a = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert warp_distance(a, a) == pytest.approx(0) and warp_distance(a, np.repeat(a, 3, axis=0)) == pytest.approx(0)
    df = spark.createDataFrame([(1, a.tolist()), (2, a[::-1].tolist())], "id long, frames array<array<double>>")
    got = {(r.a, r.b): r.similarity for r in warp_similarity(df).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 2)} and got[1, 1] == pytest.approx(1) and got[1, 2] < 0.7
    assert [r.bin for r in bins(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "v double"), "v", [2.0, 5.0]).collect()] == [0, 1, 2]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Index;Text\nSTE-1;hello\n2;\nSTE3;old\n3;new\n", encoding="utf-8")
    assert metadata.delimiter(spark, str(tmp_path / "a.csv")) == ";"
    assert {(r.audio_id, r.text) for r in metadata.transcriptions(spark, str(tmp_path / "a.csv")).collect()} == {("1", "hello"), ("3", "new")}
    (tmp_path / "b.csv").write_bytes("audio_path,transcription,speaker_id\nx.wav,\xe9t\xe9,s\n".encode("latin-1"))
    assert metadata.dataset(spark, str(tmp_path / "b.csv")).first().transcription == "été"
    with pytest.raises(ValueError, match="missing columns: audio_path"):
        metadata.dataset(spark, str(tmp_path / "a.csv"))
    (tmp_path / "m.tsv").write_text("audio_filename\tkey\tsentence\n a.mp3 \tk\tone\na.mp3\tk\ttwo\n\tk\tnone\n")
    assert [(r.audio_filename, r.sentence) for r in metadata.mapping(spark, str(tmp_path / "m.tsv")).collect()] == [("a.mp3", "two")]
    d = tmp_path / "corp" / "dr1" / "spk"
    d.mkdir(parents=True)
    (d / "S1.WRD").write_text("0 10 she\n10 20 had\nbad line\nx 3 y\n")
    (d / "S1.PHN").write_text("0 5 sh\n5 10 iy\n")
    (d / "S1.WAV").write_bytes(b"0")
    files = metadata.listing(spark, str(tmp_path / "corp"), "*.WAV")
    side = metadata.with_sidecars(files, metadata.segment_files(spark, str(tmp_path / "corp"), "*.PHN"), metadata.segment_files(spark, str(tmp_path / "corp"), "*.WRD"), metadata.sentence_files(spark, str(tmp_path / "corp"), "*.WRD").limit(0)).first()
    assert (side.parent, side.grandparent, side.phonemes, side.transcription) == ("spk", "dr1", ["sh", "iy"], "she had")
    table = spark.createDataFrame([("a", "x", "train"), ("b", "y", "test")], "id string, language string, split string")
    sinks.by_language(table, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    made = []
    build = {"nodes": lambda: made.append(1) or table}
    for _ in range(2):
        sinks.configured(spark, str(tmp_path / "built"), {"t": 0.3}, build)
    assert len(made) == 1
    assert {r.bin: r.n for r in sinks.histogram(spark.range(10), "id", 3).collect()} == {0: 3, 1: 3, 2: 4}


def test_text_functions(spark):
    r = spark.createDataFrame([("http://h/a/b/c.x?q=1", "Yes", " it's  OK! ")], "p string, f string, t string").select(X.stem(F.col("p")).alias("s"), X.path_part(F.col("p"), 2).alias("b"), X.truthy(F.col("f")).alias("f"), X.clean_strict(F.col("t")).alias("c"), X.letters(F.col("t")).alias("l"), X.to_float(F.col("f")).alias("n")).first()
    assert (r.s, r.b, r.f, r.c, r.n) == ("c", "b", True, " it's  OK ", "Yes") and r.l == [["i", "t", "'", "s"], ["O", "K", "!"]]


def test_streamed_queries(spark, tmp_path):
    ref = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    spark.createDataFrame([(10, [1.0, 0.1])], ref.schema).write.parquet(str(tmp_path / "in"))
    stream_edges(spark.readStream.schema(ref.schema).parquet(str(tmp_path / "in")), ref, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [(r.query_id, r.vec_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(10, 1)]


def test_losses_and_dictionary(spark):
    from plexure.operators.propagate import info_nce, total_loss

    rows = spark.createDataFrame([("a", 1.0, True), ("a", 0.0, False), ("b", 2.0, True)], "k string, logit double, pos boolean")
    r = info_nce(rows, "k", "logit", "pos").first()
    assert r.anchors == 2 and r.loss == pytest.approx((math.log(math.e + 1) - 1) / 2)
    assert spark.range(1).select(total_loss(F.lit(1.0), F.lit(2.0), F.lit(3.0), 0.5, 0.25).alias("t")).first().t == 4.0
    words = spark.createDataFrame([("b",), ("a",), ("ä",), (None,), ("b",)], "w string")
    assert {r.w: r.id for r in etl.dictionary(words, "w").collect()} == {"a": 0, "b": 1, "ä": 2}
    assert etl.dictionary(words.limit(0), "w").count() == 0


def test_bridges_join_components_in_a_chain(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (5, [0.0, 1.0]), (9, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    label = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (9, 9)], "node long, component long")
    got = {(r.src, r.dst) for r in G.bridges(v, label, "vec_id", "embedding").collect()}
    assert got == {(2, 5), (5, 9)}


def test_tasks_of_shared_members_have_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [(k, m) for k in range(200) for m in {k % 7, k % 11, k % 5, 12}] + [(1, 12), (None, 3), (4, None)]
    df = spark.createDataFrame(rows, "k long, m long")
    want: dict = {}
    for k in range(200):
        some = sorted({m for x, m in rows if x == k and m is not None})
        for i, a in enumerate(some):
            for b in some[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    pairs = sum(want.values())
    monkeypatch.setattr(G, "TASK_ROWS", 50)
    found = G.shared_members(df, "k", "m")
    assert found.rdd.getNumPartitions() == -(-pairs // 50) > 4
    assert {(r.src, r.dst): r.weight for r in found.collect()} == want
    kept = {tuple(r) for r in G.noise_corrected(found).collect()}
    monkeypatch.undo()
    assert kept == {tuple(r) for r in G.noise_corrected(found).collect()}


def test_pages_of_lists_are_the_pages_of_pairs(spark, monkeypatch):
    from plexure.operators import similarity as S

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist() if i % 9 else None) for i in range(-5, 120)], "vec_id long, embedding array<double>")
    e = similar_pairs(df, 0.2)
    both = e.selectExpr("src AS key", "dst AS v").unionByName(e.selectExpr("dst AS key", "src AS v"))
    want = {tuple(map(str, r)) for r in etl.pages(both, "key", "v", 4).collect()}
    for listed, page_rows in ((S.LISTED, etl.PAGE_ROWS), (100, 8)):
        monkeypatch.setattr(S, "LISTED", listed)
        monkeypatch.setattr(etl, "PAGE_ROWS", page_rows)
        got = etl.pages_of_lists(S.similar_lists(df, 0.2), 4).collect()
        assert len(got) == len(want) > 100 and {tuple(map(str, r)) for r in got} == want
    assert etl.pages_of_lists(S.similar_lists(df, 1.5), 4).count() == 0
