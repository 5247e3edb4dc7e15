"""Token counts against the library; vector codes and hard negatives against plain code and SQL."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from plexure.llm import codes
from plexure.llm import token_counts as counts
from plexure.llm.codes import compress
from plexure.llm.hard_negatives import Queries, hard_negatives, visit
from plexure.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
BITS = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "ﬁ", "你好", "<s>", "</s>", "<unk>", "<0x0A>", "▁", "\x00", "　", "😀", "01", "==", ".", "\r", "́", "кот"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pre_tokens_add_up_to_the_librarys_count(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(4000)] + ["", None, " ", "\n", "\x00"]
    pieces, cache = counts.PieceCounter(MODEL), {}
    assert pieces.cuts and pieces.ranked
    table = counts.Table(words := [" the", "a", "\n"], pieces.counts(words))
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        got = counts._sums(counts.pre_tokens(pa.array(part, pa.string())), table, pieces.counts, cache, 100)
        assert got.tolist() == [len(library.encode(t or "")) for t in part]


def test_long_runs_in_windows_count_as_the_whole(library):
    rng = random.Random(4)
    pieces = counts.PieceCounter(MODEL, window=64, overlap=24)
    for k in range(400):
        letters = rng.choice(["ab", "a", "aeiou", "abcdefghij", "=-", "0123", "tionsi", "кот"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(65, 600)))
        if k % 3 == 0:
            text = "▁" * rng.randint(1, 500) + text[: rng.randint(0, 80)]
        want = len(library.encode("\n" + text)) - 2
        assert pieces._run(text) == want and pieces._long(text) == want


def test_token_counts_of_odd_and_very_long_texts(spark, library):
    rng = random.Random(5)
    lines = "\n".join(" ".join(rng.choice(["one", "two", "drei", "quatre"]) for _ in range(9)) for _ in range(130_000))
    texts = ["", None, "plain words", "same", "same", lines, "".join(rng.choice("abcdef01") for _ in range(5 << 20)), "x\n" * 2_500_000, " " * 5_000_000]
    rows = [(i if i != 3 else None, t, 7, "n") for i, t in enumerate(texts)]
    got = counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, words string").repartition(2), MODEL).collect()
    want = [(r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert counts.token_counts(empty, MODEL).count() == 0


def test_frequent_words_cover_all_rows_and_stay_bounded(spark):
    texts = [(i, " ".join(["often"] * 3 + [f"w{i}x{k}" for k in range(40)])) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    found = counts.frequent(docs, 8)
    assert len(found) <= 8 and " often" in found
    assert sum(counts._shrunk({"a": 9, "b": 5, "c": 5, "d": 1}, 2).values()) <= 9


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in rows), default=0) // parts))
    whole = lambda x: math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale
    x = [[whole(c) for c in r[1]] + [0] * (parts * width - len(r[1])) for r in rows]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in x]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, list(rows[i][1])))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    assigned = lambda: [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in range(len(rows)) if now[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    now = assigned()
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    error, by_label, most = [sum(d for d, _ in a) for a in now], {}, (1 << 63) - 1
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + min(e, most)
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in a), min(e, most), min(by_label[r[2]], most), digest) for r, a, e in zip(rows, now, error, strict=True)), key=repr)


def odd_vectors(rng):
    rows = [(i % 90 if i % 7 else None, rng.normal(size=rng.integers(0, 40)).tolist(), None if i % 5 == 0 else i % 3) for i in range(150)]
    return rows + [(1, None, 1), (2, [float("nan")], 1), (3, [1.0, None], 2), (5, [1.0] * 33, 1), (5, [1.0] * 33, 1), (6, [float("inf")], None), (7, [], 2)]


def vectors(spark, rows):
    named = [(*r, "code", 3) for r in rows]
    return spark.createDataFrame(named, "vec_id long, embedding array<double>, label int, data string, error int").repartition(3)


@pytest.mark.parametrize("wide", [False, True])
def test_codes_against_plain_code(spark, wide):
    rows = odd_vectors(np.random.default_rng(6))
    rows = rows[:50] + [(1000, [1e300, -1e305, 1e9], 1), (1001, [1e9], 2), (0, [3e15], None)] if wide else rows
    got = sorted((tuple(r) for r in compress(vectors(spark, rows), block=16).collect()), key=repr)
    assert got == plain_codes(rows)


def test_codes_with_many_labels(spark, monkeypatch):
    """Beyond the labels that are broadcast, sums by label come back through a merge join."""
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    rows = odd_vectors(np.random.default_rng(10))
    out = compress(vectors(spark, rows), block=16)
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_codes(rows)


def test_codes_of_few_rows_or_none(spark):
    assert compress(vectors(spark, []).limit(0)).count() == 0
    rows = [(1, [], 1), (2, [], None)]
    assert sorted(tuple(r) for r in compress(vectors(spark, rows)).collect()) == plain_codes(rows)


def plain_negatives(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = lambda v: [math.floor(scale * x) if math.isfinite(scale * x) else int(x) * scale for x in v]
    anchors, most, out = {}, (1 << 63) - 1, []
    for i, v, label in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))

    def top(found, k):
        best = {}
        for s, i in found:
            best[i] = max(best.get(i, s), s)
        return sorted((-s, i) for i, s in best.items())[:k]

    for a, (label, v) in anchors.items():
        scored = [(max(-most - 1, min(most, sum(x * y for x, y in zip(whole(v), whole(w), strict=False)))), i, m) for i, w, m in rows if i != a]
        for p, i in top([(s, i) for s, i, m in scored if m == label], positives):
            fit = [(s, j) for s, j, m in scored if m != label and low * -p <= 100 * s <= high * -p]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(top(fit, negatives))]
    return sorted(out)


def labelled(rng):
    base = rng.normal(size=(12, 24))
    rows = [(i, (base[i % 12] + rng.normal(size=24) * 0.3).tolist()[: 24 if i % 9 else 10], int(rng.integers(0, 4)) if i % 11 else None) for i in range(600)]
    rows += [(100, [1.0] * 24, 1), (100, [0.5] * 24, 1), (200, None, 1), (300, [float("nan")], 1), (None, [1.0], 1), (205, rows[205][1], 2), (205, rows[205][1], 2), (206, [9.0] * 24, 0), (1000, [], 1), (1001, [0.0] * 3, 1), (1002, [1.0, None], 1)]
    return rows + [(2000 + i, [0.25] * 24, i % 2) for i in range(300)]  # a third is one vector


@pytest.mark.parametrize("how", [{}, {"block": 16}, {"most_fit": 30, "most_lists": 3}])
def test_negatives_against_plain_code(spark, how):
    rows = labelled(np.random.default_rng(7))
    got = sorted(tuple(r) for r in hard_negatives(vectors(spark, rows), **how).collect())
    assert got == plain_negatives(rows)


def test_negatives_beyond_64_bits_and_of_empty_tables(spark):
    rows = labelled(np.random.default_rng(8))[:250] + [(5, [1e300, 1e300], 1), (3000, [1e299] * 2, 1), (4000, [1e5] * 24, 2)]
    assert sorted(tuple(r) for r in hard_negatives(vectors(spark, rows)).collect()) == plain_negatives(rows)
    assert hard_negatives(vectors(spark, rows).limit(0)).count() == 0
    assert hard_negatives(vectors(spark, [(1, [1.0], 1)])).count() == 0


def test_bounds_spare_most_products_on_clustered_vectors():
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(64, 32)) * 256
    lists = [(np.arange(100) + 100 * i, np.full(100, i % 2), np.floor(c + rng.normal(size=(100, 32)) * 8)) for i, c in enumerate(centre)]
    radius = np.array([np.sqrt(((x - c) ** 2).sum(axis=1)).max() for (_, _, x), c in zip(lists, centre, strict=True)])
    x = lists[5][2][:10]
    none = np.full(10, np.inf)
    asked = Queries(x, np.arange(10) - 100, np.ones(10, int), np.arange(10), -none, none, -none)
    (query, ids, scores), made = visit(asked, lists, centre, radius, 5, True)
    every, labels, ids_all = np.concatenate([b[2] for b in lists]), np.concatenate([b[1] for b in lists]), np.concatenate([b[0] for b in lists])
    for q in range(10):
        s = np.where(labels == 1, every @ x[q], -np.inf)
        want = np.lexsort((ids_all, -s))[:5]
        assert ids[query == q].tolist() == ids_all[want].tolist() and scores[query == q].tolist() == s[want].tolist()
    assert made < 10 * len(every) / 8


def test_token_count_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    assert len(got) == len(docs)
    assert all(got[r.doc_id].n_tokens == len(library.encode(r.text or "")) for r in docs)
