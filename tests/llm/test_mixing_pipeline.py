"""Mixing against a plain loop, the pipeline's stages, and the registered queries on small tables."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from plexure.llm.bpe import read_ranks
from plexure.llm.mixing import leaf_budgets, mix
from plexure.llm.quality import score_documents
from plexure.llm.queries import ORACLE_SQL, QUERIES

from .test_text_ops import DOCS, PATTERN, RANKS, brute_components, prose

SMALL = "/root/testdata/sf0.001"


def pour(budget, kids):
    """Shares of a budget among (weight, capacity), by filling up level after level."""
    out = {k: 0.0 for k in kids}
    live = {k for k, (w, c) in kids.items() if w > 0 and c > 0}
    left = budget
    while live and left > 1e-9:
        level = left / sum(kids[k][0] for k in live)
        full = {k for k in live if kids[k][1] - out[k] <= level * kids[k][0] + 1e-9}
        if not full:
            for k in live:
                out[k] += level * kids[k][0]
            break
        for k in full:
            left -= kids[k][1] - out[k]
            out[k] = kids[k][1]
        live -= full
    return out


def test_mix_follows_the_tree(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["src1", "src7", "src12", "odd", None])
        rows.append((i, rng.choice([None, "", prose(rng, rng.randint(1, 40))]) if i % 9 == 0 else prose(rng, rng.randint(1, 60)), lang, source, 1, "x", 1))
    docs = spark.createDataFrame([*rows, rows[4], (None, "a b c", "en", "src1", 1, "x", 1)], DOCS)
    weights = {"domain": {"low": 3.0, "high": 1.0, "other": 1.0}, "lang": {"en": 1.0, "de": 5.0}}
    for fraction, epochs in ((0.5, 1), (0.9, 2), (1.7, 2)):
        got = mix(docs, weights, fraction, epochs, 3)
        assert "_row" in got.columns
        taken = [(r._row.doc_id, r._row.text, r.domain, r._row.lang, r._row.source, r.n_tokens, r.copies) for r in got.collect()]
        domain = lambda s: "other" if s is None or not s[-1].isdigit() else "low" if s[-1] < "5" else "high"
        size = lambda t: len((t or "").split())
        leaves = {}
        every = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
        for d, t, lang, s in every:
            leaves.setdefault((domain(s), lang, s), []).append((d, t))
        tokens = {k: sum(size(t) for _, t in v) for k, v in leaves.items()}
        total = sum(tokens.values()) * fraction
        cap = lambda p: float(sum(n for k, n in tokens.items() if k[: len(p)] == p) * epochs)
        names = lambda p: {k[len(p)] for k in leaves if k[: len(p)] == p}
        budget = {}
        for d, b in pour(total, {d: (weights["domain"].get(d, 1.0), cap((d,))) for d in names(())}).items():
            for lang, c in pour(b, {x: (weights["lang"].get(x, 1.0), cap((d, x))) for x in names((d,))}).items():
                for s, e in pour(c, {x: (1.0, cap((d, lang, x))) for x in names((d, lang))}).items():
                    budget[d, lang, s] = int(e + 1e-6)
        want = {}
        for k, docs_ in leaves.items():
            n = tokens[k]
            full, rest = (budget[k] // n, budget[k] % n) if n else (0, 0)
            at = 0
            key = lambda x: hashlib.md5(f"3:{full + 1}:{'~' if x[0] is None else x[0]}".encode()).hexdigest()  # noqa: B023, E731
            for d, t in sorted(set(docs_), key=key):
                at += size(t) * docs_.count((d, t))
                if c := full + (at <= rest if n else 0):
                    want[d, t, *k] = c
        assert {x[:5]: x[6] for x in [(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in taken]} == {(d, t, a, b, c): n for (d, t, a, b, c), n in want.items()}
        assert sum(x[5] * x[6] for x in taken) <= total + 1e-6
    assert mix(docs.limit(0), weights).count() == 0


def poured(leaves, weights, total, epochs):
    """The budget of each leaf, by filling up level after level what can be taken below."""
    weight = lambda i, name: weights.get(("domain", "lang", "source")[i], {}).get(name, 1.0)
    usable = {k: n * epochs for k, n in leaves.items() if all(weight(i, x) > 0 for i, x in enumerate(k))}
    out, todo = {}, [((), total)]
    while todo:
        path, budget = todo.pop()
        if len(path) == 3:
            out[path] = budget
            continue
        names = {k[len(path)] for k in leaves if k[: len(path)] == path}
        kids = {x: (weight(len(path), x), sum(n for k, n in usable.items() if k[: len(path) + 1] == (*path, x))) for x in names}
        todo += [((*path, x), b) for x, b in pour(budget, kids).items()]
    return out


def budgets(spark, leaves, weights, total, epochs=1):
    rows = spark.createDataFrame([(*k, n, 1) for k, n in leaves.items()], "domain string, lang string, source string, tokens long, docs long")
    return {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(rows, weights, total, epochs).collect()}


def test_equal_siblings_share_alike(spark):
    """On each level of the tree, whether the budget fills them or not."""
    for level in range(3):
        leaf = lambda x: tuple(x if i == level else "same" for i in range(3))  # noqa: B023, E731
        leaves = {leaf("a"): 200, leaf("b"): 200}
        assert budgets(spark, leaves, {}, 160.0) == {leaf("a"): 80, leaf("b"): 80}
        assert budgets(spark, leaves, {}, 400.0) == leaves
        leaves |= {leaf("c"): 20, leaf("d"): 20}
        assert budgets(spark, leaves, {}, 240.0) == {leaf("a"): 100, leaf("b"): 100, leaf("c"): 20, leaf("d"): 20}
    assert budgets(spark, {("a", "x", "s"): 400, ("b", "x", "s"): 400}, {}, 560.0) == {("a", "x", "s"): 280, ("b", "x", "s"): 280}


def test_what_weights_of_zero_forbid_is_no_capacity(spark):
    leaves = {("low", "en", "s1"): 100, ("low", "de", "s1"): 500, ("high", "en", "s1"): 500, ("high", "en", "s2"): 300}
    got = budgets(spark, leaves, {"lang": {"de": 0.0}, "source": {"s2": -1.0}}, 560.0)
    assert got == {("low", "en", "s1"): 100, ("low", "de", "s1"): 0, ("high", "en", "s1"): 460, ("high", "en", "s2"): 0}


def test_budgets_of_random_trees(spark):
    rng = random.Random(4)
    for _ in range(12):
        names = [rng.sample("abcd", rng.randint(1, 4)) for _ in range(3)]
        leaves = {(d, k, s): rng.choice([0, 10, 10, 50, 400]) for d in names[0] for k in names[1] for s in names[2] if rng.random() < 0.8}
        weights = {k: {x: rng.choice([0.0, 1.0, 1.0, 2.0, 0.3]) for x in "abc"} for k in ("domain", "lang", "source")}
        epochs, total = rng.choice([1, 2]), float(rng.choice([0, 7, 100, 900, 5000]))
        if leaves:
            got, want = budgets(spark, leaves, weights, total, epochs), poured(leaves, weights, total, epochs)
            assert got.keys() == leaves.keys()
            assert all(abs(got.get(k, 0) - want.get(k, 0)) <= 1 for k in leaves), (leaves, weights, total, epochs)
            usable = sum(n for k, n in leaves.items() if all(weights[w].get(x, 1.0) > 0 for w, x in zip(weights, k, strict=True))) * epochs
            assert min(total, usable) - len(leaves) <= sum(got.values()) <= min(total, usable) + 1e-6


def test_stages_keep_columns_and_hand_on(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count(), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "byte_bpe"]
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", None, None, 0), (7, "", None, None, 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SMALL).collect(), stage(spark, docs.limit(0), SMALL).collect(), name


def plain_mix(rows, weights, fraction, epochs, seed):
    """doc_ids that a mix takes, from rows of (doc_id, text, lang, source) with distinct ids."""
    domain = lambda s: "other" if s is None or not s[-1].isdigit() else "low" if s[-1] < "5" else "high"
    size = {d: len((t or "").encode().split()) for d, t, *_ in rows}
    leaves = {}
    for d, _, lang, source in rows:
        leaves.setdefault((domain(source), lang, source), []).append(d)
    tokens = {k: sum(size[d] for d in v) for k, v in leaves.items()}
    out = set()
    for k, budget in poured(tokens, weights, sum(tokens.values()) * fraction, epochs).items():
        full, rest = divmod(int(budget + 1e-6), tokens[k]) if tokens[k] else (0, 0)
        at = 0
        for d in sorted(leaves[k], key=lambda d: hashlib.md5(f"{seed}:{full + 1}:{d}".encode()).hexdigest()):  # noqa: B023
            at += size[d]
            if full or (int(budget + 1e-6) > 0 or not tokens[k]) and at <= rest:
                out.add(d)
    return out


def test_pipeline_equals_plain_code(spark):
    """Every stage of the run against a plain computation on what the stage before it kept."""
    import tiktoken

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r.doc_id for r in score_documents(docs, labels).collect() if r.predicted == 1}
    first = corpus_pipeline.quality(spark, docs, SMALL)
    assert {r.doc_id for r in first.collect()} == good
    before = {r.doc_id: (r.text or "") for r in first.collect()}
    second = {r.doc_id: r for r in corpus_pipeline.lines(spark, first, SMALL).collect()}
    seen = set()
    for d in sorted(before):
        lines = [x.strip() for x in before[d].split("\n")]
        gone = set()
        for b in range(1, len(lines) + 1):
            held = 0
            for a in range(b - 1, -1, -1):  # the least run that ends here and holds eight words; longer ones hold it
                held += len(lines[a].encode().split())
                if held >= 8:
                    gone |= set(range(a, b)) if (run := tuple(lines[a:b])) in seen else set()
                    seen.add(run)
                    break
        kept = second[d].text.split("\n") if d in second and second[d].text is not None else []
        left = [x for i, x in enumerate(lines) if i not in gone and x]
        stays = [x.strip() for x in kept if x.strip()]
        rest = iter(left)
        assert all(x in rest for x in stays)  # nothing that should be gone stays, nothing is moved
        assert second[d].n_chars == len(second[d].text) if d in second and second[d].text is not None else True
    comp, _ = brute_components([(d, r.text) for d, r in second.items()], 5, 80)
    third = [(d, r.text, r.lang, r.source) for d, r in second.items() if comp[d] == d]
    chosen = plain_mix(third, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_FRACTION, corpus_pipeline.MIX_EPOCHS, corpus_pipeline.MIX_SEED)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    want = {}
    for d, text, *_ in third:
        if d in chosen:
            ids = library.encode_ordinary(text or "")
            want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()} == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    out = QUERIES[name](spark, SMALL)
    rows = out.count()
    whole = {"pipeline": None, "op2_mixing": None, "op9_topk": 50, "op13_hard_negatives": None}.get(
        name, spark.read.parquet(f"{SMALL}/{'embeddings' if name in ('op8_vector_dedup', 'op12_vector_codes') else 'documents'}.parquet").count()
    )
    assert rows == whole if whole is not None else 0 < rows
    if name in ORACLE_SQL:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for t in Path(SMALL).glob("*.parquet"):
            con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
        found = con.execute(ORACLE_SQL[name])
        cols = [c[0] for c in found.description]
        want = sorted(repr(tuple(r[cols.index(c)] for c in out.columns)) for r in found.fetchall())
        assert sorted(repr(tuple(r)) for r in out.collect()) == want
