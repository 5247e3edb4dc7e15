"""Retrieval queries. Queries are the vectors whose id is divisible by ten; the others are the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.operators import etl
from plexure.operators import masks as M
from plexure.operators import propagate as P
from plexure.operators import retrieval as R
from plexure.operators.similarity import similar_lists, similar_pairs, top_similar
from plexure.plans import shared
from plexure.plans.learning import HIDDEN, LAST, SCORE
from plexure.plans.masks import REF, reference_nodes
from plexure.registry import query, table

S = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 10 = 0), r AS (SELECT * FROM v WHERE vec_id % 10 <> 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, q.label AS ql, r.label AS rl, list_cosine_similarity(q.v, r.v) AS score FROM q, r), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = shared.vectors(spark, sf)
    return v.filter("vec_id % 10 = 0"), v.filter("vec_id % 10 <> 0")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("query_edges_argmax_fallback", f"WITH {S} SELECT query_id, vec_id, round(score, 6) AS score FROM k WHERE score > 0.35 OR rank = 1")
def query_edges_argmax_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.query_edges(*_sides(spark, sf), 0.35))


@query("query_edges_capped", f"WITH {S} SELECT query_id, vec_id, round(score, 6) AS score FROM k WHERE (score > 0.2 AND rank <= 10) OR rank = 1")
def query_edges_capped(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(R.query_edges(*_sides(spark, sf), 0.2, 10))


@query("topk_retrieve", f"WITH {S} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM k WHERE rank <= 5")
def topk_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(top_similar(*_sides(spark, sf), 5))


def _truth(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, r = _sides(spark, sf)
    ranked = top_similar(q, r, 10)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("l"))
    queries = q.select(F.col("vec_id").alias("query_id"))
    # A candidate is true if it has the query's label: an equi-join of the ranked rows, not of all pairs.
    a = labels.select(F.col("id").alias("_a"), F.col("l").alias("la"))
    b = labels.select(F.col("id").alias("_b"), F.col("l").alias("lb"))
    truth = ranked.join(a, F.col("query_id") == F.col("_a")).join(b, F.col("vec_id") == F.col("_b")).filter("la = lb").select("query_id", "vec_id")
    return ranked, truth, queries


@query("recall_at_k", f"WITH {S}, f AS (SELECT query_id, min(CASE WHEN ql = rl THEN rank END) AS first FROM k GROUP BY query_id) SELECT x.k::BIGINT AS k, round(avg(CASE WHEN first <= x.k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM f, (VALUES (1), (5), (10)) x(k) GROUP BY x.k")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return R.recall_at(*_truth(spark, sf), [1, 5, 10]).withColumn("recall", F.round("recall", 6))


@query("baseline_recall", f"""WITH {REF}, w AS (SELECT label, arg_min(v, vec_id) AS v FROM v GROUP BY label), ra AS (SELECT src, dst FROM e WHERE src IN (SELECT vec_id FROM ref) AND dst IN (SELECT vec_id FROM ref)), sy AS (SELECT src, dst FROM ra UNION SELECT dst, src FROM ra),
x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM v), m AS (SELECT sy.dst AS vec_id, x.d, avg(x.x) AS x FROM sy JOIN x ON x.vec_id = sy.src GROUP BY 1, 2),
h AS (SELECT x.vec_id, list(x.x + coalesce(m.x, 0.0) ORDER BY x.d) AS v FROM x LEFT JOIN m ON x.vec_id = m.vec_id AND x.d = m.d GROUP BY x.vec_id),
rk2 AS (SELECT h.vec_id, w.label, row_number() OVER (PARTITION BY h.vec_id ORDER BY list_cosine_similarity(h.v, w.v) DESC, w.label) AS rank FROM h, w),
f AS (SELECT v.vec_id, min(rk2.rank) AS first FROM v LEFT JOIN ref ON ref.vec_id = v.vec_id LEFT JOIN rk2 ON rk2.vec_id = ref.vec_id AND rk2.label = ref.label GROUP BY v.vec_id)
SELECT x.k::BIGINT AS k, round(avg(CASE WHEN first <= x.k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM f, (VALUES (1), (5)) x(k) GROUP BY x.k""")
def baseline_recall(spark: SparkSession, sf: str) -> DataFrame:
    """One round of messages over the reference part; each vector looks for its word. Vectors outside the reference count as misses."""
    v, ref = shared.vectors(spark, sf), reference_nodes(spark, sf)
    known = M.within(v.withColumnRenamed("vec_id", "src"), ref, "vec_id", ("src",))
    near = P.long_form(P.similar_mean(known, shared.THRESHOLD, "src"), "node", "vec")
    state = P.vector_form(P.layer(P.long_form(v, "vec_id", "embedding"), [near]))
    words = v.groupBy(F.col("label").cast("long").alias("node")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    ranked = top_similar(state, words, 5, "node", "vec", without_self=False)
    truth = ref.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("vec_id"))
    return R.recall_at(ranked, truth, v.select(F.col("vec_id").alias("query_id")), [1, 5]).withColumn("recall", F.round("recall", 6))


@query("insert_query", f"""WITH {S}, ed AS (SELECT query_id, vec_id FROM k WHERE (score > 0.2 AND rank <= 10) OR rank = 1), x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM v), m AS (SELECT ed.query_id, x.d, avg(x.x) AS x FROM ed JOIN x USING (vec_id) GROUP BY 1, 2)
SELECT x.vec_id AS node, x.d::BIGINT AS dim, round(x.x + m.x, 6) AS x FROM m JOIN x ON x.vec_id = m.query_id AND x.d = m.d""")
def insert_query(spark: SparkSession, sf: str) -> DataFrame:
    """All queries put into the reference graph in one plan."""
    q, r = _sides(spark, sf)
    edges = R.query_edges(q, r, 0.2, 10)
    out = R.inserted(P.long_form(r, "vec_id", "embedding"), P.long_form(q, "vec_id", "embedding"), edges)
    return out.select("node", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("insert_query_words", f"""WITH {S}, ed AS (SELECT query_id, vec_id FROM k WHERE (score > 0.2 AND rank <= 10) OR rank = 1), wd AS (SELECT query_id, vec_id FROM k WHERE rank <= 2), x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM v),
m AS (SELECT ed.query_id, x.d, avg(x.x) AS x FROM ed JOIN x USING (vec_id) GROUP BY 1, 2), n AS (SELECT wd.query_id, x.d, avg(x.x) AS x FROM wd JOIN x USING (vec_id) GROUP BY 1, 2)
SELECT x.vec_id AS node, x.d::BIGINT AS dim, round(x.x + (m.x + n.x) / 2, 6) AS x FROM m JOIN n USING (query_id, d) JOIN x ON x.vec_id = m.query_id AND x.d = m.d""")
def insert_query_words(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a second relation, whose messages are averaged with the first's."""
    q, r = _sides(spark, sf)
    words = top_similar(q, r, 2).select("query_id", "vec_id")
    out = R.inserted(P.long_form(r, "vec_id", "embedding"), P.long_form(q, "vec_id", "embedding"), R.query_edges(q, r, 0.2, 10), words)
    return out.select("node", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("retrieval_pivot", f"WITH {S} SELECT query_id, string_agg(vec_id::VARCHAR, '|' ORDER BY rank) AS top, arg_min(vec_id, rank) AS first FROM k WHERE rank <= 3 GROUP BY query_id")
def retrieval_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return R.wide(top_similar(*_sides(spark, sf), 3), "query_id", "vec_id", 3)


@query("reconnect_topk", f"WITH {S}, g AS (SELECT query_id, count(*) AS n, arg_min(vec_id, rank) AS best FROM k WHERE rank <= 5 AND score > 0.3 GROUP BY query_id) SELECT q.vec_id AS query_id, coalesce(n, 0) AS n, coalesce(best, q.vec_id) AS best FROM q LEFT JOIN g ON g.query_id = q.vec_id")
def reconnect_topk(spark: SparkSession, sf: str) -> DataFrame:
    q, r = _sides(spark, sf)
    out = R.reconnected(top_similar(q, r, 5), q.select(F.col("vec_id").alias("query_id")), 5, 0.3)
    return out.select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("best", "query_id").alias("best"))


@query("ground_truth", f"WITH {shared.EDGES}, c AS (SELECT src FROM e UNION ALL SELECT dst FROM e) SELECT src AS node, count(*) AS n FROM c GROUP BY src")
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of the map from a node to its partners, as counts; the lists stay edge rows."""
    e = similar_pairs(shared.vectors(spark, sf), shared.THRESHOLD)
    return e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))


@query("ground_truth_pages", f"""WITH {shared.EDGES}, c AS (SELECT src AS node, dst AS partner FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5('7:' || node || ':' || partner)) AS rn FROM c)
SELECT node, page, array_to_string(list(partner ORDER BY partner), ',') AS partners FROM (SELECT *, (rn - 1) // 4 AS page FROM r) GROUP BY node, page""")
def ground_truth_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of the map from a node to its partners, in pages of four."""
    lists = similar_lists(shared.vectors(spark, sf), shared.THRESHOLD)
    return etl.pages_of_lists(lists, 4).select(F.col("key").alias("node"), "page", F.array_join(F.col("values").cast("array<string>"), ",").alias("partners"))


@query("test_set_recall", f"""WITH {S}, ed AS (SELECT query_id, vec_id FROM k WHERE (score > 0.2 AND rank <= 10) OR rank = 1), wd AS (SELECT query_id, vec_id FROM k WHERE rank <= 2), x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM v),
m AS (SELECT ed.query_id, x.d, avg(x.x) AS x FROM ed JOIN x USING (vec_id) GROUP BY 1, 2), n AS (SELECT wd.query_id, x.d, avg(x.x) AS x FROM wd JOIN x USING (vec_id) GROUP BY 1, 2),
h AS (SELECT 1 AS option, x.vec_id, list(x.x + m.x ORDER BY x.d) AS v FROM m JOIN x ON x.vec_id = m.query_id AND x.d = m.d GROUP BY x.vec_id
UNION ALL SELECT 2, x.vec_id, list(x.x + (m.x + n.x) / 2 ORDER BY x.d) FROM m JOIN n USING (query_id, d) JOIN x ON x.vec_id = m.query_id AND x.d = m.d GROUP BY x.vec_id),
w AS (SELECT label, arg_min(v, vec_id) AS v FROM r GROUP BY label), rk AS (SELECT option, h.vec_id, w.label, row_number() OVER (PARTITION BY option, h.vec_id ORDER BY list_cosine_similarity(h.v, w.v) DESC, w.label) AS rank FROM h, w),
f AS (SELECT option, q.vec_id, min(CASE WHEN rk.label = q.label THEN rank END) AS first FROM q JOIN rk USING (vec_id) GROUP BY 1, 2)
SELECT option::BIGINT AS option, z.k::BIGINT AS k, round(avg(CASE WHEN first <= z.k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM f, (VALUES (1), (3)) z(k) GROUP BY 1, 2""")
def test_set_recall(spark: SparkSession, sf: str) -> DataFrame:
    """New vectors inserted with one relation and with two; each looks for its label's word."""
    q, r = _sides(spark, sf)
    state, new, edges = P.long_form(r, "vec_id", "embedding"), P.long_form(q, "vec_id", "embedding"), R.query_edges(q, r, 0.2, 10)
    words = r.groupBy(F.col("label").cast("long").alias("node")).agg(F.min_by("embedding", "vec_id").alias("vec"))
    truth = q.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("vec_id"))
    out = None
    for option, more in ((1, None), (2, top_similar(q, r, 2).select("query_id", "vec_id"))):
        found = P.vector_form(R.inserted(state, new, edges, more))
        ranked = top_similar(found, words, 3, "node", "vec", without_self=False)
        one = R.recall_at(ranked, truth, truth, [1, 3]).select(F.lit(option).cast("long").alias("option"), "k", F.round("recall", 6).alias("recall"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("retrieval_grid", f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 10 = 0), r AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || vec_id)) AS rn, count(*) OVER () AS n FROM v WHERE vec_id % 10 <> 0),
s AS (SELECT f, q.vec_id AS query_id, r.vec_id, q.label = r.label AS hit, list_cosine_similarity(q.v, r.v) AS score FROM q, r, (VALUES (0.4::DOUBLE), (0.8::DOUBLE)) z(f) WHERE rn <= floor(n * f)),
k AS (SELECT *, row_number() OVER (PARTITION BY f, query_id ORDER BY score DESC, vec_id) AS rank FROM s), t AS (SELECT f, query_id, min(CASE WHEN hit THEN rank END) AS first FROM k GROUP BY 1, 2)
SELECT f AS fraction, y.k::BIGINT AS k, round(avg(CASE WHEN first <= y.k THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM t, (VALUES (1), (5)) y(k) GROUP BY 1, 2""")
def retrieval_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Recall over a grid of reference fractions, a row for each point: a long results table."""
    q, r = _sides(spark, sf)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")
    a, b = labels.select(F.col("id").alias("_a"), F.col("label").alias("la")), labels.select(F.col("id").alias("_b"), F.col("label").alias("lb"))
    out = None
    for fraction in (0.4, 0.8):
        ref = M.exact_sample(r, ["vec_id"], fraction, 11).filter("chosen")
        ranked = top_similar(q, ref, 5)
        truth = ranked.join(a, F.col("query_id") == F.col("_a")).join(b, F.col("vec_id") == F.col("_b")).filter("la = lb").select("query_id", "vec_id")
        one = R.recall_at(ranked, truth, q.select(F.col("vec_id").alias("query_id")), [1, 5]).select(F.lit(fraction).alias("fraction"), "k", F.round("recall", 6).alias("recall"), "n")
        out = one if out is None else out.unionByName(one)
    return out


W = "w AS (SELECT label::BIGINT AS word, arg_min(v, vec_id) AS v FROM v GROUP BY label)"


def _words(spark: SparkSession, sf: str) -> DataFrame:
    v = shared.vectors(spark, sf)
    return v.groupBy(F.col("label").cast("long").alias("node")).agg(F.min_by("embedding", "vec_id").alias("vec"))


@query("text_audio_edges", f"WITH {S}, {W}, p AS (SELECT word AS query_id, vec_id, list_cosine_similarity(w.v, v.v) AS score FROM w, v), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, round(score, 6) AS score FROM t WHERE (score > 0.2 AND rank <= 10) OR rank = 1")
def text_audio_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from the words to vectors of the other kind: those alike, ten at most, or the best."""
    words = _words(spark, sf).select(F.col("node").alias("vec_id"), F.col("vec").alias("embedding"))
    return _rounded(R.query_edges(words, shared.vectors(spark, sf), 0.2, 10))


@query("propose_links", f"WITH {S}, {W}, p AS (SELECT a.vec_id AS query_id, b.word AS vec_id, 1 / (1 + exp(-({SCORE}))) AS score FROM q a, w b), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, vec_id, rank, round(score, 6) AS score FROM t WHERE rank <= 3")
def propose_links(spark: SparkSession, sf: str) -> DataFrame:
    """The words that the link predictor holds likeliest for each query."""
    queries = _sides(spark, sf)[0].select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    return _rounded(R.proposed(queries, _words(spark, sf), HIDDEN, LAST, 3))


@query("reconnect_predictor", f"""WITH {S}, {W}, ed AS (SELECT query_id, vec_id FROM k WHERE (score > 0.2 AND rank <= 10) OR rank = 1), x AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM v), wx AS (SELECT word, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS d FROM w),
m AS (SELECT ed.query_id, x.d, avg(x.x) AS x FROM ed JOIN x USING (vec_id) GROUP BY 1, 2), h AS (SELECT x.vec_id, list(x.x + m.x ORDER BY x.d) AS v FROM m JOIN x ON x.vec_id = m.query_id AND x.d = m.d GROUP BY x.vec_id),
p AS (SELECT a.vec_id, b.word, 1 / (1 + exp(-({SCORE}))) AS score FROM h a, w b), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, word) AS rank FROM p), g AS (SELECT vec_id, word FROM t WHERE rank <= 3 AND score > 0.6),
n AS (SELECT g.vec_id, wx.d, avg(wx.x) AS x FROM g JOIN wx USING (word) GROUP BY 1, 2)
SELECT x.vec_id AS node, x.d::BIGINT AS dim, round(x.x + CASE WHEN n.x IS NULL THEN m.x ELSE (m.x + n.x) / 2 END, 6) AS x FROM m JOIN x ON x.vec_id = m.query_id AND x.d = m.d LEFT JOIN n ON n.vec_id = x.vec_id AND n.d = x.d""")
def reconnect_predictor(spark: SparkSession, sf: str) -> DataFrame:
    """Two passes: the link predictor proposes words for what the first one gives, and confident links are the second's other relation."""
    q, r = _sides(spark, sf)
    state, new = P.long_form(r, "vec_id", "embedding"), P.long_form(q, "vec_id", "embedding")
    out = R.reconnected_state(state, new, R.query_edges(q, r, 0.2, 10), _words(spark, sf), HIDDEN, LAST, 3, 0.6)
    return out.select("node", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))
