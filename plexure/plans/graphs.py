"""Graph queries: edges, statistics, components, forests, backbones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.functions.hashing import hash_key, hash_share
from plexure.operators import graph as G
from plexure.operators.similarity import similar_pairs, top_similar
from plexure.operators.store import Scratch, quantiles
from plexure.plans import shared
from plexure.registry import query, table

E, B = shared.EDGES, shared.BASKET


@query("same_label_edges", "SELECT a.vec_id AS src, b.vec_id AS dst, 1.0::DOUBLE AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id")
def same_label_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.within_groups(table(spark, sf, "embeddings"), "vec_id", "label").withColumn("weight", F.lit(1.0))


@query("audio_edges_combined", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS w FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT src, dst, round(CASE WHEN same THEN 1.0 ELSE w END, 6) AS weight FROM p WHERE same OR w > 0.3""")
def audio_edges_combined(spark: SparkSession, sf: str) -> DataFrame:
    w = F.col("weight")  # nearly all are pairs of a label, whose weight needs no rounding, which is slow for doubles
    return similar_pairs(shared.vectors(spark, sf), shared.THRESHOLD, tag="label").withColumn("weight", F.when(w == 1.0, w).otherwise(F.round(w, 6)))


@query("exact_edges", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE a.label = b.label OR list_cosine_similarity(a.v, b.v) >= 0.99""")
def exact_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that stand for the same word: those of a weight of 0.99 or more."""
    return G.exact(similar_pairs(shared.vectors(spark, sf), shared.THRESHOLD, tag="label")).select("src", "dst")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    """One word vector a label: that of its first row."""
    return shared.vectors(spark, sf).groupBy(F.col("label").cast("long").alias("word")).agg(F.min_by("embedding", "vec_id").alias("v"))


@query("cross_edges", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), w AS (SELECT label AS word, arg_min(v, vec_id) AS v FROM v GROUP BY label),
p AS (SELECT a.word AS own, b.word, list_cosine_similarity(a.v, b.v) AS s FROM w a JOIN w b ON a.word <> b.word WHERE list_cosine_similarity(a.v, b.v) > 0.05)
SELECT vec_id AS src, label::BIGINT AS dst, 1.0::DOUBLE AS weight FROM v UNION ALL SELECT v.vec_id, p.word::BIGINT, round(p.s, 6) FROM v JOIN p ON v.label = p.own""")
def cross_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each node to its own word, and to all words like it: the word pairs are found once and joined by key."""
    pairs = G.symmetrized(similar_pairs(_words(spark, sf), 0.05, "word", "v")).withColumnsRenamed({"src": "own", "dst": "word"})
    v = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    exact = v.select(F.col("vec_id").alias("src"), F.col("label").alias("dst"), F.lit(1.0).alias("weight"))
    return exact.unionByName(v.join(pairs, F.col("label") == F.col("own")).select(F.col("vec_id").alias("src"), F.col("word").alias("dst"), F.round("weight", 6).alias("weight")))


@query("hetero_counts", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), w AS (SELECT label AS word, arg_min(v, vec_id) AS v FROM v GROUP BY label),
p AS (SELECT a.word AS own FROM w a JOIN w b ON a.word <> b.word WHERE list_cosine_similarity(a.v, b.v) > 0.05)
SELECT (SELECT count(*) FROM v) AS audio, (SELECT count(*) FROM w) AS words, (SELECT count(*) FROM p) AS ww, (SELECT count(*) FROM v) + (SELECT count(*) FROM v JOIN p ON label = own) AS aw""")
def hetero_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the parts of the graph of two node kinds."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    words = _words(spark, sf)
    out = one(table(spark, sf, "embeddings"), "audio")
    for df, name in ((words, "words"), (G.symmetrized(similar_pairs(words, 0.05, "word", "v")), "ww"), (cross_edges(spark, sf), "aw")):
        out = out.join(one(df, name), "_k")
    return out.drop("_k")


@query("symmetrize", f"WITH {E} SELECT src, dst, round(weight, 6) AS weight FROM e UNION SELECT dst, src, round(weight, 6) FROM e")
def symmetrize(spark: SparkSession, sf: str) -> DataFrame:
    return G.symmetrized(shared.edges(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("graph_density", f"WITH {E}, n AS (SELECT count(*) AS n FROM v), c AS (SELECT count(*) AS e FROM e) SELECT n, e AS edges, round(e / (n * (n - 1) / 2), 9) AS density, round(2 * e / (n * (n - 1) / 2), 9) AS density_directed FROM n, c")
def graph_density(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    e = shared.edges(spark, sf).agg(F.count("*").alias("edges")).withColumn("_k", F.lit(1))
    return n.join(e, "_k").select("n", "edges", F.round(G.density(F.col("edges"), F.col("n")), 9).alias("density"), F.round(G.density(F.col("edges") * 2, F.col("n")), 9).alias("density_directed"))


def _degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(table(spark, sf, "embeddings"), G.symmetrized(shared.edges(spark, sf)), "vec_id")


DEG = f"{E}, d AS (SELECT vec_id AS node, (SELECT count(*) FROM e WHERE e.src = vec_id OR e.dst = vec_id) * 2 AS degree FROM v)"


@query("degree_stats", f"WITH {DEG} SELECT round(avg(degree), 6) AS mean, round(stddev_samp(degree), 6) AS std, min(degree) AS least, max(degree) AS most, quantile_disc(degree, 0.5)::DOUBLE AS median FROM d")
def degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Edges are stored both ways and both ends count, as the published report has it."""
    return _degrees(spark, sf).agg(F.round(F.avg("degree"), 6).alias("mean"), F.round(F.stddev_samp("degree"), 6).alias("std"), F.min("degree").alias("least"), F.max("degree").alias("most"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)").alias("median"))


@query("degree_histogram", f"WITH {DEG} SELECT degree, count(*) AS n FROM d GROUP BY degree")
def degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _degrees(spark, sf).groupBy("degree").agg(F.count("*").alias("n"))


@query("weight_stats", f"""WITH {E} SELECT count(*) AS n, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS std, round(min(weight), 6) AS least, round(max(weight), 6) AS most,
{", ".join(f"round(quantile_cont(weight, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95))}, count(*) FILTER (weight >= 0.99) AS exact FROM e""")
def weight_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = Scratch(spark, "weights").keep(shared.edges(spark, sf).select("weight"), "edges")
    w, shares = F.col("weight"), (25, 50, 75, 90, 95)
    found = quantiles(e, "weight", [p / 100 for p in shares], narrow=True)
    whole = e.agg(
        F.count("*").alias("n"), F.round(F.avg(w), 6).alias("mean"), F.round(F.stddev_pop(w), 6).alias("std"), F.round(F.min(w), 6).alias("least"), F.round(F.max(w), 6).alias("most"),
        F.count_if(w >= 0.99).alias("exact"),
    )
    return whole.select("*", *[F.round(F.lit(v).cast("double"), 6).alias(f"p{p}") for p, v in zip(shares, found, strict=True)])


@query("weight_histogram", f"""WITH {E}, r AS (SELECT min(weight) AS a, max(weight) AS b FROM e) SELECT least(19, floor((weight - a) / ((b - a) / 20)))::BIGINT AS bin, count(*) AS n FROM e, r GROUP BY 1""")
def weight_histogram(spark: SparkSession, sf: str) -> DataFrame:
    e = shared.edges(spark, sf)
    a, b = e.agg(F.min("weight"), F.max("weight")).first()
    if a is None:
        return e.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    return e.groupBy(F.least(F.lit(19), F.floor((F.col("weight") - a) / ((b - a) / 20))).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_PER = "round(avg({0}), 6) AS {1}_mean, round(stddev_pop({0}), 6) AS {1}_std, min({0}) AS {1}_least, max({0}) AS {1}_most, count(*) FILTER ({0} > 1) AS {1}_multi"


@query("mapping_stats", f"WITH {B}, s AS (SELECT count(*) AS n FROM b GROUP BY src), d AS (SELECT count(*) AS n FROM b GROUP BY dst), x AS (SELECT {_PER.format('n', 'parts')} FROM s), y AS (SELECT {_PER.format('n', 'orders')} FROM d) SELECT * FROM x, y")
def mapping_stats(spark: SparkSession, sf: str) -> DataFrame:
    b = shared.basket(spark, sf)

    def per(side: str, name: str) -> DataFrame:
        n = F.col("n")
        return b.groupBy(side).agg(F.count("*").alias("n")).agg(F.round(F.avg(n), 6).alias(f"{name}_mean"), F.round(F.stddev_pop(n), 6).alias(f"{name}_std"), F.min(n).alias(f"{name}_least"), F.max(n).alias(f"{name}_most"), F.count_if(n > 1).alias(f"{name}_multi")).withColumn("_k", F.lit(1))

    return per("src", "parts").join(per("dst", "orders"), "_k").drop("_k")


@query("orphans", f"WITH {E} SELECT vec_id FROM v WHERE vec_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    ends = shared.edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("vec_id")).distinct()
    return table(spark, sf, "embeddings").select("vec_id").join(ends, "vec_id", "left_anti")


CC = f"{E}, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a), cc AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)"


@query("components", f"WITH RECURSIVE {CC} SELECT node, component FROM cc")
def components(spark: SparkSession, sf: str) -> DataFrame:
    return G.components(table(spark, sf, "embeddings"), shared.edges(spark, sf), "vec_id")


@query("connectivity", f"WITH RECURSIVE {CC}, z AS (SELECT component, count(*) AS n FROM cc GROUP BY component) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n)::DOUBLE, 6) AS fraction, count(*) FILTER (n = 1) AS isolated FROM z")
def connectivity(spark: SparkSession, sf: str) -> DataFrame:
    z = components(spark, sf).groupBy("component").agg(F.count("*").alias("n"))
    return z.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("fraction"), F.count_if(F.col("n") == 1).alias("isolated"))


@query("spanning_forest", f"""WITH RECURSIVE {E}, p AS (SELECT [(SELECT min(src) FROM e)] AS seen, NULL::BIGINT AS src, NULL::BIGINT AS dst, NULL::DOUBLE AS weight
UNION ALL SELECT list_append(p.seen, x.new), x.src, x.dst, x.weight FROM p, LATERAL (SELECT * FROM (
  SELECT 0 AS o, e.src, e.dst, e.weight, CASE WHEN list_contains(p.seen, e.src) THEN e.dst ELSE e.src END AS new FROM e WHERE list_contains(p.seen, e.src) <> list_contains(p.seen, e.dst)
  UNION ALL SELECT 1, NULL, NULL, NULL, e.src FROM e WHERE NOT list_contains(p.seen, e.src)) c ORDER BY o, weight DESC, src, dst, new LIMIT 1) x)
SELECT src, dst, round(weight, 6) AS weight FROM p WHERE src IS NOT NULL""")
def spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    return G.spanning_forest(shared.edges(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("bridges", f"""WITH RECURSIVE {CC}, o AS (SELECT node, dense_rank() OVER (ORDER BY component) AS pos FROM cc),
p AS (SELECT least(a.pos, b.pos) AS low, least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, list_cosine_similarity(x.v, y.v) AS w FROM o a JOIN o b ON b.pos = a.pos + 1 JOIN v x ON x.vec_id = a.node JOIN v y ON y.vec_id = b.node)
SELECT src, dst, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY low ORDER BY w DESC, src, dst) AS rn FROM p) WHERE rn = 1""")
def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return G.bridges(shared.vectors(spark, sf), components(spark, sf), "vec_id", "embedding").withColumn("weight", F.round("weight", 6))


_STRENGTH = f"{B}, n AS (SELECT n, sum(weight) AS s, count(*) AS k FROM (SELECT 'o' || src AS n, weight FROM b UNION ALL SELECT 'p' || dst, weight FROM b) GROUP BY n), x AS (SELECT b.*, o.s AS so, o.k AS ko, p.s AS sp, p.k AS kp FROM b JOIN n o ON o.n = 'o' || src JOIN n p ON p.n = 'p' || dst)"


def _two_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Order-part edges with distinct names for both kinds of node: parts are numbered below zero."""
    return shared.basket(spark, sf).withColumn("dst", -F.col("dst") - 1)


@query("disparity_filter", f"WITH {_STRENGTH} SELECT src, dst, weight FROM x WHERE power(1 - weight / so, ko - 1) < 0.05 OR power(1 - weight / sp, kp - 1) < 0.05")
def disparity_filter(spark: SparkSession, sf: str) -> DataFrame:
    return G.disparity(_two_kinds(spark, sf)).withColumn("dst", -F.col("dst") - 1)


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers linked by the number of orders that both have lines of; an order has few lines."""
    return G.shared_members(table(spark, sf, "lineitem"), "l_orderkey", "l_suppkey")


@query("noise_corrected", """WITH d AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS s FROM lineitem), b AS (SELECT x.s AS src, y.s AS dst, count(*)::DOUBLE AS weight FROM d x JOIN d y ON x.k = y.k AND x.s < y.s GROUP BY 1, 2),
n AS (SELECT n, sum(weight) AS s FROM (SELECT src AS n, weight FROM b UNION ALL SELECT dst, weight FROM b) GROUP BY n), t AS (SELECT 2 * sum(weight) AS n FROM b),
m AS (SELECT b.src, b.dst, b.weight AS w, o.s AS a, p.s AS c, t.n FROM b JOIN n o ON o.n = b.src JOIN n p ON p.n = b.dst, t),
q AS (SELECT *, a * c / (n * n) AS prior, a * c * (n - a) * (n - c) / (n * n * n * n * (n - 1)) AS spread, n / (a * c) AS lift FROM m),
r AS (SELECT *, prior * prior / spread * (1 - prior) - prior AS al, prior / spread * (1 - prior) * (1 - prior) - (1 - prior) AS be FROM q), u AS (SELECT *, (al + w) / (al + be + n) AS ex FROM r)
SELECT src, dst, w AS weight FROM u WHERE (lift * w - 1) / (lift * w + 1) - 1.64 * sqrt(ex * (1 - ex) * n) * abs(2 * (lift + w * (1 / (a * c) - n * (a + c) / (a * c * a * c))) / ((lift * w + 1) * (lift * w + 1))) > 0""")
def noise_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """A dense graph of one kind of node, near what chance gives: most of its edges go."""
    return G.noise_corrected(_suppliers(spark, sf))


@query("hetero_edges", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), w AS (SELECT label::BIGINT AS word, arg_min(v, vec_id) AS v FROM v GROUP BY label),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS weight FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) > 0.3),
p AS (SELECT a.word AS src, b.word AS dst, round(list_cosine_similarity(a.v, b.v), 6) AS weight FROM w a JOIN w b ON a.word <> b.word WHERE list_cosine_similarity(a.v, b.v) > 0.05),
x AS (SELECT vec_id AS src, label::BIGINT AS dst, 1.0::DOUBLE AS weight FROM v UNION ALL SELECT v.vec_id, p.dst, p.weight FROM v JOIN p ON v.label = p.src)
SELECT 'aa' AS relation, * FROM e UNION ALL SELECT 'ww', * FROM p UNION ALL SELECT 'aw', * FROM x UNION ALL SELECT 'wa', dst, src, weight FROM x""")
def hetero_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of two node kinds as one edge table: relation, src, dst, weight; each relation in both directions."""
    ww = G.symmetrized(similar_pairs(_words(spark, sf), 0.05, "word", "v")).withColumn("weight", F.round("weight", 6))
    aw = cross_edges(spark, sf)
    parts = {"aa": symmetrize(spark, sf), "ww": ww, "aw": aw, "wa": G.reversed_edges(aw)}
    out = None
    for relation, edges in parts.items():
        one = edges.select(F.lit(relation).alias("relation"), "src", "dst", "weight")
        out = one if out is None else out.unionByName(one)
    return out


@query("label_members", "SELECT label::BIGINT AS label, min(vec_id) AS first, count(*) AS n, count(*) * (count(*) - 1) AS edges FROM embeddings GROUP BY label")
def label_members(spark: SparkSession, sf: str) -> DataFrame:
    """The edges within labels in linear space: one row a label, with the number of edges that ``same_label_edges`` gives for it."""
    n = F.count("*")
    return table(spark, sf, "embeddings").groupBy(F.col("label").cast("long").alias("label")).agg(F.min("vec_id").alias("first"), n.alias("n"), (n * (n - 1)).alias("edges"))


@query("threshold_backbone", f"WITH {E} SELECT src, dst, round(weight, 6) AS weight FROM e WHERE weight > 0.5")
def threshold_backbone(spark: SparkSession, sf: str) -> DataFrame:
    return G.over(shared.edges(spark, sf), 0.5).withColumn("weight", F.round("weight", 6))


@query("strongest_tenth", f"WITH {E} SELECT src, dst, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS rn, count(*) OVER () AS n FROM e) WHERE rn <= greatest(1, n // 10)")
def strongest_tenth(spark: SparkSession, sf: str) -> DataFrame:
    return G.strongest(shared.edges(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("nearest_neighbours", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query_id, vec_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) WHERE rank <= 3""")
def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    v = shared.vectors(spark, sf)
    return top_similar(v, v, 3).withColumn("score", F.round("score", 6))


@query("random_graph", "SELECT floor(('0x' || substr(md5('21:src:' || i), 1, 7))::BIGINT / 268435456.0 * 50)::BIGINT AS src, floor(('0x' || substr(md5('21:dst:' || i), 1, 7))::BIGINT / 268435456.0 * 50)::BIGINT AS dst FROM range(200) r(i)")
def random_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.random_edges(spark, 50, 200, 21)


@query("graph_report", f"""WITH {E}, o AS (SELECT count(*) AS n FROM v WHERE vec_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)), c AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM e) AS m)
SELECT 'nodes' AS metric, n::DOUBLE AS value FROM c UNION ALL SELECT 'edges', m FROM c UNION ALL SELECT 'density', round(m / (n * (n - 1) / 2), 6) FROM c UNION ALL SELECT 'mean_degree', round(4.0::DOUBLE * m / n, 6) FROM c
UNION ALL SELECT 'mean_weight', round(avg(weight), 6) FROM e UNION ALL SELECT 'orphans', n FROM o UNION ALL SELECT 'largest_id', max(greatest(src, dst)) + 1 FROM e""")
def graph_report(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics as rows of metric and value."""
    e, k = shared.edges(spark, sf), F.lit(1).alias("_k")
    parts = [
        table(spark, sf, "embeddings").agg(F.count("*").alias("n")).select("*", k), e.agg(F.count("*").alias("m"), F.round(F.avg("weight"), 6).alias("mean_weight")).select("*", k),
        orphans(spark, sf).agg(F.count("*").alias("orphans")).select("*", k), G.node_count(e).select(F.col("n").alias("largest_id"), k),
    ]
    one = parts[0]
    for p in parts[1:]:
        one = one.join(p, "_k")
    n, m = F.col("n"), F.col("m")
    named = {"nodes": n, "edges": m, "density": F.round(G.density(m, n), 6), "mean_degree": F.round(4.0 * m / n, 6), "mean_weight": F.col("mean_weight"), "orphans": F.col("orphans"), "largest_id": F.col("largest_id")}
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("metric"), b.cast("double").alias("value")) for a, b in named.items()])).alias("r")).select("r.*")


@query("backbone_fallback", f"WITH {E}, t AS (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS rn, count(*) OVER () AS n FROM e) WHERE rn <= greatest(1, n // 10)) SELECT 'fallback' AS kind, src, dst FROM t UNION ALL SELECT 'fallback', dst, src FROM t UNION ALL SELECT 'threshold', src, dst FROM e WHERE weight > 0.4 UNION ALL SELECT 'threshold', dst, src FROM e WHERE weight > 0.4")
def backbone_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """The backbone by method: one that keeps edges, and one that keeps none, for which the strongest tenth stands in."""
    e = Scratch(spark, "backbone").keep(shared.edges(spark, sf), "edges")
    kept, none = G.backbone(e, "threshold", threshold=0.4), G.backbone(e, "threshold", threshold=2.0)
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "src", "dst")
    return named(kept, "threshold").unionByName(named(none, "fallback"))


@query("weight_moments", f"WITH {E} SELECT round(min(weight), 6) AS least, round(max(weight), 6) AS most, round(avg(weight), 6) AS mean, round(stddev_pop(weight), 6) AS deviation FROM e")
def weight_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Least, greatest, mean and population deviation over all edges."""
    w = "weight"
    return shared.edges(spark, sf).agg(*[F.round(f(w), 6).alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"), (F.stddev_pop, "deviation"))])


@query("random_graph_of_tables", """WITH n AS (SELECT count(*) AS n FROM part), i AS (SELECT o_orderkey AS i FROM orders)
SELECT i, floor(('0x' || substr(md5('21:src:' || i), 1, 7))::BIGINT / 268435456.0::DOUBLE * n)::BIGINT AS src, floor(('0x' || substr(md5('21:dst:' || i), 1, 7))::BIGINT / 268435456.0::DOUBLE * n)::BIGINT AS dst FROM i, n""")
def random_graph_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded edge for each order, between places among the parts."""
    n = table(spark, sf, "part").count()
    end = lambda side: F.floor(hash_share(hash_key(f"21:{side}", "o_orderkey")) * n).cast("long").alias(side)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), end("src"), end("dst"))
