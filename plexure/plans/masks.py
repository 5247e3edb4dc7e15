"""Queries of folds, masks, dropouts and negative samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.operators import graph as G
from plexure.operators import masks as M
from plexure.operators.etl import dictionary
from plexure.plans import shared
from plexure.registry import query, table

E = shared.EDGES


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label")


@query("cv_folds", """WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY md5('3:' || vec_id)) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END::BIGINT AS fold FROM r""")
def cv_folds(spark: SparkSession, sf: str) -> DataFrame:
    return M.folds(_ids(spark, sf).select("vec_id"), "vec_id", 7, 3)


@query("cv_folds_grouped", """WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('3:' || o_custkey)) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, least(4, (rn - 1) // (n // 5))::BIGINT AS fold FROM orders JOIN g USING (o_custkey)""")
def cv_folds_grouped(spark: SparkSession, sf: str) -> DataFrame:
    return M.grouped_folds(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, 3).select("o_orderkey", "fold")


@query("edge_test_mask", f"WITH {E}, r AS (SELECT src, dst, row_number() OVER (ORDER BY md5('5:' || src || ':' || dst)) AS rn, count(*) OVER () AS n FROM e) SELECT src, dst, CASE WHEN rn <= floor(n * 0.2::DOUBLE) THEN 1 ELSE 0 END AS test FROM r")
def edge_test_mask(spark: SparkSession, sf: str) -> DataFrame:
    return M.similar_sample(shared.vectors(spark, sf), shared.THRESHOLD, 0.2, 5).select("src", "dst", F.col("chosen").cast("int").alias("test"))


ORPHAN = "orp AS (SELECT vec_id FROM embeddings WHERE ('0x' || substr(md5('9:0:' || vec_id), 1, 7))::BIGINT / 268435456.0 < 0.3)"


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return M.draw(_ids(spark, sf).select("vec_id"), "vec_id", 0.3, 9)


@query("orphan_draw", f"WITH {ORPHAN} SELECT vec_id FROM orp")
def orphan_draw(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


@query("soft_dropout", f"WITH {E}, {ORPHAN} SELECT src, dst FROM e WHERE src NOT IN (SELECT vec_id FROM orp)")
def soft_dropout(spark: SparkSession, sf: str) -> DataFrame:
    return M.without_sources(shared.edges(spark, sf), _orphans(spark, sf), "vec_id").select("src", "dst")


@query("orphan_edges", f"WITH {E}, {ORPHAN} SELECT src, dst FROM e WHERE src IN (SELECT vec_id FROM orp)")
def orphan_edges(spark: SparkSession, sf: str) -> DataFrame:
    return M.of_sources(shared.edges(spark, sf), _orphans(spark, sf), "vec_id").select("src", "dst")


@query("leak_mask", f"WITH {E}, r AS (SELECT src, dst, row_number() OVER (ORDER BY md5('5:' || src || ':' || dst)) AS rn, count(*) OVER () AS n FROM e), t AS (SELECT src, dst FROM r WHERE rn <= floor(n * 0.2::DOUBLE)) SELECT src, dst FROM e EXCEPT SELECT src, dst FROM t")
def leak_mask(spark: SparkSession, sf: str) -> DataFrame:
    return M.similar_sample(shared.vectors(spark, sf), shared.THRESHOLD, 0.2, 5, only=False).select("src", "dst")


REF = f"{E}, rk AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('11:' || vec_id)) AS rn, count(*) OVER () AS n FROM embeddings), ref AS (SELECT vec_id, label FROM rk WHERE rn <= floor(n * 0.6::DOUBLE))"


def reference_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return M.exact_sample(_ids(spark, sf), ["vec_id"], 0.6, 11).filter("chosen").drop("chosen")


@query("reference_subgraph", f"""WITH {REF}, w AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS word FROM (SELECT DISTINCT label FROM ref))
SELECT 'aa' AS relation, src, dst FROM e WHERE src IN (SELECT vec_id FROM ref) AND dst IN (SELECT vec_id FROM ref) UNION ALL SELECT 'aw', vec_id, word FROM ref JOIN w USING (label)""")
def reference_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    ref = reference_nodes(spark, sf)
    aa = M.within(shared.edges(spark, sf).select("src", "dst"), ref, "vec_id").select(F.lit("aa").alias("relation"), "src", "dst")
    words = dictionary(ref, "label").select(F.col("label").alias("l"), F.col("id").alias("dst"))
    aw = ref.join(words, F.col("label") == F.col("l")).select(F.lit("aw").alias("relation"), F.col("vec_id").alias("src"), "dst")
    return aa.unionByName(aw)


_POS = "pos AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS pos, count(*) OVER () AS n FROM embeddings)"


@query("negative_edges", f"""WITH {E}, {_POS}, d AS (SELECT id AS src, md5('13:' || id || ':' || t) AS key, n FROM pos, range(10) r(t)),
c AS (SELECT d.src, pos.id AS dst, d.key FROM d JOIN pos ON pos.pos = floor((('0x' || substr(d.key, 1, 7))::BIGINT / 268435456.0) * d.n)::BIGINT WHERE d.src <> pos.id)
SELECT src, dst FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.src = c.src AND e.dst = c.dst) OR (e.src = c.dst AND e.dst = c.src)) ORDER BY key, src LIMIT 400""")
def negative_edges(spark: SparkSession, sf: str) -> DataFrame:
    return M.negatives(_ids(spark, sf), G.symmetrized(shared.edges(spark, sf)), "vec_id", 10, 400, 13)


@query("negative_per_pair", f"""WITH {E}, {_POS}, t AS (SELECT src, dst, s, floor((('0x' || substr(md5('15:' || src || ':' || dst), 1, 7))::BIGINT / 268435456.0) * (SELECT count(*) FROM embeddings))::BIGINT AS a0 FROM e, range(3) r(s)),
f AS (SELECT src, dst, s, id FROM t JOIN pos ON pos.pos = (a0 + s) % n WHERE id <> src AND id <> dst) SELECT src, dst, arg_min(id, s) AS neg FROM f GROUP BY src, dst""")
def negative_per_pair(spark: SparkSession, sf: str) -> DataFrame:
    return M.negative_each(shared.edges(spark, sf), _ids(spark, sf), "vec_id", 15)


@query("edge_mask_algebra", f"""WITH {E}, rk AS (SELECT vec_id, row_number() OVER (ORDER BY md5('17:' || vec_id)) AS rn, count(*) OVER () AS n FROM embeddings), va AS (SELECT vec_id FROM rk WHERE rn <= floor(n * 0.2::DOUBLE))
SELECT src, dst, CASE WHEN src IN (SELECT vec_id FROM va) OR dst IN (SELECT vec_id FROM va) THEN 1 ELSE 0 END AS val_aa, CASE WHEN src IN (SELECT vec_id FROM va) THEN 1 ELSE 0 END AS val_aw, CASE WHEN src NOT IN (SELECT vec_id FROM va) AND dst NOT IN (SELECT vec_id FROM va) THEN 1 ELSE 0 END AS train_aa FROM e""")
def edge_mask_algebra(spark: SparkSession, sf: str) -> DataFrame:
    flags = M.exact_sample(_ids(spark, sf).select("vec_id"), ["vec_id"], 0.2, 17, "val")
    e = shared.edges(spark, sf).select("src", "dst")
    s, d = (flags.select(F.col("vec_id").alias(f"_{c}"), F.col("val").alias(f"v{c}")) for c in ("src", "dst"))
    e = e.join(s, F.col("src") == F.col("_src")).join(d, F.col("dst") == F.col("_dst"))
    return e.select("src", "dst", (F.col("vsrc") | F.col("vdst")).cast("int").alias("val_aa"), F.col("vsrc").cast("int").alias("val_aw"), (~F.col("vsrc") & ~F.col("vdst")).cast("int").alias("train_aa"))


@query("epoch_draws", """WITH RECURSIVE r AS (SELECT vec_id, 0 AS k, floor(ln(1 - ('0x' || substr(md5('51:' || vec_id || ':0'), 1, 7))::BIGINT / 268435456.0::DOUBLE) / ln(1 - 0.3::DOUBLE))::BIGINT AS epoch FROM embeddings
UNION ALL SELECT vec_id, k + 1, epoch + 1 + floor(ln(1 - ('0x' || substr(md5('51:' || vec_id || ':' || (k + 1)), 1, 7))::BIGINT / 268435456.0::DOUBLE) / ln(1 - 0.3::DOUBLE))::BIGINT FROM r WHERE epoch < 10)
SELECT vec_id, epoch::INTEGER AS epoch FROM r WHERE epoch < 10""")
def epoch_draws(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors that lose their cross edges in each of ten epochs, in one plan."""
    return M.redraw(_ids(spark, sf).select("vec_id"), ["vec_id"], 0.3, 51, 10)
