"""Queries of grids, fronts, ranks and run summaries. Configurations are parts: size and price stand for the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.operators import selection as S
from plexure.registry import query, table

AXES = {"alpha": [0.1, 0.5, 1.0], "beta": [0.1, 1.0], "tau": [0.05, 0.1, 0.2], "layers": [1, 2]}
C = "c AS (SELECT p_partkey AS id, ((p_partkey * 37 + 11) % 101)::DOUBLE AS x, ((p_partkey * 53 + 40) % 97)::DOUBLE AS y, p_retailprice AS err FROM part)"
_FRONT = "f AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.x <= a.x AND b.y <= a.y AND (b.x < a.x OR b.y < a.y)))"


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), ((k * 37 + 11) % 101).cast("double").alias("x"), ((k * 53 + 40) % 97).cast("double").alias("y"), F.col("p_retailprice").alias("err"))


@query("param_grid", "SELECT 'config_' || lpad((row_number() OVER (ORDER BY a.i, b.i, t.i, l.i) - 1)::VARCHAR, 4, '0') AS config_id, a.v::DOUBLE AS alpha, b.v::DOUBLE AS beta, t.v::DOUBLE AS tau, l.v::INTEGER AS layers FROM (VALUES (0, 0.1), (1, 0.5), (2, 1.0)) a(i, v), (VALUES (0, 0.1), (1, 1.0)) b(i, v), (VALUES (0, 0.05), (1, 0.1), (2, 0.2)) t(i, v), (VALUES (0, 1), (1, 2)) l(i, v)")
def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    return S.grid(spark, AXES)


@query("pareto_front", f"WITH {C}, {_FRONT} SELECT id, x, y FROM f")
def pareto_front(spark: SparkSession, sf: str) -> DataFrame:
    return S.pareto(_configs(spark, sf), "id", "x", "y").select("id", "x", "y")


@query("borda_rank", f"WITH {C}, r AS (SELECT id, row_number() OVER (ORDER BY x, id) - 1 + row_number() OVER (ORDER BY y, id) - 1 AS score FROM c) SELECT id, score FROM r ORDER BY score, id LIMIT 10")
def borda_rank(spark: SparkSession, sf: str) -> DataFrame:
    return S.borda(_configs(spark, sf), "id", "x", "y", 10).select("id", "score")


@query("stage1", f"WITH {C}, {_FRONT} SELECT id, x, y FROM f ORDER BY x + y, id LIMIT 5")
def stage1(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_stage(_configs(spark, sf), "id", "x", "y", 5).select("id", "x", "y")


@query("stage2", f"WITH {C}, {_FRONT}, g AS (SELECT * FROM f ORDER BY x + y, id LIMIT 5) SELECT id, err FROM g ORDER BY err, id LIMIT 1")
def stage2(spark: SparkSession, sf: str) -> DataFrame:
    return S.second_stage(S.first_stage(_configs(spark, sf), "id", "x", "y", 5), "id", "err")


@query("top_by_metric", f"WITH {C} SELECT id, x FROM c ORDER BY x, id LIMIT 10")
def top_by_metric(spark: SparkSession, sf: str) -> DataFrame:
    return _configs(spark, sf).orderBy("x", "id").limit(10).select("id", "x")


@query("fold_average", "WITH r AS (SELECT l_suppkey AS config, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS m FROM lineitem) SELECT config, round(avg(m), 6) AS m, count(m) AS folds FROM r GROUP BY config")
def fold_average(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("config"), F.when(F.col("l_linenumber") == 7, float("inf")).otherwise(F.col("l_discount")).alias("m"))
    return S.over_folds(runs, "config", ["m"]).withColumn("m", F.round("m", 6))


@query("experiment_stats", "SELECT o_orderpriority AS experiment, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n FROM orders GROUP BY 1")
def experiment_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("experiment")).agg(F.round(F.avg(p), 4).alias("mean"), F.round(F.stddev_samp(p), 4).alias("std"), F.min(p).alias("least"), F.max(p).alias("most"), F.count("*").alias("n"))


@query("clip_unit", "SELECT event_id, least(greatest(value / 100, 0.0), 1.0) AS clipped FROM events")
def clip_unit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("clipped"))


@query("best_configs", f"WITH {C} SELECT id, err FROM c ORDER BY err DESC, id LIMIT 5")
def best_configs(spark: SparkSession, sf: str) -> DataFrame:
    return _configs(spark, sf).orderBy(F.desc("err"), "id").limit(5).select("id", "err")


@query("best_lookup", f"WITH {C} SELECT id, err, 'YES' AS is_best FROM c ORDER BY err, id LIMIT 1")
def best_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The row that a results table marks as best; the mark is set by config id."""
    c = _configs(spark, sf)
    best = S.second_stage(c, "id", "err").select(F.col("id").alias("_b"))
    marked = c.join(best, F.col("id") == F.col("_b"), "left").withColumn("is_best", F.when(F.col("_b").isNotNull(), "YES").otherwise("NO"))
    return marked.filter("is_best = 'YES'").select("id", "err", "is_best")


@query("longest_sequence", "SELECT max(n) AS longest FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def longest_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("longest"))


@query("grid_of_tables", "WITH a AS (SELECT DISTINCT l_returnflag AS flag FROM lineitem), b AS (SELECT DISTINCT l_linenumber AS line FROM lineitem), c AS (SELECT DISTINCT r_name AS region FROM region) SELECT 'config_' || lpad((row_number() OVER (ORDER BY flag, line, region) - 1)::VARCHAR, 4, '0') AS config_id, flag, line, region FROM a CROSS JOIN b CROSS JOIN c")
def grid_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of the values that three columns have; few, as the axes of a grid are."""
    axis = lambda t, c: [r[0] for r in table(spark, sf, t).select(c).distinct().orderBy(c).limit(100).collect()]
    return S.grid(spark, {"flag": axis("lineitem", "l_returnflag"), "line": axis("lineitem", "l_linenumber"), "region": axis("region", "r_name")})
