"""Metadata queries: union, filter, dedup, splits, counts, text cleaning, joins, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexure.functions import text as X
from plexure.functions.hashing import hash_key, rank_by_hash
from plexure.operators import etl as E
from plexure.registry import query, table


@query("union_align", """SELECT c_custkey AS acct, c_acctbal AS acctbal, 'customer' AS source, c_mktsegment AS segment, c_name AS name, 'customer' AS language, NULL::BIGINT AS nation_s FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier', NULL, s_name, 'supplier', s_nationkey::BIGINT FROM supplier""")
def union_align(spark: SparkSession, sf: str) -> DataFrame:
    c = E.renamed(table(spark, sf, "customer"), {"c_custkey": "acct", "c_acctbal": "acctbal", "c_mktsegment": "segment", "c_name": "name"}, ["c_nationkey"])
    s = E.renamed(table(spark, sf, "supplier"), {"s_suppkey": "acct", "s_acctbal": "acctbal", "s_name": "name"}).select("acct", "acctbal", "name", F.col("s_nationkey").cast("long").alias("nation_s"))
    return E.aligned_union([E.tagged(c, "customer"), E.tagged(s, "supplier")])


@query("filter_eq_in", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def filter_eq_in(spark: SparkSession, sf: str) -> DataFrame:
    return E.matching(table(spark, sf, "documents"), {"lang": "en", "source": ["src1", "src2"], "dialect": "none"}).select("doc_id", "lang", "source")


@query("dedup_first", "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").select(F.sha2("text", 256).alias("k"), "doc_id", "lang", "source")
    return E.first_of_each(keyed, ["k"], ["doc_id"]).drop("k")


@query("merge_sources", """WITH u AS (SELECT 0 AS p, conv_id AS id, text FROM conversations WHERE turn = 0 UNION ALL SELECT 1, item_id, text FROM benchmark)
SELECT id, md5('42:' || id) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY p, id) AS rn FROM u) WHERE rn = 1""")
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), "text")
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return E.merged([a, b], ["audio_path", "text"], 42, "id").select("id", F.col("_order").alias("ord"))


@query("shuffle_md5", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS pos FROM documents")
def shuffle_md5(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "documents").select("doc_id").withColumn("key", hash_key(42, "doc_id"))
    return rank_by_hash(keyed, "key", [], "pos").select("doc_id", "pos")


SPLIT = """s AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL),
t AS (SELECT *, floor(n * 0.7::DOUBLE) AS a FROM s), sp AS (SELECT doc_id, lang, source, CASE WHEN n < 10 THEN 'train' WHEN rn <= a THEN 'train' WHEN rn <= a + floor((n - a) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM t)"""


SPLIT_BY = """WITH s AS (SELECT doc_id, {0} AS stratum, row_number() OVER (PARTITION BY {0} ORDER BY md5('7:' || doc_id)) AS rn, count(*) OVER (PARTITION BY {0}) AS n FROM documents WHERE {0} IS NOT NULL), t AS (SELECT *, floor(n * 0.7::DOUBLE) AS a FROM s)
SELECT doc_id, stratum, CASE WHEN n < 10 THEN 'train' WHEN rn <= a THEN 'train' WHEN rn <= a + floor((n - a) * 0.5::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM t"""


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return E.split_strata(table(spark, sf, "documents").select("doc_id", "lang", "source"), "source", "doc_id", 7)


@query("split_stratified", f"WITH {SPLIT} SELECT doc_id, source, split FROM sp")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("doc_id", "source", "split")


@query("split_by_group", """WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY role ORDER BY md5('7:' || conv_id || ':' || turn)) AS rn, count(*) OVER (PARTITION BY role) AS n FROM conversations)
SELECT conv_id, turn, role, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM s""")
def split_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return E.split_groups(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "role", ["conv_id", "turn"], 7)


@query("split_crosstab", f"WITH {SPLIT} SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM sp GROUP BY lang")
def split_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return E.crosstab(_split(spark, sf), "lang", "split", ["train", "val", "test"])


@query("group_split_counts", """WITH s AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY md5('7:' || conv_id || ':' || turn)) AS rn, count(*) OVER (PARTITION BY role) AS n FROM conversations)
SELECT role, count(*) FILTER (rn <= floor(n * 0.8::DOUBLE)) AS train, count(*) FILTER (rn > floor(n * 0.8::DOUBLE)) AS test FROM s GROUP BY role""")
def group_split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return split_by_group(spark, sf).groupBy("role").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


@query("source_share", "SELECT source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS fraction FROM documents WHERE source IS NOT NULL GROUP BY source")
def source_share(spark: SparkSession, sf: str) -> DataFrame:
    return E.shares(table(spark, sf, "documents"), "source").withColumn("fraction", F.round("fraction", 6))


@query("distinct_counts", "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


@query("length_stats", "SELECT lang, round(avg(length(text)), 6) AS mean, min(length(text)) AS least, max(length(text)) AS most, count(text) AS n FROM documents WHERE length(text) > 0 GROUP BY lang")
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select("lang", F.length("text").cast("long").alias("n")).filter("n > 0")
    return n.groupBy("lang").agg(F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"), F.count("n").alias("n"))


@query("top_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def top_groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("clean_strict", r"SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z0-9\t\n\f\r '']', '', 'g')) AS cleaned FROM documents")
def clean_strict(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_strict(F.col("text")).cast("binary")).alias("cleaned"))


@query("clean_punct", r"SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z0-9\t\n\f\r ''\-.,!?]', '', 'g')) AS cleaned FROM documents")
def clean_punct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.clean_punctuated(F.col("text")).cast("binary")).alias("cleaned"))


@query("id_prefix_strip", "SELECT c_custkey, regexp_replace(c_name, '^Customer[-#]?', '') AS code FROM customer")
def id_prefix_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", X.without_prefix(F.col("c_name"), "Customer").alias("code"))


@query("shorten_names", "SELECT p_partkey, CASE WHEN length(p_name || ' ' || p_type || ' ' || p_brand) > 20 THEN left(p_name || ' ' || p_type || ' ' || p_brand, 16) || '...' ELSE p_name || ' ' || p_type || ' ' || p_brand END AS label FROM part")
def shorten_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.shortened(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("label"))


@query("path_parts", r"""WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '/') AS s FROM pages)
SELECT page_id, regexp_replace(s[-1], '\.[^.]*$', '') AS stem, s[-2] AS parent, s[-3] AS grandparent FROM p""")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", X.stem(u).alias("stem"), X.path_part(u, 2).alias("parent"), X.path_part(u, 3).alias("grandparent"))


@query("relative_paths", "SELECT page_id, CASE WHEN starts_with(url, 'http:/') THEN substr(url, 7) ELSE url END AS rel FROM pages")
def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.relative_to(F.col("url"), "http:/").alias("rel"))


_LINES = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END || '  ' || (event_id + user_id) || ' ' || event_type || CASE WHEN event_id % 5 = 0 THEN ' extra' ELSE '' END AS line FROM events"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    line = F.concat(F.when(e % 7 == 0, F.concat(F.lit("x"), e.cast("string"))).otherwise(e.cast("string")), F.lit("  "), (e + F.col("user_id")).cast("string"), F.lit(" "), "event_type", F.when(e % 5 == 0, " extra").otherwise(""))
    return table(spark, sf, "events").select("event_id", line.alias("line"))


@query("segments_parse", rf"""WITH l AS ({_LINES}), t AS (SELECT event_id, regexp_split_to_array(trim(line), '\s+') AS t FROM l)
SELECT event_id, try_cast(t[1] AS BIGINT) AS "begin", try_cast(t[2] AS BIGINT) AS stop, t[3] AS label FROM t WHERE len(t) = 3 AND try_cast(t[1] AS BIGINT) IS NOT NULL AND try_cast(t[2] AS BIGINT) IS NOT NULL""")
def segments_parse(spark: SparkSession, sf: str) -> DataFrame:
    return E.segments(_lines(spark, sf), "line").drop("line")


@query("spoken_text", rf"""WITH l AS ({_LINES}), t AS (SELECT event_id, regexp_split_to_array(trim(line), '\s+') AS t FROM l)
SELECT event_id, CASE WHEN len(t) >= 3 THEN array_to_string(t[3:], ' ') ELSE array_to_string(t, ' ') END AS said FROM t""")
def spoken_text(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("event_id", E.spoken_text(F.col("line")).alias("said"))


@query("lenient_casts", "WITH l AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'n/a' WHEN event_id % 3 = 1 THEN ' Yes ' ELSE event_id::VARCHAR END AS x FROM events) SELECT event_id, coalesce(try_cast(x AS BIGINT)::VARCHAR, x) AS number, CASE WHEN lower(trim(x)) IN ('true', '1', 'yes', 'on') THEN 1 ELSE 0 END AS flag FROM l")
def lenient_casts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    x = F.when(e % 3 == 0, "n/a").when(e % 3 == 1, " Yes ").otherwise(e.cast("string"))
    return table(spark, sf, "events").select("event_id", F.coalesce(x.try_cast("bigint").cast("string"), x).alias("number"), X.truthy(x).cast("int").alias("flag"))


@query("transcription_inner", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def transcription_inner(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")


@query("audio_without_text", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def audio_without_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("text_without_audio", "SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def text_without_audio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").filter("lang = 'en'").select("doc_id"), "doc_id", "left_anti")


@query("mapping_left", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def mapping_left(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_default(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "quality", -1)


@query("last_wins", "SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return E.last_of_each(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("dictionary_encode", "SELECT doc_id, dense_rank() OVER (ORDER BY source) - 1 AS source_id FROM documents WHERE source IS NOT NULL")
def dictionary_encode(spark: SparkSession, sf: str) -> DataFrame:
    return E.encoded(table(spark, sf, "documents").select("doc_id", "source"), "source", "source_id").select("doc_id", "source_id")


@query("indices_by_group", "SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders")
def indices_by_group(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered ids of each group, a row each."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", (F.row_number().over(w) - 1).cast("long").alias("pos"), "o_orderkey")


@query("word_letters", r"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) SELECT item_id, count(*) AS words, sum(length(w)) AS letters, max(length(w)) AS longest FROM w WHERE w <> '' GROUP BY item_id""")
def word_letters(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "benchmark").select("item_id", X.letters(F.col("text")).alias("w"))
    size = F.transform("w", lambda x: F.size(x).cast("long"))
    return w.select("item_id", F.size("w").cast("long").alias("words"), F.aggregate(size, F.lit(0).cast("long"), lambda s, x: s + x).alias("letters"), F.array_max(size).alias("longest"))


@query("split_by_language", SPLIT_BY.format("lang"))
def split_by_language(spark: SparkSession, sf: str) -> DataFrame:
    """Split by what stands for the language: the column is chosen from those that are there."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    column = E.strata_column(docs.columns, "language", "lang")
    return E.split_strata(docs, column, "doc_id", 7).select("doc_id", F.col(column).alias("stratum"), "split")


_SECONDS = "CASE WHEN doc_id % 4 = 0 OR n_chars IS NULL THEN 0.0 ELSE n_chars::DOUBLE / (20 * (doc_id % 4)) END"


def _seconds(spark: SparkSession, sf: str) -> DataFrame:
    """A duration for each document from its characters as frames, at rates of which one is 0."""
    return table(spark, sf, "documents").select("doc_id", "lang", E.seconds(F.col("n_chars"), 20 * (F.col("doc_id") % 4)).alias("seconds"))


@query("durations", f"SELECT doc_id, round({_SECONDS}, 6) AS seconds FROM documents")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    return _seconds(spark, sf).select("doc_id", F.round("seconds", 6).alias("seconds"))


@query("duration_stats", f"WITH d AS (SELECT lang, {_SECONDS} AS s FROM documents) SELECT lang, round(avg(s), 6) AS mean, round(min(s), 6) AS least, round(max(s), 6) AS most, count(*) AS n FROM d WHERE s > 0 GROUP BY lang")
def duration_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Of the durations that are known, that is over 0."""
    s = _seconds(spark, sf).filter("seconds > 0")
    return s.groupBy("lang").agg(F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.min("seconds"), 6).alias("least"), F.round(F.max("seconds"), 6).alias("most"), F.count("*").alias("n"))


@query("batch_order", "SELECT doc_id, doc_id // 32 AS batch, row_number() OVER (PARTITION BY doc_id // 32 ORDER BY coalesce(length(text), 0) DESC, doc_id) AS place FROM documents")
def batch_order(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each document in its batch of 32, longest first."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("doc_id div 32").alias("batch"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    order = Window.partitionBy("batch").orderBy(F.desc("n"), "doc_id")
    return d.select("doc_id", "batch", F.row_number().over(order).cast("long").alias("place"))


@query("preview", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten rows: a preview is a limit."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").orderBy("doc_id").limit(10)


@query("example_lists", "SELECT doc_id, md5(text) AS transcription, source AS speaker FROM documents")
def example_lists(spark: SparkSession, sf: str) -> DataFrame:
    """What the list getters give: the texts (as digests) and their speakers, in rows."""
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("transcription"), F.col("source").alias("speaker"))


@query("speaker_info", f"WITH d AS (SELECT source, text, {_SECONDS} AS s FROM documents) SELECT source AS speaker, count(*) AS examples, round(sum(s), 4) AS total, round(avg(s) FILTER (s > 0), 6) AS mean, count(DISTINCT md5(text)) AS texts FROM d GROUP BY source")
def speaker_info(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of each speaker: examples, seconds in all and on average where known, different texts."""
    d = table(spark, sf, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("t"), E.seconds(F.col("n_chars"), 20 * (F.col("doc_id") % 4)).alias("s"))
    mean = F.round(F.avg(F.when(F.col("s") > 0, F.col("s"))), 6).alias("mean")
    return d.groupBy(F.col("source").alias("speaker")).agg(F.count("*").alias("examples"), F.round(F.sum("s"), 4).alias("total"), mean, F.count_distinct("t").alias("texts"))


@query("split_ratios", """WITH s AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL),
t AS (SELECT *, CASE WHEN lang = 'de' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS a, CASE WHEN lang = 'de' THEN 0.5::DOUBLE ELSE 0.5::DOUBLE END AS b FROM s), u AS (SELECT *, floor(n * a) AS k FROM t)
SELECT doc_id, CASE WHEN n < 10 THEN 'train' WHEN rn <= k THEN 'train' WHEN rn <= k + floor((n - k) * b) THEN 'val' ELSE 'test' END AS split FROM u""")
def split_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """A stratified split with ratios that do not add up to one, and others for one stratum."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return E.split_strata(docs, "lang", "doc_id", 7, 8.0, 1.0, 1.0, ratios={"de": (4.0, 2.0, 2.0)}).select("doc_id", "split")
