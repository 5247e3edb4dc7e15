"""Queries that go through the writers and readers: a table is written in one of the layouts and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.operators.store import Scratch
from plexure.plans import shared
from plexure.plans.etl import SPLIT, split_stratified
from plexure.registry import query, table
from plexure.sources import metadata, sinks
from plexure.sources.versions import Versions, merged


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared place; it goes when the session ends."""
    return Scratch(spark, "storage").base


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    split = F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split")
    return c.select(
        F.concat(F.col("c_name"), F.lit(".wav")).alias("audio_path"), F.col("c_mktsegment").alias("transcription"), F.col("c_nationkey").cast("string").alias("speaker_id"),
        F.concat(F.lit("src"), F.col("c_nationkey") % 3).alias("source"), split,
    )


CUSTOMERS = "c AS (SELECT c_name || '.wav' AS audio_path, c_mktsegment AS transcription, c_nationkey::VARCHAR AS speaker_id, 'src' || (c_nationkey % 3) AS source, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM customer)"


@query("csv_dataset", f"WITH {CUSTOMERS} SELECT audio_path, transcription, speaker_id, split FROM c")
def csv_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written by split as CSV, and read back as one dataset with its required columns."""
    path = _folder(spark)
    sinks.by_split(_customers(spark, sf), f"{path}/out", ["audio_path", "transcription", "speaker_id"])
    parts = None
    for split in ("train", "test"):
        one = metadata.dataset(spark, f"{path}/out/split={split}").withColumn("split", F.lit(split))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("csv_source", f"WITH {CUSTOMERS} SELECT audio_path AS path, transcription AS text, 'crowd' AS source, coalesce('Basaa', 'crowd') AS language FROM c")
def csv_source(spark: SparkSession, sf: str) -> DataFrame:
    """A semicolon-separated table: delimiter found, headers normalised, tagged with source and language, renamed and pruned."""
    path = _folder(spark)
    _customers(spark, sf).select(F.col("audio_path").alias(" Audio Path "), F.col("transcription").alias("Text"), F.col("speaker_id").alias("Old")).write.csv(f"{path}/in", header=True, sep=";")
    return metadata.source_table(spark, f"{path}/in", "crowd", {"crowd": "Basaa"}, {"audio_path": "path"}, ["old"]).select("path", "text", "source", "language")


@query("with_language", f"WITH {CUSTOMERS} SELECT audio_path, CASE source WHEN 'src0' THEN 'Basaa' ELSE source END AS language FROM c")
def with_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each row's source, or the source itself."""
    return metadata.with_language(_customers(spark, sf), {"src0": "Basaa"}).select("audio_path", "language")


@query("crowd_splits", "SELECT o_custkey::VARCHAR AS client_id, o_orderkey::VARCHAR AS path, o_orderstatus AS sentence, CASE WHEN o_orderkey % 2 = 0 THEN 'train' ELSE 'dev' END AS split FROM orders")
def crowd_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Tab-separated lists of several splits, read with the split of each."""
    path, paths = _folder(spark), {}
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("sentence"), F.lit(1).alias("up_votes"))
    for split, rest in (("train", 0), ("dev", 1)):
        paths[split] = f"{path}/{split}"
        o.filter(F.col("path") % 2 == rest).write.csv(paths[split], header=True, sep="\t")
    return metadata.crowd_splits(spark, paths)


@query("crowd_listed", "SELECT o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def crowd_listed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of such a list whose files are there."""
    path = _folder(spark)
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("client_id"), F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("sentence"))
    o.write.csv(f"{path}/all", header=True, sep="\t")
    files = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file")).distinct()
    return metadata.crowd_splits(spark, {"all": f"{path}/all"}, files).select("path")


@query("id_texts", "SELECT c_custkey::VARCHAR AS audio_id, c_mktsegment AS text FROM customer WHERE c_custkey % 7 <> 0")
def id_texts(spark: SparkSession, sf: str) -> DataFrame:
    """An id-keyed list under other headers; prefixes go, and so do empty texts."""
    path = _folder(spark)
    text = F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("Phrase")
    table(spark, sf, "customer").select(F.concat(F.lit("STE-"), "c_custkey").alias("Number"), text).write.csv(f"{path}/in", header=True, sep=";")
    return metadata.transcriptions(spark, f"{path}/in")


@query("mapping_file", "SELECT p_name || '-' || p_partkey AS audio_filename, p_partkey::VARCHAR AS key, p_brand AS sentence FROM part")
def mapping_file(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    p = table(spark, sf, "part").select(F.concat_ws("-", "p_name", "p_partkey").alias("audio_filename"), F.col("p_partkey").alias("key"), F.col("p_brand").alias("sentence"))
    p.write.csv(f"{path}/in", header=True, sep="\t", quote="")
    return metadata.mapping(spark, f"{path}/in")


@query("folder_speakers", f"WITH {CUSTOMERS} SELECT 'source=' || source AS parent, 'source=' || source AS speaker_id, 'csv' AS ending FROM c GROUP BY source")
def folder_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """The files that were written by source, listed without reading them: their folders and speakers."""
    path = _folder(spark)
    sinks.by_source(_customers(spark, sf), f"{path}/out")
    return metadata.speakers(metadata.listing(spark, f"{path}/out", "*.csv"), "source=").select("parent", "speaker_id", "ending").distinct()


@query("audio_lookup", """WITH f AS (SELECT DISTINCT o_custkey AS stem, o_orderkey % 2 AS folder, o_orderkey // 2 % 5 AS ending FROM orders), g AS (SELECT *, ['wav', 'mp3', 'txt', 'flac', 'm4a'][ending + 1] AS e, ['clips', 'other'][folder + 1] AS d FROM f WHERE ending <> 2),
o AS (SELECT *, list_position(['other', 'clips'], d) AS a, list_position(['mp3', 'wav', 'm4a', 'flac'], e) AS b FROM g), x AS (SELECT stem, arg_min(d || '/' || stem || '.' || e, a * 10 + b) AS path FROM o GROUP BY stem)
SELECT c_custkey::VARCHAR AS stem, path FROM customer LEFT JOIN x ON stem = c_custkey""")
def audio_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's file among a listing made of the orders: the first over folders, then over endings; others have none."""
    o = table(spark, sf, "orders")
    of = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    ending = of(["wav", "mp3", "txt", "flac", "m4a"], F.expr("o_orderkey div 2") % 5).alias("ending")
    files = o.select(F.col("o_custkey").cast("string").alias("stem"), of(["clips", "other"], F.col("o_orderkey") % 2).alias("parent"), ending).distinct()
    files = files.withColumn("path", F.concat("parent", F.lit("/"), "stem", F.lit("."), "ending"))
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("stem"))
    return metadata.first_match(wanted, files, ["other", "clips"])


@query("by_language", f"WITH {CUSTOMERS} SELECT source AS language, split, count(*) AS n FROM c GROUP BY ALL")
def by_language(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    sinks.by_language(_customers(spark, sf).withColumnRenamed("source", "language"), f"{path}/out")
    return spark.read.csv(f"{path}/out", header=True).groupBy("language", "split").agg(F.count("*").alias("n"))


@query("results_files", f"WITH {CUSTOMERS} SELECT source, count(*) AS n FROM c GROUP BY source")
def results_files(spark: SparkSession, sf: str) -> DataFrame:
    """A results table as Parquet and JSON; both hold the same rows."""
    path = _folder(spark)
    sinks.results(_customers(spark, sf).groupBy("source").agg(F.count("*").alias("n")), f"{path}/out")
    return spark.read.parquet(f"{path}/out/parquet").intersect(spark.read.schema("source string, n long").json(f"{path}/out/json"))


@query("stored_graph", f"WITH {shared.BASKET} SELECT src, dst, weight FROM b")
def stored_graph(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    sinks.store_graph({"nodes": table(spark, sf, "part").select("p_partkey"), "edges": shared.basket(spark, sf)}, f"{path}/graph")
    return metadata.stored_graph(spark, f"{path}/graph")["edges"].select("src", "dst", "weight")


@query("built_once", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def built_once(spark: SparkSession, sf: str) -> DataFrame:
    """A table that a configuration names is built at its first use and read at the next."""
    path, config = _folder(spark), {"threshold": 0.3, "kind": "nation"}
    sinks.configured(spark, path, config, {"nodes": lambda: table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")})
    return sinks.configured(spark, path, config, {"nodes": lambda: table(spark, sf, "nation").limit(0)})["nodes"]


@query("split_saved", f"WITH {SPLIT} SELECT split, source, count(*) AS n, min(doc_id) AS first FROM sp GROUP BY split, source")
def split_saved(spark: SparkSession, sf: str) -> DataFrame:
    """A stratified split written by split; the numbers of each stratum come from what was written."""
    path = _folder(spark)
    sinks.by_split(split_stratified(spark, sf), f"{path}/out", ["doc_id", "source"])
    rows = spark.read.csv(f"{path}/out", header=True, schema="doc_id long, source string, split string")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("fold_results_files", "SELECT l_linenumber::BIGINT AS config, round(avg(l_discount), 6) AS loss, count(*) AS folds FROM lineitem GROUP BY l_linenumber")
def fold_results_files(spark: SparkSession, sf: str) -> DataFrame:
    """Averages over folds as a results table: written as Parquet and JSON and as CSV, which agree."""
    path = _folder(spark)
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("long").alias("config")).agg(F.round(F.avg("l_discount"), 6).alias("loss"), F.count("*").alias("folds"))
    sinks.results(rows, f"{path}/out")
    spark.read.parquet(f"{path}/out/parquet").write.csv(f"{path}/csv", header=True)
    again = spark.read.csv(f"{path}/csv", header=True, schema="config long, loss double, folds long")
    return again.intersect(spark.read.schema("config long, loss double, folds long").json(f"{path}/out/json"))


@query("versioned_tables", "SELECT n_name, n_regionkey::BIGINT AS n_regionkey, 0.5::DOUBLE AS alpha, 0.2::DOUBLE AS tau FROM nation")
def versioned_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A table and settings in versions: the last whole one is read, whatever a writer that stopped half-way has left."""
    store = Versions(spark, f"{_folder(spark)}/store")
    n = table(spark, sf, "nation").select("n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    store.commit({"nodes": n.limit(0)}, {"loss": {"alpha": 0.1, "tau": 0.2}})
    store.commit({"nodes": n}, merged(store.read()[1], {"loss": {"alpha": 0.5}}))

    class Stopped(Exception):
        pass

    def stop() -> None:
        raise Stopped

    try:
        store.commit({"nodes": n.limit(1)}, {}, before_rename=stop)
    except Stopped:
        pass  # as a writer that is lost before its commit
    tables, settings = store.read()
    return tables["nodes"].select("*", *[F.lit(settings["loss"][k]).alias(k) for k in ("alpha", "tau")])


@query("sidecars", """WITH f AS (SELECT c_custkey::VARCHAR AS stem FROM customer), p AS (SELECT o_custkey::VARCHAR AS s, string_agg(o_orderstatus, ' ' ORDER BY o_orderkey, o_orderstatus) AS w, count(*) AS n FROM orders GROUP BY 1)
SELECT stem, coalesce(n, 0) AS phonemes, CASE WHEN stem::BIGINT % 3 = 0 THEN 'text ' || stem ELSE coalesce(w, '') END AS transcription FROM f LEFT JOIN p ON s = stem""")
def sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """Files with what stands beside them: segments in order, and a text, for which the words stand in where there is none."""
    files = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("stem"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("stem"), F.col("o_orderkey").alias("begin"), F.col("o_orderstatus").alias("label"))
    texts = files.filter(F.col("stem").cast("long") % 3 == 0).select("stem", F.concat(F.lit("text "), "stem").alias("text"))
    out = metadata.with_sidecars(files, rows, rows, texts)
    return out.select("stem", F.coalesce(F.size("phonemes"), F.lit(0)).cast("long").alias("phonemes"), "transcription")
