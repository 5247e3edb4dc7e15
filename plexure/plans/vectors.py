"""Vector queries: similarity edges, alignment, uniformity, discrimination, statistics, bags, padding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexure.functions.vectors import distance, mask_of, norm, normalized, pad_or_cut
from plexure.operators.similarity import pair_mean
from plexure.plans import shared
from plexure.registry import query, table

ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = "[" + ", ".join(f"'{c}'" for c in ALPHABET) + "]"


@query("cosine_edges", f"WITH {shared.EDGES} SELECT src, dst, round(weight, 6) AS weight FROM e")
def cosine_edges(spark: SparkSession, sf: str) -> DataFrame:
    return shared.edges(spark, sf).withColumn("weight", F.round("weight", 6))


@query("uniformity", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT round(ln(avg(exp(-2 * (2 - 2 * list_cosine_similarity(a.v, b.v))))), 6) AS uniformity, count(*) AS pairs FROM v a JOIN v b ON a.vec_id < b.vec_id""")
def uniformity(spark: SparkSession, sf: str) -> DataFrame:
    out = pair_mean(shared.vectors(spark, sf), lambda c: np.exp(-2 * (2 - 2 * c)))
    return out.select(F.round(F.log(F.col("total") / F.col("pairs")), 6).alias("uniformity"), "pairs")


@query("alignment_same_label", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT round(avg(2 - 2 * list_cosine_similarity(a.v, b.v)), 6) AS alignment, count(*) AS pairs FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id""")
def alignment_same_label(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared distance of unit vectors with one label, from sums alone: n * sum |x|^2 - |sum x|^2 over each label's pairs."""
    rows = shared.vectors(spark, sf).select("label", F.posexplode(normalized(F.col("embedding"))).alias("d", "x"))
    sums = rows.groupBy("label", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("total"), F.first("n").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    return per.agg(F.round(F.sum("total") / pairs, 6).alias("alignment"), pairs.cast("long").alias("pairs"))


@query("abx_accuracy", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT label, min(vec_id) AS id FROM v GROUP BY label), q AS (SELECT p.label, v.vec_id, v.v FROM p JOIN v ON p.id = v.vec_id)
SELECT round(avg(CASE WHEN list_distance(x.v, a.v) < list_distance(x.v, b.v) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n
FROM v x JOIN q a ON a.label = x.label JOIN q b ON b.label = (x.label + 1) % 10 WHERE x.vec_id <> a.vec_id""")
def abx_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Share of vectors nearer to the first vector of their label than to that of the next label. One prototype a label: a bounded side."""
    v = shared.vectors(spark, sf)
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("p"), F.min("vec_id").alias("pid"))
    a = first.select(F.col("label").alias("la"), F.col("p").alias("a"), "pid")
    b = first.select(F.col("label").alias("lb"), F.col("p").alias("b"))
    t = v.join(a, F.col("label") == F.col("la")).join(b, (F.col("label") + 1) % 10 == F.col("lb")).filter("vec_id <> pid")
    hit = F.when(distance(F.col("embedding"), F.col("a")) < distance(F.col("embedding"), F.col("b")), 1.0).otherwise(0.0)
    return t.agg(F.round(F.avg(hit), 6).alias("accuracy"), F.count("*").alias("n"))


@query("vector_norm_stats", """WITH v AS (SELECT embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT unnest(v) AS x FROM v), n AS (SELECT sqrt(list_inner_product(v, v)) AS n FROM v)
SELECT round((SELECT avg(x) FROM x), 6) AS mean, round((SELECT stddev_samp(x) FROM x), 6) AS std, round((SELECT min(x) FROM x), 6) AS least, round((SELECT max(x) FROM x), 6) AS most,
round((SELECT avg(n) FROM n), 6) AS norm_mean, round((SELECT stddev_samp(n) FROM n), 6) AS norm_std, (SELECT count(*) FROM n) AS rows""")
def vector_norm_stats(spark: SparkSession, sf: str) -> DataFrame:
    v = shared.vectors(spark, sf).select("embedding", norm(F.col("embedding")).alias("n"))
    rows = v.agg(F.round(F.avg("n"), 6).alias("norm_mean"), F.round(F.stddev_samp("n"), 6).alias("norm_std"), F.count("*").alias("rows"))
    x = v.select(F.explode("embedding").alias("x")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"))
    return x.withColumn("_one", F.lit(1)).join(rows.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _bag(spark: SparkSession, sf: str, counted: bool) -> DataFrame:
    """Counts of the letters a to z in one pass over the bytes of each lower-cased text; of other characters no byte is a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.binary_join_element_wise(batch.column(1), "", "")
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            bags = [np.bincount(data[a:b], minlength=128)[97:123] for a, b in zip(ends, ends[1:], strict=False)]
            bags = [",".join(map(str, (x if counted else x > 0).astype(int).tolist())) for x in bags]
            known = batch.column(1).is_valid().to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "bag": pa.array([x if k else "" for x, k in zip(bags, known, strict=True)], pa.string())})

    return table(spark, sf, "documents").select("doc_id", F.lower("text").alias("t")).mapInArrow(run, "doc_id long, bag string")


@query("bag_of_chars_binary", f"SELECT doc_id, array_to_string(list_transform({_LETTERS}, lambda c: CASE WHEN contains(lower(text), c) THEN 1 ELSE 0 END), ',') AS bag FROM documents")
def bag_of_chars_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _bag(spark, sf, False)


@query("bag_of_chars_counts", f"SELECT doc_id, array_to_string(list_transform({_LETTERS}, lambda c: length(lower(text)) - length(replace(lower(text), c, ''))), ',') AS bag FROM documents")
def bag_of_chars_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _bag(spark, sf, True)


@query("trait_means", """WITH c AS (SELECT item_id, unnest(string_split(lower(text), '')) AS c FROM benchmark),
t AS (SELECT c AS k, CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN 1.0 ELSE 0.0 END AS vowel, CASE WHEN c IN ('m', 'n') THEN 1.0 ELSE 0.0 END AS nasal, CASE WHEN c IN ('p', 't', 'k', 'b', 'd', 'g') THEN 1.0 ELSE 0.0 END AS stop FROM (SELECT DISTINCT c FROM c WHERE c BETWEEN 'a' AND 'z'))
SELECT b.item_id, round(coalesce(avg(vowel), 0), 6) AS vowel, round(coalesce(avg(nasal), 0), 6) AS nasal, round(coalesce(avg(stop), 0), 6) AS stop, count(k) AS n
FROM benchmark b LEFT JOIN c ON b.item_id = c.item_id LEFT JOIN t ON c.c = t.k GROUP BY b.item_id""")
def trait_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean articulatory traits of a text's letters by a dictionary join; none found gives zeros."""
    # Vowels, nasals and stops of the Latin alphabet.
    traits = spark.createDataFrame([(c, float(c in "aeiou"), float(c in "mn"), float(c in "ptkbdg")) for c in ALPHABET], "k string, vowel double, nasal double, stop double")
    letters = table(spark, sf, "benchmark").select("item_id", F.explode_outer(F.split(F.lower("text"), "")).alias("c"))
    joined = letters.join(F.broadcast(traits), F.col("c") == F.col("k"), "left")
    return joined.groupBy("item_id").agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("vowel", "nasal", "stop")], F.count("k").alias("n"))


_TRAITS = "CASE WHEN c IN ('a', 'e', 'i', 'o', 'u') THEN '1' ELSE '0' END || CASE WHEN c IN ('m', 'n') THEN '1' ELSE '0' END || CASE WHEN c IN ('p', 't', 'k', 'b', 'd', 'g') THEN '1' ELSE '0' END"
_OF_LETTERS = f"list_transform(list_filter(string_split(lower(text), ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: {_TRAITS})"
FRAMES = 50


def _traits(text: Column) -> Column:
    """The traits of each letter of a text in turn, as three digits: vowel, nasal, stop; other characters are left out."""
    has = lambda c, letters: F.when(c.isin(list(letters)), "1").otherwise("0")
    letters = F.filter(F.split(F.lower(text), ""), lambda c: c.between("a", "z"))
    return F.transform(letters, lambda c: F.concat(has(c, "aeiou"), has(c, "mn"), has(c, "ptkbdg")))


@query("trait_flat", f"SELECT item_id, CASE WHEN len({_OF_LETTERS}) = 0 THEN '000' ELSE array_to_string({_OF_LETTERS}, '') END AS traits FROM benchmark")
def trait_flat(spark: SparkSession, sf: str) -> DataFrame:
    """The traits of all letters side by side; a text without any has one zero vector."""
    t = _traits(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.when(F.size(t) == 0, "000").otherwise(F.array_join(t, "")).alias("traits"))


@query("trait_fixed", f"SELECT item_id, array_to_string(list_slice(list_concat({_OF_LETTERS}, list_transform(range({FRAMES}), lambda i: '000')), 1, {FRAMES}), '') AS traits FROM benchmark")
def trait_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """The traits of exactly fifty letters: cut on the right or filled with zeros, then flat."""
    padded = F.slice(F.concat(_traits(F.col("text")), F.array_repeat(F.lit("000"), FRAMES)), 1, FRAMES)
    return table(spark, sf, "benchmark").select("item_id", F.array_join(padded, "").alias("traits"))


@query("alignment_uniformity", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.vec_id < b.vec_id)
SELECT round(avg(2 - 2 * c) FILTER (same), 6) AS alignment, round(ln(avg(exp(-2 * (2 - 2 * c)))), 6) AS uniformity FROM p""")
def alignment_uniformity(spark: SparkSession, sf: str) -> DataFrame:
    """Both measures in one row."""
    one, two = (df.withColumn("_k", F.lit(1)).drop("pairs") for df in (alignment_same_label(spark, sf), uniformity(spark, sf)))
    return one.join(two, "_k").drop("_k")


PAD = 64


@query("pad_truncate_mask", f"""WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id),
p AS (SELECT user_id, len(v) AS n, list_slice(list_concat(v, list_transform(range({PAD}), lambda i: 0.0)), 1, {PAD}) AS x FROM s)
SELECT user_id, n, round(list_sum(x), 4) AS total, round(x[{PAD}], 4) AS last, least(n, {PAD}) AS kept FROM p""")
def pad_truncate_mask(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda r: r["value"]).alias("v"))
    x, m = pad_or_cut(F.col("v"), PAD), mask_of(F.col("v"), PAD)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, y: s + y)
    return s.select("user_id", F.size("v").cast("long").alias("n"), F.round(add(x), 4).alias("total"), F.round(F.element_at(x, PAD), 4).alias("last"), F.aggregate(m, F.lit(0), lambda s, y: s + y).cast("long").alias("kept"))


@query("peak_normalize", """SELECT event_id, user_id, round(CASE WHEN max(abs(value)) OVER (PARTITION BY user_id) > 1e-8 THEN value / max(abs(value)) OVER (PARTITION BY user_id) ELSE value END, 6) AS value FROM events""")
def peak_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    top = e.groupBy(F.col("user_id").alias("_u")).agg(F.max(F.abs("value")).alias("_peak"))
    peak = F.col("_peak")
    return e.join(top, F.col("user_id").eqNullSafe(F.col("_u"))).select("event_id", "user_id", F.round(F.when(peak > 1e-8, F.col("value") / peak).otherwise(F.col("value")), 6).alias("value"))
