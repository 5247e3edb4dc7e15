"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.near_dedup import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85)


MIX_WEIGHTS = {"domain": {"low": 3.0, "high": 2.0, "other": 1.0}, "lang": {"en": 2.0, "de": 3.0, "fr": 3.0, "es": 2.0}, "source": {}}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.mixing import mix

    taken = mix(_read(spark, sf_dir, "documents"), MIX_WEIGHTS, fraction=0.6, max_epochs=2, seed=17)
    return taken.select("_row.doc_id", "domain", "_row.lang", "_row.source", "n_tokens", "copies")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.line_dedup import line_report

    return line_report(_read(spark, sf_dir, "documents"), whole=True)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plexure.llm.bpe import digests

    return digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.quality import score_documents

    return score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plexure.llm.token_file import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.langid import identify

    return identify(_read(spark, sf_dir, "documents"))


def op8_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.vector_dedup import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.topk import top_products

    return top_products(_read(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.secrets import scan_documents

    return scan_documents(_read(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plexure.llm.token_counts import token_counts

    return token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.codes import compress

    return compress(_read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexure.llm.hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", label))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {"pipeline": pipeline, "op1_near_dedup": op1_near_dedup, "op2_mixing": op2_mixing, "op3_line_dedup": op3_line_dedup, "op4_byte_bpe": op4_byte_bpe, "op5_quality": op5_quality, "op6_token_file": op6_token_file, "op7_language": op7_language, "op8_vector_dedup": op8_vector_dedup, "op9_topk": op9_topk, "op10_secrets": op10_secrets, "op11_token_counts": op11_token_counts, "op12_vector_codes": op12_vector_codes, "op13_hard_negatives": op13_hard_negatives}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SQL_1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM s), d AS (SELECT k, min(doc_id) AS doc_id FROM k WHERE n > 0 GROUP BY k),
g AS (SELECT doc_id, n, unnest(s) AS g FROM k WHERE doc_id IN (SELECT doc_id FROM d)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(c.c, k.doc_id) AS component_id, k.doc_id = coalesce(c.c, k.doc_id) AS kept FROM k LEFT JOIN d ON k.k = d.k AND k.n > 0 LEFT JOIN c ON c.a = d.doc_id"""


def _case(name: str) -> str:
    if not MIX_WEIGHTS[name]:
        return "1.0::DOUBLE"
    return f"(CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[name].items()) + " ELSE 1.0 END)::DOUBLE"


def _sql_2() -> str:
    """Shares level by level: full nodes take their capacity, the others what those leave, by weight."""
    levels = ("domain", "lang", "source")
    out = rf"""WITH t AS (SELECT doc_id, lang, source, regexp_extract(source, '([0-9])[^0-9]*$', 1) AS digit, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
d AS (SELECT doc_id, CASE WHEN digit = '' THEN 'other' WHEN digit < '5' THEN 'low' ELSE 'high' END AS domain, lang, source, n FROM t),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL),
l0 AS (SELECT *, CASE WHEN {" AND ".join(f"{_case(k)} > 0" for k in levels)} THEN tokens ELSE 0 END AS usable, (SELECT sum(tokens)::DOUBLE * 0.6::DOUBLE FROM leaf) AS b FROM leaf)"""
    for i, name in enumerate(levels):
        keys, above = ", ".join(levels[: i + 1]), ", ".join(levels[:i]) or "b"
        order = f"PARTITION BY {above} ORDER BY cap / w, {name}"
        out += f""",
n{i} AS (SELECT {keys}, b, sum(usable)::DOUBLE * 2 AS cap, {_case(name)} AS w FROM l{i} GROUP BY {keys}, b),
x{i} AS (SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
 sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM n{i} WHERE w > 0),
f{i} AS (SELECT *, cap / w <= (b - used) / onward * (1 + 1e-12) AS is_full FROM x{i}),
y{i} AS (SELECT {keys}, CASE WHEN is_full THEN cap ELSE greatest(0.0, b - coalesce(sum(cap) FILTER (is_full) OVER p, 0)) / sum(w) FILTER (NOT is_full) OVER p * w END AS b
 FROM f{i} WINDOW p AS (PARTITION BY {above})),
l{i + 1} AS (SELECT l.domain, l.lang, l.source, l.tokens, l.usable, y.b FROM l{i} l JOIN y{i} y USING ({keys}))"""
    return out + """,
f AS (SELECT *, floor(b + 1e-6)::BIGINT AS budget FROM l3), z AS (SELECT domain, lang, source, budget // tokens AS fl, budget % tokens AS rest FROM f WHERE budget > 0),
o AS (SELECT d.*, fl, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || (fl + 1) || ':' || doc_id)) AS upto FROM d JOIN z USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n AS n_tokens, fl + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS copies FROM o WHERE fl + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0"""


_SQL_8 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT a AS vec_id, (SELECT count(*) FROM l WHERE l.a = c.a) AS n_links, c AS component_id, a = c AS kept FROM c"""
_SQL_9 = """WITH q AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10"""


def _sql_12() -> str:
    """Parts as rows; each round meets all parts with all entries of their codebooks."""
    out = """WITH v AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS x FROM v, range(16) r(p)), b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64))"""
    for i in range(3):
        out += f""",
d{i} AS (SELECT x.vec_id, x.p, x.x, b.e, (x.x[1] - b.c[1]) ** 2 + (x.x[2] - b.c[2]) ** 2 + (x.x[3] - b.c[3]) ** 2 + (x.x[4] - b.c[4]) ** 2 AS d FROM x JOIN b{i} b ON x.p = b.p),
a{i} AS (SELECT vec_id, p, any_value(x) AS x, min(d) AS d, arg_min(e, d * 64 + e) AS e FROM d{i} GROUP BY vec_id, p)"""
        if i < 2:
            means = ", ".join(f"floor(sum(x[{k}]) / count(*))" for k in range(1, 5))
            out += f""",
m{i} AS (SELECT p, e, [{means}] AS c FROM a{i} GROUP BY p, e), b{i + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m ON b.p = m.p AND b.e = m.e)"""
    return out + """,
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS h FROM b2),
r AS (SELECT vec_id, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT r.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN v USING (vec_id), h"""


_SQL_13 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings WHERE label IS NOT NULL),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS rank FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10"""
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": _SQL_1, "op2_mixing": _sql_2(), "op8_vector_dedup": _SQL_8, "op9_topk": _SQL_9, "op12_vector_codes": _sql_12(), "op13_hard_negatives": _SQL_13}
