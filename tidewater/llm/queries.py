"""The registered query of each operator, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import audit, blockjoin, bpe, covertree, lm, packing, quality, secrets, similar, simhash, substring, toxicity, vafile, warc
from tidewater.llm.common import row_key, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockjoin.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", ~quality.held_out(F.col("doc_id"), 5, 0))
    return quality.classify(docs, model, 5, 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id"), 4, 2))
    return toxicity.classify(docs, model, 4, 2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences without two documents of a source or of a near-duplicate component."""
    docs = table(spark, sf_dir, "documents")
    keep = {"source": F.col("source"), "n_tokens": packing.count_words(F.col("text"))} | dict(zip(("k1", "k2"), row_key(F.col("doc_id"), F.col("text")), strict=True))
    return packing.pack(similar.near_duplicates(docs, keep=keep).withColumnRenamed("component_id", "cluster"))


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    return covertree.hard_negatives(table(spark, sf_dir, "embeddings"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label), every=100)


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), quality.held_out(F.col("doc_id"), 10, 0))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_exact_top_k": op2_exact_top_k,
    "op3_nearest": op3_nearest,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_substring": op7_substring,
    "op8_secrets": op8_secrets,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_warc": op10_warc,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_language_model": op12_language_model,
    "op13_divergence": op13_divergence,
}

_USABLE = "embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

ORACLES: dict[str, str] = {
    "op2_exact_top_k": f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE {_USABLE}),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_nearest": f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_USABLE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_substring": """
        WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
        f AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (k) WHERE first < doc_id),
        p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        r AS (SELECT p.doc_id, count(c.p) AS n, string_agg(word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
        SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, """
    + " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, {1 + 10 * g}, 10))::BIGINT >> {35 - 5 * j}) & 31 AS INTEGER), 1)" for g in range(4) for j in range(8))
    + """ AS payload_digest,
        CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f""",
    "op11_hard_negatives": f"""
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND {_USABLE}),
        s AS (SELECT a.r AS a, a.vec_id AS anchor_id, c.r AS c, c.vec_id, c.label = a.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
              FROM v a JOIN v c ON len(a.e) = len(c.e) AND (a.vec_id <> c.vec_id OR a.label <> c.label) WHERE a.vec_id % 100 = 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
        f AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
              FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.n <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM f WHERE rank <= 5""",
    "op13_divergence": """
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
        t AS (SELECT lang, source, term, r, count(*) AS n FROM (SELECT lang, source, r, unnest(ts) AS term FROM d) GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
        l AS (SELECT lang, count(*) AS v, sum(total) AS of FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, sum(n) AS of FROM c GROUP BY lang, source),
        g AS (SELECT DISTINCT lang, source FROM d),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // (coalesce(s.of, 0) + 5 * l.v) AS p,
                1 + CAST(1000000000 AS HUGEINT) * (k.total + 5) // (l.of + 5 * l.v) AS q
              FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50""",
}
