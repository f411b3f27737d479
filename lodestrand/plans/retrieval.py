"""Ranked retrieval over documents, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import retrieval as V
from lodestrand.registry import register
from lodestrand.sources.tables import table

_BM25 = """
    WITH t AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents),
    s AS (SELECT doc, len(ts) AS length, len(list_filter(ts, lambda x: x = 'with')) AS a, len(list_filter(ts, lambda x: x = 'from')) AS b FROM t),
    g AS (SELECT count(*) AS n, avg(length) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM s),
    r AS (SELECT doc, -(greatest(ln((n - da + 0.5) / (da + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * length / mean))) - (greatest(ln((n - db + 0.5) / (db + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM s, g WHERE a > 0 AND b > 0)
    SELECT doc, round(score, 8) AS score FROM r ORDER BY r.score, doc LIMIT 20
"""


@register("g01_bm25", _BM25)
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for two terms, both required."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return V.bm25(docs, ["with", "from"], 20).select("doc", F.round("score", 8).alias("score"))


@register(
    "g01_postings",
    "SELECT term, count(*) AS n_docs, sum(tf)::BIGINT AS n FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term HAVING count(*) >= 20",
)
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequencies of terms in at least 20 documents."""
    found = V.postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n")).where("n_docs >= 20")


#: A query vector stated in full.
_QUERY = [((i * 37) % 19 - 9) / 10.0 for i in range(64)]


@register(
    "t02_cosine_top_k",
    f"SELECT vec_id, round(score, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, {_QUERY}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 10",
)
def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of a query vector."""
    return V.cosine_top_k(table(spark, sf_dir, "embeddings"), _QUERY, 10).select("vec_id", F.round("score", 6).alias("score"))


@register(
    "w11_sections",
    """
    SELECT doc_id AS doc, 0 AS position, 'a/' || doc_id::VARCHAR || '.md' AS path, sha256(text) AS body_hash FROM documents
    UNION ALL SELECT doc_id, 1, 'b.md', sha256('tail') FROM documents
    """,
)
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a rendered index at file headers."""
    text = F.concat(F.lit("intro\n## File: a/"), F.col("doc_id").cast("string"), F.lit(".md\n"), F.col("text"), F.lit("\n## File: b.md\ntail"))
    out = V.sections(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text")))
    return out.select("doc", "position", "path", F.sha2("body", 256).alias("body_hash"))


@register("w10_chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-aligned overlapping chunks of every document."""
    return V.chunked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@register(
    "f31_hit_suffix",
    f"SELECT string_agg('- ' || vec_id::VARCHAR, chr(10) ORDER BY s DESC, vec_id) AS suffix FROM (SELECT vec_id, s FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, {_QUERY}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 5)",
)
def hit_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of a query as text."""
    hits = V.cosine_top_k(table(spark, sf_dir, "embeddings"), _QUERY, 5)
    lines = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "vec_id"))).alias("h"))
    return lines.select(F.array_join(F.transform("h", lambda h: F.concat(F.lit("- "), h["vec_id"].cast("string"))), "\n").alias("suffix"))
