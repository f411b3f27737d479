"""Exact-content de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.registry import register
from lodestrand.sources.tables import table


@register(
    "w01_exact_dedup_savings",
    """
    WITH keyed AS (SELECT doc_id, lang, octet_length(encode(text)) AS bytes, sha256(text) AS content_key FROM documents),
    firsts AS (SELECT content_key, min(doc_id) AS first_id FROM keyed GROUP BY content_key)
    SELECT lang, count(*) AS n_documents, count(*) FILTER (WHERE k.doc_id <> f.first_id) AS n_replaced,
           coalesce(sum(bytes) FILTER (WHERE k.doc_id <> f.first_id), 0)::BIGINT AS bytes_saved
    FROM keyed k JOIN firsts f USING (content_key) GROUP BY lang
    """,
)
def exact_dedup_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01 over documents: the first copy of each text stays, later ones are replaced; savings by language.

    The first copy comes from an aggregate with map-side combine, not from a window, so that
    a text with very many copies is no single task's burden.
    """
    keyed = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("content_key"))
    firsts = keyed.groupBy("content_key").agg(F.min("doc_id").alias("first_id"))
    later = F.col("doc_id") != F.col("first_id")
    return (
        keyed.join(firsts, "content_key")
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(later).alias("n_replaced"), F.coalesce(F.sum(F.when(later, F.col("bytes"))), F.lit(0)).alias("bytes_saved"))
    )
