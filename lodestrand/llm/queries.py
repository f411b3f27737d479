"""The ten operators applied to their whole tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.chat_format import rotate
from lodestrand.llm.decontamination import contamination
from lodestrand.llm.language_id import identify
from lodestrand.llm.mixing import mix
from lodestrand.llm.near_dedup import near_duplicates
from lodestrand.llm.quality_classifier import classify
from lodestrand.llm.quality_rules import judge, train
from lodestrand.llm.secret_scan import secret_digest
from lodestrand.llm.sharding import assign
from lodestrand.llm.substring_dedup import removal
from lodestrand.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


@query(
    "op2_substring_dedup",
    r"""
    WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    starts AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
    twice AS (SELECT k FROM starts GROUP BY k HAVING count(*) > 1),
    ordered AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS j FROM starts SEMI JOIN twice USING (k)),
    gone AS (SELECT doc_id, unnest(range(greatest(i, coalesce(j + 35, i)), i + 35)) AS p FROM ordered),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words WHERE len(w) > 0),
    left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(l.n, 0))::BIGINT AS n_removed, sha256(coalesce(l.kept, '')) AS kept_sha256
    FROM words d LEFT JOIN left_over l USING (doc_id)
    """,
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(documents(spark, sf_dir), window=35)


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), n_shards=8)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


@query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


@query(
    "op7_decontamination",
    r"""
    WITH words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
    items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(13, len(w)) AS k FROM items WHERE len(w) > 0),
    patterns AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
    lengths AS (SELECT DISTINCT k FROM patterns),
    starts AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS p FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, lengths WHERE len(w) >= k)),
    hits AS (SELECT s.doc_id, s.k, s.i, b.item_id FROM starts s JOIN patterns b ON s.k = b.k AND s.p = b.p),
    hit_words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at_word FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
    hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
           coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.w) AS contaminated
    FROM words d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items t USING (doc_id)
    """,
)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(
    "op8_near_dedup",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM words WHERE len(w) > 1)
        UNION ALL SELECT doc_id, w[1] AS s FROM words WHERE len(w) = 1)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
    links AS (
      SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, node) AS (
      SELECT doc_id, doc_id FROM documents
      UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.node = e.a)
    SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(r.node) AS component_id, d.doc_id = min(r.node) AS kept
    FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id
    """,
)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), k=2, percent=80)


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no URL: a source stands for the host, and its languages for its paths."""
    docs = documents(spark, sf_dir)
    sited = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return classify(sited, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(
    "op10_chat_format",
    """
    WITH turns AS (SELECT DISTINCT conv_id, coalesce(turn // 64, 0)::BIGINT AS piece, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
    parted AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id, piece ORDER BY turn NULLS FIRST, role, text) - 1) // 512)::BIGINT AS part FROM turns),
    people AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
    headed AS (
      SELECT t.*, p.perspective, CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user name=' || role END AS header
      FROM parted t JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
    shown AS (SELECT *, '<|im_start|>' || header || chr(10) || text || '<|im_end|>' || chr(10) AS r FROM headed),
    placed AS (
      SELECT *, coalesce(sum(length(r)) OVER (PARTITION BY conv_id, piece, part, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at FROM shown)
    SELECT conv_id, piece, part, perspective, count(*) AS n_turns, count(*) FILTER (WHERE role = perspective) AS n_masked_in,
           string_agg(r, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
           coalesce(string_agg((begin_at + 13 + length(header))::VARCHAR || ':' || (begin_at + length(r) - 1)::VARCHAR, ',' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = perspective), '') AS spans
    FROM placed GROUP BY conv_id, piece, part, perspective
    """,
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"), everyone=True)
