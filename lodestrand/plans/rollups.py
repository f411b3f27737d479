"""Grouped analytics: lint digests, benchmark rollups, outcome counts, cache statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import rollups
from lodestrand.registry import register
from lodestrand.sources.derive import CELLS, FINDINGS, SCORES, select

_SUMMARY = f"""
    cells AS ({CELLS}), scores AS ({SCORES}),
    ok AS (SELECT * FROM cells WHERE status = 'ok'),
    base AS (SELECT model, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status <> 'ok') AS n_fail,
                    quantile_cont(latency_seconds, 0.5) FILTER (WHERE status = 'ok') AS p50, quantile_cont(latency_seconds, 0.95) FILTER (WHERE status = 'ok') AS p95 FROM cells GROUP BY model),
    groups AS (SELECT model, category, fixture, CASE WHEN count(DISTINCT output_text) = 1 THEN 1.0 ELSE 0.0 END AS same FROM ok GROUP BY ALL),
    stab AS (SELECT model, avg(same) AS stability FROM groups GROUP BY model),
    caps(category, cap) AS (VALUES ('diff', 900), ('test', 700), ('lint', 500)),
    viol AS (SELECT model, count(*) AS cap_violations FROM ok JOIN caps USING (category) WHERE output_chars > cap GROUP BY model),
    qual AS (SELECT s.model, avg((faithfulness + conciseness + risk_callout) / 3.0) AS quality FROM scores s JOIN (SELECT DISTINCT model, category, fixture FROM cells) c USING (model, category, fixture) WHERE error IS NULL GROUP BY s.model),
    errs AS (SELECT model, count(*) AS judge_errors FROM scores WHERE error IS NOT NULL GROUP BY model),
    summary AS (SELECT b.*, coalesce(stability, 0.0) AS stability, coalesce(cap_violations, 0) AS cap_violations, quality, coalesce(judge_errors, 0) AS judge_errors
                FROM base b LEFT JOIN stab USING (model) LEFT JOIN viol USING (model) LEFT JOIN qual USING (model) LEFT JOIN errs USING (model))
"""


@register(
    "a01_lint_digest",
    f"""
    WITH findings AS ({FINDINGS})
    SELECT rule_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT file)), ',') AS files, arg_min(message, seq) AS example,
           row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS position FROM findings GROUP BY rule_id
    """,
)
def lint_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule, most frequent first, ties by first appearance."""
    return rollups.digest_by_rule(select(spark, sf_dir, FINDINGS))


@register("a02_model_summary", f"WITH {_SUMMARY} SELECT model, n_ok, n_fail, round(p50, 6) AS p50, round(p95, 6) AS p95, round(stability, 6) AS stability, cap_violations, round(quality, 6) AS quality, judge_errors FROM summary")
def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts, latency percentiles, stability, cap violations and quality of each model."""
    out = rollups.summarise_models(select(spark, sf_dir, CELLS), select(spark, sf_dir, SCORES))
    return out.select("model", "n_ok", "n_fail", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "stability")], "cap_violations", F.round("quality", 6).alias("quality"), "judge_errors")


@register(
    "a06_composite_ranking",
    f"""
    WITH {_SUMMARY},
    scaled AS (SELECT *, coalesce(quality, 2.5) / 5.0 AS q, coalesce((p95 - min(p95) OVER ()) / greatest(max(p95) OVER () - min(p95) OVER (), 1e-6), 1.0) AS slow FROM summary),
    scored AS (SELECT *, 0.5 * q + 0.3 * (1 - slow) + 0.2 * stability AS composite FROM scaled)
    SELECT model, round(composite, 6) AS composite, row_number() OVER (ORDER BY composite DESC, model) AS position,
           concat_ws(',', CASE WHEN stability < 1 THEN 'unstable' END, CASE WHEN cap_violations > 1 THEN 'over_cap' END, CASE WHEN n_fail > 0 THEN 'failures' END, CASE WHEN judge_errors > 0 THEN 'judge_errors' END) AS flags
    FROM scored
    """,
)
def composite_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite of quality, min-max latency and stability; flags; rank."""
    out = rollups.rank_models(rollups.summarise_models(select(spark, sf_dir, CELLS), select(spark, sf_dir, SCORES)))
    return out.select("model", F.round("composite", 6).alias("composite"), "position", "flags")


@register(
    "a10_outcome_counts",
    """
    WITH outcomes AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'passed' WHEN 1 THEN 'skipped' ELSE 'failed' END AS outcome, 'test_' || event_type AS nodeid,
                      CASE event_id % 10 WHEN 2 THEN 'Connection refused' WHEN 3 THEN 'HARNESS_BUG' WHEN 4 THEN 'missing_env KEY' WHEN 5 THEN 'smoke target disabled' WHEN 6 THEN 'upstream provider down' WHEN 7 THEN 'request timed out' ELSE 'assert' END AS detail FROM events),
    texts AS (SELECT *, lower(nodeid || chr(10) || detail) AS t FROM outcomes),
    classed AS (SELECT *, CASE WHEN outcome = 'passed' THEN 'passed'
      WHEN outcome = 'skipped' AND contains(t, 'smoke target disabled') THEN 'target_disabled'
      WHEN outcome = 'skipped' AND contains(t, 'missing_env') THEN 'missing_env'
      WHEN outcome = 'skipped' AND regexp_matches(t, 'upstream_unavailable|connection refused|connecterror|readtimeout|timed out|not reachable') THEN 'upstream_unavailable'
      WHEN outcome = 'skipped' THEN 'missing_env'
      WHEN contains(t, 'harness_bug') THEN 'harness_bug' WHEN contains(t, 'missing_env') THEN 'missing_env'
      WHEN regexp_matches(t, 'upstream_unavailable|connection refused|connecterror|readtimeout|timed out|not reachable|upstream provider') THEN 'upstream_unavailable'
      ELSE 'product_failure' END AS classification FROM texts)
    SELECT classification, count(*) AS n, bool_or(classification IN ('product_failure', 'harness_bug')) AS regression FROM classed GROUP BY classification
    """,
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified test outcomes."""
    rows = select(
        spark,
        sf_dir,
        """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'passed' WHEN 1 THEN 'skipped' ELSE 'failed' END AS outcome, 'test_' || event_type AS nodeid,
           CASE event_id % 10 WHEN 2 THEN 'Connection refused' WHEN 3 THEN 'HARNESS_BUG' WHEN 4 THEN 'missing_env KEY' WHEN 5 THEN 'smoke target disabled' WHEN 6 THEN 'upstream provider down' WHEN 7 THEN 'request timed out' ELSE 'assert' END AS detail FROM events""",
    )
    classed = rows.withColumn("classification", rollups.classify_outcome(F.col("nodeid"), F.col("outcome"), F.col("detail")))
    return classed.groupBy("classification").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("classification").isin("product_failure", "harness_bug")).alias("regression"))


@register(
    "a19_cache_hits",
    """
    WITH usage AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS cache_read, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN event_id % 70 END AS cache_creation, CASE WHEN event_id % 3 = 1 THEN event_id % 40 END AS cached, event_id % 100 AS prompt FROM events),
    parts AS (SELECT CASE WHEN cache_read IS NULL AND cache_creation IS NULL THEN coalesce(cached, 0) ELSE coalesce(cache_read, 0) END AS hit,
                     coalesce(cache_creation, 0) AS miss FROM usage)
    SELECT sum(hit)::BIGINT AS hit, sum(miss)::BIGINT AS miss, round(100.0 * sum(hit) / nullif(sum(hit) + sum(miss), 0), 6) AS hit_percent FROM parts
    """,
)
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hits and misses over two usage shapes."""
    usage = select(
        spark,
        sf_dir,
        "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS cache_read, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN event_id % 70 END AS cache_creation, CASE WHEN event_id % 3 = 1 THEN event_id % 40 END AS cached, event_id % 100 AS prompt FROM events",
    )
    return rollups.cache_totals(usage)


@register(
    "a23_evidence_counts",
    """SELECT doc_id, (len(text) - len(replace(text, 'th', ''))) // 2 AS n_th, (len(text) - len(replace(text, '$$', ''))) // 2 AS n_dollars,
       greatest((len(text) - len(replace(text, 'the', ''))) // 3, (len(text) - len(replace(text, 'and', ''))) // 3, (len(text) - len(replace(text, 'der', ''))) // 3) AS most FROM documents""",
)
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping occurrences of literals, and the greatest of three counters."""
    from lodestrand.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    n = lambda literal: rollups.occurrences(F.col("text"), literal)
    return docs.select("doc_id", n("th").alias("n_th"), n("$$").alias("n_dollars"), F.greatest(n("the"), n("and"), n("der")).alias("most"))


@register(
    "a25_ordered_sources",
    "SELECT o_custkey AS ref, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS sources, min(o_orderkey) AS first_seen FROM orders GROUP BY o_custkey",
)
def ordered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with the ordered list of where they come from."""
    from lodestrand.sources.tables import table

    orders = table(spark, sf_dir, "orders")
    return (
        orders.groupBy(F.col("o_custkey").alias("ref"))
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"), F.min("o_orderkey").alias("first_seen"))
        .select("ref", F.array_join("s.o_orderpriority", ",").alias("sources"), "first_seen")
    )


@register(
    "a26_stream_totals",
    """SELECT user_id AS stream_id, count(*) AS n_chunks, sum(octet_length(encode(props)))::BIGINT AS n_bytes, count(*) // 20 AS n_progress, CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE 'complete' END AS outcome FROM events GROUP BY user_id""",
)
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk and byte totals of each stream, progress marks and outcome (batch form)."""
    from lodestrand.sources.tables import table

    return rollups.stream_totals(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("props").alias("chunk"), (F.col("event_type") == "error").alias("failed")))


@register(
    "a27_chat_message_ids",
    "SELECT o_custkey AS chat_id, count(DISTINCT m) AS n_messages FROM (SELECT o_custkey, o_orderkey AS m FROM orders UNION ALL SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END FROM orders) WHERE m IS NOT NULL GROUP BY o_custkey",
)
def chat_message_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct incoming and status message ids of a chat."""
    from lodestrand.sources.tables import table

    orders = table(spark, sf_dir, "orders")
    ids = orders.select(F.col("o_custkey").alias("chat_id"), F.explode(F.array("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1))).alias("m"))
    return ids.where("m is not null").groupBy("chat_id").agg(F.countDistinct("m").alias("n_messages"))


@register(
    "t10_auto_limits",
    "SELECT n, least(20 + n // 10, 100) AS top_n, least(8000 + floor(sqrt(n))::BIGINT * 1200, 56000) AS token_ceiling FROM (SELECT o_custkey AS c, count(*) * 37 AS n FROM orders GROUP BY 1)",
)
def auto_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic top-n and token ceiling from a file count."""
    from lodestrand.sources.tables import table

    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) * 37).alias("n"))
    return n.select("n", F.least(20 + F.expr("n div 10"), F.lit(100)).alias("top_n"), F.least(8000 + F.floor(F.sqrt("n")) * 1200, F.lit(56000)).alias("token_ceiling"))
