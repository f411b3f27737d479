"""Folds of block events and transcripts, over streams derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.registry import register
from lodestrand.sources.derive import select
from lodestrand.streaming import stateful

#: Blocks of a user's events, one after the other; every fifth is a thought, every seventh gets no stop of its own.
BLOCK_EVENTS = """
    SELECT CAST(user_id AS STRING) AS stream_id, event_id * 3 AS seq, 'content_block_start' AS event, '{"index":' || CAST(event_id AS STRING) || ',"content_block":{"type":"' || CASE WHEN event_id % 5 = 0 THEN 'thinking' ELSE 'text' END || '"}}' AS data FROM events
    UNION ALL SELECT CAST(user_id AS STRING), event_id * 3 + 1, 'content_block_delta', '{"index":' || CAST(event_id AS STRING) || ',"delta":{"type":"' || CASE WHEN event_id % 5 = 0 THEN 'thinking' ELSE 'text' END || '_delta"}}' FROM events
    UNION ALL SELECT CAST(user_id AS STRING), event_id * 3 + 2, 'content_block_stop', '{"index":' || CAST(event_id AS STRING) || '}' FROM events WHERE event_id % 7 <> 0
"""


@register(
    "st05_normalised",
    """
    WITH b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS is_last FROM events WHERE event_id % 5 <> 0)
    SELECT user_id::VARCHAR AS stream_id, max(i) AS highest, count(*) AS starts, count(*) AS deltas, count(*) FILTER (WHERE NOT is_last OR event_id % 7 <> 0) AS stops, sum(i)::BIGINT AS places FROM b GROUP BY user_id
    """,
)
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST05, P20, X32, X33: upstream blocks under dense indexes, without thoughts, one open at a time."""
    out = stateful.normalised(select(spark, sf_dir, BLOCK_EVENTS), thinking=False)
    of = lambda name: F.col("event") == f"content_block_{name}"
    index = F.get_json_object("data", "$.index").cast("long")
    counts = out.groupBy("stream_id").agg(
        F.max(index).alias("highest"), *[F.count_if(of(n)).alias(f"{n}s") for n in ("start", "delta", "stop")], F.sum(F.when(of("start"), index)).alias("places")
    )
    return counts


@register(
    "st06_tails",
    """
    WITH b AS (SELECT user_id, event_id FROM events WHERE event_id % 7 = 0)
    SELECT user_id::VARCHAR AS stream_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id DESC) || ';message_delta;message_stop' AS tail FROM b GROUP BY user_id
    UNION ALL SELECT DISTINCT user_id::VARCHAR, ';message_delta;message_stop' FROM events WHERE user_id NOT IN (SELECT user_id FROM b)
    """,
)
def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST06, ST06b, X30: what streams lack that end with blocks open, the last opened closed first."""
    return stateful.success_tails(select(spark, sf_dir, BLOCK_EVENTS), "end_turn")


#: A user's events as a client's rows: every fourth is a subagent that speaks and reads, the others are texts.
CLIENT_ROWS = """
    SELECT CAST(user_id AS STRING) AS stream_id, event_id * 4 AS seq, CASE WHEN event_id % 4 = 0 THEN '{"type":"tool_use","id":"Task' || CAST(event_id AS STRING) || '","name":"Task","input":{"description":"' || event_type || '"}}' ELSE '{"type":"text_chunk","text":"' || event_type || '"}' END AS data FROM events
    UNION ALL SELECT CAST(user_id AS STRING), event_id * 4 + 1, '{"type":"thinking_chunk","text":"not shown"}' FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT CAST(user_id AS STRING), event_id * 4 + 2, '{"type":"tool_use","id":"r","name":"Read","input":{}}' FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT CAST(user_id AS STRING), event_id * 4 + 3, '{"type":"tool_result","tool_use_id":"Task' || CAST(event_id AS STRING) || '.out","content":"done"}' FROM events WHERE event_id % 4 = 0
"""


@register(
    "st09_transcripts",
    """
    SELECT user_id::VARCHAR AS stream_id, string_agg(CASE WHEN event_id % 4 = 0 THEN 'subagent ' || event_type || ' 1,tool_result done' ELSE 'text ' || event_type END, ',' ORDER BY event_id) AS shown FROM events GROUP BY user_id
    """,
)
def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST09, ST10: transcripts without what subagents say; a result's id continues that of its subagent."""
    rows = stateful.transcripts(select(spark, sf_dir, CLIENT_ROWS))
    line = F.concat_ws(" ", "kind", "content", F.col("calls").cast("string"))
    held = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("part", line.alias("line")))).alias("l"))
    return held.select("stream_id", F.array_join("l.line", ",").alias("shown"))


@register(
    "t07_excerpts",
    "SELECT doc_id, sha256(right(text, 2400)) AS excerpt, sha256(array_to_string(l[greatest(1, len(l) - 29) : len(l)], chr(10))) AS last_lines FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)",
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 2400 characters, and the last 30 lines, of every document."""
    lines = F.split("text", "\n")
    last = F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 29), 30)
    return select(spark, sf_dir, "SELECT doc_id, text FROM documents").select("doc_id", F.sha2(F.right("text", F.lit(2400)), 256).alias("excerpt"), F.sha2(F.array_join(last, "\n"), 256).alias("last_lines"))


@register("x21_drained_queue", "SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 4 = 0 THEN 'error' WHEN o_orderkey % 4 = 1 THEN 'in_progress' WHEN o_orderkey % 4 = 2 THEN 'completed' ELSE 'error' END AS state, CASE WHEN o_orderkey % 4 = 0 THEN 'cancelled' END AS message FROM orders")
def drained_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits in a queue is drained and marked as cancelled."""
    from lodestrand.sources.derive import NODES

    waits = F.col("state") == "pending"
    return select(spark, sf_dir, NODES).select("node_id", F.when(waits, "error").otherwise(F.col("state")).alias("state"), F.when(waits, "cancelled").alias("message"))


@register("x55_real_sessions", "SELECT e.event_id, coalesce('real' || a.user_id::VARCHAR, 'temp' || e.user_id::VARCHAR) AS session_id FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_id % 50 = 0) a ON e.user_id = a.user_id")
def real_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary session ids replaced by the real ones that have been registered for them."""
    aliases = select(spark, sf_dir, "SELECT DISTINCT 'temp' || CAST(user_id AS STRING) AS session_id, 'real' || CAST(user_id AS STRING) AS real_id FROM events WHERE event_id % 50 = 0")
    seen = select(spark, sf_dir, "SELECT event_id, 'temp' || CAST(user_id AS STRING) AS session_id FROM events")
    return seen.join(aliases, "session_id", "left").select("event_id", F.coalesce("real_id", "session_id").alias("session_id"))


@register("st18_placeholders", "SELECT conv_id, 'Truncation placeholder (' || count(*)::VARCHAR || ' messages)' AS header, count(*) AS omitted FROM conversations GROUP BY conv_id")
def placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST18c, X34: the header of the block that stands for messages no summary came for; the same for the same count."""
    counted = select(spark, sf_dir, "SELECT conv_id FROM conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("omitted"))
    return counted.select("conv_id", F.concat(F.lit("Truncation placeholder ("), F.col("omitted").cast("string"), F.lit(" messages)")).alias("header"), "omitted")
