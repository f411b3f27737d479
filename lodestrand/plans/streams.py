"""Stream parsers, run over streams derived from conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.registry import register
from lodestrand.sources.derive import select
from lodestrand.streaming import stateful



def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = select(spark, sf_dir, "SELECT conv_id, turn, CASE WHEN role = 'user' THEN '<think>' || text || '</think>' ELSE text END AS s FROM conversations")
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "s"))).alias("t")).select(F.col("conv_id").cast("string").alias("stream_id"), F.array_join("t.s", "").alias("s"))
    spots = F.sequence(F.lit(0), F.floor((F.length("s") - 1) / 37))
    return whole.select("stream_id", F.explode(spots).alias("seq"), "s").select("stream_id", "seq", F.expr("substring(s, CAST(seq * 37 + 1 AS INT), 37)").alias("chunk"))


@register(
    "st01_think_split",
    """
    SELECT conv_id::VARCHAR AS stream_id, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, '' ORDER BY turn), '') AS thinking, coalesce(string_agg(CASE WHEN role <> 'user' THEN text END, '' ORDER BY turn), '') AS said FROM conversations GROUP BY conv_id
    """,
)
def think_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, ST01: thoughts and text of streams whose tags are cut by chunk ends."""
    parts = stateful.split_thinking(_chunks(spark, sf_dir))
    texts = parts.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("part", "kind", "content"))).alias("p"))
    of = lambda kind: F.array_join(F.transform(F.filter("p", lambda x: x["kind"] == kind), lambda x: x["content"]), "")
    return texts.select("stream_id", of("thinking").alias("thinking"), of("text").alias("said"))


@register(
    "st02_text_tool_calls",
    """SELECT user_id::VARCHAR AS stream_id, count(*) AS n_calls, string_agg(event_type || ' ' || event_id::VARCHAR, ',' ORDER BY event_id) AS calls, repeat('before ', count(*)::INT) AS said FROM events GROUP BY user_id""",
)
def text_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST02: calls written as text, a stream of them for each user."""
    chunks = select(
        spark,
        sf_dir,
        """SELECT CAST(user_id AS STRING) AS stream_id, event_id * 3 AS seq, 'before ● <func' AS chunk FROM events
           UNION ALL SELECT CAST(user_id AS STRING), event_id * 3 + 1, 'tion=' || event_type || '><parameter=path>' || CAST(event_id AS STRING) || '</para' FROM events
           UNION ALL SELECT CAST(user_id AS STRING), event_id * 3 + 2, 'meter>' FROM events""",
    )
    parts = stateful.extract_calls(chunks).withColumn("c", F.from_json("content", "name string, input map<string,string>"))
    of = lambda kind, value: F.array_join(F.transform(F.filter("p", lambda x: x["kind"] == kind), value), "," if kind == "tool_use" else "")
    found = parts.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("part", "kind", "content", F.concat_ws(" ", "c.name", F.element_at("c.input", "path")).alias("call")))).alias("p"))
    return found.select("stream_id", F.size(F.filter("p", lambda x: x["kind"] == "tool_use")).cast("long").alias("n_calls"), of("tool_use", lambda x: x["call"]).alias("calls"), of("text", lambda x: x["content"]).alias("said"))


@register("s13_sse_frames", "SELECT event_type AS event, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY event_type")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Server-sent lines framed to events."""
    lines = select(
        spark,
        sf_dir,
        """SELECT CAST(user_id AS STRING) AS stream_id, event_id * 4 AS seq, 'event: ' || event_type AS chunk FROM events
           UNION ALL SELECT CAST(user_id AS STRING), event_id * 4 + 1, 'data: {"user":' FROM events
           UNION ALL SELECT CAST(user_id AS STRING), event_id * 4 + 2, 'data: ' || CAST(user_id AS STRING) || '}' FROM events
           UNION ALL SELECT CAST(user_id AS STRING), event_id * 4 + 3, '' FROM events""",
    )
    framed = stateful.frame_events(lines)
    return framed.groupBy(F.col("kind").alias("event")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("content", "$.user").cast("long")).alias("total"))


@register(
    "st08_contract",
    """
    SELECT user_id::VARCHAR AS stream_id, concat_ws('; ', CASE WHEN user_id % 5 = 1 THEN 'no start' END, CASE WHEN user_id % 5 = 2 THEN 'no stop' END, CASE WHEN user_id % 5 = 3 THEN '0 left open' END, CASE WHEN user_id % 5 = 4 THEN 'input_json_delta for text' END) AS breaks FROM (SELECT DISTINCT user_id FROM events)
    """,
)
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST08: what streams break of the block contract."""
    events = select(
        spark,
        sf_dir,
        """
        SELECT CAST(user_id AS STRING) AS stream_id, seq, event, data FROM (
          SELECT DISTINCT user_id, 0 AS seq, 'message_start' AS event, '{}' AS data FROM events WHERE user_id % 5 <> 1
          UNION ALL SELECT DISTINCT user_id, 1, 'content_block_start', '{"index":0,"content_block":{"type":"text","text":""}}' FROM events
          UNION ALL SELECT DISTINCT user_id, 2, 'content_block_delta', CASE WHEN user_id % 5 = 4 THEN '{"index":0,"delta":{"type":"input_json_delta"}}' ELSE '{"index":0,"delta":{"type":"text_delta"}}' END FROM events
          UNION ALL SELECT DISTINCT user_id, 3, 'content_block_stop', '{"index":0}' FROM events WHERE user_id % 5 <> 3
          UNION ALL SELECT DISTINCT user_id, 4, CASE WHEN user_id % 5 = 2 THEN 'message_delta' ELSE 'message_stop' END, '{}' FROM events) x
        """,
    )
    return stateful.check_contract(events)


@register("s14_json_lines", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE '{\"type\":\"raw\",\"content\":\"' || event_type || ' {\"}' END AS value FROM events")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are JSON, and others wrapped."""
    rows = select(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props ELSE event_type || ' {' END AS value FROM events")
    wrapped = F.to_json(F.struct(F.lit("raw").alias("type"), F.trim("value").alias("content")))
    return rows.select("event_id", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(wrapped).alias("value"))
