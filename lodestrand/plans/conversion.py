"""Token accounting, chat conversion, span de-duplication and JSON over derived messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import jsons as J
from lodestrand.operators import conversion as V
from lodestrand.operators import spans
from lodestrand.registry import register
from lodestrand.sources.derive import select
from lodestrand.sources.tables import table

#: Users of events as conversations: a user turn, then an assistant with a thought, a text, a call and a closing word, then its result.
MESSAGES = """
    SELECT user_id AS conv_id, event_id * 3 + m AS msg_idx, role, place, type, text, name, id, input, tool_use_id FROM (
      SELECT user_id, event_id, 0 AS m, 'user' AS role, 0 AS place, 'text' AS type, 'do ' || event_type AS text, CAST(NULL AS STRING) AS name, CAST(NULL AS STRING) AS id, CAST(NULL AS STRING) AS input, CAST(NULL AS STRING) AS tool_use_id FROM events
      UNION ALL SELECT user_id, event_id, 1, 'assistant', 0, 'thinking', 'plan ' || event_type, NULL, NULL, NULL, NULL FROM events
      UNION ALL SELECT user_id, event_id, 1, 'assistant', 1, 'text', 'I look', NULL, NULL, NULL, NULL FROM events
      UNION ALL SELECT user_id, event_id, 1, 'assistant', 2, 'tool_use', NULL, 'Read', 't' || CAST(event_id AS STRING), props, NULL FROM events
      UNION ALL SELECT user_id, event_id, 1, 'assistant', 3, 'text', 'so it is', NULL, NULL, NULL, NULL FROM events WHERE event_id % 2 = 0
      UNION ALL SELECT user_id, event_id, 2, 'user', 0, 'tool_result', 'result ' || event_type, NULL, NULL, NULL, 't' || CAST(event_id AS STRING) FROM events
      UNION ALL SELECT user_id, event_id, 2, 'user', 1, 'text', 'and', NULL, NULL, NULL, NULL FROM events
      UNION ALL SELECT user_id, event_id, 2, 'user', 2, 'text', 'then?', NULL, NULL, NULL, NULL FROM events) x
"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select(spark, sf_dir, MESSAGES)
    return rows.groupBy("conv_id", "msg_idx", "role").agg(F.array_sort(F.collect_list(F.struct("place", "type", "text", "name", "id", "input", "tool_use_id"))).alias("blocks"))


def _tokens_sql(framing: int, with_id: bool) -> str:
    return f"""
    WITH b AS ({MESSAGES}),
    t AS (SELECT conv_id, CASE type WHEN 'tool_use' THEN length(name) // 4 + length(input) // 4 + length(id) // 4 + 15 WHEN 'tool_result' THEN length(text) // 4 + 8 {"+ length(tool_use_id) // 4" if with_id else ""} ELSE length(text) // 4 END AS n FROM b),
    m AS (SELECT conv_id, count(DISTINCT msg_idx) AS k FROM b GROUP BY conv_id)
    SELECT t.conv_id, (sum(n) + {framing} * any_value(k))::BIGINT AS tokens FROM t JOIN m USING (conv_id) GROUP BY t.conv_id
    """


@register("a15_package_tokens", _tokens_sql(8, False))
def package_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of requests, with 8 a message."""
    return V.request_tokens(_messages(spark, sf_dir), 8, False)


@register("a16_core_tokens", _tokens_sql(4, True))
def core_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of requests, with 4 a message and the ids of results."""
    return V.request_tokens(_messages(spark, sf_dir), 4, True)


@register("v02_assistant_text", f"WITH b AS ({MESSAGES}) SELECT conv_id, msg_idx, string_agg(CASE type WHEN 'thinking' THEN '<think>' || chr(10) || text || chr(10) || '</think>' ELSE text END, chr(10) || chr(10) ORDER BY place) FILTER (WHERE type IN ('text', 'thinking')) AS content FROM b WHERE role = 'assistant' GROUP BY ALL")
def assistant_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant blocks as one text."""
    return _messages(spark, sf_dir).where("role = 'assistant'").select("conv_id", "msg_idx", V.assistant_text(F.col("blocks")).alias("content"))


@register("v03_user_messages", "SELECT user_id AS conv_id, event_id * 3 AS msg_idx, 1 AS place, 'user' AS role, 'do ' || event_type AS content FROM events UNION ALL SELECT user_id, event_id * 3 + 2, 1, 'tool', 'result ' || event_type FROM events UNION ALL SELECT user_id, event_id * 3 + 2, 2, 'user', 'and' || chr(10) || 'then?' FROM events")
def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User blocks split at results."""
    return V.user_messages(_messages(spark, sf_dir))


@register(
    "v01_to_chat",
    """
    SELECT user_id AS conv_id, role, count(*) AS n, sum(length(content))::BIGINT AS chars FROM (
      SELECT user_id, 'user' AS role, 'do ' || event_type AS content FROM events
      UNION ALL SELECT user_id, 'assistant', '<think>' || chr(10) || 'plan ' || event_type || chr(10) || '</think>' || chr(10) || chr(10) || 'I look' FROM events
      UNION ALL SELECT user_id, 'assistant', 'so it is' FROM events WHERE event_id % 2 = 0
      UNION ALL SELECT user_id, 'tool', 'result ' || event_type FROM events
      UNION ALL SELECT user_id, 'user', 'and' || chr(10) || 'then?' FROM events) x GROUP BY ALL
    """,
)
def to_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat messages; what follows a call waits for its result."""
    return V.to_chat(_messages(spark, sf_dir)).groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@register("v04_tool_choice", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"type":"function","function":{"name":"' || event_type || '"}}' WHEN 1 THEN 'required' WHEN 2 THEN 'auto' ELSE '{"type":"odd"}' END AS choice FROM events""")
def tool_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool choices in the chat form."""
    given = F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.lit("tool").alias("type"), F.col("event_type").alias("name")))).when(F.col("event_id") % 4 == 1, F.lit('{"type":"any"}')).when(F.col("event_id") % 4 == 2, F.lit('{"type":"auto"}')).otherwise('{"type":"odd"}')
    return table(spark, sf_dir, "events").select("event_id", V.tool_choice(given).alias("choice"))


@register("d01_dedupe_spans")
def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 40 groups as conversations; repeated runs of 70 words are deleted. Greedy, so no SQL."""
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("conv_id"), F.col("doc_id").alias("seq"), F.lit(False).alias("definer"), "text")
    return spans.dedupe_spans(rows, 70).select("conv_id", "seq", "changed", F.length("text").cast("long").alias("n_chars"))


@register("js2_complete_inputs", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN props END AS input, CASE WHEN event_id % 2 = 0 THEN 'ok"}' END AS repair FROM events""")
def complete_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS2, JS4: complete tool inputs, and repairs of cut ones."""
    given = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.lit("[1]")).otherwise('{"a": ')
    candidates = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("1}"), F.lit('ok"}'))).otherwise(F.array(F.lit("x")))
    return table(spark, sf_dir, "events").select("event_id", J.complete_object(given).alias("input"), J.repaired(F.lit('{"message":"'), candidates).alias("repair"))


@register("js8_session_ids", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 's' || user_id::VARCHAR END AS session_id FROM events")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS8: the session id of an event, by precedence of keys."""
    s, k = F.concat(F.lit("s"), F.col("user_id").cast("string")), F.col("event_id") % 4
    event = F.when(k == 0, F.to_json(F.struct(s.alias("session_id"), F.lit("x").alias("sessionId")))).when(k == 1, F.to_json(F.struct(s.alias("sessionId")))).when(k == 2, F.to_json(F.struct(F.struct(s.alias("session_id")).alias("metadata")))).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", J.session_id(event).alias("session_id"))


@register("js9_judges", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 1 + (event_id % 5)::INT END AS faithfulness, CASE event_id % 4 WHEN 1 THEN 'no_json' WHEN 2 THEN 'bad_json' WHEN 3 THEN 'bad_axes' END AS error FROM events")
def judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS9: scores in judges' answers, and what is wrong with the others."""
    k = F.col("event_id") % 4
    good = F.concat(F.lit('Sure: {"faithfulness": '), (F.col("event_id") % 5 + 1).cast("string"), F.lit(', "conciseness": 2, "risk_callout": 3, "note": "n"} ok'))
    text = F.when(k == 0, good).when(k == 1, F.lit("none")).when(k == 2, F.lit("{a: }")).otherwise('{"faithfulness": "x"}')
    return table(spark, sf_dir, "events").withColumn("j", J.judge(text)).select("event_id", "j.faithfulness", "j.error")


@register("p22_redact_json", """SELECT event_id, '{"a":{"auth_token":"<redacted>","n":' || user_id::VARCHAR || '},"list":[{"Password":"<redacted>"}]}' AS body FROM events""")
def redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret keys redacted at any depth."""
    body = F.concat(F.lit('{"a": {"auth_token": "x", "n": '), F.col("user_id").cast("string"), F.lit('}, "list": [{"Password": [1]}]}'))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"event_id": frame["event_id"], "body": frame["body"].map(J.redact_json)})

    return table(spark, sf_dir, "events").select("event_id", body.alias("body")).mapInPandas(run, "event_id long, body string")
