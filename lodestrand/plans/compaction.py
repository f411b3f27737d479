"""Conversation compaction over derived tool calls and the driver's conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import compaction as C
from lodestrand.registry import register
from lodestrand.sources.derive import TOOL_CALLS, TOOL_RESULTS, select
from lodestrand.sources.tables import table

MESSAGES = "SELECT conv_id, turn AS msg_idx, role, text FROM conversations"
#: Messages as blocks: assistants think first, every fifth message has an image.
BLOCKS = """
    SELECT conv_id, msg_idx, role, type, text, name, place FROM (
      SELECT conv_id, turn AS msg_idx, role, 'thinking' AS type, 'hm ' || text AS text, CAST(NULL AS STRING) AS name, 0 AS place FROM conversations WHERE role = 'assistant'
      UNION ALL SELECT conv_id, turn, role, 'text', text, NULL, 1 FROM conversations WHERE (conv_id + turn) % 6 <> 5
      UNION ALL SELECT conv_id, turn, role, 'tool_use', NULL, 'Read', 2 FROM conversations WHERE role = 'assistant' AND turn % 3 = 0
      UNION ALL SELECT conv_id, turn, role, 'image', NULL, NULL, 3 FROM conversations WHERE (conv_id + turn) % 5 = 0
    ) b
"""
REMINDERS = """
    SELECT conv_id, turn AS seq, '<system-reminder>rule ' || CAST(turn % 3 AS STRING) || '</system-reminder>' || text || '<system-reminder>note ' || CAST(conv_id % 4 AS STRING) || '</system-reminder>!' AS text FROM conversations
"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = select(spark, sf_dir, BLOCKS)
    return rows.groupBy("conv_id", "msg_idx", "role").agg(F.array_sort(F.collect_list(F.struct("place", "type", "text", "name"))).alias("blocks"))


_ERRORED = rf"""
    calls AS ({TOOL_CALLS}), results AS ({TOOL_RESULTS}),
    joined AS (SELECT r.*, coalesce(c.name, '') AS name FROM results r LEFT JOIN calls c USING (conv_id, tool_use_id)),
    errored AS (SELECT DISTINCT conv_id, tool_use_id FROM joined WHERE coalesce(is_error, false)
      OR (name = 'Bash' AND (regexp_matches(lower(content), '<bash-stderr>') OR regexp_matches(lower(content), '\bexit code:\s*([1-9]\d*)\b') OR regexp_matches(lower(content), '\bexit status\s*([1-9]\d*)\b')))
      OR (name IN ('Bash', 'WebFetch', 'WebSearch') AND regexp_matches(lower(content), 'traceback|error:|enoent|permission denied|failed:|fatal:|command not found')))
"""


@register("p01_strip_ansi", "SELECT doc_id, sha256(text) AS stripped FROM documents")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal escapes are removed, here from texts that were coloured."""
    docs = table(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    coloured = F.concat(F.lit("\x1b[1;31m"), F.left("text", half), F.lit("\x1b[0m\x1bM"), F.right("text", F.length("text") - half))
    return docs.select("doc_id", F.sha2(T.strip_ansi(coloured), 256).alias("stripped"))


@register(
    "p02_head_tail",
    """
    WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
    SELECT doc_id, sha256(CASE WHEN len(l) > 20 THEN array_to_string(l[1:5], chr(10)) || chr(10) || '... [' || (len(l) - 10)::VARCHAR || ' lines omitted] ...' || chr(10) || array_to_string(l[len(l) - 4 : len(l)], chr(10)) ELSE text END) AS cut, len(l) > 20 AS was_cut FROM lines
    """,
)
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of more than 20 lines keep 5 at either end."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(T.head_tail(F.col("text"), 20, 5, 5), 256).alias("cut"), (F.size(F.split("text", "\n")) > 20).alias("was_cut"))


@register(
    "p03_strip_thinking",
    f"""
    WITH b AS ({BLOCKS}), m AS (SELECT DISTINCT conv_id, msg_idx, role FROM b),
    aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY msg_idx DESC) AS age FROM m),
    sizes AS (SELECT conv_id, msg_idx, count(*) FILTER (WHERE type <> 'thinking') AS others FROM b GROUP BY ALL)
    SELECT b.conv_id, b.msg_idx, string_agg(b.type, ',' ORDER BY place) AS types FROM b JOIN aged a USING (conv_id, msg_idx, role) JOIN sizes s USING (conv_id, msg_idx)
    WHERE NOT (b.type = 'thinking' AND b.role = 'assistant' AND age > 2 AND others > 0) GROUP BY b.conv_id, b.msg_idx
    """,
)
def strip_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinking stays in the last two assistant messages."""
    out = C.strip_thinking(_blocks(spark, sf_dir), 2)
    return out.select("conv_id", "msg_idx", F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("types"))


@register("p04_large_texts", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents WHERE octet_length(encode(text)) >= 4000")
def large_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of at least 4000 UTF-8 bytes."""
    return table(spark, sf_dir, "documents").where(F.octet_length("text") >= 4000).select("doc_id", F.octet_length("text").cast("long").alias("bytes"))


@register("j01_errored_calls", f"WITH {_ERRORED} SELECT conv_id, tool_use_id FROM errored")
def errored_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose result failed, by flag, shell failure mark or error word."""
    return C.errored_calls(select(spark, sf_dir, TOOL_CALLS), select(spark, sf_dir, TOOL_RESULTS))


@register(
    "p06_stub_calls",
    f"WITH {_ERRORED} SELECT c.conv_id, c.tool_use_id, CASE WHEN e.tool_use_id IS NULL THEN '{{}}' ELSE c.input END AS input, e.tool_use_id IS NULL AS stubbed FROM calls c LEFT JOIN errored e USING (conv_id, tool_use_id)",
)
def stub_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of calls that did not fail are emptied."""
    return C.stub_calls(select(spark, sf_dir, TOOL_CALLS), select(spark, sf_dir, TOOL_RESULTS)).select("conv_id", "tool_use_id", "input", "stubbed")


@register(
    "w01_dedupe_results",
    f"""
    WITH r AS ({TOOL_RESULTS}), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sha256(content) ORDER BY seq) AS k FROM r)
    SELECT conv_id, tool_use_id, CASE WHEN k > 1 AND trim(content) <> '' THEN '{C.SAME_RESULT}' ELSE content END AS content FROM n
    """,
)
def dedupe_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of a tool result in a conversation are replaced."""
    return C.dedupe_results(select(spark, sf_dir, TOOL_RESULTS)).select("conv_id", "tool_use_id", "content")


@register(
    "w02_dedupe_reminders",
    f"""
    WITH m AS (SELECT conv_id, turn AS seq, 'rule ' || (turn % 3)::VARCHAR AS b1, 'note ' || (conv_id % 4)::VARCHAR AS b2, text AS mid FROM conversations),
    spots AS (SELECT conv_id, seq, 0 AS place, b1 AS body FROM m UNION ALL SELECT conv_id, seq, 1, b2 FROM m),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, body ORDER BY seq, place) AS k FROM spots),
    shown AS (SELECT conv_id, seq, place, CASE WHEN k > 1 THEN '{C.SAME_REMINDER}' ELSE '<system-reminder>' || body || '</system-reminder>' END AS s FROM ranked)
    SELECT m.conv_id, m.seq, x.s || m.mid || y.s || '!' AS text FROM m JOIN shown x ON x.conv_id = m.conv_id AND x.seq = m.seq AND x.place = 0 JOIN shown y ON y.conv_id = m.conv_id AND y.seq = m.seq AND y.place = 1
    """,
)
def dedupe_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated reminders in a conversation are elided."""
    return C.dedupe_reminders(select(spark, sf_dir, REMINDERS)).select("conv_id", "seq", "text")


@register(
    "w04_digest_candidates",
    """
    WITH e AS (SELECT user_id AS conv_id, event_id AS seq, props FROM events WHERE octet_length(encode(props)) >= 9),
    aged AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq DESC) AS age FROM e)
    SELECT conv_id, seq FROM aged WHERE age > 3
    """,
)
def digest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with large input, without the last three large ones of a conversation."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("seq"), "props")
    return C.large_but_recent(rows, "props", 9, 3).select("conv_id", "seq")


@register(
    "w05_history_candidates",
    "WITH l AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS last_user FROM conversations GROUP BY conv_id) SELECT conv_id, turn AS msg_idx, last_user FROM conversations JOIN l USING (conv_id) WHERE (last_user IS NULL OR turn <> last_user) AND octet_length(encode(text)) >= 300",
)
def history_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large messages other than the last user message."""
    return C.before_last_user(select(spark, sf_dir, MESSAGES)).where(F.octet_length("text") >= 300).select("conv_id", "msg_idx", "last_user")


@register("p13_hoist_system", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS system FROM conversations WHERE role = 'system' AND text <> '' GROUP BY conv_id")
def hoist_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System messages become the request's system text."""
    return C.hoist_system(select(spark, sf_dir, MESSAGES))


@register("p14_last_user_text", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user text."""
    return C.last_user_text(select(spark, sf_dir, MESSAGES))


@register(
    "p15_drop_attachments",
    f"""
    WITH b AS ({BLOCKS})
    SELECT conv_id, msg_idx, CASE WHEN count(*) FILTER (WHERE type <> 'image') = 0 THEN 'text' ELSE string_agg(type, ',' ORDER BY place) FILTER (WHERE type <> 'image') END AS types, count(*) FILTER (WHERE type = 'image') AS dropped FROM b GROUP BY conv_id, msg_idx
    """,
)
def drop_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and documents are dropped."""
    out = C.drop_attachments(_blocks(spark, sf_dir))
    return out.select("conv_id", "msg_idx", F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("types"), F.col("dropped").cast("long").alias("dropped"))


@register("h01_message_hash", "SELECT conv_id, sha256(string_agg(role || chr(31) || text || chr(30), '' ORDER BY turn)) AS content_hash FROM conversations GROUP BY conv_id")
def message_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash over a conversation's messages."""
    return C.message_hash(select(spark, sf_dir, MESSAGES))


@register(
    "h02_session_key",
    "SELECT c.conv_id, coalesce(substr(sha256('user' || chr(31) || u.text || chr(30)), 1, 16), 'empty') AS session_key FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) u USING (conv_id)",
)
def session_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's key."""
    return C.session_key(select(spark, sf_dir, MESSAGES))


@register(
    "f02_render",
    f"""
    WITH b AS ({BLOCKS}), s AS (SELECT conv_id, msg_idx, place, CASE type WHEN 'text' THEN text WHEN 'tool_use' THEN '[tool_use: ' || name || ']' WHEN 'image' THEN '[image]' END AS s FROM b)
    SELECT conv_id, msg_idx, sha256(coalesce(string_agg(s, ' ' ORDER BY place) FILTER (WHERE s IS NOT NULL AND s <> ''), '')) AS rendered FROM s GROUP BY conv_id, msg_idx
    """,
)
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blocks as flat text."""
    return _blocks(spark, sf_dir).select("conv_id", "msg_idx", F.sha2(C.render(F.col("blocks")), 256).alias("rendered"))


@register("a21_saved_bytes", f"WITH r AS ({TOOL_RESULTS}), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, sha256(content) ORDER BY seq) AS k FROM r) SELECT conv_id, sum(octet_length(encode(content)))::BIGINT AS before, sum(CASE WHEN k > 1 AND trim(content) <> '' THEN {len(C.SAME_RESULT)} ELSE octet_length(encode(content)) END)::BIGINT AS after FROM n GROUP BY conv_id")
def saved_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes before and after a step."""
    rows = select(spark, sf_dir, TOOL_RESULTS)
    before = rows.groupBy("conv_id").agg(F.sum(F.octet_length("content")).alias("before"))
    return before.join(C.dedupe_results(rows).groupBy("conv_id").agg(F.sum(F.octet_length("content")).alias("after")), "conv_id")
