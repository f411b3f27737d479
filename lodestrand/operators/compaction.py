"""Conversation compaction: exact and reminder de-duplication, recency windows, error-aware stubs, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T

#: What stands in for removed content.
SAME_RESULT = "[identical to earlier tool result -- omitted]"
SAME_REMINDER = "<system-reminder>[elided — identical to earlier]</system-reminder>"
OMITTED_ATTACHMENT = "[attachment omitted]"


def dedupe_results(results: DataFrame) -> DataFrame:
    """``results(conv_id, seq, content)`` with later copies of one content in a conversation replaced.

    Blank content is never replaced. The first copy is found by an aggregate with map-side
    combine, so a content with very many copies is no single task's burden.
    """
    keyed = results.withColumn("content_key", F.sha2("content", 256))
    first = keyed.groupBy("conv_id", "content_key").agg(F.min("seq").alias("first_seq"))
    out = keyed.join(first, ["conv_id", "content_key"], "left")
    later = (F.col("seq") > F.col("first_seq")) & (T.strip(F.col("content")) != "")
    return out.withColumn("replaced", F.coalesce(later, F.lit(False))).withColumn("content", F.when(F.col("replaced"), SAME_RESULT).otherwise(F.col("content"))).drop("content_key", "first_seq")


def dedupe_reminders(messages: DataFrame) -> DataFrame:
    """``messages(conv_id, seq, text)`` with repeats of a reminder body in a conversation elided; the first, in order of seq and place, stays."""
    marked = messages.withColumn("bodies", F.regexp_extract_all("text", F.lit(r"(?s)<system-reminder>(.*?)</system-reminder>"), F.lit(1)))
    spots = marked.select("conv_id", "seq", F.posexplode("bodies").alias("place", "body")).withColumn("key", F.sha2("body", 256))
    firsts = spots.groupBy("conv_id", "key").agg(F.min(F.struct("seq", "place")).alias("first"))
    kept = spots.join(firsts, ["conv_id", "key"]).withColumn("again", (F.col("seq") != F.col("first.seq")) | (F.col("place") != F.col("first.place")))
    flags = kept.groupBy("conv_id", "seq").agg(F.array_sort(F.collect_list(F.struct("place", "again"))).alias("flags"))
    joined = marked.join(flags, ["conv_id", "seq"], "left")
    # The text between reminders, and the reminders by their flags, in turn.
    gaps = F.split("text", r"(?s)<system-reminder>.*?</system-reminder>", -1)
    whole = F.transform(
        gaps,
        lambda gap, i: F.concat(
            gap,
            F.when(i >= F.size("bodies"), F.lit("")).when(F.get(F.col("flags"), i)["again"], F.lit(SAME_REMINDER)).otherwise(F.concat(F.lit("<system-reminder>"), F.get("bodies", i), F.lit("</system-reminder>"))),
        ),
    )
    return joined.select(*messages.columns).drop("text").join(joined.select("conv_id", "seq", F.array_join(whole, "").alias("text")), ["conv_id", "seq"])


def strip_thinking(messages: DataFrame, keep_last: int) -> DataFrame:
    """``messages(conv_id, msg_idx, role, blocks)`` without thinking blocks of all but the last ``keep_last`` assistant messages.

    0 strips all, a negative number none. A message that would become empty stays as it is.
    """
    if keep_last < 0:
        return messages
    order = Window.partitionBy("conv_id", "role").orderBy(F.desc("msg_idx"))
    ranked = messages.withColumn("__age", F.row_number().over(order))
    left = F.filter("blocks", lambda b: b["type"] != "thinking")
    strip = (F.col("role") == "assistant") & (F.col("__age") > keep_last) & (F.size(left) > 0)
    return ranked.withColumn("blocks", F.when(strip, left).otherwise(F.col("blocks"))).drop("__age")


def errored_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, tool_use_id) of results that failed. A repeated call id has the name of its last call; a missing one ''."""
    names = calls.groupBy("conv_id", "tool_use_id").agg(F.max_by("name", "seq").alias("name"))
    joined = results.join(names, ["conv_id", "tool_use_id"], "left")
    return joined.where(T.is_error(F.col("is_error"), F.col("content"), F.coalesce("name", F.lit("")))).select("conv_id", "tool_use_id").distinct()


def stub_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` with ``input`` emptied unless the call's result failed; calls without a result are stubbed too."""
    errored = errored_calls(calls, results).withColumn("__errored", F.lit(True))
    out = calls.join(errored, ["conv_id", "tool_use_id"], "left")
    return out.withColumn("stubbed", F.col("__errored").isNull()).withColumn("input", F.when(F.col("stubbed"), "{}").otherwise(F.col("input"))).drop("__errored")


def large_but_recent(rows: DataFrame, column: str, min_bytes: int, keep_recent: int) -> DataFrame:
    """Rows whose ``column`` has at least ``min_bytes`` bytes, without the last ``keep_recent`` of those in each conversation."""
    eligible = rows.where(F.octet_length(column) >= min_bytes)
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("seq")))
    return eligible.withColumn("__age", age).where(F.col("__age") > keep_recent).drop("__age")


def before_last_user(messages: DataFrame) -> DataFrame:
    """Messages of a conversation other than its last user message, with ``last_user``, that message's number."""
    last = messages.where("role = 'user'").groupBy("conv_id").agg(F.max("msg_idx").alias("last_user"))
    return messages.join(last, "conv_id", "left").where(F.coalesce(F.col("msg_idx") != F.col("last_user"), F.lit(True)))


def hoist_system(messages: DataFrame) -> DataFrame:
    """(conv_id, system): non-empty texts of system messages, in order, joined by blank lines; null if there are none."""
    held = messages.where("role = 'system' and text <> ''").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "text"))).alias("s"))
    return held.select("conv_id", F.array_join("s.text", "\n\n").alias("system"))


def last_user_text(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "msg_idx").alias("text"))


def drop_attachments(messages: DataFrame) -> DataFrame:
    """``messages(blocks)`` without image and document blocks, with ``dropped``; an emptied message gets a placeholder."""
    left = F.filter("blocks", lambda b: ~b["type"].isin("image", "document"))
    dropped = F.size("blocks") - F.size(left)
    first = F.transform(F.slice("blocks", 1, 1), lambda b: b.withField("type", F.lit("text")).withField("text", F.lit(OMITTED_ATTACHMENT)))
    return messages.withColumn("dropped", dropped).withColumn("blocks", F.when((F.size(left) == 0) & (dropped > 0), first).otherwise(left))


def message_hash(messages: DataFrame) -> DataFrame:
    """(conv_id, content_hash) over role and rendered text of each message in order."""
    parts = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", F.concat("role", F.lit("\x1f"), "text", F.lit("\x1e")).alias("p")))).alias("s"))
    return parts.select("conv_id", F.sha2(F.array_join("s.p", ""), 256).alias("content_hash"))


def session_key(messages: DataFrame) -> DataFrame:
    """(conv_id, session_key): 16 hex digits from the first user message; 'empty' without one."""
    first = messages.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "msg_idx").alias("text"))
    key = F.left(F.sha2(F.concat(F.lit("user\x1f"), "text", F.lit("\x1e")), 256), F.lit(16))
    return messages.select("conv_id").distinct().join(first, "conv_id", "left").select("conv_id", F.coalesce(key, F.lit("empty")).alias("session_key"))


def render(blocks: Column) -> Column:
    """Text of blocks for hashing: texts, calls by name, results cut at 500 characters; thinking is left out."""
    shown = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "text", b["text"])
        .when(b["type"] == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(b["name"], F.lit("?")), F.lit("]")))
        .when(b["type"] == "tool_result", F.concat(F.lit("[tool_result: "), F.left(F.coalesce(b["text"], F.lit("")), F.lit(500)), F.lit("]")))
        .when(b["type"] == "image", F.lit("[image]")),
    )
    return F.array_join(F.filter(shown, lambda s: s.isNotNull() & (s != "")), " ")
