"""Token accounting and conversion of block messages to chat messages.

Blocks: array<struct<type, text, name, id, input, tool_use_id>>; text holds the text, the
thought or the rendered result. Tokens are counted by a pluggable expression; the default
is a quarter of the characters.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Counter = Callable[[Column], Column]


def quarter(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def _block_tokens(b: Column, n: Counter, with_result_id: bool) -> Column:
    result = n(b["text"]) + 8
    return (
        F.when(b["type"].isin("text", "thinking"), n(b["text"]))
        .when(b["type"] == "tool_use", n(b["name"]) + n(b["input"]) + n(b["id"]) + 15)
        .when(b["type"] == "tool_result", result + n(b["tool_use_id"]) if with_result_id else result)
        .when(b["type"] == "image", F.lit(765).cast("long") if with_result_id else n(F.to_json(b)))
        .otherwise(n(F.to_json(b)))
    )


def request_tokens(messages: DataFrame, framing: int = 8, with_result_id: bool = False, n: Counter = quarter) -> DataFrame:
    """(conv_id, tokens) of ``messages(conv_id, msg_idx, blocks)``.

    Two counters are in use and differ by design: one adds 8 a message (4 twice) and does
    not count a result's call id; the other adds 4 and counts it, and an image is 765. The
    count is at least 1.
    """
    per = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + _block_tokens(b, n, with_result_id))
    return messages.groupBy("conv_id").agg(F.greatest(F.sum(per + framing), F.lit(1)).alias("tokens"))


def assistant_text(blocks: Column, mode: str = "tags") -> Column:
    """An assistant message's content: texts, and thoughts in tags if ``mode`` is tags, joined by blank lines; a space if there is nothing and no call."""
    shown = F.transform(
        blocks,
        lambda b: F.when(b["type"] == "text", b["text"]).when((b["type"] == "thinking") & (mode == "tags"), F.concat(F.lit("<think>\n"), b["text"], F.lit("\n</think>"))),
    )
    joined = F.array_join(F.array_compact(shown), "\n\n")
    calls = F.exists(blocks, lambda b: b["type"] == "tool_use")
    return F.when((joined == "") & ~calls, " ").otherwise(joined)


def user_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, msg_idx, place, role, content): user blocks as chat messages; runs of text are one message, every result a tool message."""
    blocks = messages.where("role = 'user'").select("conv_id", "msg_idx", F.posexplode("blocks").alias("i", "b")).where("b.type in ('text', 'tool_result')")
    order = Window.partitionBy("conv_id", "msg_idx").orderBy("i")
    result = F.col("b.type") == "tool_result"
    grouped = blocks.withColumn("__starts", F.when(result | F.coalesce(F.lag(result).over(order), F.lit(True)), 1).otherwise(0)).withColumn("place", F.sum("__starts").over(order))
    return (
        grouped.groupBy("conv_id", "msg_idx", "place")
        .agg(F.array_sort(F.collect_list(F.struct("i", F.col("b.text").alias("t")))).alias("ts"), F.max(F.when(result, 1).otherwise(0)).alias("is_result"))
        .select("conv_id", "msg_idx", F.col("place").cast("int").alias("place"), F.when(F.col("is_result") == 1, "tool").otherwise("user").alias("role"), F.array_join("ts.t", "\n").alias("content"))
    )


CHAT = "conv_id long, place int, role string, content string, tool_call_id string, calls string"


def to_chat(messages: DataFrame, mode: str = "tags") -> DataFrame:
    """(conv_id, place, role, content, tool_call_id, calls): whole conversations as chat messages.

    What an assistant says after its calls waits until every call has its result; if the
    results do not come before the next assistant message or plain user message, it is said then.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        waiting: list[str] = []
        open_calls: set[str] = set()

        def say(role, content, call=None, calls=None):
            out.append((role, content, call, calls))

        def release():
            nonlocal waiting
            if waiting:
                say("assistant", "\n\n".join(waiting))
            waiting = []
            open_calls.clear()

        for role, blocks in zip(frame["role"], frame["blocks"]):
            blocks = [dict(b.asDict() if hasattr(b, "asDict") else b) for b in blocks]
            kinds = [b["type"] for b in blocks]
            if role == "assistant":
                release()
                first = kinds.index("tool_use") if "tool_use" in kinds else len(blocks)
                shown = [f"<think>\n{b['text']}\n</think>" if b["type"] == "thinking" else b["text"] for b in blocks if b["type"] == "text" or b["type"] == "thinking" and mode == "tags"]
                split = sum(k in ("text", "thinking") and (k == "text" or mode == "tags") for k in kinds[:first])
                calls = [{"id": b["id"], "name": b["name"], "arguments": b["input"]} for b in blocks if b["type"] == "tool_use"]
                say("assistant", "\n\n".join(shown[:split]) or ("" if calls else " "), None, json.dumps(calls, sort_keys=True) if calls else None)
                waiting, open_calls = shown[split:], {c["id"] for c in calls} if shown[split:] else set()
                continue
            if role == "user" and waiting and "tool_result" not in kinds:
                release()
            texts: list[str] = []
            for b in blocks:
                if b["type"] == "text":
                    texts.append(b["text"] or "")
                elif b["type"] == "tool_result":
                    if texts:
                        say(role, "\n".join(texts))
                        texts = []
                    say("tool", b["text"] or "", b["tool_use_id"])
                    open_calls.discard(b["tool_use_id"])
                    if waiting and not open_calls:
                        release()
            if texts:
                say(role, "\n".join(texts))
        release()
        rows = pd.DataFrame(out, columns=["role", "content", "tool_call_id", "calls"])
        rows.insert(0, "place", range(len(rows)))
        rows.insert(0, "conv_id", frame["conv_id"].iloc[0])
        return rows

    ordered = messages.select("conv_id", "msg_idx", "role", "blocks")
    return ordered.groupBy("conv_id").applyInPandas(lambda frame: run(frame.sort_values("msg_idx")), CHAT)


def tool_choice(choice: Column) -> Column:
    """The chat form of a tool choice given as JSON: a function by name, required, or the word itself."""
    kind, name = F.get_json_object(choice, "$.type"), F.get_json_object(choice, "$.name")
    function = F.to_json(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name")).alias("function")))
    return F.when((kind == "tool") & (F.coalesce(name, F.lit("")) != ""), function).when(kind == "any", F.lit("required")).when(kind.isin("auto", "none", "required"), kind).otherwise(choice)
