"""Keyed stateful operators for batch and Structured Streaming.

Batch: chunks of a stream are gathered by key and run in order. Streaming: the parser's
state is kept by key between micro-batches; chunks of a micro-batch are run in order of
``seq``, so a source must deliver a stream's chunks in order between micro-batches. An idle
stream's rest is emitted when its event-time timeout passes.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrand.functions import blocks as B
from lodestrand.functions import streams as S

PARTS = "stream_id string, part int, kind string, content string"


def _rows(key: str, parts: Iterable[tuple[str, str]], begin: int = 0) -> pd.DataFrame:
    rows = [(key, begin + i, kind, content) for i, (kind, content) in enumerate(parts)]
    return pd.DataFrame(rows, columns=["stream_id", "part", "kind", "content"]).astype({"part": "int32"})


def merged(parts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbouring parts of one kind as one, so that the result does not depend on how the stream was cut."""
    out: list[tuple[str, str]] = []
    for kind, content in parts:
        if out and out[-1][0] == kind and kind != "tool_use":
            out[-1] = (kind, out[-1][1] + content)
        else:
            out.append((kind, content))
    return out


def split_thinking(chunks: DataFrame) -> DataFrame:
    """(stream_id, part, kind, content) of the batch ``chunks(stream_id, seq, chunk)``, parts of one kind merged."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        splitter, parts = S.ThinkSplitter(), []
        for chunk in frame.sort_values("seq")["chunk"]:
            parts += splitter.feed(chunk or "")
        return _rows(frame["stream_id"].iloc[0], merged(parts + splitter.flush()))

    return chunks.groupBy("stream_id").applyInPandas(run, PARTS)


def extract_calls(chunks: DataFrame) -> DataFrame:
    """Like ``split_thinking``, for tool calls written as text."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame["stream_id"].iloc[0]
        finder, parts = S.ToolCallExtractor(key=key), []
        for chunk in frame.sort_values("seq")["chunk"]:
            parts += finder.feed(chunk or "")
        return _rows(key, merged(parts + finder.feed("", last=True)))

    return chunks.groupBy("stream_id").applyInPandas(run, PARTS)


def frame_events(lines: DataFrame) -> DataFrame:
    """(stream_id, part, kind, content): event names and data of the batch ``lines(stream_id, seq, chunk)`` of server-sent lines."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _rows(frame["stream_id"].iloc[0], S.frame_events([c or "" for c in frame.sort_values("seq")["chunk"]]))

    return lines.groupBy("stream_id").applyInPandas(run, PARTS)


def check_contract(events: DataFrame) -> DataFrame:
    """(stream_id, breaks) of ``events(stream_id, seq, event, data)``; breaks is empty for a sound stream."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq")
        found = S.contract_breaks([(e, json.loads(d or "{}")) for e, d in zip(frame["event"], frame["data"])])
        return pd.DataFrame({"stream_id": [frame["stream_id"].iloc[0]], "breaks": ["; ".join(found)]})

    return events.groupBy("stream_id").applyInPandas(run, "stream_id string, breaks string")


def split_thinking_stream(chunks: DataFrame, idle: str = "10 minutes") -> DataFrame:
    """``split_thinking`` for a streaming ``chunks(stream_id, seq, ts, chunk)`` with a watermark on ts; parts as they come."""
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, inside, part = state.get if state.exists else ("", False, 0)
        splitter = S.ThinkSplitter(held, inside)
        if state.hasTimedOut:
            state.remove()
            yield _rows(key[0], splitter.flush(), part)
            return
        frame = pd.concat(list(frames)).sort_values("seq")
        parts = [p for chunk in frame["chunk"] for p in splitter.feed(chunk or "")]
        state.update((splitter.held, splitter.inside, part + len(parts)))
        state.setTimeoutTimestamp(max(int(frame["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + millis)
        yield _rows(key[0], parts, part)

    return chunks.groupBy("stream_id").applyInPandasWithState(run, PARTS, "held string, inside boolean, part int", "append", GroupStateTimeout.EventTimeTimeout)


def limited_stream(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """(key, seq, allowed) of a streaming ``events(key, seq, ts)``: at most ``most`` allowed events in any window of ``seconds``."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values(["ts", "seq"])
        allowed = []
        for now in frame["ts"].map(lambda t: t.timestamp()):
            recent = [t for t in recent if t > now - seconds]
            allowed.append(len(recent) < most)
            if allowed[-1]:
                recent.append(now)
        state.update((recent,))
        yield pd.DataFrame({"key": key[0], "seq": frame["seq"].to_numpy(), "allowed": allowed})

    return events.groupBy("key").applyInPandasWithState(run, "key string, seq long, allowed boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def delivered_once(messages: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """A streaming ``messages(ts, ...)`` without later copies of a key that come within ``delay``."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def json_lines(lines: DataFrame) -> DataFrame:
    """(value) of ``lines(value)``: the line if it is JSON, else {"type": "raw", "content": line}; blank lines are dropped. Batch or streaming."""
    text = F.trim("value")
    wrapped = F.to_json(F.struct(F.lit("raw").alias("type"), text.alias("content")))
    return lines.where(text != "").select(F.when(F.try_parse_json(text).isNotNull(), text).otherwise(wrapped).alias("value"))


EVENTS = "stream_id string, part int, event string, data string"


def _event_frame(key: str, events: list[tuple[str, dict]], begin: int = 0) -> pd.DataFrame:
    rows = [(key, begin + i, name, json.dumps(data, ensure_ascii=False, sort_keys=True)) for i, (name, data) in enumerate(events)]
    return pd.DataFrame(rows, columns=["stream_id", "part", "event", "data"]).astype({"part": "int32"})


def _read(frame: pd.DataFrame) -> Iterator[tuple[str, dict]]:
    frame = frame.sort_values("seq")
    return zip(frame["event"], (json.loads(d or "{}") for d in frame["data"]))


def normalised(events: DataFrame, thinking: bool = True) -> DataFrame:
    """(stream_id, part, event, data) of ``events(stream_id, seq, event, data)``: block events under dense indexes (``blocks.Normaliser``)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fold = B.Normaliser(thinking)
        return _event_frame(frame["stream_id"].iloc[0], [e for name, data in _read(frame) for e in fold.apply(name, data)])

    return events.groupBy("stream_id").applyInPandas(run, EVENTS)


def normalised_stream(events: DataFrame, thinking: bool = True) -> DataFrame:
    """``normalised`` for a streaming ``events``; the fold of a stream is its state."""

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, part = (pickle.loads(bytes(state.get[0])), state.get[1]) if state.exists else (B.Normaliser(thinking), 0)
        out = [e for name, data in _read(pd.concat(list(frames))) for e in fold.apply(name, data)]
        state.update((pickle.dumps(fold), part + len(out)))
        yield _event_frame(key[0], out, part)

    return events.groupBy("stream_id").applyInPandasWithState(run, EVENTS, "fold binary, part int", "append", GroupStateTimeout.NoTimeout)


def success_tails(events: DataFrame, reason: str) -> DataFrame:
    """(stream_id, tail) of ``events(stream_id, seq, event, data)``: the indexes of blocks that have to be closed, in order, then the missing message events."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sent = B.Emitted()
        for name, data in _read(frame):
            sent.see(name, data)
        tail = sent.finish(reason)
        stops = ",".join(str(d["index"]) for n, d in tail if n == "content_block_stop")
        return pd.DataFrame({"stream_id": [frame["stream_id"].iloc[0]], "tail": [";".join([stops, *[n for n, _ in tail if n != "content_block_stop"]])]})

    return events.groupBy("stream_id").applyInPandas(run, "stream_id string, tail string")


def transcripts(rows: DataFrame) -> DataFrame:
    """(stream_id, part, kind, content, calls) of ``rows(stream_id, seq, data)``, typed rows of a client's events; calls counts those of a subagent."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        fold = B.Transcript()
        for data in frame.sort_values("seq")["data"]:
            fold.apply(json.loads(data))
        found = [(frame["stream_id"].iloc[0], i, s["kind"], s["text"] if isinstance(s["text"], str) else json.dumps(s["text"]), s.get("calls")) for i, s in enumerate(fold.segments)]
        return pd.DataFrame(found, columns=["stream_id", "part", "kind", "content", "calls"]).astype({"part": "int32", "calls": "Int64"})

    return rows.groupBy("stream_id").applyInPandas(run, "stream_id string, part int, kind string, content string, calls long")
