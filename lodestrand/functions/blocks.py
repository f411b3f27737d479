"""Folds over the block events of a message stream: normalising, closing, transcripts.

Each class takes one event at a time and keeps what it must know of the stream so far; all
are deterministic and can be pickled, so batch and streaming operators run them by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

Event = tuple[str, dict]
#: The kind of block that a delta belongs to.
KIND_OF_DELTA = {"text_delta": "text", "thinking_delta": "thinking", "signature_delta": "thinking", "input_json_delta": "tool_use"}


def dropped_kind(kind: object, thinking: bool) -> bool:
    """Whether blocks or deltas of a type are left out: all thinking, redacted or not, if ``thinking`` is off."""
    return isinstance(kind, str) and "thinking" in kind and not thinking


def stop_event(index: int) -> Event:
    return "content_block_stop", {"type": "content_block_stop", "index": index}


def start_event(index: int, block: dict) -> Event:
    return "content_block_start", {"type": "content_block_start", "index": index, "content_block": block}


@dataclass
class Segment:
    """A stretch of an upstream block under one index of ours."""

    index: int
    start: dict
    open: bool = True


@dataclass
class Normaliser:
    """Upstream block events under dense indexes of ours, one open block at a time.

    A start closes all other open blocks, whose own stops are then left out. A delta for a closed
    block opens it again under a new index; one for an unknown text or call opens it too.
    """

    thinking: bool = True
    next: int = 0
    segments: dict[int, Segment] = field(default_factory=dict)
    left_out: set[int] = field(default_factory=set)
    closed_by_us: set[int] = field(default_factory=set)

    def apply(self, name: str, data: dict) -> list[Event]:
        step: Callable | None = {"content_block_start": self._start, "content_block_delta": self._delta, "content_block_stop": self._stop}.get(name)
        own = step(data["index"], data) if step and isinstance(data.get("index"), int) else None
        return [(name, data)] if own is None else own

    def _open(self, upstream: int, start: dict) -> int:
        self.segments[upstream] = Segment(self.next, start)
        self.next += 1
        return self.next - 1

    def _start(self, upstream: int, data: dict) -> list[Event] | None:
        block = data.get("content_block")
        if not isinstance(block, dict) or not isinstance(block.get("type"), str):
            return None
        if dropped_kind(block["type"], self.thinking):
            self.left_out.add(upstream)
            return []
        others = {u: s for u, s in self.segments.items() if s.open and u != upstream}
        for segment in others.values():
            segment.open = False
        self.closed_by_us |= set(others)
        return [*(stop_event(s.index) for s in others.values()), ("content_block_start", {**data, "index": self._open(upstream, block)})]

    def _delta(self, upstream: int, data: dict) -> list[Event] | None:
        delta = data.get("delta")
        kind = KIND_OF_DELTA.get(delta.get("type")) if isinstance(delta, dict) else None
        if isinstance(delta, dict) and (upstream in self.left_out or dropped_kind(delta.get("type"), self.thinking)):
            return []
        segment = self.segments.get(upstream)
        if kind is None or segment is None and kind == "thinking":
            return None
        out = []
        if segment is None or not segment.open:
            self.closed_by_us.discard(upstream)
            block = self._empty(kind, upstream, segment.start if segment else {})
            out.append(start_event(self._open(upstream, segment.start if segment else block), block))
        return [*out, ("content_block_delta", {**data, "index": self.segments[upstream].index})]

    @staticmethod
    def _empty(kind: str, upstream: int, start: dict) -> dict:
        """A block that starts without content; a call keeps the id, name and input it had."""
        if kind != "tool_use":
            return {"type": kind, kind: ""}
        known = start if start.get("type") == "tool_use" else {}
        held = known.get("input")
        return {"type": kind, "id": known.get("id") or f"call_{upstream}", "name": known.get("name") or "", "input": held if isinstance(held, dict) else {}}

    def _stop(self, upstream: int, data: dict) -> list[Event] | None:
        segment = self.segments.get(upstream)
        if upstream in self.left_out or upstream in self.closed_by_us or segment is not None and not segment.open:
            self.closed_by_us.discard(upstream)
            return []
        if segment is None:
            return None if self.thinking else []
        segment.open = False
        return [("content_block_stop", {**data, "index": segment.index})]


@dataclass
class Emitted:
    """What has gone out of a message: its open blocks in the order they were opened, and whether it has ended."""

    open: dict[int, str] = field(default_factory=dict)
    highest: int = -1
    reason: str | None = None
    ended: bool = False

    def see(self, name: str, data: dict) -> None:
        index = data.get("index")
        if name == "content_block_start" and isinstance(index, int):
            self.highest = max(self.highest, index)
            self.open.pop(index, None)
            self.open[index] = str((data.get("content_block") or {}).get("type", ""))
        elif name == "content_block_stop":
            self.open.pop(index, None)
        elif name == "message_delta":
            self.reason = (data.get("delta") or {}).get("stop_reason") or self.reason
        self.ended |= name == "message_stop"

    def close(self) -> list[Event]:
        """Stops of the blocks that are open, the last opened first."""
        out = [stop_event(i) for i in reversed(self.open)]
        self.open.clear()
        return out

    def add(self, kind: str, text: str) -> list[Event]:
        """``text`` for the last open block of that kind (text or thinking), or for a new one."""
        if not text:
            return []
        at = next((i for i, k in reversed(self.open.items()) if k == kind), None)
        out = []
        if at is None:
            out = [start_event(at := self.highest + 1, {"type": kind, kind: ""})]
            self.see(*out[0])
        return [*out, ("content_block_delta", {"type": "content_block_delta", "index": at, "delta": {"type": f"{kind}_delta", kind: text}})]

    def finish(self, reason: str) -> list[Event]:
        """What a message that ends well still lacks."""
        out = self.close()
        if self.reason is None:
            out.append(("message_delta", {"type": "message_delta", "delta": {"stop_reason": reason, "stop_sequence": None}, "usage": {"input_tokens": 0, "output_tokens": 1}}))
        return out if self.ended else [*out, ("message_stop", {"type": "message_stop"})]


#: Names that a subagent goes by when its call has no id begin with this.
UNNAMED = "__task_"


@dataclass
class Transcript:
    """Typed rows of a client's events as segments: dicts with ``kind`` and what belongs to it.

    While a subagent (a call of Task) runs, thoughts and texts are left out and its calls only
    count in its segment. A result whose id equals, begins or continues that of a running
    subagent ends it and all that it started.
    """

    segments: list[dict] = field(default_factory=list)
    results: bool = True
    opened: dict[tuple[str, int], int] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)
    running: list[tuple[str, int]] = field(default_factory=list)

    def _add(self, kind: str, **parts: object) -> int:
        self.segments.append({"kind": kind, **parts})
        return len(self.segments) - 1

    def _close(self, index: int) -> None:
        at = next((k for k in ((kind, index) for kind in ("tool", "thinking", "text")) if k in self.opened), None)
        if at is not None:
            place = self.opened.pop(at)
            if at[0] == "tool":
                self.segments[place]["closed"] = True

    def apply(self, row: dict) -> None:
        what, _, how = str(row.get("type", "")).rpartition("_")
        index = row.get("index", -1)
        if what in ("thinking", "text"):
            if not self.running:
                self._said(what, how, index, str(row.get("text", "")))
        elif row.get("type") in ("tool_use", "tool_use_start"):
            self._call(row, index)
        elif row.get("type") in ("block_stop", "tool_use_stop"):
            self._close(index)
        elif row.get("type") == "tool_result":
            self._result(row)
        elif row.get("type") == "error":
            self._add("error", text=str(row.get("message", "")))

    def _said(self, kind: str, how: str, index: int, text: str) -> None:
        if how == "stop":
            self.opened.pop((kind, index), None)
            return
        if how == "start" and index >= 0:
            self._close(index)
        at = None if how == "start" else self.opened.get((kind, index))
        if at is None:
            at = self._add(kind, text="")
            if index >= 0:
                self.opened[kind, index] = at
        if how != "start":
            self.segments[at]["text"] += text

    def _call(self, row: dict, index: int) -> None:
        starting = row["type"] == "tool_use_start"
        if starting and index >= 0:
            self._close(index)
        call, name = str(row.get("id") or "").strip(), str(row.get("name") or "tool")
        if call:
            self.names[call] = name
        if name == "Task":
            given = row.get("input") if isinstance(row.get("input"), dict) else {}
            heading = next((h for k in ("description", "subagent_type", "type") if (h := str(given.get(k) or "").strip())), "Subagent")
            self.running.append((call or f"{UNNAMED}{len(self.running) + 1}", self._add("subagent", text=heading, calls=0, last="")))
            return
        if self.running:
            at = self.running[-1][1]
            self.segments[at] |= {"calls": self.segments[at]["calls"] + 1, "last": name}
        else:
            at = self._add("tool_call", id=call, text=name, closed=not starting)
        if starting and index >= 0:
            self.opened["tool", index] = at

    def _leave(self, call: str) -> bool:
        alike = lambda name: bool(name) and (name.startswith(call) or call.startswith(name))
        if call:
            depth = next((d for d in reversed(range(len(self.running))) if alike(self.running[d][0])), None)
        else:
            depth = len(self.running) - 1 if self.running and self.running[-1][0].startswith(UNNAMED) else None
        if depth is not None:
            del self.running[depth:]
        return depth is not None

    def _result(self, row: dict) -> None:
        call = str(row.get("tool_use_id") or "").strip()
        name = self.names.get(call)
        if self.running and not self._leave(call) and name in (None, "Task") and "task" in call.lower():
            self._leave("")  # a subagent without an id of its own
        if self.results:
            self._add("tool_result", id=call, text=row.get("content"), name=name, is_error=bool(row.get("is_error", False)))
