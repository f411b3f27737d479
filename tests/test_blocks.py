"""Folds of block events on small streams, and a stream against its batch."""

import json

from pyspark.sql import functions as F

from lodestrand.functions.blocks import Emitted, Normaliser, Transcript
from lodestrand.operators import graph as G
from lodestrand.streaming import stateful


def start(i, kind="text", **more):
    return "content_block_start", {"index": i, "content_block": {"type": kind, **more}}


def delta(i, kind="text_delta"):
    return "content_block_delta", {"index": i, "delta": {"type": kind}}


def stop(i):
    return "content_block_stop", {"index": i}


def short(events):
    return [(n.removeprefix("content_block_"), d.get("index")) for n, d in events]


def run(fold, events):
    return [e for name, data in events for e in fold.apply(name, data)]


def test_normaliser():
    assert short(run(Normaliser(), [start(4), delta(4), stop(4), start(9), stop(9)])) == [("start", 0), ("delta", 0), ("stop", 0), ("start", 1), ("stop", 1)]
    overlap = [start(0), start(1, "tool_use", id="t", name="n"), delta(0), stop(0), delta(1, "input_json_delta"), stop(1), stop(1)]
    assert short(run(Normaliser(), overlap)) == [("start", 0), ("stop", 0), ("start", 1), ("start", 2), ("delta", 2), ("stop", 2), ("delta", 1), ("stop", 1)]
    assert short(run(Normaliser(False), [start(0, "thinking"), delta(0, "thinking_delta"), stop(0), start(1, "redacted_thinking"), stop(1), start(2), stop(5)])) == [("start", 0)]
    assert short(run(Normaliser(), [delta(3), delta(4, "thinking_delta"), stop(7), ("ping", {})])) == [("start", 0), ("delta", 0), ("delta", 4), ("stop", 7), ("ping", None)]
    again = run(Normaliser(), [start(0, "tool_use", id="t", name="n"), start(1), delta(0, "input_json_delta")])
    assert again[-2][1]["content_block"] == {"type": "tool_use", "id": "t", "name": "n", "input": {}}


def test_emitted():
    sent = Emitted()
    for e in [start(0), start(1, "thinking"), start(2, "tool_use"), stop(1)]:
        sent.see(*e)
    assert short(sent.add("text", "more")) == [("delta", 0)] and short(sent.add("thinking", "t")) == [("start", 3), ("delta", 3)] and sent.add("text", "") == []
    assert short(sent.finish("end_turn")) == [("stop", 3), ("stop", 2), ("stop", 0), ("message_delta", None), ("message_stop", None)]
    done = Emitted()
    for e in [start(0), ("message_delta", {"delta": {"stop_reason": "x"}}), ("message_stop", {})]:
        done.see(*e)
    assert short(done.finish("end_turn")) == [("stop", 0)]


def kinds(rows, **options):
    fold = Transcript(**options)
    for row in rows:
        fold.apply(row)
    return [(s["kind"], s.get("text")) for s in fold.segments], fold


def test_transcript():
    rows = [{"type": "text_start", "index": 0}, {"type": "text_delta", "index": 0, "text": "a"}, {"type": "text_delta", "index": 0, "text": "b"}, {"type": "thinking_start", "index": 0}, {"type": "thinking_chunk", "text": "t"}, {"type": "error", "message": "e"}]
    assert kinds(rows)[0] == [("text", "ab"), ("thinking", ""), ("thinking", "t"), ("error", "e")]
    task = {"type": "tool_use", "id": "T1", "name": "Task", "input": {"subagent_type": "x"}}
    read = {"type": "tool_use_start", "id": "r", "name": "Read", "index": 2}
    found, fold = kinds([task, {"type": "text_chunk", "text": "hidden"}, read, {"type": "block_stop", "index": 2}, {**task, "id": "T2"}, read, {"type": "tool_result", "tool_use_id": "T1-out", "content": 1}, {"type": "text_chunk", "text": "shown"}])
    assert found == [("subagent", "x"), ("subagent", "x"), ("tool_result", 1), ("text", "shown")] and [s.get("calls") for s in fold.segments[:2]] == [1, 1] and not fold.running
    bare = {"type": "tool_use", "name": "Task"}
    found, fold = kinds([bare, {"type": "tool_result", "tool_use_id": "other"}, {"type": "text_chunk", "text": "n"}, {"type": "tool_result", "tool_use_id": "functions.Task:0"}, {"type": "text_chunk", "text": "y"}], results=False)
    assert found == [("subagent", "Subagent"), ("text", "y")]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{k}", i, name, json.dumps(data)) for k in range(3) for i, (name, data) in enumerate([start(k), start(k + 1), delta(k), stop(k), stop(k + 1), start(7), delta(7), stop(7)])]
    schema = "stream_id string, seq long, event string, data string"
    for part, some in enumerate((rows[:10], rows[10:])):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = stateful.normalised_stream(source).writeStream.format("memory").queryName("normal").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.stream_id, r.part, r.event, r.data)
    batch = stateful.normalised(spark.createDataFrame(rows, schema))
    assert sorted(map(key, spark.table("normal").collect())) == sorted(map(key, batch.collect()))


def test_deep_trees(spark):
    """A chain that no recursion limit allows, roots below roots, states and a cycle."""
    n = 3000
    rows = [(i, i - 1 if i else None, "pending" if i != 2000 else "done") for i in range(n)] + [(9001, 9002, "pending"), (9002, 9001, "pending")]
    nodes = spark.createDataFrame(rows, "node_id long, parent_id long, state string")
    roots = spark.createDataFrame([(0,), (1000,), (2500,)], "node_id long")
    near = {r.node_id: (r.root, r.depth) for r in G.reached(nodes, roots).collect()}
    assert near == {i: (max(r for r in (0, 1000, 2500) if r <= i), i - max(r for r in (0, 1000, 2500) if r <= i)) for i in range(n)}
    every = G.descendants(nodes, roots).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("depth")).collect()
    assert {tuple(r) for r in every} == {(0, n, n - 1), (1000, n - 1000, n - 1001), (2500, n - 2500, n - 2501)}
    pending = G.descendants(nodes, roots, "pending").groupBy("root").count().collect()
    assert {tuple(r) for r in pending} == {(0, 2000), (1000, 1000), (2500, 500)}
