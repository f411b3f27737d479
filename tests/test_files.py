"""File sources and streaming, through files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrand.sources import files
from lodestrand.streaming import stateful


def test_notes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text('---\ntitle: "One: two"\nstatus: x\nstatus: done\n---\n\n body')
    (tmp_path / "sub" / "b.md").write_bytes(b"plain \xff")
    (tmp_path / "c.md").write_text("  \n")
    (tmp_path / "d.txt").write_text("no")
    rows = {r.title: r for r in files.note_records(files.whole_files(spark, f"file://{tmp_path}", "*.md")).collect()}
    assert rows.keys() == {"One: two", "b"}
    assert rows["One: two"].status == "done" and rows["One: two"].content == "body"


def test_session_log_and_reports(spark, tmp_path):
    entry = lambda i, d: {"message_id": i, "ts": "t", "direction": d, "kind": "k"}
    (tmp_path / "s.json").write_text(json.dumps({"message_log": {"p:c": [entry("1", "in"), entry("1", "out"), entry("2", "in")]}}))
    rows = files.session_log(spark, f"file://{tmp_path}/s.json").collect()
    assert sorted((r.message_id, r.direction) for r in rows) == [("1", "in"), ("2", "in")]
    (tmp_path / "report-1.json").write_text(json.dumps({"outcomes": [{"classification": "passed"}, {"nodeid": "x"}]}))
    assert {r.classification: r.n for r in files.report_counts(spark, f"file://{tmp_path}").collect()} == {"passed": 1, "unknown": 1}


def test_tower_and_index(spark, tmp_path):
    blocks = spark.createDataFrame([], "session_key string, block_index int, range_begin int, range_end int, header string, body string")
    blocks = files.seal(blocks, "k", 0, 4, "b1", " h\nx " + "y" * 300)
    blocks = files.seal(blocks, "k", 4, 9, "b2", "h2")
    assert [(r.block_index, len(r.header)) for r in blocks.orderBy("block_index").collect()] == [(1, 200), (2, 2)]
    with pytest.raises(ValueError):
        files.seal(blocks, "k", 10, 12, "b", "h")
    chunks = spark.createDataFrame([(0, "t", [0.5])], "chunk_index int, text string, embedding array<float>")
    files.save_index(chunks, f"file://{tmp_path}/ix", "c1")
    assert files.load_index(spark, f"file://{tmp_path}/ix", "c1", 1).count() == 1
    assert files.load_index(spark, f"file://{tmp_path}/ix", "c1", 2) is None and files.load_index(spark, f"file://{tmp_path}/ix", "c2") is None
    with pytest.raises(ValueError):
        files.fixtures(spark, f"file://{tmp_path}/ix")


def run_stream(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name).collect()


def test_think_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "stream_id string, seq long, ts timestamp, chunk string"
    pieces = {"a": ["be <thi", "nk>x</th", "ink> y"], "b": ["plain", " <", "b>"]}
    for n in range(3):
        rows = [{"stream_id": k, "seq": n, "ts": f"2024-01-01T00:00:0{n}Z", "chunk": v[n]} for k, v in pieces.items()]
        (folder / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files arrive in this order
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}").withWatermark("ts", "1 second")
    out = run_stream(stateful.split_thinking_stream(source), tmp_path, "think")
    batch = stateful.split_thinking(spark.read.schema(schema).json(f"file://{folder}")).collect()
    text = lambda rows, k: stateful.merged([(r.kind, r.content) for r in sorted(rows, key=lambda r: r.part) if r.stream_id == k])
    assert text(out, "a") == text(batch, "a") == [("text", "be "), ("thinking", "x"), ("text", " y")]
    assert text(out, "b") == text(batch, "b")


def test_limiter_and_guard_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [{"key": "k", "seq": i, "ts": f"2024-01-01T00:00:{s:02d}Z"} for i, s in enumerate([0, 1, 2, 10, 11, 12])] + [{"key": "k", "seq": 0, "ts": "2024-01-01T00:00:00Z"}]
    (folder / "0.json").write_text("\n".join(map(json.dumps, rows[:6])))
    source = spark.readStream.schema("key string, seq long, ts timestamp").json(f"file://{folder}")
    out = run_stream(stateful.limited_stream(source, 2, 10), tmp_path, "limited")
    assert {r.seq: r.allowed for r in out} == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
    (folder / "1.json").write_text(json.dumps(rows[6]))
    source = spark.readStream.schema("key string, seq long, ts timestamp").json(f"file://{folder}")
    assert len(run_stream(stateful.delivered_once(source, ["key", "seq"]), tmp_path, "guard")) == 6


def test_json_lines(spark):
    rows = spark.createDataFrame([(' {"a": 1}',), ("bad {",), ("  ",)], "value string")
    assert sorted(r.value for r in stateful.json_lines(rows).collect()) == ['{"a": 1}', '{"type":"raw","content":"bad {"}']
    assert stateful.json_lines(rows.where(F.lit(False))).collect() == []
