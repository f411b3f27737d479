"""Functions and operators on small inputs with stated results."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import diagnostics as D
from lodestrand.functions import jsons as J
from lodestrand.functions import streams as S
from lodestrand.functions import text as T
from lodestrand.operators import conversion as V
from lodestrand.operators import graph as G
from lodestrand.operators import retrieval as R
from lodestrand.operators import spans
from lodestrand.operators import windows as W
from lodestrand.streaming import stateful


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).head().x


def test_error_classifier(spark):
    for flag, text, tool, want in [
        (True, "fine", "Read", True),
        (False, "Traceback", "Read", False),
        (False, "Traceback", "WebFetch", True),
        (False, "Exit code: 2", "Bash", True),
        (False, "exit code: 0", "Bash", False),
        (False, "<BASH-STDERR>", "Bash", True),
        (False, "exit status 12", "Grep", False),
    ]:
        assert one(spark, T.is_error(F.col("f"), F.col("t"), F.col("n")), f=flag, t=text, n=tool) is want


def test_head_tail(spark):
    text = "\n".join(map(str, range(10)))
    assert one(spark, T.head_tail(F.col("t"), 5, 2, 1), t=text) == "0\n1\n... [7 lines omitted] ...\n9"
    assert one(spark, T.head_tail(F.col("t"), 10, 2, 1), t=text) == text
    assert "[-2 lines omitted]" in one(spark, T.head_tail(F.col("t"), 5, 6, 6), t=text)


def test_cap_bytes_splits_characters(spark):
    assert one(spark, T.cap_bytes(F.col("t"), 3), t="éé").startswith("é�")


def test_continuation(spark):
    assert one(spark, T.continuation(F.col("a"), F.col("b")), a="hello wor", b="world") == "ld"
    assert one(spark, T.continuation(F.col("a"), F.col("b")), a="abc", b="xyz") == "xyz"


def cut(text, rng):
    out = []
    while text:
        n = rng.randrange(1, 6)
        out.append(text[:n])
        text = text[n:]
    return out


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("before <think>hidden</think> after", [("text", "before "), ("thinking", "hidden"), ("text", " after")]),
        ("a</think>b<thin", [("text", "ab<thin")]),
        ("<think>open <b", [("thinking", "open <b")]),
        ("x < y <think></think>z", [("text", "x < y z")]),
    ],
)
def test_think_tags_do_not_depend_on_chunks(text, want):
    rng = random.Random(1)
    for _ in range(30):
        splitter = S.ThinkSplitter()
        parts = [p for chunk in cut(text, rng) for p in splitter.feed(chunk)] + splitter.flush()
        assert stateful.merged(parts) == want


def test_text_tool_calls_do_not_depend_on_chunks():
    text = "Hi ● <function=Grep><parameter=pattern>a b</parameter><parameter=path>src</parameter>"
    rng = random.Random(2)
    for _ in range(30):
        finder = S.ToolCallExtractor(key="s")
        parts = [p for chunk in cut(text, rng) for p in finder.feed(chunk)] + finder.feed("", last=True)
        assert stateful.merged(parts) == [("text", "Hi "), ("tool_use", '{"id": "s-0", "input": {"path": "src", "pattern": "a b"}, "name": "Grep"}')]


def test_framing():
    lines = ["event: a", "data: {", 'data: "x": 1}', "", "", "data: nope", "", "event: b", "data: 3"]
    assert S.frame_events(lines) == [("a", '{"x": 1}'), ("", '{"raw": "nope"}'), ("b", '{"value": 3}')]
    assert S.frame_events(S.emit_event("n", {"k": 1}).split("\n")) == [("n", '{"k": 1}')]


def test_contract():
    start, stop = ("message_start", {}), ("message_stop", {})
    block = ("content_block_start", {"index": 0, "content_block": {"type": "thinking"}})
    delta = ("content_block_delta", {"index": 0, "delta": {"type": "signature_delta"}})
    end = ("content_block_stop", {"index": 0})
    assert S.contract_breaks([start, block, delta, end, stop]) == []
    assert S.contract_breaks([start, block, end, block, end, stop]) == ["0 used again"]
    assert S.contract_breaks([start, ("error", {}), block, end, stop]) == ["error"]
    assert S.contract_breaks([start, ("error", {}), block, end, stop], allow_error=True) == []
    assert S.contract_breaks([]) == ["empty"]


def test_event_rows():
    message = {"content": [{"type": "thinking", "thinking": "t"}, {"type": "text", "text": "x"}, {"type": "tool_result", "tool_use_id": " a ", "content": 1}]}
    assert [r["type"] for r in S.flatten_event({"type": "assistant", "message": message})] == ["thinking_chunk", "text_chunk", "tool_result"]
    assert S.flatten_event({"type": "result", "result": {"content": [{"type": "text", "text": "r"}]}}) == [{"type": "text_chunk", "text": "r"}]
    assert S.flatten_event({"type": "exit", "code": 3})[0]["message"] == "Process exited with code 3"
    assert S.flatten_event({"type": "content_block_delta", "index": 2, "delta": {"type": "input_json_delta", "partial_json": "{"}}) == [{"type": "tool_use_delta", "index": 2, "partial_json": "{"}]
    assert S.flatten_event({"type": "system"}) == S.flatten_event(7) == []


def test_holdback_and_remap():
    h = S.Holdback()
    assert h.push("a", 0.0) == [] == h.push("b", 0.74) and h.push("c", 0.75) == ["a", "b", "c"] and h.push("d", 0.8) == ["d"]
    r = S.BlockRemap()
    seen = [r.apply(n, {"index": i})["index"] for n, i in [("content_block_start", 5), ("content_block_delta", 5), ("content_block_stop", 5), ("content_block_start", 5)]]
    assert seen == [0, 0, 0, 1]


def test_span_dedup():
    words = [f"w{i}" for i in range(200)]
    run = " ".join(words[:80])
    first, second, last = f"a {run} b", f"c {run} d", "bye"
    assert spans.without_seen([(first, True), (second, True), (last, False)], 70) == [first, "c d", "bye"]
    assert spans.without_seen([(first, True), (second, True)], 90) == [first, second]
    assert spans.without_seen([(f"y {run}", False), (f"x {run}", True)], 70) == [f"y {run}", "x"]
    twice = f"{run} mid {run}"
    assert spans.without_seen([(twice, True)], 70) == [twice]
    once = spans.without_seen([(first, True), (second, True)], 70)
    assert spans.without_seen([(t, True) for t in once], 70) == once
    assert spans.without_seen([(first, True), (second, True)], 1) == [first, second]


def test_json_functions():
    assert J.redact_json('{"a": [{"API_KEY": "x"}], "b": 1}') == '{"a":[{"API_KEY":"<redacted>"}],"b":1}'
    assert J.redact_json("no") == "no" and J.redact_json(None) is None
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": True}}
    assert J.fits_schema(schema, {"a": 1}) and not J.fits_schema(schema, {"a": True}) and not J.fits_schema(schema, {}) and J.fits_schema(None, 3)
    assert J.without_boolean_schemas(schema)["properties"] == {"a": {"type": "integer"}}
    assert J.alias_parameters(["type", "type_arg", "x"], ("type",)) == {"type": "type_arg2"}
    assert J.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "d": {}}) == {"a": {"b": 9, "c": 2}, "d": {}}


def test_pages_and_commands():
    html = "<title>T <b>x</b></title><script>no</script><p>Hello\n  you</p><style>p{}</style><noscript>n</noscript> end"
    assert D.page_text(html) == ("T x", "Hello you\nend")
    assert D.page_text("<p>" + "a" * 30, 5)[1] == "aaaaa"
    assert D.page_text("<!-- <p>no</p> -->a&amp;b<br>c<script>if (a < b) '<p>'</script>d<noscript><p>n</p></noscript>") == ("", "a&b\nc\nd")
    links = '<A class="x" HREF="/l/?uddg=https%3A%2F%2Fe.org%2F%3Fa%3D1&amp;rut=2">One <b>t</b></A><a href=/l/?uddg=u></a><a href="/l/?uddg=u">late</a><a>none</a><a href="/l/?uddg=u">again</a>'
    assert D.result_links(links) == [("https://e.org/?a=1", "One t"), ("u", "late")] and D.result_links(links, 1) == [("https://e.org/?a=1", "One t")]
    assert D.command_prefix("FOO=1 git commit -m x") == "git commit" and D.command_prefix("FOO=1 make all") == "FOO=1 make" and D.command_prefix("git -C x log") == "git" and D.command_prefix("A=1 'x") == "'x"
    assert D.command_paths("/bin/Cat -n \"a b\" c") == ['"a b"', "c"] and D.command_paths("grep -e -f x.py y.py") == ["x.py", "y.py"] and D.command_paths("grep -m 2 p x") == ["x"] and D.command_paths("cat 'x") == []
    assert D.command_prefix("ls -l") == "ls" and D.command_prefix("a `b`") == "command_injection_detected" and D.command_prefix("") == "none"
    assert D.command_paths("grep -n pat a.py 'b.py'") == ["a.py", "'b.py'"] and D.command_paths("ls x") == []


def test_python_sources():
    source = "import os, sys as s\nfrom . import a\nfrom ..p.q import b, c\nX = 1\nclass K:\n    def f(self):\n        return g(os.path.join('a'))\n"
    assert D.python_imports(source) == [("os", 1, False), ("sys", 1, False), (".a", 2, True), ("..p.q.b", 3, True), ("..p.q.c", 3, True)]
    assert {t[:2] for t in D.python_tags(source)} == {("X", "def"), ("K", "def"), ("f", "def"), ("g", "ref"), ("join", "ref")}
    assert D.python_imports("def (") == [] == D.python_tags("def (")


def test_chunks_overlap():
    text = "".join(f"line {i} {'x' * 30}\n" for i in range(60))
    found = R.chunk_lines(text, 100, 20)
    assert [c[0] for c in found] == list(range(len(found)))
    assert all(c[2] <= 100 for c in found)
    for a, b in zip(found, found[1:]):
        assert a[1].splitlines()[-1] == b[1].splitlines()[1 if len(b[1].splitlines()) > 1 and a[1].splitlines()[-1] != b[1].splitlines()[0] else 0]
    assert R.chunk_lines("", 100, 20) == []


def test_bm25_matches_sqlite(spark):
    texts = ["red house by the river", "river river stone", "green house", "the red red red river house", "nothing here"] * 3
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    except sqlite3.OperationalError:
        pytest.skip("no fts5")
    con.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", list(enumerate(texts)))
    want = {i: s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH 'red river'")}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got = {r.doc: r.score for r in R.bm25(docs, ["red", "river"], 50).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)
    with pytest.raises(ValueError):
        R.bm25(docs, ["red"], 0)


def test_pagerank_converges(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("c", "a", 2.0), ("a", "d", 1.0)], "src string, dst string, weight double")
    scores = {r.node: r.score for r in G.pagerank(edges, tolerance=1e-9).collect()}
    x = dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        lost = x["d"]
        x = {n: 0.15 / 4 + 0.85 * (lost / 4 + {"a": x["b"] + x["c"], "b": x["a"] / 2, "c": 0, "d": x["a"] / 2}[n]) for n in x}
    assert all(abs(scores[n] - x[n]) < 1e-6 for n in x)
    best = G.by_mass(spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "node string, score double"), 0.6, 5)
    assert {r.node for r in best.collect()} == {"a", "b"}


def test_pagerank_by_hubs_equals_pagerank_by_edges(spark):
    rng = random.Random(4)
    tags = spark.createDataFrame([(f"f{rng.randrange(12)}", f"longName_{rng.randrange(9)}", rng.choice(["def", "ref", "ref", "ref"])) for _ in range(90)] + [("lone", "_only", "def"), ("x", "unknown", "ref")], "rel_path string, name string, kind string")
    a = {r.node: r.score for r in G.pagerank(G.symbol_edges(tags), rounds=8, tolerance=None).collect()}
    b = {r.node: r.score for r in G.pagerank_hubs(*G.symbol_hubs(tags), rounds=8, tolerance=None).collect()}
    assert a.keys() == b.keys() and all(abs(a[n] - b[n]) < 1e-9 for n in a)


def test_deferred_text_waits_for_results(spark):
    block = "struct<type:string,text:string,name:string,id:string,input:string,tool_use_id:string>"
    b = lambda **k: {f: k.get(f) for f in ("type", "text", "name", "id", "input", "tool_use_id")}
    rows = [
        (1, 0, "assistant", [b(type="text", text="go"), b(type="tool_use", name="R", id="x", input="{}"), b(type="text", text="later")]),
        (1, 1, "user", [b(type="tool_result", text="r", tool_use_id="x"), b(type="text", text="ok")]),
        (2, 0, "assistant", [b(type="tool_use", name="R", id="y", input="{}"), b(type="text", text="orphan")]),
        (2, 1, "user", [b(type="text", text="no result")]),
    ]
    out = V.to_chat(spark.createDataFrame(rows, f"conv_id long, msg_idx long, role string, blocks array<{block}>")).orderBy("conv_id", "place").collect()
    assert [(r.role, r.content) for r in out if r.conv_id == 1] == [("assistant", "go"), ("tool", "r"), ("assistant", "later"), ("user", "ok")]
    assert [(r.role, r.content) for r in out if r.conv_id == 2] == [("assistant", ""), ("assistant", "orphan"), ("user", "no result")]


def test_window_boundary(spark):
    rows = spark.sql("SELECT 'k' AS key, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,s) AS ts, s FROM (SELECT explode(array(0, 5, 10)) AS s)")
    assert {r.s: r.in_window for r in W.over_limit(rows, 2, 10).collect()} == {0: 1, 5: 2, 10: 2}
