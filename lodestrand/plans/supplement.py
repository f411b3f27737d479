"""Smaller operators: thinking policies, settings, models, streams' index remap, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import policies as P
from lodestrand.plans.compaction import BLOCKS, _blocks
from lodestrand.registry import register
from lodestrand.sources.derive import CELLS, NODES, TOOL_CALLS, select
from lodestrand.sources.tables import table



def _types(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "msg_idx", F.array_join(F.transform("blocks", lambda b: b["type"]), ",").alias("types"))


@register("p17_thinking_off", f"WITH b AS ({BLOCKS}) SELECT conv_id, msg_idx, coalesce(string_agg(type, ',' ORDER BY place) FILTER (WHERE NOT (role = 'assistant' AND type = 'thinking')), '') AS types FROM b GROUP BY conv_id, msg_idx")
def thinking_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant messages without thinking."""
    return _types(P.thinking_policy(_blocks(spark, sf_dir), enabled=False))


@register(
    "p19_replayable",
    f"""
    WITH b AS ({BLOCKS}), f AS (SELECT conv_id, msg_idx, min(place) FILTER (WHERE type = 'tool_use') AS first_call, bool_or(type = 'tool_use') AS has_call FROM b GROUP BY ALL)
    SELECT f.conv_id, f.msg_idx, has_call AND coalesce(bool_or(b.type = 'thinking' AND b.place < f.first_call AND trim(b.text) <> ''), false) AS replayable, has_call AS has_tools FROM f JOIN b USING (conv_id, msg_idx) GROUP BY f.conv_id, f.msg_idx, has_call
    """,
)
def replayable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with calls, and those that think before the first call."""
    b = _blocks(spark, sf_dir)
    return b.select("conv_id", "msg_idx", P.thinks_before_call(F.col("blocks")).alias("replayable"), P.has_calls(F.col("blocks")).alias("has_tools"))


@register("p16_unsupported", f"WITH b AS ({BLOCKS}) SELECT conv_id, msg_idx, bool_or(type = 'image') AS unsupported FROM b GROUP BY ALL")
def unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with blocks that a provider does not take."""
    return _blocks(spark, sf_dir).select("conv_id", "msg_idx", F.exists("blocks", lambda x: x["type"].isin("image", "document")).alias("unsupported"))


@register("f03_joined_text", f"WITH b AS ({BLOCKS}) SELECT conv_id, msg_idx, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE type = 'text'), '')) AS plain, sha256(coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (WHERE type IN ('text', 'thinking') AND text <> ''), '')) AS lines FROM b GROUP BY ALL")
def joined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of blocks joined without, and with, line ends."""
    pick = lambda *types: F.transform(F.filter("blocks", lambda b: b["type"].isin(*types) & b["text"].isNotNull() & (b["text"] != "")), lambda b: b["text"])
    return _blocks(spark, sf_dir).select("conv_id", "msg_idx", F.sha2(F.array_join(pick("text"), ""), 256).alias("plain"), F.sha2(F.array_join(pick("text", "thinking"), "\n"), 256).alias("lines"))


@register("x13_all_text", "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS everything, arg_max(text, turn) FILTER (WHERE role = 'user') AS latest FROM conversations GROUP BY conv_id")
def all_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a request, and of its last user message."""
    c = table(spark, sf_dir, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("latest"))
    return g.select("conv_id", F.sha2(F.array_join("t.text", "\n"), 256).alias("everything"), "latest")


@register("x33_dense_indexes", "SELECT user_id, event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY first_id) - 1 AS index FROM (SELECT user_id, event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_id FROM events)")
def dense_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X33 (batch form): blocks numbered densely by first appearance."""
    e = table(spark, sf_dir, "events")
    firsts = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    ranked = firsts.withColumn("index", (F.row_number().over(Window.partitionBy("user_id").orderBy("first_id")) - 1).cast("long"))
    return e.join(ranked, ["user_id", "event_type"]).select("user_id", "event_id", "index")


@register("w14_open_blocks", "SELECT user_id, event_id, last(CASE WHEN event_id % 7 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_block FROM events")
def open_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14, ST06 (batch form): the block that is open at each event."""
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    started = F.when(F.col("event_id") % 7 == 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.last(started, ignorenulls=True).over(order).alias("open_block"))


@register("x28_assembled_calls", f"WITH c AS ({TOOL_CALLS}) SELECT conv_id, name, sha256(string_agg(input, '' ORDER BY seq)) AS arguments, count(*) AS n FROM c GROUP BY conv_id, name")
def assembled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST04, X28 (batch form): argument fragments of a call in order."""
    c = select(spark, sf_dir, TOOL_CALLS)
    return c.groupBy("conv_id", "name").agg(F.array_sort(F.collect_list(F.struct("seq", "input"))).alias("f"), F.count(F.lit(1)).alias("n")).select("conv_id", "name", F.sha2(F.array_join("f.input", ""), 256).alias("arguments"), "n")


@register("x29_salvageable", f"WITH c AS ({TOOL_CALLS}) SELECT conv_id, bool_and(tool_use_id <> '' AND name <> '' AND seq % 50 <> 0) AS salvageable FROM c GROUP BY conv_id")
def salvageable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams whose calls all have id, name and complete input; every 50th input is cut here."""
    from lodestrand.functions.jsons import complete_object

    c = select(spark, sf_dir, TOOL_CALLS)
    given = F.when(F.col("seq") % 50 == 0, F.lit('{"k": ')).otherwise(F.col("input"))
    return c.groupBy("conv_id").agg(F.bool_and((F.col("tool_use_id") != "") & (F.col("name") != "") & complete_object(given).isNotNull()).alias("salvageable"))


@register("j10_fuzzy_ids", "SELECT a.p_partkey, arg_max(b.s_suppkey, b.s_suppkey) AS owner FROM part a JOIN supplier b ON starts_with('t' || a.p_partkey::VARCHAR, 't' || b.s_suppkey::VARCHAR) OR starts_with('t' || b.s_suppkey::VARCHAR, 't' || a.p_partkey::VARCHAR) GROUP BY a.p_partkey")
def fuzzy_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, ST10: the most recent id that equals, begins or continues another.

    A prefix of an id is an equality on one of the id's own prefixes, so this is two equi-joins.
    """
    a = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("a"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner"), F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("b"))
    return P.prefix_matches(a, b).groupBy("p_partkey").agg(F.max("owner").alias("owner"))


@register("x47_error_hints", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'code' || user_id::VARCHAR WHEN 2 THEN 'upstream_model_error' END AS hint FROM events""")
def error_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of an error body."""
    k = F.col("event_id") % 4
    body = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.col("event_type").alias("type")).alias("error"), F.lit("x").alias("type"))))
        .when(k == 1, F.to_json(F.struct(F.concat(F.lit("code"), F.col("user_id").cast("string")).alias("code"))))
        .when(k == 2, F.lit("This Model is Unsupported"))
        .otherwise("oops")
    )
    return table(spark, sf_dir, "events").select("event_id", P.error_hint(body).alias("hint"))


@register("x51_session_headers", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 's' || user_id::VARCHAR END AS session FROM events")
def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session id among headers, whatever their case; the first of several names wins."""
    s, k = F.concat(F.lit("s"), F.col("user_id").cast("string")), F.col("event_id") % 3
    headers = F.when(k == 0, F.create_map(F.lit("X-Session-ID"), s, F.lit("session-id"), F.lit("no"))).when(k == 1, F.create_map(F.lit("Session-Id"), s)).otherwise(F.create_map(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "events").select("event_id", P.header(headers, ["x-session-id", "session-id"]).alias("session"))


@register("x12_forced_tools", "SELECT conv_id, turn, role = 'user' AND turn % 3 = 0 AS forced_search FROM conversations")
def forced_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that force the search tool."""
    choice = F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), F.lit('{"type":"tool","name":"web_search"}')).otherwise('{"type":"auto"}')
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", ((F.get_json_object(choice, "$.type") == "tool") & (F.get_json_object(choice, "$.name") == "web_search")).alias("forced_search"))


@register("f25_js_candidates", "SELECT l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 'src/m' || l_suppkey::VARCHAR || '.ts' WHEN l_suppkey % 4 = 1 THEN 'src/m' || l_suppkey::VARCHAR || '/index.js' END AS resolved FROM (SELECT DISTINCT l_suppkey FROM lineitem)")
def js_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative script imports resolved: as written, with an extension, or as a folder's index."""
    imports = table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().select("l_suppkey", F.lit("src/a.ts").alias("importer"), F.concat(F.lit("./x/../m"), F.col("l_suppkey").cast("string")).alias("raw"))
    have = imports.select(F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("src/m"), F.col("l_suppkey").cast("string"), F.lit(".ts"))).when(F.col("l_suppkey") % 4 == 1, F.concat(F.lit("src/m"), F.col("l_suppkey").cast("string"), F.lit("/index.js"))).alias("path")).where("path is not null")
    return P.resolve_scripts(imports, have).select("l_suppkey", "resolved")


@register("x56_branch_chats", f"WITH RECURSIVE nodes AS ({NODES}), below(root, node_id) AS (SELECT node_id, node_id FROM nodes WHERE node_id % 50 = 5 UNION ALL SELECT b.root, n.node_id FROM below b JOIN nodes n ON n.parent_id = b.node_id) SELECT root, count(DISTINCT chat_id) AS chats FROM below JOIN nodes USING (node_id) GROUP BY root")
def branch_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chats of a branch."""
    from lodestrand.operators import graph

    nodes = select(spark, sf_dir, NODES)
    below = graph.descendants(nodes, nodes.where("node_id % 50 = 5").select("node_id"))
    return below.join(nodes.select("node_id", "chat_id"), "node_id").groupBy("root").agg(F.countDistinct("chat_id").alias("chats"))


@register("x24_tree_json", f"WITH nodes AS ({NODES}) SELECT root_id, count(*) AS n, sum(node_id)::BIGINT AS ids, count(DISTINCT state) AS states FROM nodes GROUP BY root_id")
def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees written as JSON and read back."""
    nodes = select(spark, sf_dir, NODES).select("root_id", F.to_json(F.struct("node_id", "parent_id", "state")).alias("j"))
    back = nodes.select("root_id", F.from_json("j", "node_id bigint, parent_id bigint, state string").alias("n"))
    return back.groupBy("root_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n.node_id").alias("ids"), F.countDistinct("n.state").alias("states"))


@register("h06_run_hash", f"WITH c AS ({CELLS}) SELECT model, sha256(string_agg(concat_ws('|', category, fixture, run_index::VARCHAR, output_text, status), chr(10) ORDER BY category, fixture, run_index, output_text, status)) AS run_hash FROM c GROUP BY model")
def run_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of a model's runs that ignores latency."""
    c = select(spark, sf_dir, CELLS)
    key = F.struct("category", "fixture", "run_index", "output_text", "status", F.concat_ws("|", "category", "fixture", F.col("run_index").cast("string"), "output_text", "status").alias("s"))
    return c.groupBy("model").agg(F.array_sort(F.collect_list(key)).alias("k")).select("model", F.sha2(F.array_join("k.s", "\n"), 256).alias("run_hash"))


@register("js7_schemas", f"WITH c AS ({TOOL_CALLS}) SELECT conv_id, name, CASE WHEN arg_max(seq, seq) % 2 = 0 THEN arg_max(input, seq) ELSE '{{\"type\":\"object\"}}' END AS schema FROM c GROUP BY conv_id, name")
def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS7: the last schema of each tool; what is no object accepts any."""
    from lodestrand.functions.jsons import complete_object

    c = select(spark, sf_dir, TOOL_CALLS).withColumn("given", F.when(F.col("seq") % 2 == 0, F.col("input")).otherwise("[1]"))
    last = c.groupBy("conv_id", "name").agg(F.max_by("given", "seq").alias("given"))
    return last.select("conv_id", "name", F.coalesce(complete_object(F.col("given")), F.lit('{"type":"object"}')).alias("schema"))


@register("f23_merged_names", "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'ReadFile' ELSE 'Read' END AS name FROM (SELECT DISTINCT user_id FROM events)")
def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a tool's name from streamed fragments; a longer form replaces its prefix, a repeated one adds nothing."""
    fragments = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("Read"), F.lit("ReadFile"), F.lit("Read"))).otherwise(F.array(F.lit("Re"), F.lit("ad"), F.lit("Read")))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", P.merged_name(fragments).alias("name"))


@register("a22_session_stats", f"WITH nodes AS ({NODES}) SELECT chat_id, count(*) FILTER (WHERE state = 'in_progress') AS active, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) AS total FROM nodes GROUP BY chat_id")
def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active, pending and all sessions of a chat."""
    s = F.col("state")
    return select(spark, sf_dir, NODES).groupBy("chat_id").agg(F.count_if(s == "in_progress").alias("active"), F.count_if(s == "pending").alias("pending"), F.count(F.lit(1)).alias("total"))


@register("st19_applied_blocks", "WITH b AS (SELECT conv_id, max(turn) AS cut FROM conversations WHERE turn % 3 = 2 GROUP BY conv_id) SELECT c.conv_id, count(*) AS kept FROM conversations c LEFT JOIN b USING (conv_id) WHERE turn >= coalesce(cut, 0) GROUP BY c.conv_id")
def applied_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST19: messages after the last sealed block."""
    c = table(spark, sf_dir, "conversations")
    cut = c.where("turn % 3 = 2").groupBy("conv_id").agg(F.max("turn").alias("cut"))
    return c.join(cut, "conv_id", "left").where(F.col("turn") >= F.coalesce("cut", F.lit(0))).groupBy("conv_id").agg(F.count(F.lit(1)).alias("kept"))


@register("x35_prepended", "SELECT conv_id, '[earlier]' || chr(10) || string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS prefix FROM conversations GROUP BY conv_id")
def prepended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block bodies joined in order under a header."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("b"))
    return c.select("conv_id", F.concat(F.lit("[earlier]\n"), F.array_join("b.t", "\n---\n")).alias("prefix"))


@register("x48_messages", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Rate limit reached. Try again later.' WHEN 1 THEN 'The provider is overloaded.' ELSE 'The request failed.' END AS message FROM events")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by kind of error."""
    status = F.when(F.col("event_id") % 3 == 0, 429).when(F.col("event_id") % 3 == 1, 503).otherwise(418)
    return table(spark, sf_dir, "events").select("event_id", P.error_message(T.error_kind(status)).alias("message"))
