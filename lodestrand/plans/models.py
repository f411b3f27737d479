"""Model lists, notes and request shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.registry import register
from lodestrand.sources import files
from lodestrand.sources.derive import select
from lodestrand.sources.tables import table

_NOTES = "SELECT p_partkey, '/notes/n' || CAST(p_partkey AS STRING) || '.md' AS path, CASE p_partkey % 4 WHEN 0 THEN '---' || chr(10) || 'title: \"Part ' || p_name || '\"' || chr(10) || 'status: open' || chr(10) || 'status: closed' || chr(10) || 'created: 2024-01-01T10:00:00' || chr(10) || '---' || chr(10) || chr(10) || '  Body ' || p_type WHEN 1 THEN '---' || chr(10) || 'status: open' || chr(10) || '---' || chr(10) || p_type WHEN 2 THEN '   ' ELSE 'plain --- ' || p_type END AS value FROM part"


@register(
    "s03_notes",
    """
    SELECT '/notes/n' || p_partkey::VARCHAR || '.md' AS source_path, CASE WHEN p_partkey % 4 = 0 THEN 'Part ' || p_name ELSE 'n' || p_partkey::VARCHAR END AS title,
           CASE p_partkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE '' END AS status, CASE WHEN p_partkey % 4 = 0 THEN '2024-01-01T10:00:00' ELSE '' END AS created_at,
           CASE p_partkey % 4 WHEN 0 THEN 'Body ' || p_type WHEN 1 THEN p_type ELSE 'plain --- ' || p_type END AS content FROM part WHERE p_partkey % 4 <> 2
    """,
)
def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with front matter as records; blank files are dropped."""
    return files.note_records(select(spark, sf_dir, _NOTES).select("path", "value"))


@register("s05_upsert", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables, the newest of each key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return files.upserted(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 <> 0"), "o_custkey", "o_orderkey")


_MODELS = "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE p_brand || '/' || p_type END AS model_id, CASE p_partkey % 4 WHEN 0 THEN 'tools,reasoning' WHEN 1 THEN 'temperature' WHEN 2 THEN 'tool_choice' ELSE '' END AS params FROM part"


@register("p26_model_refs", f"SELECT DISTINCT trim(model_id) AS model_id FROM ({_MODELS}) WHERE trim(model_id) <> ''")
def model_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct model ids without blanks."""
    return select(spark, sf_dir, _MODELS).select(F.trim("model_id").alias("model_id")).where("model_id <> ''").distinct()


@register("p27_tool_models", f"SELECT p_partkey, params LIKE '%reasoning%' AS supports_thinking FROM ({_MODELS}) WHERE trim(model_id) <> '' AND (params LIKE '%tools%' OR params LIKE '%tool_choice%')")
def tool_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that take tools, and whether they reason."""
    rows = select(spark, sf_dir, _MODELS).withColumn("ps", F.split("params", ","))
    able = F.arrays_overlap("ps", F.array(F.lit("tools"), F.lit("tool_choice")))
    return rows.where((F.trim("model_id") != "") & able).select("p_partkey", F.array_contains("ps", "reasoning").alias("supports_thinking"))


@register(
    "u02_model_variants",
    f"""
    WITH m AS (SELECT DISTINCT model_id FROM ({_MODELS}) WHERE trim(model_id) <> ''), v AS (SELECT 'gw/' || model_id AS id FROM m UNION ALL SELECT 'gw-plain/' || model_id FROM m WHERE length(model_id) % 2 = 0)
    SELECT id, count(*) AS n FROM v GROUP BY id
    """,
)
def model_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two advertised ids for each model, each once."""
    m = select(spark, sf_dir, _MODELS).where("trim(model_id) <> ''").select("model_id").distinct()
    ids = F.array_compact(F.array(F.concat(F.lit("gw/"), "model_id"), F.when(F.length("model_id") % 2 == 0, F.concat(F.lit("gw-plain/"), "model_id"))))
    return m.select(F.explode(ids).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@register("p24_snapshot", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"model":"' || event_type || '","user":' || user_id::VARCHAR || '}' ELSE '{"model":"' || event_type || '"}' END AS body FROM events""")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed fields that are not null, as JSON."""
    fields = F.struct(F.col("event_type").alias("model"), F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user"))
    return table(spark, sf_dir, "events").select("event_id", F.to_json(fields).alias("body"))


@register(
    "p25_request_shape",
    "SELECT conv_id, array_to_string(list_slice(list(role ORDER BY turn), 1, 12), ',') AS roles, count(*) AS n_messages, array_to_string(list_sort(list(DISTINCT role)), ',') AS kinds FROM conversations GROUP BY conv_id",
)
def request_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: the first twelve kinds of a request's parts, and the distinct ones in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count(F.lit(1)).alias("n_messages"), F.array_sort(F.collect_set("role")).alias("k"))
    return rows.select("conv_id", F.array_join(F.slice(F.col("r.role"), 1, 12), ",").alias("roles"), "n_messages", F.array_join("k", ",").alias("kinds"))


@register(
    "p18_tool_history",
    "SELECT conv_id, bool_or(role = 'assistant' AND turn % 3 = 0) AS has_tools, max(CASE WHEN role = 'user' AND trim(text) <> '' THEN turn END) AS turn_start FROM conversations GROUP BY conv_id",
)
def tool_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request has tool history, and where its current turn starts."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & (F.col("turn") % 3 == 0)).alias("has_tools"), F.max(F.when((F.col("role") == "user") & (F.trim("text") != ""), F.col("turn"))).alias("turn_start"))


@register("x06_filled_signatures", "SELECT a.event_id, coalesce(CASE WHEN a.event_id % 3 = 0 THEN a.props END, c.sig) AS sig FROM events a LEFT JOIN (SELECT user_id, arg_max(props, event_id) AS sig FROM events WHERE event_id % 3 = 0 GROUP BY user_id) c ON a.user_id = c.user_id")
def filled_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing attribute is filled from a cache by key."""
    e = table(spark, sf_dir, "events")
    cache = e.where("event_id % 3 = 0").groupBy("user_id").agg(F.max_by("props", "event_id").alias("sig"))
    own = F.when(F.col("event_id") % 3 == 0, F.col("props"))
    return e.join(cache, "user_id", "left").select("event_id", F.coalesce(own, F.col("sig")).alias("sig"))


@register("s20_log_lines", """SELECT event_id, '{"level":"INFO","stage":"' || event_type || '","props":"p' || user_id::VARCHAR || '"}' AS value FROM events""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records as JSON lines; context wins over payload."""
    payload = F.create_map(F.lit("stage"), F.lit("other"), F.lit("props"), F.concat(F.lit("p"), F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("INFO").alias("level"), F.col("event_type").alias("stage"), payload.alias("payload"))
    context = ["level", "stage"]
    extra = F.map_filter("payload", lambda k, v: ~k.isin(*context))
    joined = F.map_concat(F.create_map(*[x for c in context for x in (F.lit(c), F.col(c))]), extra)
    return rows.select("event_id", F.to_json(joined).alias("value"))


@register("js11_event_rows", "SELECT event_type AS kind, count(*) * 2 AS n FROM events GROUP BY event_type")
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS11: a client's events flattened to typed rows, here two blocks each."""
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text")), F.struct(F.lit("other").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.col("event_type").alias("text")))
    event = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(content.alias("content")).alias("message")))
    blocks = F.from_json(F.get_json_object(event, "$.message.content"), "array<struct<type:string,text:string>>")
    rows = table(spark, sf_dir, "events").select(F.explode(blocks).alias("b")).where("b.type = 'text'")
    return rows.groupBy(F.col("b.text").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
