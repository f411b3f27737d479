"""Windows, limits and queues over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.operators import windows as W
from lodestrand.registry import register
from lodestrand.sources.derive import CELLS, select
from lodestrand.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@register("w08_log_tail", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 log rows of each chat."""
    return W.keep_last(_events(spark, sf_dir).select("user_id", "event_id"), "user_id", [F.desc("event_id")], 20)


@register("s17_retention", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k > 3")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a retention of three drops."""
    return W.prune(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@register(
    "w09_broken_ranges",
    """
    WITH r AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id FROM events),
    b AS (SELECT k, i, (i - 1) * 10 AS b, CASE WHEN event_id % 13 = 0 THEN (i - 1) * 10 ELSE i * 10 END AS e FROM r),
    p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY k ORDER BY i), 0) AS expected FROM b)
    SELECT k AS key, i AS index, expected FROM p WHERE b <> expected OR e <= b
    """,
)
def broken_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that do not join up."""
    blocks = select(
        spark,
        sf_dir,
        "SELECT key, i AS index, (i - 1) * 10 AS begin, CASE WHEN event_id % 13 = 0 THEN (i - 1) * 10 ELSE i * 10 END AS end FROM (SELECT user_id AS key, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events) x",
    )
    return W.broken_ranges(blocks).select("key", F.col("index").cast("long").alias("index"), F.col("expected").cast("long").alias("expected"))


@register("w13_first_models", "SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return W.first_seen(_events(spark, sf_dir), ["event_type", "user_id"], "event_id")


@register(
    "st11_sliding_limit",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS in_window FROM events",
)
def sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11: how many events of a user lie in the strict sliding window of twelve hours."""
    return W.over_limit(_events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id"), 4, 43200).select("event_id", "in_window")


@register("st13_compact_queue", "SELECT user_id AS queue, event_type AS dedup_key, min(event_id) AS place, arg_max(props, event_id) AS payload, count(*) AS merged FROM events GROUP BY ALL")
def compact_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST13: a queue in which a later item with the same key replaces the payload and keeps the place."""
    items = _events(spark, sf_dir).select(F.col("user_id").alias("queue"), F.col("event_type").alias("dedup_key"), F.col("event_id").alias("seq"), F.col("props").alias("payload"))
    return W.compact_queue(items)


@register("st14_changes", "SELECT event_id, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14, ST17: statuses that differ from the one before."""
    return W.changes(_events(spark, sf_dir), "user_id", "event_id", "event_type").select("event_id", "event_type")


@register(
    "st15_debounced",
    """
    WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
    SELECT user_id AS key, epoch_us(max(ts)) + 21600000000 AS saved_at, count(*) AS n FROM s GROUP BY user_id, k
    """,
)
def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST15: a save after every pause of six hours."""
    return W.debounced(_events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts"), "6 hours").select("key", W.micros_of("saved_at").alias("saved_at"), "n")


@register("st16_delivered_once", "SELECT user_id, event_type, count(*) AS n_seen, count(DISTINCT props) AS n_delivered FROM events GROUP BY ALL")
def delivered_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16 (batch form): messages seen and delivered, by id."""
    e = _events(spark, sf_dir)
    seen = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_seen"))
    once = e.dropDuplicates(["user_id", "event_type", "props"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n_delivered"))
    return seen.join(once, ["user_id", "event_type"])


@register(
    "t08_budgeted_tail",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 2 AS used FROM conversations) WHERE used <= 3000",
)
def budgeted_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turns that fit into 3000 characters."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "text")
    return W.budgeted_tail(rows, 3000).select(F.col("key").alias("conv_id"), F.col("seq").alias("turn"))


@register(
    "st18_seal_points",
    """
    WITH RECURSIVE r AS (SELECT conv_id, turn, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    s(conv_id, i, turn, n, held, sealed) AS (
      SELECT conv_id, i, turn, CASE WHEN 1 >= 2 AND tokens > 150 THEN 0 ELSE 1 END, tokens, false FROM r WHERE i = 1
      UNION ALL SELECT r.conv_id, r.i, r.turn, CASE WHEN s.n + 1 >= 2 AND s.held + r.tokens > 150 THEN 0 ELSE s.n + 1 END, CASE WHEN s.n + 1 >= 2 AND s.held + r.tokens > 150 THEN 0 ELSE s.held + r.tokens END, s.n + 1 >= 2 AND s.held + r.tokens > 150 FROM s JOIN r ON r.conv_id = s.conv_id AND r.i = s.i + 1)
    SELECT conv_id, turn, sealed FROM s
    """,
)
def seal_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST18: where blocks are sealed, with a running count and sum that start again."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.floor(F.length("text") / 4).alias("tokens"))
    return W.seal_points(rows, 2, 150).select(F.col("key").alias("conv_id"), F.col("seq").alias("turn"), "sealed")


@register("st22_latest_state", "SELECT user_id AS node_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest state of each node (an upsert by key)."""
    return _events(spark, sf_dir).groupBy(F.col("user_id").alias("node_id")).agg(F.max_by("event_type", "event_id").alias("state"))


@register("x20_queued_starts", "SELECT event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 HOUR THEN 'queued' ELSE 'started' END AS decision FROM events")
def queued_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that arrives while the one before still runs (an hour each) is queued."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    running = F.col("ts") < before + F.expr("INTERVAL 1 HOUR")
    return _events(spark, sf_dir).select("event_id", F.when(running, "queued").otherwise("started").alias("decision"))


@register("u03_prefixed_union", "SELECT * FROM (SELECT 'a/' || r_name AS id, 1 AS rank FROM region UNION ALL SELECT 'b/' || n_name, 2 FROM nation) ORDER BY rank, id")
def prefixed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of two providers under their prefixes."""
    a = table(spark, sf_dir, "region").select(F.concat(F.lit("a/"), "r_name").alias("id"), F.lit(1).alias("rank"))
    b = table(spark, sf_dir, "nation").select(F.concat(F.lit("b/"), "n_name").alias("id"), F.lit(2).alias("rank"))
    return a.unionByName(b).orderBy("rank", "id")


@register("j11_unknown_refs", "SELECT c_mktsegment AS provider, string_agg(c_name, ',' ORDER BY c_name) AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O') GROUP BY c_mktsegment")
def unknown_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured references that no provider lists."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return c.groupBy(F.col("c_mktsegment").alias("provider")).agg(F.array_join(F.array_sort(F.collect_list("c_name")), ",").alias("missing"))


@register("x38_cache_split", f"WITH c AS ({CELLS}), seen AS (SELECT DISTINCT sha256(output_text) AS k FROM c WHERE run_index = 0 AND output_text <> 'other') SELECT model, count(*) FILTER (WHERE seen.k IS NOT NULL) AS hits, count(*) FILTER (WHERE seen.k IS NULL) AS misses FROM c LEFT JOIN seen ON sha256(output_text) = seen.k GROUP BY model")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results found in, and missing from, a cache keyed by content hash."""
    c = select(spark, sf_dir, CELLS).withColumn("k", F.sha2("output_text", 256))
    seen = c.where("run_index = 0 and output_text <> 'other'").select("k", F.lit(True).alias("hit")).distinct()
    return c.join(seen, "k", "left").groupBy("model").agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))


@register("x46_changed_fields", "SELECT a.c_custkey AS key FROM customer a JOIN supplier b ON a.c_custkey = b.s_suppkey WHERE a.c_nationkey <> b.s_nationkey")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose value changed between two states."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("old"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("new"))
    return a.join(b, "key").where("old <> new").select("key")


@register("x22_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent is missing."""
    parents = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(parents, "l_suppkey", "left_anti").select("l_orderkey", "l_linenumber")
