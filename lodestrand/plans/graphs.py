"""Symbol graph, PageRank, import resolution and reply trees over derived inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.text import edge_multiplier
from lodestrand.operators import graph as G
from lodestrand.registry import register
from lodestrand.sources.derive import NODES, TAGS, select
from lodestrand.sources.tables import table

_EDGES = f"""
    tags AS ({TAGS}), defs AS (SELECT DISTINCT name, rel_path AS dst FROM tags WHERE kind = 'def'),
    definers AS (SELECT name, count(*) AS k FROM defs GROUP BY name),
    refs AS (SELECT name, rel_path AS src, count(*) AS n FROM tags WHERE kind = 'ref' GROUP BY ALL),
    mult AS (SELECT name, (CASE WHEN (contains(name, '_') OR regexp_matches(name, '[A-Z]')) AND length(name) >= 8 THEN 10.0::DOUBLE ELSE 1.0 END) * (CASE WHEN starts_with(name, '_') THEN 0.1::DOUBLE ELSE 1.0 END) * (CASE WHEN k > 5 THEN 0.1::DOUBLE ELSE 1.0 END) AS m FROM definers),
    used AS (SELECT src, dst, m * floor(sqrt(n)) AS weight FROM refs JOIN defs USING (name) JOIN mult USING (name)),
    loops AS (SELECT dst AS src, dst, 0.1::DOUBLE AS weight FROM defs WHERE name NOT IN (SELECT name FROM refs)),
    edges AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM used UNION ALL SELECT * FROM loops) GROUP BY ALL)
"""
_TOTALS = "totals AS (SELECT src, sum(weight) AS total FROM edges GROUP BY src), nodes AS (SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges), size AS (SELECT count(*) AS n FROM nodes)"
_ROUNDS = ", ".join(
    f"r{i} AS (SELECT v.node, 0.15 / n + 0.85 * (coalesce(came, 0) + lost / n) AS score FROM nodes v CROSS JOIN size LEFT JOIN (SELECT e.dst, sum(p.score * e.weight / t.total) AS came FROM edges e JOIN totals t USING (src) JOIN r{i - 1} p ON p.node = e.src GROUP BY e.dst) c ON c.dst = v.node CROSS JOIN (SELECT coalesce(sum(score), 0) AS lost FROM r{i - 1} WHERE node NOT IN (SELECT src FROM totals)) l)"
    for i in range(1, 6)
)
_RANKED = f"WITH {_EDGES}, {_TOTALS}, r0 AS (SELECT node, 1.0::DOUBLE / n AS score FROM nodes, size), {_ROUNDS}"


@register("j03_symbol_edges", f"WITH {_EDGES} SELECT src, dst, round(weight, 6) AS weight FROM edges")
def symbol_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges from referring to defining files."""
    return G.symbol_edges(select(spark, sf_dir, TAGS)).withColumn("weight", F.round("weight", 6))


@register("r01_pagerank", f"{_RANKED} SELECT node, round(score, 8) AS score FROM r5")
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of weighted PageRank over the symbol graph (a fixed number, so that SQL can follow)."""
    return G.pagerank_hubs(*G.symbol_hubs(select(spark, sf_dir, TAGS)), rounds=5, tolerance=None).withColumn("score", F.round("score", 8))


@register(
    "w07_by_mass",
    f"{_RANKED}, o AS (SELECT node, score, sum(score) OVER (ORDER BY score DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(score) OVER () AS total, row_number() OVER (ORDER BY score DESC, node) AS k FROM r5) SELECT node FROM o WHERE k <= 40 AND coalesce(before, 0) < 0.6 * total",
)
def files_by_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best files until 60 % of the mass, at most 40."""
    ranked = G.pagerank_hubs(*G.symbol_hubs(select(spark, sf_dir, TAGS)), rounds=5, tolerance=None)
    return G.by_mass(ranked, 0.6, 40).select("node")


@register("r02_definitions", f"WITH t AS ({TAGS}) SELECT name, count(*) FILTER (WHERE kind = 'def') AS n_defs, count(*) FILTER (WHERE kind = 'ref') AS n_refs, min(line + 1) FILTER (WHERE kind = 'def') AS first_line FROM t GROUP BY name")
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions and references of names; lines count from 1."""
    t = select(spark, sf_dir, TAGS)
    d = F.col("kind") == "def"
    return t.groupBy("name").agg(F.count_if(d).alias("n_defs"), F.count_if(F.col("kind") == "ref").alias("n_refs"), F.min(F.when(d, F.col("line") + 1)).alias("first_line"))


_IMPORTS = "SELECT 'pkg/m' || CAST(l_suppkey AS STRING) || '.py' AS src, 'pkg.m' || CAST(l_partkey % 120 AS STRING) || CASE WHEN l_linenumber % 2 = 0 THEN '.helper' ELSE '' END AS module FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2"
_FILES = "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'pkg/m' || CAST(s_suppkey AS STRING) || '/__init__.py' ELSE 'pkg/m' || CAST(s_suppkey AS STRING) || '.py' END AS path FROM supplier UNION SELECT 'pkg/m' || CAST(s_suppkey AS STRING) || '/helper.py' FROM supplier WHERE s_suppkey % 6 = 0"
_RESOLVED = f"""
    i AS ({_IMPORTS}), f AS ({_FILES}),
    c AS (SELECT src, module, replace(module, '.', '/') || '.py' AS path, 1 AS place FROM i UNION ALL SELECT src, module, replace(module, '.', '/') || '/__init__.py', 2 FROM i
          UNION ALL SELECT src, module, replace(replace(module, '.helper', ''), '.', '/') || '.py', 3 FROM i UNION ALL SELECT src, module, replace(replace(module, '.helper', ''), '.', '/') || '/__init__.py', 4 FROM i),
    hit AS (SELECT src, module, arg_min(c.path, place) AS resolved FROM c JOIN f ON c.path = f.path GROUP BY ALL),
    resolved AS (SELECT i.src, i.module, resolved FROM i LEFT JOIN hit USING (src, module))
"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve_imports(select(spark, sf_dir, _IMPORTS), select(spark, sf_dir, _FILES))


@register("j05_resolve_imports", f"WITH {_RESOLVED} SELECT * FROM resolved")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports resolved to files."""
    return _resolved(spark, sf_dir).select("src", "module", "resolved")


@register("j07_importers", f"WITH {_RESOLVED} SELECT resolved AS file, count(DISTINCT src) AS importers FROM resolved WHERE resolved IS NOT NULL GROUP BY resolved")
def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who imports a file."""
    return _resolved(spark, sf_dir).where("resolved is not null").groupBy(F.col("resolved").alias("file")).agg(F.countDistinct("src").alias("importers"))


@register("a13_unresolved", f"WITH {_RESOLVED} SELECT src, count(*) FILTER (WHERE resolved IS NULL) AS unresolved, CASE WHEN bool_or(resolved IS NOT NULL) THEN 'resolves' ELSE 'opaque' END AS tier FROM resolved GROUP BY src")
def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unresolved imports of each file, zeros kept."""
    r = _resolved(spark, sf_dir)
    return r.groupBy("src").agg(F.count_if(F.col("resolved").isNull()).alias("unresolved"), F.when(F.bool_or(F.col("resolved").isNotNull()), "resolves").otherwise("opaque").alias("tier"))


_BELOW = "below(root, node_id, depth) AS (SELECT node_id, node_id, 0 FROM nodes WHERE {start} UNION ALL SELECT b.root, n.node_id, b.depth + 1 FROM below b JOIN nodes n ON n.parent_id = b.node_id {only})"


@register("r05_descendants", f"WITH RECURSIVE nodes AS ({NODES}), {_BELOW.format(start='node_id % 50 = 10', only='')} SELECT root, count(*) AS n, max(depth)::INT AS depth FROM below GROUP BY root")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and depth of the trees below some nodes."""
    nodes = select(spark, sf_dir, NODES)
    return G.descendants(nodes, nodes.where("node_id % 50 = 10").select("node_id")).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


@register(
    "r07_error_propagation",
    f"""
    WITH RECURSIVE nodes AS ({NODES}), {_BELOW.format(start="state = 'error'", only="WHERE n.state = 'pending'")}
    SELECT n.node_id, CASE WHEN b.node_id IS NOT NULL THEN 'error' ELSE n.state END AS state FROM nodes n LEFT JOIN (SELECT DISTINCT node_id FROM below) b USING (node_id)
    """,
)
def error_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors reach the pending nodes below, through pending nodes only."""
    nodes = select(spark, sf_dir, NODES)
    hit = G.reached(nodes, nodes.where("state = 'error'").select("node_id"), "pending").select("node_id", F.lit(True).alias("hit"))
    return nodes.join(hit, "node_id", "left").select("node_id", F.when(F.col("hit"), "error").otherwise(F.col("state")).alias("state"))


@register("r08_remove_branch", f"WITH RECURSIVE nodes AS ({NODES}), {_BELOW.format(start='node_id % 50 = 20', only='')} SELECT root_id, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT node_id FROM below) GROUP BY root_id")
def remove_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees without a branch."""
    nodes = select(spark, sf_dir, NODES)
    gone = G.reached(nodes, nodes.where("node_id % 50 = 20").select("node_id")).select("node_id")
    return nodes.join(gone, "node_id", "left_anti").groupBy("root_id").agg(F.count(F.lit(1)).alias("n"))


@register("r09_cancel_branch", f"WITH RECURSIVE nodes AS ({NODES}), {_BELOW.format(start='node_id % 50 = 20', only='')} SELECT n.node_id, CASE WHEN b.node_id IS NOT NULL AND state IN ('pending', 'in_progress') THEN 'error' ELSE state END AS state FROM nodes n LEFT JOIN (SELECT DISTINCT node_id FROM below) b USING (node_id)")
def cancel_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unfinished nodes of a branch are cancelled."""
    nodes = select(spark, sf_dir, NODES)
    hit = G.reached(nodes, nodes.where("node_id % 50 = 20").select("node_id")).select("node_id", F.lit(True).alias("hit"))
    return nodes.join(hit, "node_id", "left").select("node_id", F.when(F.col("hit") & F.col("state").isin("pending", "in_progress"), "error").otherwise(F.col("state")).alias("state"))


@register("j08_parent_sessions", f"WITH nodes AS ({NODES}) SELECT n.node_id, p.session_id AS parent_session FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.node_id")
def parent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session of a node's parent."""
    nodes = select(spark, sf_dir, NODES)
    return nodes.select("node_id", "parent_id").join(nodes.select(F.col("node_id").alias("parent_id"), F.col("session_id").alias("parent_session")), "parent_id", "left").select("node_id", "parent_session")


@register(
    "j09_resolve_ids",
    f"""
    WITH nodes AS ({NODES}), asked AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 2000)::VARCHAR WHEN 1 THEN 'st' || (event_id % 2000)::VARCHAR ELSE 'none' END AS id FROM events)
    SELECT a.event_id, coalesce(x.node_id, y.node_id) AS node_id FROM asked a LEFT JOIN nodes x ON a.id = x.node_id::VARCHAR LEFT JOIN nodes y ON a.id = y.status_message_id
    """,
)
def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id is a node's, or the id of its status message."""
    nodes = select(spark, sf_dir, NODES)
    asked = select(spark, sf_dir, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(event_id % 2000 AS STRING) WHEN 1 THEN 'st' || CAST(event_id % 2000 AS STRING) ELSE 'none' END AS id FROM events")
    x = nodes.select(F.col("node_id").cast("string").alias("id"), F.col("node_id").alias("x"))
    y = nodes.select(F.col("status_message_id").alias("id"), F.col("node_id").alias("y"))
    return asked.join(x, "id", "left").join(y, "id", "left").select("event_id", F.coalesce("x", "y").alias("node_id"))


@register("x18_queue_positions", f"WITH nodes AS ({NODES}) SELECT root_id, node_id, row_number() OVER (PARTITION BY root_id ORDER BY node_id) AS position FROM nodes WHERE state = 'pending'")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of pending nodes in their tree's queue."""
    return G.queue_positions(select(spark, sf_dir, NODES))


@register("f30_multipliers", f"WITH {_EDGES} SELECT name, round(m, 6) AS multiplier FROM mult")
def multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weights of identifiers."""
    defs = select(spark, sf_dir, TAGS).where("kind = 'def'").groupBy("name").agg(F.countDistinct("rel_path").alias("k"))
    return defs.select("name", F.round(edge_multiplier(F.col("name"), F.col("k")), 6).alias("multiplier"))


@register(
    "x45_layered_settings",
    "WITH s AS (SELECT p_brand AS key, p_size % 4 AS layer, p_partkey AS spot, p_type AS value FROM part), best AS (SELECT key, arg_max(value, layer * 1000000 + spot) AS value, arg_max(layer, layer * 1000000 + spot) AS source FROM s GROUP BY key) SELECT key, value, source FROM best",
)
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last layer that has it, with that layer."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), (F.col("p_size") % 4).alias("source"), F.col("p_partkey").alias("at"), F.col("p_type").alias("value"))
    return s.groupBy("key").agg(F.max(F.struct("source", "at", "value")).alias("m")).select("key", "m.value", "m.source")
