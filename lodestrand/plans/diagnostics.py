"""Parsers of tool output and pages over derived reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import diagnostics as D
from lodestrand.registry import register
from lodestrand.sources.derive import select
from lodestrand.sources.tables import table


@register("s08_ruff", "SELECT event_id AS report_id, 'E' || (event_id % 23)::VARCHAR AS rule_id, 'f' || user_id::VARCHAR || '.py' AS file, (event_id % 300)::INT AS line, NULL::INT AS \"column\", event_type AS message FROM events")
def ruff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a JSON array."""
    text = F.to_json(F.array(F.struct(F.concat(F.lit("E"), (F.col("event_id") % 23).cast("string")).alias("code"), F.concat(F.lit("f"), F.col("user_id").cast("string"), F.lit(".py")).alias("filename"), F.col("event_type").alias("message"), F.struct((F.col("event_id") % 300).alias("row")).alias("location"))))
    return D.ruff(table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), text.alias("text")))


@register("s08b_eslint", "SELECT event_id AS report_id, CASE WHEN event_id % 2 = 0 THEN 'unknown' ELSE event_type END AS rule_id, 'a.js' AS file, k::INT AS line, NULL::INT AS \"column\", 'm' AS message FROM events, (VALUES (1), (2)) v(k)")
def eslint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of an array of files."""
    message = lambda k: F.struct(F.when(F.col("event_id") % 2 == 1, F.col("event_type")).alias("ruleId"), F.lit(k).alias("line"), F.lit("m").alias("message"))
    text = F.to_json(F.array(F.struct(F.lit("a.js").alias("filePath"), F.array(message(1), message(2)).alias("messages"))))
    return D.eslint(table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), text.alias("text")))


_REPORT = "SELECT p_partkey AS report_id, 'src/a' || CAST(p_size AS STRING) || '.ts(' || CAST(p_size AS STRING) || ',7): error TS23' || CAST(p_size % 10 AS STRING) || ': ' || p_type || ' ' || chr(10) || 'noise' || chr(10) || 'm/b.py:' || CAST(p_size AS STRING) || ': error: bad ' || p_brand || '  [arg-type]' || chr(10) || 'm/b.py:3:4: note: see' || chr(10) || 'c.py:9:2: error: plain' AS text FROM part"


@register("s10_tsc", "SELECT p_partkey AS report_id, 0 AS n, 'src/a' || p_size::VARCHAR || '.ts' AS file, p_size AS line, 'TS23' || (p_size % 10)::VARCHAR AS code, p_type AS summary FROM part")
def tsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler lines with position in brackets."""
    return D.tsc(select(spark, sf_dir, _REPORT))


@register("s11_mypy", "SELECT p_partkey AS report_id, 2 AS n, 'm/b.py' AS file, p_size AS line, 'arg-type' AS code, 'bad ' || p_brand AS summary FROM part UNION ALL SELECT p_partkey, 4, 'c.py', 9, NULL, 'plain' FROM part")
def mypy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type checker lines; notes are dropped."""
    return D.mypy(select(spark, sf_dir, _REPORT))


@register("s09_cargo", "SELECT p_partkey AS report_id, 1 AS n, CASE WHEN p_partkey % 2 = 0 THEN 'b.rs' END AS file, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS line, 'E0' || p_size::VARCHAR AS code, p_type AS summary FROM part")
def cargo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiler messages in JSON lines."""
    span = lambda primary, name: F.struct(F.lit(primary).alias("is_primary"), F.lit(name).alias("file_name"), F.col("p_size").alias("line_start"))
    spans = F.when(F.col("p_partkey") % 2 == 0, F.array(span(False, "a.rs"), span(True, "b.rs")))
    message = F.struct(F.lit("error").alias("level"), F.col("p_type").alias("message"), F.struct(F.concat(F.lit("E0"), F.col("p_size").cast("string")).alias("code")).alias("code"), spans.alias("spans"))
    line = F.to_json(F.struct(F.lit("compiler-message").alias("reason"), message.alias("message")))
    text = F.concat(F.lit("building\n"), line, F.lit('\n{"reason":"build-finished"}\n{broken'))
    return D.cargo(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("report_id"), text.alias("text")))


_TESTS = """SELECT p_partkey AS report_id, '=== FAILURES ===' || chr(10) || '____ test_a ____' || chr(10) || 'p/t' || CAST(p_size AS STRING) || '.py:' || CAST(p_size AS STRING) || ': in test_a' || chr(10) || 'E boom' || chr(10) || '___ m.test_b[1] ___' || chr(10) || 'no place' || chr(10) || 'last ' || p_brand || chr(10) || '=== short test summary info ===' || chr(10) || 'FAILED test_a - ' || p_type || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '=== 2 failed, 5 passed in 1.50s ===' ELSE '=== 7 passed, 1 skipped in 0.25s ===' END AS text FROM part"""


@register("s12_test_summary", "SELECT p_partkey AS report_id, CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 7 END AS passed, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS failed, CASE WHEN p_partkey % 2 = 1 THEN 1 END AS skipped, CASE WHEN p_partkey % 2 = 0 THEN 1.5::DOUBLE ELSE 0.25::DOUBLE END AS duration FROM part")
def test_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, S12d: counts of a test run's last line."""
    return D.test_summary(select(spark, sf_dir, _TESTS))


@register("s12_test_failures", "SELECT p_partkey AS report_id, 'test_a' AS test_id, 'p/t' || p_size::VARCHAR || '.py' AS file, p_size AS line, p_type AS summary FROM part UNION ALL SELECT p_partkey, 'm.test_b[1]', NULL, NULL, 'last ' || p_brand FROM part")
def test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure blocks of a test run."""
    return D.test_failures(select(spark, sf_dir, _TESTS))


@register("f20_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and visible text of every page, by a real HTML parser (Arrow batches; SQL has none)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [D.page_text(h or "") for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "title": [t for t, _ in found], "text": [t for _, t in found]})

    return table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(run, "page_id long, title string, text string")


@register("f21_result_links", "SELECT page_id, 0 AS place, url, 'One two' AS title FROM pages UNION ALL SELECT page_id, 1, 'https://x.example/' || page_id::VARCHAR, 'b' FROM pages")
def result_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result links of pages made of the table's addresses."""
    link = lambda url, title: F.concat(F.lit('<a href="/l/?uddg='), F.url_encode(url), F.lit('&amp;rut=1">'), F.lit(title), F.lit("</a>"))
    html = F.concat(link(F.col("url"), " One <b>two</b>\n"), F.lit('<a href="/other">no</a>'), link(F.concat(F.lit("https://x.example/"), F.col("page_id").cast("string")), "b"), link(F.col("url"), "again"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(page, i, url, title) for page, h in zip(frame["page_id"], frame["html"]) for i, (url, title) in enumerate(D.result_links(h))]
            yield pd.DataFrame(rows, columns=["page_id", "place", "url", "title"])

    return table(spark, sf_dir, "pages").select("page_id", html.alias("html")).mapInPandas(run, "page_id long, place int, url string, title string")


@register(
    "f13_commands",
    """
    SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'git status' WHEN 1 THEN 'npm run' WHEN 2 THEN 'command_injection_detected' WHEN 3 THEN 'cat' WHEN 4 THEN 'none' WHEN 5 THEN '/bin/CAT' WHEN 6 THEN 'B=' || p_size::VARCHAR || ' grep' WHEN 7 THEN 'git' ELSE 'echo' END AS prefix,
           CASE p_partkey % 9 WHEN 3 THEN p_brand || '.txt' WHEN 5 THEN '"a ' || p_brand || '",b' WHEN 6 THEN 'd/' || p_brand ELSE '' END AS paths FROM part
    """,
)
def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefixes and files of shell commands; words keep their quotes."""
    shapes = ["'git status -s'", "'A=1 npm run build'", "'echo $(id)'", "'cat -n ' || p_brand || '.txt'", "''", """'/bin/CAT "a ' || p_brand || '" -n b'""", "'B=' || CAST(p_size AS STRING) || ' grep -m 3 -e x d/' || p_brand", "'git -C x log'", "'echo \"open ' || p_brand"]
    command = F.expr("CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN {shape}" for i, shape in enumerate(shapes)) + " END")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"p_partkey": frame["p_partkey"], "prefix": frame["c"].map(D.command_prefix), "paths": frame["c"].map(lambda c: ",".join(D.command_paths(c)))})

    return table(spark, sf_dir, "part").select("p_partkey", command.alias("c")).mapInPandas(run, "p_partkey long, prefix string, paths string")


@register("x43_body_routing", "SELECT page_id, CASE WHEN octet_length(encode(html)) < 4000 THEN 'passthrough' ELSE 'digest' END AS route FROM pages")
def body_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small bodies pass, large ones are digested."""
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.octet_length("html") < 4000, "passthrough").otherwise("digest").alias("route"))
