"""Inputs that the driver's tables lack, derived from them by SQL that Spark and DuckDB both read.

The tables hold no tool calls, no terminal escapes and no request bodies, so the queries
over these take them from here: each constant is a SELECT over the driver's tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestrand.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the driver's tables of ``sf_dir``."""
    named = sorted(set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)) & set(TABLES))
    text = sql.replace("{", "{{").replace("}", "}}")
    for name in named:
        text = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in named})


#: Tool calls and results: every event is a call in its user's conversation; one in 17 has no result.
TOOL_CALLS = """
    SELECT user_id AS conv_id, event_id AS seq, 'tu_' || CAST(event_id AS STRING) AS tool_use_id,
           CASE event_id % 5 WHEN 0 THEN 'Bash' WHEN 1 THEN 'Read' WHEN 2 THEN 'WebFetch' WHEN 3 THEN 'Edit' ELSE 'Grep' END AS name,
           props AS input
    FROM events
"""
TOOL_RESULTS = """
    SELECT user_id AS conv_id, event_id AS seq, 'tu_' || CAST(event_id AS STRING) AS tool_use_id,
           CASE WHEN event_id % 29 = 0 THEN true END AS is_error,
           CASE WHEN event_id % 11 = 0 THEN 'done, Exit code: ' || CAST(event_id % 3 AS STRING)
                WHEN event_id % 13 = 0 THEN 'Error: cannot open ' || event_type
                WHEN event_id % 19 = 0 THEN '<bash-stderr>warn</bash-stderr>'
                WHEN event_id % 23 = 0 THEN '   '
                ELSE 'ok ' || event_type || ' ' || CAST(event_id % 40 AS STRING) END AS content
    FROM events WHERE event_id % 17 <> 0
"""
#: Requests with one user message each, of the shapes that have canned answers.
REQUESTS = """
    SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 256 END AS max_tokens, CASE WHEN conv_id % 4 = 3 THEN 2 ELSE 1 END AS n_messages, conv_id % 9 = 8 AS has_tools,
           CASE WHEN conv_id % 5 = 0 THEN 'Write a sentence-case title for this.' WHEN conv_id % 5 = 1 THEN 'Extract any file paths that this command reads.' WHEN conv_id % 5 = 2 THEN 'Return JSON with a title field for this session.' ELSE '' END AS system_text,
           CASE WHEN conv_id % 7 = 0 THEN 'Quota check'
                WHEN conv_id % 7 = 1 THEN '<policy_spec>p</policy_spec> Command: ls Command:  git status -s '
                WHEN conv_id % 7 = 2 THEN '[SUGGESTION MODE: x] ' || text
                WHEN conv_id % 7 = 3 THEN 'Give filepaths. Command: cat a.txt Output: hello' || chr(10) || chr(10) || 'more'
                WHEN conv_id % 7 = 4 THEN 'Command: ls -l Output: a.py b.py <end>'
                ELSE text END AS user_text
    FROM conversations WHERE turn = 0
"""
#: A repository: files, the names that each defines and refers to.
TAGS = """
    SELECT 'src/' || CASE l_suppkey % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'api' ELSE 'cli' END || '/m' || CAST(l_suppkey AS STRING) || '.py' AS rel_path,
           CASE l_partkey % 4 WHEN 0 THEN 'load_table_' WHEN 1 THEN '_hidden' WHEN 2 THEN 'run' ELSE 'parseItem' END || CAST(l_partkey % 150 AS STRING) AS name,
           CASE WHEN l_linenumber = 1 THEN 'def' ELSE 'ref' END AS kind, CAST(l_quantity AS INT) AS line
    FROM lineitem
"""
#: Reply trees: every order answers an earlier one of its group of 50, or is a root.
NODES = """
    SELECT o_orderkey AS node_id, CASE WHEN o_orderkey % 50 <= 1 THEN NULL ELSE o_orderkey - 1 - (o_orderkey % 3) * CAST(o_orderkey % 50 > 3 AS INT) END AS parent_id,
           CAST(floor(o_orderkey / 50) AS BIGINT) AS root_id,
           CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'error' END AS state,
           o_custkey AS chat_id, 's' || CAST(o_orderkey % 700 AS STRING) AS session_id, 'st' || CAST(o_orderkey AS STRING) AS status_message_id
    FROM orders
"""
#: Runs of models over fixtures with outputs and latencies, and judges' scores.
CELLS = """
    SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'diff' WHEN 1 THEN 'test' ELSE 'lint' END AS category, 'f' || CAST(user_id % 20 AS STRING) AS fixture, event_id % 4 AS run_index,
           CASE WHEN event_id % 9 = 0 THEN 'other' ELSE 'out' || CAST(user_id % 20 AS STRING) END AS output_text, CAST(round(value * 10) AS BIGINT) AS output_chars, value AS latency_seconds,
           CASE WHEN event_id % 31 = 0 THEN 'timeout' ELSE 'ok' END AS status
    FROM events
"""
SCORES = """
    SELECT event_type AS model, CASE user_id % 3 WHEN 0 THEN 'diff' WHEN 1 THEN 'test' ELSE 'lint' END AS category, 'f' || CAST(user_id % 20 AS STRING) AS fixture,
           1 + event_id % 5 AS faithfulness, 1 + event_id % 4 AS conciseness, 1 + event_id % 3 AS risk_callout, CASE WHEN event_id % 37 = 0 THEN 'bad_json' END AS error
    FROM events WHERE event_id % 4 = 0
"""
#: Diagnostics.
FINDINGS = """
    SELECT event_id AS seq, 'E' || CAST(event_id % 23 AS STRING) AS rule_id, 'src/f' || CAST(user_id % 40 AS STRING) || '.py' AS file, CAST(event_id % 300 AS INT) AS line, event_type || ' at ' || CAST(event_id AS STRING) AS message
    FROM events
"""
