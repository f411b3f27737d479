"""Scalar functions over the driver's texts and derived requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import requests as R
from lodestrand.functions import text as T
from lodestrand.registry import register
from lodestrand.sources.derive import REQUESTS, select
from lodestrand.sources.tables import table


@register(
    "f05_cap_bytes",
    "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 200 THEN true ELSE false END AS capped, sha256(CASE WHEN octet_length(encode(t)) > 20 THEN substr(t, 1, 20) || chr(10) || '... [truncated after 20 bytes]' ELSE t END) AS text_hash FROM (SELECT doc_id, text, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)",
)
def cap_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a cap in bytes, here on ASCII."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", (F.octet_length("text") > 200).alias("capped"), F.sha2(T.cap_bytes(F.regexp_replace("text", "[^ -~]", ""), 20), 256).alias("text_hash"))


@register(
    "f06_tags",
    r"""
    WITH t AS (SELECT doc_id, regexp_replace(text, '^[\s\x0B]+|[\s\x0B]+$', '', 'g') AS whole FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, sha256(nullif(whole, '')) AS digest, sha256(whole) AS header, CASE WHEN doc_id % 2 = 0 THEN 'b' END AS body FROM t
    """,
)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and section tags of a response that holds a whole text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    a = F.concat(F.lit("x <digest> "), F.col("text"), F.lit(" </digest>"))
    b = F.concat(F.lit("<header>old</header><header>"), F.col("text"), F.lit("</header><body>b"), F.when(F.col("doc_id") % 2 == 0, "</body>").otherwise(""))
    return docs.select("doc_id", F.sha2(T.digest_tag(a), 256).alias("digest"), F.sha2(T.between_last(b, "<header>", "</header>"), 256).alias("header"), T.between_last(b, "<body>", "</body>").alias("body"))


@register(
    "f09_include_list",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN array_to_string(list_sort(list_distinct(list_filter([3, 1, (event_id % 12)::INT], lambda x: x >= 1 AND x <= 8))), ',') WHEN 2 THEN NULL ELSE NULL END AS included FROM events
    """,
)
def include_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the numbers of an INCLUDE line."""
    line = (
        F.when(F.col("event_id") % 4 == 0, F.lit("ok\nINCLUDE: NONE"))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("INCLUDE: 3, 1,"), (F.col("event_id") % 12).cast("string")))
        .when(F.col("event_id") % 4 == 2, F.lit("INCLUDE: 1, two"))
        .otherwise("nothing")
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.include_list(line, 8), ",").alias("included"))


@register(
    "f10_preview",
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '... [+' || (length(text) - 100)::VARCHAR || ' chars]' ELSE text END AS preview, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut previews and the four-characters-a-token estimate."""
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text"), 100).alias("preview"), T.estimated_tokens(F.col("text")).alias("tokens"))


@register(
    "f26_file_languages",
    """
    WITH f AS (SELECT p_partkey, 'src/' || replace(p_name, ' ', '_') || CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.hh' WHEN 3 THEN '.md' WHEN 4 THEN '' WHEN 5 THEN '.mjs' WHEN 6 THEN '.rs' ELSE '.cs' END AS path FROM part)
    SELECT p_partkey, path, CASE p_partkey % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'cpp' WHEN 5 THEN 'javascript' WHEN 6 THEN 'rust' WHEN 7 THEN 'csharp' END AS language FROM f
    """,
)
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language by file extension."""
    rows = select(spark, sf_dir, "SELECT p_partkey, 'src/' || replace(p_name, ' ', '_') || CASE p_partkey % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.TSX' WHEN 2 THEN '.hh' WHEN 3 THEN '.md' WHEN 4 THEN '' WHEN 5 THEN '.mjs' WHEN 6 THEN '.rs' ELSE '.cs' END AS path FROM part")
    return rows.select("p_partkey", "path", T.language_of(F.col("path")).alias("language"))


@register(
    "f36_gateway_ids",
    """
    WITH ids AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gw/' || p_brand || '/m/' || p_type WHEN 1 THEN 'gw-plain/' || p_brand || '/m' WHEN 2 THEN 'gw/' || p_brand WHEN 3 THEN 'other/a/b' ELSE 'gw/' || p_brand || '/' END AS id FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 <= 1 THEN split_part(id, '/', 2) END AS provider, CASE p_partkey % 5 WHEN 0 THEN substr(id, length('gw/') + length(split_part(id, '/', 2)) + 2) WHEN 1 THEN 'm' END AS model, CASE WHEN p_partkey % 5 = 1 THEN false END AS force_thinking FROM ids
    """,
)
def gateway_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertised model ids taken apart."""
    rows = select(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gw/' || p_brand || '/m/' || p_type WHEN 1 THEN 'gw-plain/' || p_brand || '/m' WHEN 2 THEN 'gw/' || p_brand WHEN 3 THEN 'other/a/b' ELSE 'gw/' || p_brand || '/' END AS id FROM part")
    parts = T.gateway_parts(F.col("id"), "gw", "gw-plain")
    return rows.withColumn("p", parts).select("p_partkey", "p.provider", "p.model", "p.force_thinking")


@register(
    "f37_tier_models",
    "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'big' WHEN p_partkey % 4 = 1 THEN 'default' WHEN p_partkey % 4 = 2 THEN 'mid' ELSE 'default' END AS model FROM part",
)
def tier_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the configured model of a tier, in order of tiers."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "x-Opus-haiku").when(k == 1, "x-haiku").when(k == 2, "x-Sonnet").otherwise("y")
    return table(spark, sf_dir, "part").select("p_partkey", T.tier_model(name, F.lit("big"), F.lit(None).cast("string"), F.lit("mid"), F.lit("default")).alias("model"))


@register(
    "f34_error_kinds",
    """
    WITH s AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 400 WHEN 4 THEN 502 WHEN 5 THEN 503 WHEN 6 THEN 500 WHEN 7 THEN 404 ELSE 529 END AS status FROM events)
    SELECT status, count(*) AS n, CASE WHEN status IN (401, 403) THEN 'authentication' WHEN status = 429 THEN 'rate_limit' WHEN status = 400 THEN 'invalid_request' WHEN status IN (502, 503, 504) THEN 'overloaded' ELSE 'api' END AS kind, status = 429 OR status BETWEEN 500 AND 599 AS retryable FROM s GROUP BY status
    """,
)
def error_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """error kinds and whether to retry."""
    s = select(spark, sf_dir, "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 401 WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN 400 WHEN 4 THEN 502 WHEN 5 THEN 503 WHEN 6 THEN 500 WHEN 7 THEN 404 ELSE 529 END AS status FROM events")
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumns({"kind": T.error_kind(F.col("status")), "retryable": T.retryable(F.col("status"))})


@register("p23_redact", "SELECT event_id, 'GET https://api.telegram.org/bot<redacted>/send Authorization: Bearer <redacted> ' || event_type AS line FROM events")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens leave log lines."""
    line = F.concat(F.lit("GET https://api.telegram.org/bot"), F.col("event_id").cast("string"), F.lit(":AB_c-"), F.col("user_id").cast("string"), F.lit("/send Authorization: Bearer t"), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.redact(line).alias("line"))


@register("f01_search_terms", """SELECT page_id, '"' || regexp_extract(url, '//([a-z0-9.]+)', 1) || '" "x"' AS terms FROM pages""")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a query's quoted terms."""
    query = F.concat(F.lit(' "'), F.regexp_extract("url", "//([a-z0-9.]+)", 1), F.lit('*  (x^) - '))
    return table(spark, sf_dir, "pages").select("page_id", T.search_terms(query).alias("terms"))


@register("f16_first_url", r"SELECT page_id, regexp_replace(url, '[).,\]]+$', '') AS found, 'about ' || (page_id % 10)::VARCHAR AS query FROM pages")
def first_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first URL and the query of a request text."""
    pages = table(spark, sf_dir, "pages")
    text = F.concat(F.lit("see "), F.col("url"), F.lit("). and https://b.example"))
    query = F.concat(F.lit("please\nQuery:  about "), (F.col("page_id") % 10).cast("string"), F.lit(" "))
    return pages.select("page_id", T.first_url(text).alias("found"), T.query_text(query).alias("query"))


@register("f12_escape", r"SELECT doc_id, sha256(regexp_replace(text, '([_*\[\]()~`>#+\-=|{}.!\\])', '\\\1', 'g')) AS escaped FROM documents")
def escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown characters escaped."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.escape_markdown(F.col("text"), "_*[]()~`>#+-=|{}.!\\"), 256).alias("escaped"))


@register(
    "f17_continuation",
    "SELECT doc_id, substr(text, 41, 20) AS suffix FROM documents WHERE length(text) > 100 AND NOT contains(substr(text, 42, 19), substr(text, 40, 1))",
)
def continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a retried stream adds: its longest overlap with the end of the first is dropped.

    The texts are those in which only the planted overlap is possible.
    """
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 100).where(~F.substring("text", 42, 19).contains(F.substring("text", 40, 1)))
    return docs.select("doc_id", T.continuation(F.substring("text", 1, 40), F.substring("text", 21, 40)).alias("suffix"))


@register("f22_stop_reasons", "SELECT event_type, CASE event_type WHEN 'stop' THEN 'end_turn' ELSE 'end_turn' END AS reason, count(*) AS n FROM events GROUP BY event_type")
def stop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unknown stop reasons end the turn."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("reason", T.stop_reason(F.col("event_type")))


@register(
    "h05_composite_key",
    "SELECT event_id, sha256(concat_ws('|', user_id::VARCHAR, event_type, props)) AS cache_key FROM events",
)
def composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content keys."""
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256).alias("cache_key"))


@register("js10_compact_json", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN replace(props, ' ', '') ELSE 'plain' END AS body FROM events")
def compact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS1, JS10: error bodies rendered compactly."""
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.col("props"), F.lit("\n"))).otherwise(F.lit(" plain "))
    return table(spark, sf_dir, "events").select("event_id", T.compact_json(body).alias("body"))


@register(
    "p12_canned_answers",
    f"""
    WITH r AS ({REQUESTS}), l AS (SELECT *, lower(user_text) AS u, lower(system_text) AS s FROM r),
    c AS (SELECT *, max_tokens = 1 AND n_messages = 1 AND contains(u, 'quota') AS is_quota,
        n_messages = 1 AND contains(user_text, '<policy_spec>') AND contains(user_text, 'Command:') AS is_prefix,
        system_text <> '' AND NOT has_tools AND contains(s, 'title') AND (contains(s, 'sentence-case title') OR (contains(s, 'return json') AND contains(s, 'field') AND (contains(s, 'coding session') OR contains(s, 'this session')))) AS is_title,
        contains(user_text, '[SUGGESTION MODE:') AS is_suggestion,
        n_messages = 1 AND NOT has_tools AND contains(user_text, 'Command:') AND contains(user_text, 'Output:') AND (contains(u, 'filepaths') OR contains(s, 'extract any file paths') OR contains(s, 'file paths that this command')) AS is_paths FROM l)
    SELECT conv_id, CASE WHEN is_quota THEN 'quota' WHEN is_prefix THEN 'prefix' WHEN is_title THEN 'title' WHEN is_suggestion THEN 'suggestion' WHEN is_paths THEN 'filepaths' END AS rule,
      CASE WHEN is_prefix AND NOT is_quota THEN 'git status -s' WHEN is_paths AND NOT is_quota AND NOT is_prefix AND NOT is_title AND NOT is_suggestion THEN CASE WHEN contains(user_text, 'cat a.txt') THEN 'cat a.txt' ELSE 'ls -l' END END AS command,
      CASE WHEN is_paths AND NOT is_quota AND NOT is_prefix AND NOT is_title AND NOT is_suggestion THEN CASE WHEN contains(user_text, 'cat a.txt') THEN 'hello' ELSE 'a.py b.py' END END AS output FROM c
    """,
)
def canned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with canned answers; the first rule that holds wins."""
    return R.route(select(spark, sf_dir, REQUESTS)).select("conv_id", "rule", "command", "output")
