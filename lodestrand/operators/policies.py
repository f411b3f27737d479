"""Small policies over blocks, ids, headers and error bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings tried for a script import, and a folder's index files.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def thinking_policy(messages: DataFrame, enabled: bool, signature: str | None = None) -> DataFrame:
    """Assistant ``messages(blocks)`` by policy: off drops every thinking block, on drops those whose ``signature`` field is empty."""
    thinking = lambda b: b["type"].isin("thinking", "redacted_thinking")
    if enabled:
        keep = lambda b: (b["type"] != "thinking") | (F.coalesce(b[signature], F.lit("")) != "") if signature else F.lit(True)
    else:
        keep = lambda b: ~thinking(b)
    return messages.withColumn("blocks", F.when(F.col("role") == "assistant", F.filter("blocks", keep)).otherwise(F.col("blocks")))


def has_calls(blocks: Column) -> Column:
    return F.exists(blocks, lambda b: b["type"].isin("tool_use", "tool_result"))


def thinks_before_call(blocks: Column) -> Column:
    """Whether the last thinking block before the first call has text."""
    kinds = F.transform(blocks, lambda b: b["type"])
    first = F.array_position(kinds, "tool_use")
    before = F.filter(F.slice(blocks, 1, F.greatest(first - 1, F.lit(0)).cast("int")), lambda b: b["type"] == "thinking")
    return (first > 0) & F.coalesce(F.trim(F.try_element_at(before, F.lit(-1))["text"]) != "", F.lit(False))


def prefix_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a(..., a)`` and ``b(..., b)`` of which one key begins with the other, by equality on prefixes."""
    prefixes = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(F.col(c), n)))
    longer = a.withColumn("__p", prefixes("a")).join(b, F.col("__p") == F.col("b")).drop("__p")
    shorter = b.withColumn("__p", prefixes("b")).join(a, F.col("__p") == F.col("a")).where("a <> b").drop("__p")
    return longer.unionByName(shorter)


def error_hint(body: Column) -> Column:
    """The type or code of an error body, of its error object first; a model that is unsupported has a hint of its own."""
    paths = ("$.error.type", "$.error.code", "$.type", "$.code")
    lower = F.lower(body)
    own = F.when(lower.contains("model") & lower.contains("unsupported"), F.lit("upstream_model_error"))
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(body, p)), F.lit("")) for p in paths], own)


def header(headers: Column, names: list[str]) -> Column:
    """The value of the first of ``names`` among headers, whatever their case."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    return F.coalesce(*[F.get(F.filter(pairs, lambda p: p["k"] == name), F.lit(0))["v"] for name in names])


def resolve_scripts(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(importer, raw, ...)`` with ``resolved``: the first candidate in ``files(path)``; imports that are not relative stay unresolved."""
    folder = F.regexp_extract("importer", r"^(.*)/[^/]*$", 1)
    parts = F.filter(F.split(F.concat_ws("/", folder, "raw"), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    base = F.array_join(walked, "/")
    tried = F.array(base, *[F.concat(base, F.lit(e)) for e in SCRIPT_ENDINGS], *[F.concat(base, F.lit(f"/index{e}")) for e in SCRIPT_ENDINGS])
    spots = imports.where(F.col("raw").startswith(".")).select("importer", "raw", F.posexplode(tried).alias("place", "path"))
    found = spots.join(files.distinct(), "path").groupBy("importer", "raw").agg(F.min_by("path", "place").alias("resolved"))
    return imports.join(found, ["importer", "raw"], "left")


def merged_name(fragments: Column) -> Column:
    """A name from its fragments: one that continues the name so far replaces it, one that the name has begun with adds nothing, others are appended."""
    return F.aggregate(
        fragments,
        F.lit(""),
        lambda name, f: F.when(f.startswith(name), f).when(name.startswith(f), name).otherwise(F.concat(name, f)),
    )


#: Messages by kind of error.
MESSAGES = {"rate_limit": "Rate limit reached. Try again later.", "overloaded": "The provider is overloaded.", "authentication": "The provider refused the key.", "invalid_request": "The provider refused the request."}


def error_message(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair]), kind), F.lit("The request failed."))
