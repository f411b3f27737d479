"""File sources and sinks: notes with front matter, session stores, reports, fixtures, block towers, vector indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.functions.text import strip


def whole_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, value, modified) of every file under ``root`` whose name matches ``pattern``; malformed UTF-8 becomes U+FFFD."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_modification_time").alias("modified"))


_FRONT = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


def front_matter(text: Column) -> Column:
    """map<string,string> of a leading ``---`` block's ``key: value`` lines, quotes stripped; of a repeated key the last counts."""
    lines = F.filter(F.split(F.regexp_extract(text, _FRONT, 1), "\n"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(strip(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']|[\"']$", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("value"))))


def body(text: Column) -> Column:
    """The text behind the front matter, without leading blanks."""
    return F.regexp_replace(F.regexp_replace(text, _FRONT, ""), r"\A\s+", "")


def note_records(files: DataFrame) -> DataFrame:
    """(source_path, title, status, created_at, content) of ``files(path, value)``; blank files are dropped, the title defaults to the file's stem."""
    meta = files.where(strip(F.col("value")) != "").withColumn("m", front_matter(F.col("value")))
    field = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return meta.select(F.col("path").alias("source_path"), F.coalesce(F.nullif(field("title"), F.lit("")), stem).alias("title"), field("status").alias("status"), field("created").alias("created_at"), body(F.col("value")).alias("content"))


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables with the newest row of each key, by aggregate."""
    rows = old.unionByName(new)
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("m")).select(key, f"m.{order}", *[f"m.{c}" for c in rest])


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """(chat_key, message_id, ts, direction, kind) of session stores; of a repeated message id in a chat the first counts."""
    entry = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("message_id", "ts", "direction", "kind")]))
    raw = spark.read.schema(T.StructType([T.StructField("message_log", T.MapType(T.StringType(), entry))])).option("multiLine", True).json(path)
    rows = raw.select(F.explode("message_log").alias("chat_key", "entries")).select("chat_key", F.posexplode("entries").alias("n", "e"))
    first = rows.groupBy("chat_key", "e.message_id").agg(F.min(F.struct("n", "e.ts", "e.direction", "e.kind")).alias("f"))
    return first.select("chat_key", "message_id", "f.ts", "f.direction", "f.kind")


def report_counts(spark: SparkSession, root: str) -> DataFrame:
    """(classification, n) over the outcomes of all ``report-*.json`` under ``root``; a missing classification is ``unknown``."""
    outcome = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("nodeid", "outcome", "classification", "detail")]))
    raw = spark.read.schema(T.StructType([T.StructField("outcomes", outcome)])).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "report-*.json").json(root)
    return raw.select(F.explode("outcomes").alias("o")).groupBy(F.coalesce("o.classification", F.lit("unknown")).alias("classification")).agg(F.count(F.lit(1)).alias("n"))


def fixtures(spark: SparkSession, root: str) -> DataFrame:
    """(category, fixture, body) of ``root/category/*.txt``; a folder without any is an error."""
    found = whole_files(spark, root, "*.txt").select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("fixture"), F.col("value").alias("body"))
    if not found.head(1):
        raise ValueError(f"no fixtures under {root}")
    return found


def seal(blocks: DataFrame, session_key: str, begin: int, end: int, text: str, header: str) -> DataFrame:
    """``blocks(session_key, block_index, range_begin, range_end, header, body)`` with one more block of the session.

    It must begin where the last one ends, and not be empty; the header is one line of at
    most 200 characters.
    """
    last = blocks.where(F.col("session_key") == session_key).agg(F.max("block_index").alias("i"), F.max("range_end").alias("e")).head()
    index, expected = (last["i"] or 0) + 1, last["e"] or 0
    if begin != expected or end <= begin:
        raise ValueError(f"a block from {begin} to {end} does not follow {expected}")
    row = blocks.sparkSession.createDataFrame([(session_key, index, begin, end, header.strip().replace("\n", " ")[:200], text)], blocks.schema)
    return blocks.unionByName(row)


def tower(bodies: DataFrame, metas: DataFrame) -> DataFrame:
    """Blocks with both body and meta, by index; a body without meta is skipped."""
    return metas.join(bodies, ["session_key", "block_index"])


def save_index(chunks: DataFrame, path: str, commit: str) -> None:
    """Write ``chunks(chunk_index, text, embedding)`` as the index of ``commit``."""
    chunks.write.mode("overwrite").parquet(f"{path}/commit={commit}")


def load_index(spark: SparkSession, path: str, commit: str, rows: int | None = None) -> DataFrame | None:
    """The index of ``commit``; None if it is missing or, with ``rows`` given, has another number of rows."""
    try:
        found = spark.read.parquet(f"{path}/commit={commit}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return found if rows is None or found.count() == rows else None


def newest(indexes: DataFrame, keep: int = 3) -> DataFrame:
    """The ``keep`` newest of ``indexes(name, modified)``, by time, then name."""
    return indexes.orderBy(F.desc("modified"), F.desc("name")).limit(keep)


def log_lines(records: DataFrame, context: list[str]) -> DataFrame:
    """(value): records as JSON lines; ``context`` fields stand at the top level and are never overridden by the payload map."""
    extra = F.map_filter("payload", lambda k, v: ~k.isin(*context))
    return records.select(F.to_json(F.map_concat(F.map_from_arrays(F.array(*[F.lit(c) for c in context]), F.array(*[F.col(c).cast("string") for c in context])), extra)).alias("value"))


def capped(pages: DataFrame, most: int) -> DataFrame:
    """``pages(body)`` cut at ``most`` bytes."""
    raw = F.encode("body", "UTF-8")
    return pages.withColumn("body", F.make_valid_utf8(F.substring(raw, 1, most).cast("string")))
