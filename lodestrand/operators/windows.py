"""Order-dependent operators as windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_last(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key in ``order`` (given newest first)."""
    age = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__age", age).where(F.col("__age") <= n).drop("__age")


def prune(rows: DataFrame, key: str, order: list[Column], keep: int) -> DataFrame:
    """The rows that ``keep_last`` would not keep."""
    age = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__age", age).where(F.col("__age") > keep).drop("__age")


def broken_ranges(blocks: DataFrame) -> DataFrame:
    """Rows of ``blocks(key, index, begin, end)`` that do not begin where the one before ends, or are empty."""
    before = F.lag("end").over(Window.partitionBy("key").orderBy("index"))
    return blocks.withColumn("expected", F.coalesce(before, F.lit(0))).where((F.col("begin") != F.col("expected")) | (F.col("end") <= F.col("begin")))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each value of ``keys``, with the least ``order``, by aggregate."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def micros_of(column: str) -> Column:
    """Microseconds since 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def over_limit(events: DataFrame, most: int, seconds: float) -> DataFrame:
    """``events(key, ts)`` with ``in_window``, the events of the key in the last ``seconds`` up to each, and ``violates``.

    An event exactly ``seconds`` old has left the window.
    """
    micros = micros_of("ts")
    span = Window.partitionBy("key").orderBy("__us").rangeBetween(-int(seconds * 1_000_000) + 1, 0)
    return events.withColumn("__us", micros).withColumn("in_window", F.count(F.lit(1)).over(span)).withColumn("violates", F.col("in_window") > most).drop("__us")


def compact_queue(items: DataFrame) -> DataFrame:
    """``items(queue, dedup_key, seq, payload)``: one row a key, at its first place with its last payload, and the number of merged items."""
    return items.groupBy("queue", "dedup_key").agg(F.min("seq").alias("place"), F.max_by("payload", "seq").alias("payload"), F.count(F.lit(1)).alias("merged"))


def changes(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key; the first counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__before", before).withColumn("__first", F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1).where(F.col("__first") | ~F.col(value).eqNullSafe(F.col("__before"))).drop("__before", "__first")


def debounced(events: DataFrame, gap: str) -> DataFrame:
    """(key, saved_at, n): one save for each run of ``events(key, ts)`` without a pause of ``gap``."""
    sessions = events.groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("key", F.col("w.end").alias("saved_at"), "n")


def budgeted_tail(segments: DataFrame, limit: int, separator: int = 2) -> DataFrame:
    """The last segments of ``segments(key, seq, text)`` whose lengths with separators stay within ``limit``."""
    after = Window.partitionBy("key").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return segments.withColumn("__used", F.sum(F.length("text") + separator).over(after) - separator).where(F.col("__used") <= limit).drop("__used")


def seal_points(requests: DataFrame, least_requests: int, least_tokens: int) -> DataFrame:
    """(key, seq, sealed) of ``requests(key, seq, tokens)``: a block is sealed when at least ``least_requests`` came and more than ``least_tokens`` are held since the last seal."""
    rows = requests.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "tokens"))).alias("r"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<seq:bigint,sealed:boolean>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        n, held = acc["n"] + 1, acc["held"] + r["tokens"]
        seal = (n >= least_requests) & (held > least_tokens)
        row = F.struct(r["seq"].cast("long").alias("seq"), seal.alias("sealed"))
        return F.struct(F.when(seal, 0).otherwise(n).alias("n"), F.when(seal, F.lit(0).cast("long")).otherwise(held).alias("held"), F.concat(acc["out"], F.array(row)).alias("out"))

    return rows.select("key", F.explode(F.aggregate("r", start, step)["out"]).alias("x")).select("key", "x.seq", "x.sealed")
