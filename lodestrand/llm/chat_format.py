"""Chat formatting by multi-party perspective rotation (operator 10).

Every participant of a conversation gets a rendering of it in which their own turns are
the assistant's, other participants are users with their names, and system turns stay
system turns. The loss mask is on for the content of assistant turns and the end mark
after it.

A conversation is rendered in pieces of at most ``PIECE`` turn numbers, so no task or row
holds an unbounded conversation; pieces of one rendering, in order, join to the whole, if
``everyone`` gets every piece. Otherwise a piece is rendered only for the participants who
speak in it, as without own turns it has no loss. The text is shuffled once, to gather the
turns of a piece; the perspectives are made after that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut, fits, hint_if, n_partitions

PIECE = 64
#: Rows that one piece may gather; pieces with more (repeated turn numbers) are parted in the order of their turns.
ROWS = 512
#: Rows of the tables of such pieces, and of their ranges, that may be broadcast.
BROADCAST_PIECES = 100_000
SYSTEM = "system"
#: Markers of a rendering.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, piece: int = PIECE, rows_per_piece: int = ROWS, everyone: bool = False) -> DataFrame:
    """One row for each conversation, piece, part and participant of ``turns(conv_id, turn, role, text)``.

    Returns conv_id, piece, part, perspective, n_turns, n_masked_in (turns with loss),
    rendered, and spans: begin:end of the masked-in characters (code points of ``rendered``,
    end exclusive), comma-joined.

    A participant is a distinct role other than ``system``, of the piece, or of the conversation
    if ``everyone`` is set; without one there are no rows. Who is silent in a piece has no
    turns with loss in it, and empty spans. A
    null role is the participant ``unknown``, a null text is empty, a null turn comes first
    and lies in piece 0. Equal turn numbers are ordered by role, then text; rows equal in
    conv_id, turn, role and text are one turn. A null conv_id is a conversation like any
    other. Pieces of more than ``rows_per_piece`` turns are parted into so many turns each,
    numbered in order; else part is 0. An empty table gives an empty table. Other columns are not read.
    """
    rows = turns.select(
        F.col("conv_id"),
        F.coalesce(F.floor(F.col("turn").cast("long") / piece), F.lit(0)).cast("long").alias("piece"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    large = rows.groupBy(F.col("conv_id").alias("c"), F.col("piece").alias("p")).count().where(F.col("count") > rows_per_piece).select("c", "p")
    crowded = large.head(1)
    of_large = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))
    if crowded:
        large = hint_if(large, fits(large, BROADCAST_PIECES))
        ordered = _parted(rows.join(large, of_large, "left_semi").distinct(), rows_per_piece)
        rows = rows.join(large, of_large, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(ordered)
    else:
        rows = rows.withColumn("part", F.lit(0).cast("long"))
    rows = rows.withColumn("listener", F.lit(None).cast("string"))
    if everyone:
        rows = _with_listeners(rows)
    grouped = rows.groupBy("conv_id", "piece", "part").agg(F.collect_list("t").alias("ts"), F.collect_set("listener").alias("listeners")).withColumn("ts", F.array_sort(F.array_distinct("ts")))
    people = F.array_union(F.transform(F.filter("ts", lambda t: t["role"] != SYSTEM), lambda t: t["role"]), "listeners")
    seen = grouped.withColumn("perspective", F.explode(people))

    def header(t: Column) -> Column:
        return F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).when(t["role"] == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"]))

    shown = seen.withColumn("heads", F.transform("ts", header))
    texts = F.zip_with("heads", "ts", lambda h, t: F.concat(F.lit(OPEN), h, F.lit("\n"), t["text"], F.lit(CLOSE + "\n")))
    # A turn takes the markers, its header and its text; its loss begins after the header's line.
    frame = len(OPEN) + 1 + len(CLOSE) + 1
    ends = F.aggregate(
        F.zip_with("heads", "ts", lambda h, t: F.length(h) + F.length(t["text"]) + frame),
        F.array(F.lit(0)),
        lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)),
    )
    shown = shown.withColumn("ends", ends)
    spans = F.zip_with(
        F.transform("heads", lambda h, i: F.struct(h.alias("h"), F.get("ends", i).alias("begin"), F.get("ends", i + 1).alias("end"))),
        "ts",
        lambda s, t: F.when(t["role"] == F.col("perspective"), F.concat((s["begin"] + len(OPEN) + F.length(s["h"]) + 1).cast("string"), F.lit(":"), (s["end"] - 1).cast("string"))),
    )
    return shown.select(
        "conv_id",
        "piece",
        "part",
        "perspective",
        F.size("ts").cast("long").alias("n_turns"),
        F.size(F.filter("ts", lambda t: t["role"] == F.col("perspective"))).cast("long").alias("n_masked_in"),
        F.array_join(texts, "").alias("rendered"),
        F.array_join(F.array_compact(spans), ",").alias("spans"),
    )


def _with_listeners(rows: DataFrame) -> DataFrame:
    """``rows``, and for conversations of several pieces a row without a turn for each piece and participant.

    These rows come from keys and roles only, so the text is not joined.
    """
    keys = rows.select("conv_id", "piece", "part").distinct()
    several = keys.groupBy(F.col("conv_id").alias("c")).count().where("count > 1").select("c")
    if not several.head(1):
        return rows
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    people = rows.where(F.col("t.role") != SYSTEM).select("conv_id", F.col("t.role").alias("listener")).distinct().join(several, same, "left_semi")
    people = people.select(F.col("conv_id").alias("c"), "listener")
    return rows.unionByName(keys.join(people, same).select("conv_id", "piece", "part", "listener"), allowMissingColumns=True)


def _parted(rows: DataFrame, size: int) -> DataFrame:
    """``rows(conv_id, piece, t)`` without repeats, with the part: their place in the order of t within a piece, divided by ``size``.

    The rows are sorted by ranges, so no task holds a whole piece; a place is that in its
    range, after the counts of the ranges before.
    """
    by = ["conv_id", "piece", "t"]
    ranged = rows.repartitionByRange(n_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    # The table is cut, as ranges could differ when they are made again.
    ranged = cut(ranged.select(*by, F.monotonically_increasing_id().alias("at"), F.spark_partition_id().alias("range")), "chat-ranges")
    ranges = ranged.groupBy("conv_id", "piece", "range").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id", "piece").orderBy("range")) - F.col("n")
    ranges = ranges.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.col("range").alias("r"), (before - F.col("least")).alias("shift"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & (F.col("range") == F.col("r"))
    placed = ranged.join(hint_if(ranges, fits(ranges, BROADCAST_PIECES)), same)
    return placed.select("conv_id", "piece", "t", F.floor((F.col("at") + F.col("shift")) / size).cast("long").alias("part"))
