"""Mixing sources to target weights by Pareto order sampling (operator 6).

Every source has a target number of words. A source whose target is r times its size gives
floor(r) whole copies of each document (the certain part); the rest, f = r - floor(r), is
a sample without replacement and with unequal probabilities: a document of size s has
inclusion probability p = min(c * x, 0.999), x = the bit length of s, with c such that the
expected words are the rest of the target. Documents are ranked by (u / (1 - u)) /
(p / (1 - p)) with a hashed u, and the least ones are taken while they fit into the rest of
the target. From the first that does not fit, the order is followed on among the documents
that still fit, for ``TURNS`` turns; the last turn overshoots if that comes closer.

All of it is DataFrame expressions. No source is ranked in one task: sizes and ranks are dealt
to ranges of about equal rows, words are summed by range, and only the range at a source's edge
is ordered by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut, hint_if, measured, n_partitions, scratch

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
WEIGHTS = (5, 2, 1)
TURNS = 4
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame) -> DataFrame:
    """``totals(source, source_size, ...)`` with ``target``, one row a source.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Targets share the sum of all
    sizes by weight; a target stops at 3 times its source's size and the excess is reshared
    by weight until none is above. That fixed point has one level for all sources below
    their limit, so it is found by ordering sources by limit / weight: the first j of that
    order stop, for the least j whose level does not exceed the next source's ratio. The
    window without a key sees one row for each source.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight.cast("long")).withColumn("limit", CAP * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    stepped = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))).alias("left_words"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    level = F.col("left_words") / F.col("left_weight")
    free = level * F.col("weight") <= F.col("limit")
    found = stepped.withColumn("level", F.first(F.when(free, level), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") > F.col("limit")), F.col("limit").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return found.select(*totals.columns, target.alias("target"))


#: Sources whose plan rows (below 200 bytes each) may be broadcast; with more, the join is shuffled.
BROADCAST_SOURCES = 50_000
CUTS = "array<struct<limit:bigint,last:double>>"


def _sized(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(row, source, key, size): the carried columns as one, so that their names clash with none used here."""
    text = F.col("text").cast("string")
    key = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(text).cast("string"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("source").cast("string").alias("source"), key.alias("key"), word_count(text).alias("size"))


def _rank() -> Column:
    """A document's place in (0, 1] in its source's order, from key, size, rest and moment."""
    u = (F.conv(F.substring(F.md5("key"), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    p = F.least(F.coalesce(F.try_divide(F.col("rest") * F.length(F.bin("size")), F.col("moment").cast("double")), F.lit(0.0)), F.lit(0.999))
    odds = (u / (1 - u)) * ((1 - p) / p)
    return F.when(p > 0, odds / (1 + odds)).otherwise(1.0)


def with_copies(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(row, size, source_size, target, copies): the ``carried`` columns of each row of ``docs``, and how often it is taken, 0 to 3.

    One pass counts words; passes over the table of ranks find each source's cuts, and then every
    row is decided by itself. Rows of one source that are equal in doc_id and text are taken or
    left together.
    """
    with scratch(docs.sparkSession) as keep:
        plan, small = _plan(docs)
        plan = keep(plan, "mix")
    out = _sized(docs, carried).join(hint_if(plan.withColumnRenamed("source", "of"), small), F.col("source").eqNullSafe(F.col("of")))
    out = out.withColumn("rank", _rank())
    chosen = F.exists("cuts", lambda c: (F.col("size") <= c["limit"]) & (F.col("rank") <= c["last"]))
    taken = F.when((F.col("rest") > 0) & chosen, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.col("whole") + taken).otherwise(0).cast("int")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"))


def _plan(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(source, moment, source_size, target, whole, rest, cuts): what each source takes; and whether that may be broadcast."""
    slim = cut(_sized(docs, ["doc_id"]).select("source", "key", "size"), "sizes")
    moment = F.sum(F.col("size") * F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0))
    plan = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), moment.alias("moment")))
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan, counts = measured(plan.select("source", "moment", "source_size", "target", "whole", "rest"), "targets")
    small = counts["rows"] <= BROADCAST_SOURCES
    drawn = slim.where("size > 0").join(hint_if(plan.where("rest > 0").select(F.col("source").alias("s"), "rest", "moment"), small), F.col("source").eqNullSafe(F.col("s")))
    # Rows of one rank are one entry, so that no range is crowded by repeats of a row.
    ranks = drawn.select("s", "size", _rank().alias("rank")).groupBy("s", "rank", "size").agg(F.sum("size").alias("words"))
    ranks = cut(ranks.repartitionByRange(n_partitions(docs.sparkSession), "s", "rank").withColumn("range", F.spark_partition_id()), "ranks")
    state = plan.select("source", F.col("rest").alias("left_words"), F.lit(1 << 62).alias("limit"), F.lit(0.0).alias("last"), F.array().cast(CUTS).alias("cuts"))
    for turn in range(TURNS):
        state = cut(_fill(ranks, state, small, turn == TURNS - 1), "turn")
    return plan.join(state.select(F.col("source").alias("s"), "cuts"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), small


def _fill(ranks: DataFrame, state: DataFrame, small: bool, final: bool) -> DataFrame:
    """``state(source, left_words, limit, last, cuts)`` after one more turn.

    Each source takes rows of ``ranks(s, size, rank, words, range)`` in rank order, from behind its
    last cut and of at most ``limit`` words, while they fit into left_words; the last turn may
    overshoot if that comes closer. A cut (limit, last) takes rows with at most ``limit`` words up
    to rank ``last``. Limits only fall and ranks only rise, so a row that fits a cut was never
    passed over by an earlier one.
    """
    open_ = state.where("left_words > 0").select(F.col("source").alias("of"), "left_words", "limit", "last")
    rows = ranks.join(hint_if(open_, small), F.col("s").eqNullSafe(F.col("of"))).where("size <= limit and rank > last")
    sums = cut(rows.groupBy("s", "left_words", "range").agg(F.sum("words").alias("words"), F.max("rank").alias("top")), "ranges")
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("below", F.max("top").over(before))
    # Ranges before the edge are taken whole; the edge is the range in which the words reach left_words.
    edges = placed.where("start <= left_words and start + words > left_words").select(F.col("s").alias("e"), F.col("range").alias("edge"), "start", "below")
    at_edge = rows.join(hint_if(edges, small), F.col("s").eqNullSafe(F.col("e"))).where("range = edge")
    inside = Window.partitionBy("s").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.col("start") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    takes = filled + F.col("words") / (2.0 if final else 1.0) <= F.col("left_words")
    taking = at_edge.select("s", "rank", "words", takes.alias("takes"))
    last = taking.groupBy(F.col("s").alias("t")).agg(F.max(F.when(F.col("takes"), F.col("rank"))).alias("edge_last"), F.sum(F.when(F.col("takes"), F.col("words"))).alias("edge_words"))
    totals = sums.groupBy(F.col("s").alias("b")).agg(F.sum("words").alias("all_words"))
    side = lambda df, of: (hint_if(df, small), F.col("source").eqNullSafe(F.col(of)), "left")
    joined = state.withColumnRenamed("last", "was").join(*side(totals, "b")).join(*side(edges, "e")).join(*side(last, "t"))
    whole = F.col("start").isNull()  # no edge: all that is left is taken
    taken = F.when(whole, F.coalesce("all_words", F.lit(0))).otherwise(F.col("start") + F.coalesce("edge_words", F.lit(0)))
    reached = F.when(whole, F.lit(1.0)).otherwise(F.coalesce("edge_last", "below", "was"))
    joined = joined.select("source", (F.col("left_words") - taken).alias("left_words"), "limit", reached.alias("last"), "cuts")
    made = F.struct("limit", "last")
    return joined.select("source", "left_words", F.least("limit", F.greatest(F.floor("left_words"), F.lit(0))).cast("long").alias("limit"), "last", F.concat("cuts", F.array(made)).alias("cuts"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs(doc_id, text, source)``.

    taken is copies * size. A null or empty text has size 0 and gives nothing; a source
    without words has target 0; a null source is a source of its own, the last in order.
    The draw depends on doc_id and text alone, so reruns agree whatever the partitioning; rows
    equal in both are taken or left together. Other columns are not read. An empty table
    gives an empty table.
    """
    out = with_copies(docs, ["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Rows without words are in no mix.
    """
    out = with_copies(docs, docs.columns).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
