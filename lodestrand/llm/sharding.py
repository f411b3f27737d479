"""Sharding by a hierarchical weighted hash tree (operator 3).

Shards are the leaves of a tree of regions and racks. A document descends from the root:
at each level every child draws -ln(u) / weight, with u in (0, 1) hashed from the document's
key and the child's name, and the least draw wins, so a child gets its share of weight.
A node's weight is the sum of its shards' weights. When weights change, draws of other
nodes stay as they are, so only documents of the changed subtrees move.

Law ``key``: the key and the tree decide alone. A shard added by ``grow`` opens a region of
its own; every draw of the older regions is unchanged, so documents move into it and
nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.tables import cut, hint_if, measured, table_path


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def balanced(n: int) -> list[Shard]:
    """``n`` equal shards, two to a rack and two racks to a region."""
    return [Shard(i, f"region{i // 4}", f"rack{i // 2}") for i in range(n)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` and one more shard, in a new region and rack."""
    number = max((s.number for s in tree), default=-1) + 1
    return [*tree, Shard(number, f"grown{number}", f"grown{number}", weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight for u in (0, 1) with 53 bits of the hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(weight)


def _descend(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The result of the child with the least draw; equal draws go to the lesser name."""
    if len(children) == 1:
        return next(iter(children.values()))[1]
    ranked = F.least(*[F.struct(_draw(key, name, weight).alias("draw"), F.lit(name).alias("name")) for name, (weight, _) in children.items()])
    chosen = ranked["name"]
    out = None
    for name, (_, below) in sorted(children.items()):
        out = F.when(chosen == name, below) if out is None else out.when(chosen == name, below)
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard number for ``key`` as an int column. A null key is a key like any other."""
    if not tree:
        raise ValueError("a tree needs a shard")
    key = F.coalesce(key.cast("string"), F.lit("\0null"))

    def level(shards: list[Shard], names: list[str]) -> Column:
        if not names:
            return _descend(key, {f"shard/{s.number}": (s.weight, F.lit(s.number)) for s in shards})
        groups: dict[str, list[Shard]] = {}
        for s in shards:
            groups.setdefault(getattr(s, names[0]), []).append(s)
        return _descend(key, {f"{names[0]}/{g}": (sum(s.weight for s in inside), level(inside, names[1:])) for g, inside in groups.items()})

    return level(tree, ["region", "rack"]).cast("int")


#: Rows of a shard that one task numbers, on average.
BUCKET_ROWS = 50_000
MAX_BUCKETS = 1 << 16


def with_slots(rows: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """``rows`` with ``slot``, which counts the rows of each shard from 0 without gaps.

    Rows of a shard are dealt to buckets by a hash of ``order`` and numbered inside a bucket;
    a bucket begins where the counts of the buckets before it end. So no task numbers a
    whole shard. The bucket counts are one row for each bucket and shard.
    """
    counted = rows.groupBy(shard).count().agg(F.max("count")).head()[0] or 0
    n = min(MAX_BUCKETS, counted // BUCKET_ROWS + 1)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = rows.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = rows.withColumn("__row", F.row_number().over(inside))
    return numbered.join(starts, [shard, "__bucket"]).withColumn(slot, (F.col("__start") + F.col("__row") - 1).cast("long")).drop("__bucket", "__start", "__row", "__n")


def assign(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs(doc_id, text)``.

    size is the text's UTF-8 bytes plus 1 (null: 1), text_crc32 the unsigned CRC-32 of them
    (null: that of no bytes, 0). law is ``key``: shard depends on doc_id and ``n_shards`` alone,
    grown_shard is the shard with one more. Repeated doc_ids share a shard and get slots of
    their own; a null doc_id is one key. Other columns of ``docs`` are not read. An empty
    table gives an empty table.
    """
    tree = balanced(n_shards)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree).alias("shard"),
        shard_of(F.col("doc_id"), grow(tree)).alias("grown_shard"),
    )
    out = with_slots(cut(rows, "sharded"), "shard", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: Rows of the table of files (some 200 bytes each) that may be broadcast; with more, the join is shuffled.
BROADCAST_FILES = 100_000


def place(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced), by law ``key``.

    The rows are written once, to a folder for each shard, without a shuffle. A row's slot is its
    place in its file, behind the rows of the shard's files that come before by name. So
    slots are gapless from 0 however often a row repeats, no task sorts or holds a shard, and
    what is numbered is one row for each file. Which row of a shard gets which slot follows
    the files. Repeated doc_ids share a shard; a null doc_id is one key. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    held = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    rows = held.select("*", shard_of(F.col("doc_id"), balanced(n_shards)).alias("shard"))
    path = table_path(spark, "shards")
    rows.write.partitionBy("shard").parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    file = F.col("_metadata.file_path")
    counts = written.groupBy("shard", file.alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts, files = measured(counts.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    # The row is one column, so that its names cannot clash with those used here.
    packed = written.select(F.struct(*[F.col(f"`{c}`") for c in held.columns]).alias("row"), "shard", file.alias("file"), F.col("_metadata.row_index").alias("at"))
    placed = packed.join(hint_if(starts, files["rows"] <= BROADCAST_FILES), "file")
    return placed.select("row.*", "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` to one folder ``shard=N`` for each shard, with files of at most ``rows_per_file`` rows."""
    placed = docs.withColumn("shard", shard_of(F.col("doc_id"), balanced(n_shards)))
    placed.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
