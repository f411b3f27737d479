"""Lineage cuts and table access that work on a cluster.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``. Where that
is unset, a folder of this process is used, on a local master only: on a cluster each
executor would write to a disk of its own.

Who removes them: tables written inside ``scratch`` go when it ends. What an operator returns
may read a table that stays in ``<checkpoint dir>/lodestrand``; that folder belongs to the
application, and ``sweep`` removes what this process wrote there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
#: Paths of the tables of each open scratch; the first list is of those outside.
_written: list[list[str]] = [[]]


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as a URI prefix without trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="lodestrand-"))
        named = _local[0]
    return named.rstrip("/")


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/lodestrand/{tag}-{uuid.uuid4().hex}"
    _written[-1].append(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    The write survives lost executors: no block of the result lives only on one of them.
    """
    spark = df.sparkSession
    path = table_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, tag: str, **counted: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, with the number of rows as ``rows``, and of those where each of ``counted`` holds, in one pass over the table."""
    out = cut(df, tag)
    return out, out.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(name) for name, c in counted.items()]).head().asDict()


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for path in paths:
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(there, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are cut inside are removed at the end, but for what the given function cuts."""
    _written.append([])

    def keep(df: DataFrame, tag: str) -> DataFrame:
        out = cut(df, tag)
        _written[-2].append(_written[-1].pop())
        return out

    try:
        yield keep
    finally:
        _remove(spark, _written.pop())


def sweep(spark: SparkSession) -> None:
    """Remove all tables that this process wrote and that are still there."""
    _remove(spark, _written[0])
    _written[0].clear()


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than one row beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def hint_if(df: DataFrame, small: bool) -> DataFrame:
    """A broadcast hint for a side whose row count was checked with ``fits``."""
    return F.broadcast(df) if small else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
