"""Shared-folder tables and order numbers that need no single task."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.session import scratch_dir

#: Rows of a side that may be broadcast; beyond it Spark chooses the join itself.
BROADCAST_ROWS = 200_000
_LOCAL_BITS = 33
#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 500
#: Bytes of a row group, which a writing task holds in memory.
GROUP_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, purpose: str, rows: int = TEXT_ROWS) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cut lineage that outlives an executor."""
    path = scratch_dir(df.sparkSession, purpose)
    with batches_of(df.sparkSession, rows):
        df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Arrow batches hold ``rows`` rows at most, so that tasks with long rows stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for broadcast only if it is counted to be short."""
    return F.broadcast(df) if df.count() <= rows else df


def lines_up(df: DataFrame, *order: Column) -> DataFrame:
    """Deal the rows out by range and number them: ``run`` and ``at`` (place in the run) make the order.

    The scan's own row number breaks ties, so rows alike in every key still
    spread over many tasks. To be stored before use, as a second evaluation may
    number tied rows otherwise.
    """
    tie = "__tie"
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(tie))
    number = F.monotonically_increasing_id()
    return (
        dealt.sortWithinPartitions(*order, F.col(tie))
        .drop(tie)
        .withColumn("__id", number)
        .withColumn("run", F.shiftright("__id", _LOCAL_BITS).cast("int"))
        .withColumn("at", F.col("__id").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("__id")
    )


def run_offsets(df: DataFrame, total: Column, *by: str) -> DataFrame:
    """``before``: the sum of ``total`` over all earlier runs (of the same ``by``); a row per run."""
    sums = df.groupBy(*by, "run").agg(total.alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("long")
    return sums.select(*by, "run", before.alias("before"))
