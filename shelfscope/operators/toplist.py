"""Top-k that keeps every task bounded, and the samples built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HEAP_ROWS = 100  # up to here every task keeps its k best rows in a heap
HEAP_TASKS = 8192  # and this many tasks hand theirs to the last one
LANES = 256  # above HEAP_ROWS, the number of first-round groups
DRAW_DIGITS = 3  # leading hex digits of a draw that make its bucket: 4,096 buckets

_BUCKET, _LANE, _RANK, _DRAW = "__bucket", "__lane", "__rank", "__draw"


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def desc(name: str) -> Column:
    return F.col(name).desc_nulls_last()


def by(order: Sequence[Column], ties: Sequence[str]) -> list[Column]:
    """A full order: the wanted keys, then the remaining output columns."""
    return [*order, *(asc(c) for c in ties)]


def top_rows(df: DataFrame, order: Sequence[Column], k: int, bucket: Column | None = None) -> DataFrame:
    """The first ``k`` rows in ``order``.

    A plain sort-and-limit sends k rows of every input split to one task. Few
    rows are kept in bounded heaps over at most HEAP_TASKS tasks; for many, the
    splits first settle their best k within LANES groups. Both are exact.
    ``bucket`` may spare most rows the sorting, see ``leading_rows``.
    """
    if k > HEAP_ROWS:
        df = df if bucket is None else leading_rows(df, bucket, k)
        df = _best_per_lane(df, [], order, k)
    else:
        df = df.coalesce(HEAP_TASKS)
    return df.orderBy(*order).limit(k)


def top_rows_per_group(
    df: DataFrame,
    group: str | Sequence[str],
    order: Sequence[Column],
    k: int,
    bucket: Column | None = None,
    lanes: bool = True,
    rank: str = "position",
) -> DataFrame:
    """The first ``k`` rows of each group, with their rank from 1.

    One group may hold most of the rows, so the lanes cut it before it meets in
    one task: that task sees at most LANES * k rows. Frames that come out of an
    aggregation have few partitions, each cut to k rows where it stands, and can
    do without the extra round (``lanes=False``). With ``bucket`` the group is
    one column of few values.
    """
    groups = [group] if isinstance(group, str) else list(group)
    if bucket is not None:
        df = leading_rows(df, bucket, k, *groups)
    if lanes:
        df = _best_per_lane(df, groups, order, k)
    last = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(last)).filter(F.col(rank) <= k)


def leading_rows(df: DataFrame, bucket: Column, k: int, group: str | None = None) -> DataFrame:
    """Leave out rows that cannot be among the first ``k`` (of their group).

    ``bucket`` maps the leading order key to a bounded number of values that
    sort as the rows do, lower ones first. Counting rows per bucket needs no sort; every row up to
    the bucket that completes k rows is kept, however many these are.
    """
    groups = [group] if group else []
    sizes = df.groupBy(*groups, bucket.alias(_BUCKET)).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*groups).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    needed = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < k)
    ends = needed.groupBy(*groups).agg(F.max(_BUCKET).alias("end"))
    if group is None:
        return df.filter(bucket <= ends.scalar())
    by_group = ends.agg(F.map_from_entries(F.collect_list(F.struct(group, "end")))).scalar()
    return df.filter(bucket <= F.try_element_at(by_group, F.col(group)))


def _best_per_lane(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    lane = Window.partitionBy(*group, _LANE).orderBy(*order)
    return (
        df.withColumn(_LANE, F.spark_partition_id() % LANES)
        .withColumn(_RANK, F.row_number().over(lane))
        .filter(F.col(_RANK) <= k)
        .drop(_LANE, _RANK)
    )


def sample_rows(df: DataFrame, n: int, seed: int | None = None, key: Sequence[str] = ()) -> DataFrame:
    """``n`` rows in random order.

    With ``key`` the order is the md5 of those columns, so the same rows come
    back whatever the partitioning; otherwise it is drawn from ``rand(seed)``.
    """
    if not key:
        drawn = df.withColumn(_DRAW, F.rand(seed))
        return top_rows(drawn, by([asc(_DRAW)], df.columns), n).drop(_DRAW)
    drawn = df.withColumn(_DRAW, F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key))))
    bucket = F.left(F.col(_DRAW), F.lit(DRAW_DIGITS))
    return top_rows(drawn, by([asc(_DRAW)], df.columns), n, bucket).drop(_DRAW)
