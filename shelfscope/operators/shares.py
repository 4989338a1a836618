"""Share of each group in the total."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfscope.functions.exact import percent


def with_share(counts: DataFrame, items: str = "items", share: str = "share_pct") -> DataFrame:
    """Add each row's percentage of the sum of ``items``; 0 where that sum is 0.

    The total is a scalar subquery over the same grouped counts, so the groups
    are not gathered in one partition and the shuffle of the counts is reused.
    """
    whole = counts.agg(F.sum(items)).scalar()
    value = F.when(whole > 0, percent(F.col(items), whole)).otherwise(F.lit(0.0))
    return counts.withColumn(share, value)
