"""Sums and averages of DOUBLE columns that do not depend on the order of rows.

Adding doubles gives a result that changes with the partitioning, and at 10^12
rows the change reaches the second decimal. Each value is therefore split by
size into four whole numbers (lanes), all added up as BIGINT: millions, ones,
millionths and millionths of these. A lane holds less than a million per row,
so no sum of fewer than 9 * 10^12 rows leaves 64 bits. Values are taken at what
a double tells for certain: twelve decimals below 1,000, six below 10^9, two
beyond. Those from 10^12 on, infinities and NaN have no lanes; their plain sum
is added to that of the others.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, functions as F

MILLION = 1e6
FINE, MEDIUM, FAR = 1e3, 1e9, 1e12  # up to these: twelve decimals, six, two


class Moments(NamedTuple):
    """What has to be kept of a column so that groups can be merged later: four lanes, what has none, the number of values."""

    mega: Column
    whole: Column
    micro: Column
    pico: Column
    far: Column
    n: Column

    def named(self, prefix: str) -> list[Column]:
        return [c.alias(f"{prefix}_{f}") for f, c in zip(self._fields, self)]


def moments(x: Column) -> Moments:
    """Aggregates over raw rows."""
    size = F.abs(x)
    near = F.when(size < FAR, x)
    ones = near % MILLION  # without rounding, like the differences below
    whole = F.rint(ones)
    rest = ones - whole
    micro = F.when(size < MEDIUM, F.rint(rest * MILLION)).otherwise(F.rint(rest * 100) * 10_000)
    pico = F.when(size < FINE, F.rint((rest - micro / MILLION) * MILLION * MILLION))
    lanes = ((near - ones) / MILLION, whole, micro, pico)
    return Moments(*(F.sum(lane.cast("bigint")) for lane in lanes), F.sum(F.when(~(size < FAR), x)), F.count(x))


def merged(prefix: str) -> Moments:
    """Aggregates over rows that already carry the moments of ``prefix``."""
    return Moments(*(F.sum(f"{prefix}_{f}") for f in Moments._fields))


def mean(m: Moments, digits: int | None = 2) -> Column:
    """Average as DOUBLE, NULL without values; ``digits=None`` leaves it unrounded."""
    n = F.nullif(m.n, F.lit(0))
    plain = _added(m) / n
    if digits is None:
        return plain
    exact = F.round(_near(m) / n.cast("decimal(20,0)"), digits).cast("double")
    return F.when(m.far.isNull() & exact.isNotNull(), exact).otherwise(F.round(plain, digits))


def total(m: Moments, digits: int = 2) -> Column:
    """Sum as DOUBLE rounded half up, NULL without values."""
    exact = F.round(_near(m), digits).cast("double")
    return F.when(m.far.isNull() & exact.isNotNull(), exact).otherwise(F.round(_added(m), digits))


def _near(m: Moments) -> Column:
    """The lanes as a decimal; NULL without values or from 10^24 on."""
    mega, whole, micro, pico = (F.coalesce(lane, F.lit(0)).cast("decimal(20,0)") for lane in m[:4])
    large = (mega * F.lit(int(MILLION)) + whole).try_cast("decimal(36,12)")
    small = micro * F.lit(Decimal("0.000001")) + pico * F.lit(Decimal("0.000000000001"))
    return F.when(m.n > 0, large + small)


def _added(m: Moments) -> Column:
    """All of it as DOUBLE. Lanes are whole numbers, so their order does not matter here either."""
    mega, whole, micro, pico = (F.coalesce(lane, F.lit(0)).cast("double") for lane in m[:4])
    lanes = F.coalesce(_near(m).cast("double"), mega * MILLION + whole + (micro / MILLION + pico / MILLION / MILLION))
    return F.when(m.n > 0, lanes + F.coalesce(m.far, F.lit(0.0)))


def avg(name: str, digits: int | None = 2) -> Column:
    return mean(moments(F.col(name)), digits)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` rounded half up to two digits, in decimals until the end."""
    share = F.lit(100) * part.cast("decimal(20,0)") / whole.cast("decimal(20,0)")
    return F.round(share, 2).cast("double")
