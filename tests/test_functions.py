"""Bands, coercion, exact arithmetic, sentences: edge rows and properties."""

import math
import random
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from shelfscope.functions import bands, coerce, exact

INF = float("inf")

BANDS = [
    (bands.discount_band, "double", {
        0.0: "0%", 0.01: "0-20%", 19.99: "0-20%", 20.0: "20-40%", 40.0: "40-60%", 60.0: "60%+", -5.0: "0-20%",
        None: "60%+",
    }),
    (bands.rating_band, "double", {
        0.0: "0 (unrated)", 0.3: "1.0-1.9", 2.0: "2.0-2.9", 3.0: "3.0-3.9", 4.0: "4.0-4.49", 4.5: "4.5-5.0",
        None: "4.5-5.0",
    }),
    (bands.price_bucket, "double", {
        499.99: "<500", 500.0: "500-999", 999.5: "500-999", 1000.0: "1000-1999", 2000.0: "2000-4999",
        5000.0: "5000+", None: "5000+",
    }),
    (bands.image_bucket, "bigint", {None: "0", 0: "0", 1: "1-2", 2: "1-2", 3: "3-4", 4: "3-4", 5: "5+"}),
]


@pytest.mark.parametrize("band,kind,cases", BANDS, ids=lambda x: getattr(x, "__name__", ""))
def test_band_edges(spark, band, kind, cases):
    rows = spark.createDataFrame([(x,) for x in cases], f"x {kind}")
    assert {r.x: r.b for r in rows.select("x", band(F.col("x")).alias("b")).collect()} == cases


WHOLES = {
    "12": 12, " 7 ": 7, "+3": 3, "-5": -5, "1_000": 1000, "\t8": 8, "007": 7, "9223372036854775807": 2**63 - 1,
    "12.0": None, "abc": None, "": None, "_1": None, "1__0": None, "1_": None, "+ 3": None, "NA": None,
    "99999999999999999999": None, None: None,
}
REALS = {
    "10.5": 10.5, "1e2": 100.0, "inf": INF, "-Infinity": -INF, " 2. ": 2.0, ".5": 0.5, "+.5e3": 500.0,
    "1_0.5": 10.5, "1E-3": 0.001, "7": 7.0, "1e400": INF,
    "10.5d": None, "5f": None, "0x1p3": None, "abc": None, "": None, "nan": None, "NAN": None, ".": None,
    "e5": None, "- 5": None, "1,5": None, None: None,
}
WORDS = {
    "NA": None, "None": None, "null": None, "nan": None, "NaN": None, "NAN": None, "": None, "#N/A": None,
    "<NA>": None, "n/a": None, "4711": "4711", "none": "none", "na": "na", " ": " ", "a • b": "a • b", None: None,
}


@pytest.mark.parametrize(
    "read,cases", [(coerce.as_whole, WHOLES), (coerce.as_real, REALS), (coerce.as_text, WORDS)]
)
def test_coercion(spark, read, cases):
    rows = spark.createDataFrame([(x,) for x in cases], "x string")
    assert {r.x: r.y for r in rows.select("x", read(F.col("x")).alias("y")).collect()} == cases


@pytest.mark.parametrize("pattern,read", [(coerce.WHOLE, int), (coerce.REAL, float)])
def test_number_patterns_agree_with_python(pattern, read):
    import re

    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("0123_ +-.eEinf") for _ in range(rng.randint(1, 6)))
        try:
            read(text)
            number = True
        except ValueError:
            number = False
        assert bool(re.search(pattern.replace("(?i:inf|infinity)", "(?:[iI][nN][fF]|infinity)"), text)) == number, text


def half_up(x: Fraction) -> float:
    cents = Decimal(x.numerator) / Decimal(x.denominator)
    return float(cents.quantize(Decimal("0.01"), ROUND_HALF_UP))


def test_mean_and_total_are_exact_and_independent_of_partitioning(spark):
    rng = random.Random(7)
    values = [rng.choice([rng.randint(-10**8, 10**8) / 100, rng.randint(0, 10**9) / 1000, None]) for _ in range(5000)]
    known = [Fraction(str(v)) for v in values if v is not None]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for parts in (1, 7):
        m = exact.moments(F.col("x"))
        got = rows.repartition(parts).agg(exact.mean(m).alias("m"), exact.total(m).alias("t")).first()
        assert got.m == half_up(sum(known) / len(known))
        assert got.t == half_up(sum(known))


def test_halves_are_rounded_up(spark):
    # as doubles 4.005 lies below the half and 1.115 above it
    rows = spark.createDataFrame([("a", 4.0), ("a", 4.01), ("b", 1.11), ("b", 1.12), ("c", -0.01), ("c", 0.0)], "k string, x double")
    assert dict(rows.groupBy("k").agg(exact.avg("x")).collect()) == {"a": 4.01, "b": 1.12, "c": -0.01}
    share = spark.range(1).select(exact.percent(F.lit(2403), F.lit(60000))).first()[0]
    assert share == 4.01


def test_values_beyond_exact_range_still_count(spark):
    rows = spark.createDataFrame([("a", INF), ("a", 1.0), ("b", 1e300), ("b", 3e300), ("c", None)], "k string, x double")
    got = {r.k: (r.m, r.t) for r in rows.groupBy("k").agg(
        exact.avg("x").alias("m"), exact.total(exact.moments(F.col("x"))).alias("t")).collect()}
    assert got["a"] == (INF, INF)
    assert math.isclose(got["b"][0], 2e300) and math.isclose(got["b"][1], 4e300)
    assert got["c"] == (None, None)


def test_merged_moments_equal_direct_ones(spark):
    rows = spark.createDataFrame([(i % 9, i / 100) for i in range(2000)] + [(3, None), (4, 1e15)], "k int, x double")
    cube = rows.groupBy("k").agg(*exact.moments(F.col("x")).named("x"))
    for split in (rows.filter("k <> 4"), rows):
        keys = [r.k for r in split.select("k").distinct().collect()]
        merged = cube.filter(F.col("k").isin(keys)).agg(exact.mean(exact.merged("x"))).first()[0]
        assert merged == pytest.approx(split.agg(exact.avg("x")).first()[0], rel=1e-12)


def test_sums_beyond_the_decimal_range(spark):
    big = 4 * 10**18
    cube = spark.createDataFrame(
        [("a", big, 0, 0, None, None, big)] * 2 + [("b", None, None, None, None, None, 0), ("b", 0, 3, 250_000, 0, None, 2)],
        "k string, x_mega long, x_whole long, x_micro long, x_pico long, x_far double, x_n long",
    )
    once = cube.groupBy("k").agg(*exact.merged("x").named("x"))
    for frame in (cube, once):
        got = {r.k: (r.m, r.t) for r in frame.groupBy("k").agg(
            exact.mean(exact.merged("x")).alias("m"), exact.total(exact.merged("x")).alias("t")).collect()}
        assert got == {"a": (1e6, 8e24), "b": (1.63, 3.25)}


@pytest.mark.parametrize("values", [
    [2e9, 4e-7, 4e-7, -2e9, 10.1, 0.2],
    [999_999_999_999.25, -0.75, 1e-12, 123456.789, -999.000001, 5e11],
    [4e-7, 4e-7],
])
def test_large_and_fine_values_share_one_arithmetic(spark, values):
    known = sum(Fraction(str(v)) for v in values) * 50
    rows = spark.createDataFrame([(v, i % 4) for i in range(50) for v in values], "x double, k int")
    m = exact.moments(F.col("x"))
    both = lambda m: [exact.total(m, 12).alias("t"), exact.mean(m, None).alias("m")]
    seen = {tuple(rows.repartition(p).agg(*both(m)).first()) for p in (1, 3, 7, 16)}
    levels = rows.repartition(5).groupBy("k").agg(*m.named("x"))
    seen.add(tuple(levels.agg(*both(exact.merged("x"))).first()))
    assert seen == {(float(known), float(known) / (50 * len(values)))}


def test_values_without_lanes_are_added_to_the_others(spark):
    rows = spark.createDataFrame([("a", 2e12), ("a", 1.5), ("n", float("nan")), ("n", 1.0), ("z", -0.0)], "k string, x double")
    got = {r.k: (r.t, r.m) for r in rows.groupBy("k").agg(
        exact.total(exact.moments(F.col("x"))).alias("t"), exact.avg("x").alias("m")).collect()}
    assert got["a"] == (2000000000001.5, 1000000000000.75) and math.isnan(got["n"][0]) and got["z"] == (0.0, 0.0)


def test_negative_and_fine_values(spark):
    rows = spark.createDataFrame([(-1.25,), (-0.000001,), (999_999_999.123456,), (0.1,), (0.2,)], "x double")
    m = exact.moments(F.col("x"))
    assert rows.agg(exact.total(m, 6), exact.mean(m, 6)).first()[:] == (999999998.173455, 199999999.634691)
