"""The four banding functions. All are pure projections.

A NULL falls through every comparison, so it lands in the last band; only the
image count names NULL itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Band edges (exclusive upper bound) and labels.
DISCOUNT_ZERO = "0%"
DISCOUNT_BELOW = ((20, "0-20%"), (40, "20-40%"), (60, "40-60%"))
DISCOUNT_TOP = "60%+"

RATING_ZERO = "0 (unrated)"
RATING_BELOW = ((2, "1.0-1.9"), (3, "2.0-2.9"), (4, "3.0-3.9"), (4.5, "4.0-4.49"))
RATING_TOP = "4.5-5.0"

PRICE_BELOW = ((500, "<500"), (1000, "500-999"), (2000, "1000-1999"), (5000, "2000-4999"))
PRICE_TOP = "5000+"

# Image-count edges are inclusive upper bounds.
IMAGES_NONE = "0"
IMAGES_UP_TO = ((2, "1-2"), (4, "3-4"))
IMAGES_TOP = "5+"


def _choose(cases: list[tuple[Column, str]], last: str) -> Column:
    (condition, label), *rest = cases
    chain = reduce(lambda c, case: c.when(*case), rest, F.when(condition, label))
    return chain.otherwise(last)


def discount_band(x: Column) -> Column:
    cases = [(x == 0, DISCOUNT_ZERO)] + [(x < edge, label) for edge, label in DISCOUNT_BELOW]
    return _choose(cases, DISCOUNT_TOP)


def rating_band(x: Column) -> Column:
    cases = [(x == 0, RATING_ZERO)] + [(x < edge, label) for edge, label in RATING_BELOW]
    return _choose(cases, RATING_TOP)


def price_bucket(x: Column) -> Column:
    return _choose([(x < edge, label) for edge, label in PRICE_BELOW], PRICE_TOP)


def image_bucket(x: Column) -> Column:
    cases = [(x.isNull() | (x == 0), IMAGES_NONE)]
    return _choose(cases + [(x <= edge, label) for edge, label in IMAGES_UP_TO], IMAGES_TOP)
