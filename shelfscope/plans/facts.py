"""What the aggregate reports are made of, read from rows or from a cube.

``Rows`` aggregates the catalogue directly: one scan per report, only the
columns it needs. ``Levels`` reads the same figures from ``build_levels``: all of
them by brand, and those asked by band for the at most 600 combinations of bands.
That is answered by two narrow aggregates instead of one per report, and levels of
separate loads add up. Brands and bands are never combined.
``Cube`` is for figures kept by several keys at once, as those of packs are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.functions import bands, exact
from shelfscope.functions.exact import Moments

c = F.col


def blank(name: str) -> Column:
    return c(name).isNull() | (c(name) == "")


def both_known(x: str, other: str) -> Column:
    """``x`` where ``other`` is known as well."""
    return F.when(c(other).isNotNull(), c(x))


KEYS: dict[str, Callable[[], Column]] = {
    "brand": lambda: c("brand"),
    "discount_band": lambda: bands.discount_band(c("discount_percent")),
    "rating_band": lambda: bands.rating_band(c("rating")),
    "price_bucket": lambda: bands.price_bucket(c("price")),
    "img_bucket": lambda: bands.image_bucket(c("img_count")),
}

FLAGS: dict[str, Callable[[], Column]] = {
    "no_discount_items": lambda: c("price") == c("mrp"),
    "rated_items": lambda: c("rating_total") > 0,
    "unrated_items": lambda: c("rating_total") == 0,
    "null_brands": lambda: blank("brand"),
    "null_titles": lambda: blank("title"),
    "bad_price": lambda: c("price").isNull() | (c("price") <= 0),
}

VALUES: dict[str, Callable[[], Column]] = {
    "price": lambda: c("price"),
    "mrp": lambda: c("mrp"),
    "discount_percent": lambda: c("discount_percent"),
    "rating_nonzero": lambda: F.nullif(c("rating"), F.lit(0.0)),
    "markdown": lambda: F.greatest(c("mrp") - c("price"), F.lit(0.0)),
    "paired_price": lambda: both_known("price", "discount_percent"),
    "paired_discount": lambda: both_known("discount_percent", "price"),
}


def count_where(condition: Column) -> Column:
    """Rows that meet the condition; NULL, not 0, without any row."""
    return F.sum(F.when(condition, 1).otherwise(0))


class Rows:
    """Figures aggregated from the catalogue itself."""

    def __init__(self, products: DataFrame) -> None:
        self.frame = products

    def by(self, key: str) -> DataFrame:
        """What to group by this key."""
        return self.frame

    def key(self, name: str) -> Column:
        return KEYS[name]()

    def items(self) -> Column:
        return F.count("*")

    def flagged(self, name: str) -> Column:
        return count_where(FLAGS[name]())

    def ratings(self) -> Column:
        return F.sum("rating_total")

    def moments(self, name: str) -> Moments:
        return exact.moments(VALUES[name]())


class Cube:
    """The same figures added up from cube rows."""

    def __init__(self, cube: DataFrame) -> None:
        self.frame = cube

    def by(self, key: str) -> DataFrame:
        return self.frame

    def key(self, name: str) -> Column:
        return c(name)

    def items(self) -> Column:
        return F.coalesce(F.sum("items"), F.lit(0))

    def flagged(self, name: str) -> Column:
        return F.sum(name)

    def ratings(self) -> Column:
        return F.sum("total_ratings")

    def moments(self, name: str) -> Moments:
        return exact.merged(name)


class Levels(Cube):
    """Figures kept by brand (``level`` is "brand") and by the bands together ("bands").

    Each level covers all rows, so what has no key is added up from the brands.
    """

    def __init__(self, levels: DataFrame) -> None:
        self.levels = levels
        super().__init__(self.by("brand"))

    def by(self, key: str) -> DataFrame:
        return self.levels.where(c("level") == ("brand" if key == "brand" else "bands"))


Facts = Rows | Cube | Levels
BANDS = [k for k in KEYS if k != "brand"]
#: What the reports ask by band, beside counts.
BAND_VALUES = ["discount_percent", "rating_nonzero"]


def build_levels(products: DataFrame) -> DataFrame:
    facts = Rows(products)
    brands = products.groupBy("brand").agg(*_figures(facts, FLAGS, VALUES))
    bands_ = products.groupBy(*(facts.key(k).alias(k) for k in BANDS)).agg(*_figures(facts, (), BAND_VALUES))
    both = zip(("brand", "bands"), (brands, bands_))
    by_brand, by_bands = (rows.select(F.lit(level).alias("level"), "*") for level, rows in both)
    return by_brand.unionByName(by_bands, allowMissingColumns=True)


def merge_levels(levels: DataFrame) -> DataFrame:
    """One table of levels from the union of several."""
    return levels.groupBy("level", *KEYS).agg(*_figures(Cube(levels), FLAGS, VALUES))


def _figures(facts: Facts, flags: Iterable[str], values: Iterable[str]) -> list[Column]:
    return [
        facts.items().alias("items"),
        *(facts.flagged(f).alias(f) for f in flags),
        facts.ratings().alias("total_ratings"),
        *(column for v in values for column in facts.moments(v).named(v)),
    ]
