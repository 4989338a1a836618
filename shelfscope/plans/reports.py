"""The sixteen fixed catalogue reports.

Aggregate reports take ``Facts`` and so run on the rows or on shared levels;
top lists and the sample always read the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from shelfscope.functions import exact
from shelfscope.operators.shares import with_share
from shelfscope.operators.toplist import asc, by, desc, sample_rows, top_rows
from shelfscope.plans.facts import Facts, Levels, Rows

c = F.col
RATED_LIST = ["product_id", "title", "brand", "rating", "rating_total", "price", "mrp", "discount_percent"]
DISCOUNT_LIST = ["product_id", "title", "brand", "price", "mrp", "discount_percent", "rating", "rating_total"]
SAMPLE = ["product_id", "brand", "price", "mrp", "discount_percent"]
SAMPLE_ROWS = 1000


def kpi_columns(facts: Facts) -> list[Column]:
    return [
        exact.mean(facts.moments("price")).alias("avg_price"),
        exact.mean(facts.moments("mrp")).alias("avg_mrp"),
        exact.mean(facts.moments("discount_percent")).alias("avg_discount_pct"),
        facts.flagged("no_discount_items").alias("no_discount_items"),
    ]


def _by(facts: Facts, key: str, label: str, *figures: Column) -> DataFrame:
    return facts.by(key).groupBy(facts.key(key).alias(label)).agg(*figures)


def _biggest_first(rows: DataFrame, label: str) -> DataFrame:
    return rows.orderBy(desc("items"), asc(label))


def row_counts(facts: Facts) -> DataFrame:
    return facts.frame.agg(facts.items().alias("products"), F.count_distinct("brand").alias("brands"))


def core_kpis(facts: Facts) -> DataFrame:
    return facts.frame.agg(*kpi_columns(facts))


def discount_bands(facts: Facts) -> DataFrame:
    return _biggest_first(_by(facts, "discount_band", "band", facts.items().alias("items")), "band")


def brand_avg_discount_top20(facts: Facts) -> DataFrame:
    average = exact.mean(facts.moments("discount_percent")).alias("avg_discount_pct")
    rows = _by(facts, "brand", "brand", facts.items().alias("items"), average).filter(c("items") >= 5)
    return top_rows(rows, by([desc("avg_discount_pct")], ["brand"]), 20)


def brand_concentration(facts: Facts, k: int = 20) -> DataFrame:
    rows = with_share(_by(facts, "brand", "brand", facts.items().alias("items")))
    return top_rows(rows, by([desc("items")], ["brand"]), k)


def ratings_coverage(facts: Facts) -> DataFrame:
    return facts.frame.agg(
        facts.flagged("rated_items").alias("rated_items"),
        facts.flagged("unrated_items").alias("unrated_items"),
        exact.mean(facts.moments("rating_nonzero")).alias("avg_rating_nonzero"),
    )


def rating_distribution(facts: Facts) -> DataFrame:
    return _biggest_first(_by(facts, "rating_band", "rating_band", facts.items().alias("items")), "rating_band")


def rating_by_discount_band(facts: Facts) -> DataFrame:
    return _by(
        facts,
        "discount_band",
        "band",
        exact.mean(facts.moments("rating_nonzero")).alias("avg_rating_nonzero"),
        facts.ratings().alias("total_ratings"),
        facts.items().alias("items"),
    ).orderBy(asc("band"))


def price_bucket_distribution(facts: Facts) -> DataFrame:
    average = exact.mean(facts.moments("discount_percent")).alias("avg_discount_pct")
    return _biggest_first(
        _by(facts, "price_bucket", "price_bucket", facts.items().alias("items"), average), "price_bucket"
    )


def image_count_vs_rating(facts: Facts) -> DataFrame:
    average = exact.mean(facts.moments("rating_nonzero")).alias("avg_rating_nonzero")
    return _biggest_first(_by(facts, "img_bucket", "img_bucket", facts.items().alias("items"), average), "img_bucket")


def total_markdown_value(facts: Facts) -> DataFrame:
    return facts.frame.agg(exact.total(facts.moments("markdown")).alias("total_markdown_value"))


def data_quality_nulls(facts: Facts) -> DataFrame:
    return facts.frame.agg(*(facts.flagged(f).alias(f) for f in ("null_brands", "null_titles", "bad_price")))


def top_rated_by_volume(products: DataFrame) -> DataFrame:
    rows = products.filter((c("rating_total") >= 100) & (c("rating") >= 4)).select(RATED_LIST)
    return top_rows(rows, by([desc("rating"), desc("rating_total")], RATED_LIST), 50)


def deepest_discounts(products: DataFrame, k: int = 50) -> DataFrame:
    order = by([desc("discount_percent"), asc("price")], DISCOUNT_LIST)
    return top_rows(products.select(DISCOUNT_LIST), order, k)


def highest_discounts_rated(products: DataFrame) -> DataFrame:
    return deepest_discounts(products.filter(c("rating_total") > 0))


def duplicate_titles_top50(products: DataFrame) -> DataFrame:
    rows = products.groupBy("title").agg(F.count("*").alias("dupes")).filter(c("dupes") > 1)
    return top_rows(rows, by([desc("dupes")], ["title"]), 50)


def sample_price_vs_mrp(products: DataFrame, seed: int | None = None) -> DataFrame:
    """1,000 priced products in random order; the same ones each time unless a seed is given."""
    rows = products.filter(c("price").isNotNull() & c("mrp").isNotNull())
    if seed is not None:
        return sample_rows(rows.select(SAMPLE), SAMPLE_ROWS, seed=seed)
    rows = rows.select(*SAMPLE, "style_id")
    return sample_rows(rows, SAMPLE_ROWS, key=["product_id", "style_id"]).select(SAMPLE)


AGGREGATES: dict[str, Callable[[Facts], DataFrame]] = {
    "row_counts": row_counts,
    "core_kpis": core_kpis,
    "discount_bands": discount_bands,
    "brand_avg_discount_top20": brand_avg_discount_top20,
    "brand_concentration_top20": brand_concentration,
    "ratings_coverage": ratings_coverage,
    "rating_distribution": rating_distribution,
    "rating_by_discount_band": rating_by_discount_band,
    "price_bucket_distribution": price_bucket_distribution,
    "image_count_vs_rating": image_count_vs_rating,
    "total_markdown_value": total_markdown_value,
    "data_quality_nulls": data_quality_nulls,
}

LISTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "top_rated_by_volume": top_rated_by_volume,
    "highest_discounts_rated": highest_discounts_rated,
    "duplicate_titles_top50": duplicate_titles_top50,
    "sample_price_vs_mrp": sample_price_vs_mrp,
}


NAMES = [*AGGREGATES, *LISTS]


def report(name: str, products: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """One report from the rows, or an aggregate one from levels of them where those are given."""
    if name in LISTS:
        return LISTS[name](products)
    return AGGREGATES[name](Rows(products) if levels is None else Levels(levels))
