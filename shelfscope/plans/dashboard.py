"""The dashboard's own queries; its other panels are fixed reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from shelfscope.functions import exact
from shelfscope.operators.toplist import by, desc, top_rows
from shelfscope.plans.facts import Facts, Rows
from shelfscope.plans.reports import deepest_discounts, kpi_columns

c = F.col


def dash_brand_list(facts: Facts) -> DataFrame:
    return facts.frame.select("brand").dropna().distinct().orderBy("brand")


def dash_kpis(facts: Facts) -> DataFrame:
    return facts.frame.agg(facts.items().alias("products"), *kpi_columns(facts))


def dash_top_brands(facts: Facts) -> DataFrame:
    average = exact.mean(facts.moments("mrp"), None).alias("mrp")
    rows = facts.frame.groupBy("brand").agg(facts.items().alias("product_count"), average)
    return top_rows(rows, by([desc("product_count")], ["brand"]), 5)


def dash_brand_price_discount(facts: Facts) -> DataFrame:
    """Averages over products that have a brand, a price and a discount."""
    price, discount = facts.moments("paired_price"), facts.moments("paired_discount")
    return (
        facts.frame.dropna(subset=["brand"])
        .groupBy("brand")
        .agg(
            exact.mean(price, None).alias("avg_price"),
            exact.mean(discount, None).alias("avg_discount_percent"),
            price.n.alias("paired"),
        )
        .filter(c("paired") > 0)
        .drop("paired")
    )


def chart_top10_brand_means(facts: Facts) -> DataFrame:
    """Brands by number of priced products; rows without a brand are left out."""
    price = facts.moments("price")
    rows = (
        facts.frame.dropna(subset=["brand"])
        .groupBy("brand")
        .agg(
            exact.mean(price, None).alias("avg_price"),
            exact.mean(facts.moments("discount_percent"), None).alias("avg_discount"),
            price.n.alias("count"),
        )
    )
    return top_rows(rows, by([desc("count")], ["brand"]), 10)


AGGREGATES: dict[str, Callable[[Facts], DataFrame]] = {
    f.__name__: f
    for f in (dash_brand_list, dash_kpis, dash_top_brands, dash_brand_price_discount, chart_top10_brand_means)
}


def panel(name: str, products: DataFrame) -> DataFrame:
    if name == "dash_top_discounted":  # unlike the report of the same shape, unrated products count too
        return deepest_discounts(products)
    return AGGREGATES[name](Rows(products))


PANELS = [*AGGREGATES, "dash_top_discounted"]
