"""The text findings of an insight pack, formatted inside Spark."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The findings, as format strings.
AVERAGES = "Avg price ₹%s, avg MRP ₹%s, avg discount %.2f%% across %s items."
AT_MRP = "%s items are at MRP (0%% discount)."
TOP_BRAND = "Top brand: %s with %s items (~%.2f%%)."
TOP_BAND = "Largest discount band: %s at %s items (~%s%%)."
NO_ITEMS = "No items match the current filters."
NO_BRAND = "None"  # how a missing brand name reads in a sentence


def _or_zero(x: Column) -> Column:
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def bullets(kpis: Column, brands: Column, bands: Column) -> Column:
    """Up to four sentences from the KPI struct and the two ordered arrays."""
    products = F.coalesce(kpis["products"], F.lit(0))
    averages = F.format_string(
        AVERAGES,
        F.format_number(_or_zero(kpis["avg_price"]), 2),
        F.format_number(_or_zero(kpis["avg_mrp"]), 2),
        _or_zero(kpis["avg_discount_pct"]),
        F.format_number(products, 0),
    )
    at_mrp = F.format_string(AT_MRP, F.format_number(F.coalesce(kpis["no_discount_items"], F.lit(0)), 0))
    brand = F.get(brands, 0)
    top_brand = F.format_string(
        TOP_BRAND,
        F.coalesce(brand["brand"], F.lit(NO_BRAND)),
        F.format_number(brand["items"], 0),
        _or_zero(brand["share_pct"]),
    )
    band = F.get(bands, 0)
    counted = F.aggregate(bands, F.lit(0).cast("bigint"), lambda n, b: n + b["items"])
    top_band = F.format_string(
        TOP_BAND,
        band["band"],
        F.format_number(band["items"], 0),
        F.format_number(F.lit(100.0) * band["items"] / F.nullif(counted, F.lit(0)), 1),
    )
    found = F.array_compact(
        F.array(averages, at_mrp, F.when(F.size(brands) > 0, top_brand), F.when(F.size(bands) > 0, top_band))
    )
    return F.when(products > 0, found).otherwise(F.array(F.lit(NO_ITEMS)))
