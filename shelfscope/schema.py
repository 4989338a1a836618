"""The one table of the engine: a flat catalogue with a fixed schema."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCTS = T.StructType(
    [
        T.StructField("product_id", T.LongType()),
        T.StructField("style_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("mrp", T.DoubleType()),
        T.StructField("discount_percent", T.DoubleType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("rating_total", T.LongType()),
        T.StructField("img_primary", T.StringType()),
        T.StructField("img_count", T.LongType()),
    ]
)

COLUMNS = PRODUCTS.names
