"""A ``products`` table derived from the order lines and parts of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per order line. Money is worked out in whole cents.

    The join is left to the optimizer: parts are broadcast while their size
    allows it, beyond that adaptive execution splits a hot part key.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("l_partkey")
    unpriced = key % 101 == 0
    listed = F.col("mrp_cents")
    off = F.col("off")
    return (
        lines.join(parts, key == F.col("p_partkey"))
        .withColumn("mrp_cents", F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity")))
        .withColumn("off", F.round(F.col("l_discount") * 100).cast("bigint") * 7)
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("product_id"),
            key.alias("style_id"),
            F.when(key % 97 == 0, None)
            .when(key % 89 == 0, "")
            .otherwise(F.concat("p_name", F.lit(" - Style "), key.cast("string")))
            .alias("title"),
            F.when(F.col("p_brand") == "Brand#25", None)
            .when(F.col("p_brand") == "Brand#24", "")
            .otherwise(F.col("p_brand"))
            .alias("brand"),
            F.when(~unpriced, F.floor(listed * (100 - off) / 100.0).cast("double") / 100).alias("price"),
            (listed.cast("double") / 100).alias("mrp"),
            F.when(~unpriced, off.cast("double")).alias("discount_percent"),
            (F.round(F.col("l_tax") * 100) * 5 / 8).alias("rating"),
            F.when(F.col("l_returnflag") == "N", F.lit(0).cast("bigint"))
            .otherwise(F.col("l_quantity").cast("bigint") * 3)
            .alias("rating_total"),
            F.concat(F.lit("img/"), key.cast("string"), F.lit(".jpg")).alias("img_primary"),
            F.nullif(F.col("p_size") % 8, F.lit(7)).cast("bigint").alias("img_count"),
        )
    )
