"""Read-only ad-hoc SQL over the ``products`` view."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

VIEW = "products"


def publish(products: DataFrame, view: str = VIEW) -> None:
    products.createOrReplaceTempView(view)


def select(spark: SparkSession, sql: str) -> DataFrame:
    """Rows of a query. Inside parentheses nothing but a query can be parsed."""
    return spark.sql(f"SELECT * FROM (\n{sql.rstrip().rstrip(';')}\n)")


def select_json(spark: SparkSession, sql: str) -> DataFrame:
    """Each row as JSON text; a query that cannot run gives one ``{"error": ...}`` row.

    The query is run here, as some errors show only then; its rows are kept
    on the executors, in memory or on disk, for whoever reads the result.
    """
    try:
        rows = select(spark, sql)
        found = rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row_json")).persist()
        found.count()
        return found
    except PySparkException as error:
        message = F.struct(F.lit(str(error)).alias("error"))
        return spark.range(1).select(F.to_json(message).alias("row_json"))
