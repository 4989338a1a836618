"""Where results go: the products table, report files, pack documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

#: Quotes doubled, blanks kept, as common CSV readers expect.
REPORT_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def append_products(rows: DataFrame, table: str) -> int:
    """Append to the Parquet table and say how many rows went in.

    The count is taken while writing. A failed write leaves the table as it was.
    """
    written = Observation("append_products")
    rows.observe(written, F.count("*").alias("rows")).write.mode("append").parquet(table)
    return written.get["rows"]


def overwrite_batch(rows: DataFrame, table: str, batch_id: int) -> None:
    """Write one stream batch into its own folder, so that a repeated batch replaces itself."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/batch_id={batch_id}")


def rows_per_partition(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("rows_inserted"))


def _as_text(field: T.StructField) -> Column:
    """Doubles in plain digits, as ``258495563.45``; a whole one as ``12.0``."""
    value = F.col(field.name)
    if not isinstance(field.dataType, T.DoubleType):
        return value
    digits = F.regexp_replace(value.cast("decimal(38,15)").cast("string"), r"(\.\d+?)0+$", "$1")
    exact = digits.cast("double") == value
    return F.when(exact, digits).otherwise(value.cast("string")).alias(field.name)


def write_report(report: DataFrame, path: str, limit: int | None = None) -> bool:
    """One CSV file with a header, or no file for an empty result.

    Reports are short by construction (top lists, bands, single rows); the
    persisted rows are what is both checked and written.
    """
    rows = (report if limit is None else report.limit(limit)).persist()
    try:
        if rows.isEmpty():
            return False
        rows.select(*map(_as_text, rows.schema)).coalesce(1).write.mode("overwrite").options(**REPORT_TEXT).csv(path)
        return True
    finally:
        rows.unpersist()


def write_packs(packs: DataFrame, path: str) -> None:
    """Pack documents as JSON, one folder per pack."""
    packs.write.mode("overwrite").partitionBy("pack_id").option("ignoreNullFields", False).json(path)
