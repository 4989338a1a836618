"""Named queries that send the products through CSV files, sinks and streams.

Each writes what Spark derives from the given tables to a fresh folder, runs
the operator on it and reads the outcome back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from shelfscope.operators import sinks
from shelfscope.operators.filters import FilterSpec
from shelfscope.plans import packs, reports
from shelfscope.plans.facts import Levels
from shelfscope.schema import COLUMNS, PRODUCTS
from shelfscope.session import scratch_dir
from shelfscope.sources import adhoc
from shelfscope.sources.catalog_csv import csv_files, read_catalog
from shelfscope.streaming import ingest, refresh

c = F.col
KEEP_SPACES = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, folder: str) -> str:
    rows.write.mode("append").options(header=True, escape='"', **KEEP_SPACES).csv(folder)
    return folder


def write_lines(lines: DataFrame, header: str, folder: str) -> str:
    """Text lines as they are, each file starting with the header line."""
    plain = {"header": True, "sep": "\u0001", "escapeQuotes": False, "quote": "\u0002", **KEEP_SPACES}
    lines.select(c(lines.columns[0]).alias(header)).write.options(**plain).csv(folder)
    return folder


def loaded(spark: SparkSession, folder: str) -> DataFrame:
    return read_catalog(spark, csv_files(spark, folder))


def _turn(key: Column, texts: list[Column]) -> Column:
    """The texts in turn, by the remainder of the key."""
    turn = key % len(texts)
    chain = F.when(turn == 0, texts[0])
    for i, text in enumerate(texts[1:], 1):
        chain = chain.when(turn == i, text)
    return chain


def ingest_csv(products: DataFrame) -> DataFrame:
    spark = products.sparkSession
    return loaded(spark, write_csv(products, scratch_dir(spark, "csv")))


def ingest_missing_columns(products: DataFrame) -> DataFrame:
    """All products over two layouts in one folder: another order with a foreign column, and a narrow one."""
    spark = products.sparkSession
    folder = scratch_dir(spark, "csv")
    odd = c("style_id") % 2 == 1
    foreign = F.lit("red").alias("colour")
    write_csv(products.filter(odd).select("brand", "price", foreign, "product_id", "title"), folder)
    write_csv(products.filter(~F.coalesce(odd, F.lit(False))).select("img_count", "style_id", "product_id"), folder)
    return loaded(spark, folder)


def ingest_coercion(products: DataFrame) -> DataFrame:
    """Numbers and words in every spelling the loader has to tell apart."""
    spark = products.sparkSession
    key, number, price = c("style_id"), c("product_id").cast("string"), c("mrp").cast("string")
    whole = [
        F.concat(F.lit(" "), number, F.lit(" ")),
        F.concat(F.lit("+"), number),
        F.concat(number, F.lit(".0")),
        F.lit("abc"),
        F.concat(F.lit("1_"), number),
        F.lit(""),
        number,
    ]
    real = [price, F.concat(price, F.lit("d")), *map(F.lit, ["1e2", "nan", "NAN", " 12.5 ", "", "1_0.5"])]
    words = [*map(F.lit, ["NA", "None", "null", "nan", "NaN", "NAN", "", "Nantes"]), c("img_primary")]
    messy = products.select(
        _turn(c("product_id"), whole).alias("product_id"),
        "style_id",
        _turn(key, words).alias("title"),
        _turn(key, real).alias("price"),
    )
    return loaded(spark, write_csv(messy, scratch_dir(spark, "csv"))).select("product_id", "style_id", "title", "price")


def ingest_ragged_rows(products: DataFrame) -> DataFrame:
    """Short rows are kept, overlong rows are not, whatever stands in the extra fields."""
    spark = products.sparkSession
    ends = ["A,4711", "short", "long,B,x", "empties,B,,", '"q,uoted",B', ",", '"long, q",B,z', "one empty,B,"]
    line = F.concat_ws(",", c("product_id"), c("style_id"), _turn(c("style_id"), [F.lit(e) for e in ends]))
    folder = write_lines(products.select(line), "product_id,style_id,title,brand", scratch_dir(spark, "csv"))
    return loaded(spark, folder).select("product_id", "style_id", "title", "brand")


def ingest_quoted_lines(products: DataFrame) -> DataFrame:
    """Titles that go on over line breaks, with quotes and commas in them, beside files that have none."""
    spark = products.sparkSession
    folder = scratch_dir(spark, "csv")
    broken = c("style_id") % 3 == 0
    title = F.concat(c("title"), F.lit('\nsecond "line", and\n\n'), c("brand"), F.lit("\n"))
    wide = [*COLUMNS[2:], *COLUMNS[:2]]
    write_csv(products.filter(broken).withColumn("title", title).select(wide), folder)
    write_csv(products.filter(~F.coalesce(broken, F.lit(False))), folder)
    return loaded(spark, folder)


def _appended_twice(products: DataFrame) -> DataFrame:
    spark = products.sparkSession
    source = loaded(spark, write_csv(products, scratch_dir(spark, "csv")))
    table = scratch_dir(spark, "table")
    for _ in range(2):
        sinks.append_products(source, table)
    return spark.read.schema(PRODUCTS).parquet(table)


def ingest_append(products: DataFrame) -> DataFrame:
    """Loads add up; nothing is deduplicated."""
    return _appended_twice(products).groupBy("brand").agg(
        F.count("*").alias("items"), F.sum("product_id").alias("id_sum"), F.count("title").alias("titled")
    )


def ingest_row_count(products: DataFrame) -> DataFrame:
    """Rows inserted, summed over the partitions."""
    parts = sinks.rows_per_partition(_appended_twice(products))
    return parts.agg(F.sum("rows_inserted").alias("rows_inserted"))


def report_csv(products: DataFrame) -> DataFrame:
    """First rows of a report, through its CSV file."""
    spark = products.sparkSession
    report = reports.report("highest_discounts_rated", products)
    path = scratch_dir(spark, "report")
    sinks.write_report(report, path, limit=20)
    return spark.read.schema(report.schema).option("header", True).option("escape", '"').csv(path)


def adhoc_select(products: DataFrame) -> DataFrame:
    adhoc.publish(products, "adhoc_products")
    return adhoc.select(
        products.sparkSession,
        "SELECT brand, COUNT(*) AS items, MAX(mrp) AS max_mrp FROM adhoc_products GROUP BY brand ORDER BY brand; ",
    )


def adhoc_select_json(products: DataFrame) -> DataFrame:
    adhoc.publish(products, "adhoc_products")
    return adhoc.select_json(
        products.sparkSession, "SELECT brand, COUNT(*) AS items FROM adhoc_products GROUP BY brand -- as JSON"
    )


def stream_ingest(products: DataFrame) -> DataFrame:
    spark = products.sparkSession
    source, table = write_csv(products, scratch_dir(spark, "csv")), scratch_dir(spark, "table")
    ingest.start_ingest(
        ingest.stream_products(spark, source, batch_bytes=ingest.LOAD_BYTES), table, scratch_dir(spark, "checkpoint")
    ).awaitTermination()
    return spark.read.schema(PRODUCTS).parquet(table)


def stream_ingest_by_name(products: DataFrame) -> DataFrame:
    """All products over files whose columns come in different orders."""
    spark = products.sparkSession
    source, table = scratch_dir(spark, "csv"), scratch_dir(spark, "table")
    rated = F.coalesce(c("rating_total") > 0, F.lit(False))
    write_csv(products.filter(rated).select(COLUMNS[::-1]), source)
    write_csv(products.filter(~rated), source)
    files = ingest.stream_files(spark, source, batch_bytes=ingest.LOAD_BYTES)
    ingest.start_ingest_by_name(files, table, scratch_dir(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(table).select(COLUMNS)


def stream_ingest_unique(products: DataFrame) -> DataFrame:
    """All products in files that come twice, the second time in another column order: rows per key in the table.

    The data hold different products with the same key; which of them stays
    depends on the file that is taken first, so only keys are returned.
    """
    spark = products.sparkSession
    source, table, checkpoint = (scratch_dir(spark, purpose) for purpose in ("csv", "table", "checkpoint"))
    for columns in (COLUMNS, COLUMNS[::-1]):
        write_csv(products.select(columns), source)
        files = ingest.stream_files(spark, source, batch_bytes=ingest.LOAD_BYTES)
        ingest.start_ingest_by_name(files, table, checkpoint, unique="product_id").awaitTermination()
    return spark.read.parquet(table).groupBy("product_id").agg(F.count("*").alias("n_rows"))


def _refreshed(products: DataFrame, specs: packs.Specs) -> tuple[str, StreamingQuery]:
    """All products in two loads, so that the second is added to a state."""
    spark = products.sparkSession
    source, home, checkpoint = (scratch_dir(spark, purpose) for purpose in ("csv", "home", "checkpoint"))
    odd = F.coalesce(c("product_id") % 2 == 1, F.lit(False))
    for load in (odd, ~odd):
        write_csv(products.filter(load), source)
        files = ingest.stream_files(spark, source, batch_bytes=ingest.LOAD_BYTES)
        query = refresh.start_refresh(files, specs, home, checkpoint)
        query.awaitTermination()
    return home, query


def stream_refresh_packs(products: DataFrame, specs: packs.Specs) -> DataFrame:
    """Pack documents after the last file, as flat KPI rows."""
    home, query = _refreshed(products, specs)
    spark = products.sparkSession
    cube, top = (refresh.latest(spark, f"{home}/{name}", query) for name in refresh.pack_states(specs))
    return flat_kpis(packs.assemble(cube, top, specs))


def stream_refresh_reports(products: DataFrame, specs: packs.Specs) -> DataFrame:
    """A report from the running levels."""
    home, query = _refreshed(products, specs)
    levels = refresh.latest(products.sparkSession, f"{home}/report_levels", query)
    return reports.price_bucket_distribution(Levels(levels))


def stream_brand_counts(products: DataFrame) -> DataFrame:
    spark = products.sparkSession
    source, table = write_csv(products, scratch_dir(spark, "csv")), scratch_dir(spark, "counts")
    rows = ingest.stream_products(spark, source, batch_bytes=ingest.LOAD_BYTES)
    query = refresh.start_brand_counts(rows, table, scratch_dir(spark, "checkpoint"))
    query.awaitTermination()
    return refresh.latest(spark, table, query)


# --- flat views of pack documents ---------------------------------------------------


def flat_kpis(documents: DataFrame) -> DataFrame:
    return documents.select("pack_id", "kpis.*", F.size("bullets").cast("bigint").alias("sentences"))


def flat_table(documents: DataFrame, table: str) -> DataFrame:
    """Rows of one pack table, with their position from 1."""
    rows = documents.select("pack_id", F.posexplode(f"tables.{table}").alias("n", "row"))
    return rows.select("pack_id", (c("n") + 1).cast("bigint").alias("position"), "row.*")


def flat_bullets(documents: DataFrame) -> DataFrame:
    rows = documents.select("pack_id", F.posexplode("bullets").alias("n", "bullet"))
    return rows.select("pack_id", (c("n") + 1).cast("bigint").alias("bullet_no"), "bullet")


def flat_document(documents: DataFrame) -> DataFrame:
    """Every value of the documents: section, position (from 1), field, and the value as text or as number."""
    kinds = documents.schema
    tables = kinds["tables"].dataType

    def listed(table: str) -> Column:
        fields = tables[table].dataType.elementType
        return F.transform(c(f"tables.{table}"), lambda row, n: _cells(table, n + 1, row, fields))

    kpis = F.array(_cells("kpis", F.lit(1), c("kpis"), kinds["kpis"].dataType))
    said = F.transform("bullets", lambda x, n: F.array(_cell("bullets", n + 1, "bullet", x, None)))
    return documents.select(F.inline(F.flatten(F.concat(kpis, *map(listed, tables.names), said))))


def _cells(section: str, position: Column, row: Column, fields: T.StructType) -> Column:
    def cell(f: T.StructField) -> Column:
        is_text = isinstance(f.dataType, T.StringType)
        return _cell(section, position, f.name, row[f.name] if is_text else None, None if is_text else row[f.name])

    return F.array(*map(cell, fields))


def _cell(section: str, position: Column, field: str, text: Column | None, number: Column | None) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        position.cast("bigint").alias("position"),
        F.lit(field).alias("field"),
        F.lit(text).cast("string").alias("text"),
        F.lit(number).cast("double").alias("number"),
    )


def pack_documents(products: DataFrame, specs: dict[str, FilterSpec]) -> DataFrame:
    """Packs through their JSON files."""
    spark = products.sparkSession
    documents = packs.insight_packs(products, specs)
    path = scratch_dir(spark, "packs")
    sinks.write_packs(documents, path)
    schema = T.StructType([f for f in documents.schema if f.name != "pack_id"] + [documents.schema["pack_id"]])
    return flat_table(spark.read.schema(schema).json(path), "brand_concentration")


LOADING: dict[str, Callable[[DataFrame], DataFrame]] = {
    f.__name__: f
    for f in (
        ingest_csv,
        ingest_missing_columns,
        ingest_coercion,
        ingest_ragged_rows,
        ingest_quoted_lines,
        ingest_append,
        ingest_row_count,
        report_csv,
        adhoc_select,
        adhoc_select_json,
        stream_ingest,
        stream_ingest_by_name,
        stream_ingest_unique,
        stream_brand_counts,
    )
}
