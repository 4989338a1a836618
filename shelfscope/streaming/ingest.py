"""New CSV files as a stream. The steps after the scan are those of the batch load."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from shelfscope.operators.sinks import overwrite_batch
from shelfscope.schema import COLUMNS
from shelfscope.sources.catalog_csv import GLOB, Header, conform, listing, read_catalog, scan_text

FILES_PER_BATCH = 1  # files are taken one at a time unless told otherwise
LOAD_BYTES = 8 << 30  # what a bulk load takes at a time, so that its batches follow its size, not its number of files
FEW_KEYS = 200_000  # new keys that are sent to the rows of a batch rather than the rows to them
DRAIN = {"availableNow": True}  # trigger: work through what is there, then stop


def _reader(spark: SparkSession, files: int, batch_bytes: int | None) -> DataStreamReader:
    """So many files to a batch or, with ``batch_bytes``, as many as have that size together, one at least."""
    limit = ("maxFilesPerTrigger", files) if batch_bytes is None else ("maxBytesPerTrigger", batch_bytes)
    return spark.readStream.option(*limit)


def stream_products(
    spark: SparkSession,
    folder: str,
    header: Header = tuple(COLUMNS),
    files: int = FILES_PER_BATCH,
    batch_bytes: int | None = None,
) -> DataFrame:
    """Typed products from files that all have the columns of ``header`` in that order."""
    return conform(scan_text(_reader(spark, files, batch_bytes), header, folder, GLOB), header)


def start_ingest(rows: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append to the Parquet table, each file exactly once."""
    writer = rows.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start(table)


def stream_files(
    spark: SparkSession,
    folder: str,
    files: int = FILES_PER_BATCH,
    known: str | None = None,
    batch_bytes: int | None = None,
) -> DataFrame:
    """Paths of new files. ``known`` is a table of paths to leave out, see ``record_known``.

    Only the listing is streamed; nothing is read until a batch loads its files.
    """
    found = listing(_reader(spark, files, batch_bytes), folder).select("path")
    if known is None:
        return found
    return found.join(spark.read.schema("path string").parquet(known), "path", "left_anti")


def record_known(spark: SparkSession, folder: str, table: str) -> str:
    """Write down, at the first start only, which files are there already.

    Names, not times: what arrives while nothing watches, or is moved in with an
    old time stamp, is new.
    """
    try:
        spark.read.parquet(table)
    except AnalysisException:
        listing(spark.read, folder).select("path").write.parquet(table)
    return table


def batch_paths(batch: DataFrame) -> Sequence[str]:
    """The names of the files of one batch."""
    return [r.path for r in batch.collect()]


def start_ingest_by_name(
    files: DataFrame, table: str, checkpoint: str, trigger: dict | None = None, unique: str | None = None
) -> StreamingQuery:
    """Load each batch of files by their own headers into a folder of its own.

    A batch that is repeated after a failure overwrites its folder. With the
    name of a key column in ``unique``, only rows that are new go in, see ``unseen``.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        paths = batch_paths(batch)
        if not paths:
            return
        rows = read_catalog(batch.sparkSession, paths)
        if unique is None:
            overwrite_batch(rows, table, batch_id)
            return
        rows = rows.persist()
        new = new_keys(rows, table, batch_id, unique)
        new = new.persist() if new is not None else None
        try:
            overwrite_batch(rows_of_new(rows, unique, new), table, batch_id)
        finally:
            for held in (new, rows):
                if held is not None:
                    held.unpersist()

    writer = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()


def unseen(rows: DataFrame, table: str, batch_id: int, key: str) -> DataFrame:
    """The rows whose key no earlier batch of the table holds, one for each key.

    Of rows with the same key the first in column order stays. Rows without a
    key cannot be told apart and all stay. Later folders are left out, so a
    repeated batch finds the same rows new.
    """
    return rows_of_new(rows, key, new_keys(rows, table, batch_id, key))


def new_keys(rows: DataFrame, table: str, batch_id: int, key: str) -> DataFrame | None:
    """The distinct keys of the rows that no earlier batch of the table holds; None if there is nothing to look at.

    Of the table only the key column is read, and of that only row groups
    within the span of the batch's keys. No other column is moved.
    """
    span = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    try:
        earlier = rows.sparkSession.read.parquet(table)
    except AnalysisException:
        return None
    if span.low is None:
        return None
    within = (F.col("batch_id") < batch_id) & F.col(key).between(span.low, span.high)
    keys = rows.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(earlier.where(within).select(key), key, "left_anti")


def rows_of_new(rows: DataFrame, key: str, new: DataFrame | None) -> DataFrame:
    """The first row of each new key, and all rows without a key.

    Few new keys are sent to the rows, so that only theirs are moved. Otherwise
    all rows are moved by key, once.
    """
    keyed = rows.where(F.col(key).isNotNull())
    few = new is not None and new.count() <= FEW_KEYS
    if few:
        keyed = keyed.join(F.broadcast(new), key, "left_semi")
    others = [name for name in rows.columns if name != key]
    single = keyed.groupBy(key).agg(F.min(F.struct(*others)).alias("row"))
    if new is not None and not few:
        single = single.join(new, key, "left_semi")
    return single.select(key, "row.*").select(rows.columns).unionByName(rows.where(F.col(key).isNull()))
