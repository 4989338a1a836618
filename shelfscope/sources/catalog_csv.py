"""CSV catalogues: scan as text, bind columns by header name, coerce to the schema."""

from __future__ import annotations

import csv
import io
import logging
import math
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamReader

from shelfscope.functions.coerce import typed
from shelfscope.schema import PRODUCTS

log = logging.getLogger(__name__)

GLOB = "*.csv"
CSV_TEXT = {"encoding": "UTF-8", "escape": '"', "mode": "PERMISSIVE"}
FEW_FILES = 32
HEADER_READERS = 16

_CORRUPT = "_corrupt"
_END = "\u0001end"

Header = tuple[str, ...]
Reader = DataFrameReader | DataStreamReader


def named_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, whatever its suffix, or the CSV files of a folder."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.read.format("binaryFile").schema(schema).load(path).select("path").limit(2).collect()
    if [PurePosixPath(r.path).name for r in found] == [PurePosixPath(path).name] or _hidden(path):
        return [path]
    return csv_files(spark, path)


def _hidden(path: str) -> bool:
    """Whether Spark's readers pass over a file of this name."""
    return PurePosixPath(path).name.startswith(("_", "."))


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """CSV files lying directly in the folder. The files are listed, not read."""
    return [r.path for r in listing(spark.read, folder).select("path").collect()]


def listing(reader: Reader, folder: str) -> DataFrame:
    """File names and sizes of the folder; works for batch and stream readers."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return reader.format("binaryFile").schema(schema).option("pathGlobFilter", GLOB).load(folder)


def read_catalog(spark: SparkSession, paths: str | Sequence[str], quoted_lines: bool = True) -> DataFrame:
    """Typed products from one or more CSV files, whatever their column order.

    A file that is named is read whatever its suffix; one whose name Spark's
    readers pass over is refused. Files are grouped by header line and each group is one splittable scan.
    Files that have line breaks inside quotes are found by a count of quotes and
    read whole, each in one task; ``quoted_lines=False`` spares the count where
    no file has any.
    Columns a file lacks are NULL, columns it has beyond the schema are ignored.
    """
    groups: dict[tuple[Header, bool], list[str]] = defaultdict(list)
    named = [paths] if isinstance(paths, str) else list(paths)
    if hidden := [p for p in named if _hidden(p)]:
        raise ValueError(f"names beginning with '_' or '.' cannot be read, rename {', '.join(hidden[:5])}")
    whole = with_quoted_lines(spark, named) if quoted_lines and named else set()
    for path, header in read_headers(spark, named).items():
        if header:
            groups[header, _place(path) in whole].append(path)
        else:
            log.warning("%s is empty", path)
    if not groups:
        return spark.createDataFrame([], PRODUCTS)
    scans = (conform(scan_text(spark.read, header, members, whole=w), header) for (header, w), members in groups.items())
    return reduce(DataFrame.unionByName, scans)


def with_quoted_lines(spark: SparkSession, files: Sequence[str]) -> set[str]:
    """Places of the files that have a line break inside quotes.

    Such a break leaves an odd number of quotes on its line, and doubled quotes
    count twice. Lines are looked at where they are read; a name per such file
    comes to the driver.
    """
    lines = spark.read.text(list(files)).select("value", F.col("_metadata.file_path").alias("path"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.filter(quotes % 2 == 1).select("path").distinct()
    return {_place(unquote(r.path)) for r in odd.collect()}


def _place(path: str) -> str:
    """A path without what may be written in several ways: scheme and number of slashes."""
    return "/" + re.sub(r"^\w+:", "", path).lstrip("/")


def read_headers(spark: SparkSession, files: Sequence[str]) -> dict[str, Header]:
    """Header of each file; only first lines are read.

    A few files are looked at one by one. For many, tasks open the files
    themselves; what they cannot reach is left to the reader of the session.
    """
    heads: dict[str, str | None] = {}
    if len(files) > FEW_FILES:
        names = spark.createDataFrame([(f,) for f in files], "path string")
        lines = names.repartition(math.ceil(len(files) / FEW_FILES)).mapInPandas(_first_lines, "path string, head string")
        heads = {r.path: r.head for r in lines.filter("head IS NOT NULL").collect()}
    rest = [f for f in files if f not in heads]
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        heads |= zip(rest, pool.map(lambda f: _first_line(spark, f), rest))
    return {f: tuple(next(csv.reader([heads[f].lstrip("\ufeff")]), ())) for f in files}


def _first_line(spark: SparkSession, file: str) -> str:
    """The job stops after that line."""
    first = spark.read.text(file).first()
    return first.value if first else ""


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(head=batch["path"].map(_open_first_line))


def _open_first_line(file: str) -> str | None:
    try:
        system, name = fs.FileSystem.from_uri(file.replace("s3a://", "s3://", 1))
        with system.open_input_stream(name) as stream:
            return io.TextIOWrapper(io.BufferedReader(stream), encoding="utf-8").readline().rstrip("\r\n")
    except (OSError, ValueError, pa.ArrowException):
        return None


def scan_text(
    reader: Reader, header: Header, paths: str | Sequence[str], glob: str | None = None, whole: bool = False
) -> DataFrame:
    """All fields as text in columns ``_0, _1, ...``; overlong rows are left out.

    Short rows are padded with NULL. The reader marks both kinds alike and cuts
    long rows, so marked lines are parsed once more with an end mark behind
    them: a row fits where that gives the same first field and the mark is among
    one field more than the header has. (The first field also keeps a scan from
    being pruned to the mark alone, which the reader refuses.)

    Lines must be parsed whole even where few columns are asked for: a pruned
    parse takes overlong rows for good ones. With ``whole`` a file is not split,
    and a row goes on over line breaks inside quotes.
    """
    names = [f"_{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _CORRUPT]])
    reader = reader.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    rows = reader.options(header=True, columnPruning=False, multiLine=whole, **CSV_TEXT).csv(paths)
    return rows.filter(F.col(_CORRUPT).isNull() | _fits(F.col(_CORRUPT), len(header))).select(names)


def _fits(line: Column, width: int) -> Column:
    wider = ", ".join(f"_{i} string" for i in range(width + 1))
    fields = F.from_csv(F.concat(line, F.lit("," + _END)), F.lit(wider), CSV_TEXT)
    ended = reduce(Column.__or__, (fields[f"_{i}"].eqNullSafe(_END) for i in range(1, width + 1)))
    return fields["_0"].eqNullSafe(F.col("_0")) & ended


def conform(rows: DataFrame, header: Header) -> DataFrame:
    """The product columns by name, typed, in schema order."""
    missing = [f.name for f in PRODUCTS if f.name not in header]
    if missing:
        log.warning("columns missing in the input, filled with NULL: %s", ", ".join(missing))

    def column(field: T.StructField) -> Column:
        if field.name not in header:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return typed(F.col(f"_{header.index(field.name)}"), field.dataType).alias(field.name)

    return rows.select(*map(column, PRODUCTS))
