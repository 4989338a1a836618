"""Command line: load files, follow a folder, run reports, build packs, ask in SQL."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import DataFrame, SparkSession

from shelfscope.operators.filters import FilterSpec
from shelfscope.operators.sinks import append_products, write_packs
from shelfscope.plans import packs, runner
from shelfscope.schema import COLUMNS, PRODUCTS
from shelfscope.session import build_session
from shelfscope.sources import adhoc
from shelfscope.sources.catalog_csv import named_files, read_catalog
from shelfscope.streaming import ingest, refresh


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCTS).parquet(path)


def load(spark: SparkSession, args: argparse.Namespace) -> None:
    for path in args.csv:
        print(f"{append_products(read_catalog(spark, named_files(spark, path)), args.table)} rows from {path}")


def watch(spark: SparkSession, args: argparse.Namespace) -> None:
    known = None if args.existing else ingest.record_known(spark, args.folder, f"{args.home}/known_files")
    files = ingest.stream_files(spark, args.folder, args.files_per_batch, known)
    trigger = {"processingTime": args.every}
    specs = {"pack": FilterSpec.from_json(args.filters_json)}
    refresh.start_refresh(files, specs, args.home, args.checkpoint, trigger).awaitTermination()


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    for name, status in runner.write_all(table(spark, args.table), args.out, args.limit).items():
        print(f"{name}: {status}")


def pack(spark: SparkSession, args: argparse.Namespace) -> None:
    specs = {name: FilterSpec.from_dict(values) for name, values in json.loads(args.filters_json).items()}
    write_packs(packs.insight_packs(table(spark, args.table), specs, args.rating_everywhere), args.out)


def ask(spark: SparkSession, args: argparse.Namespace) -> None:
    adhoc.publish(table(spark, args.table).select(COLUMNS))
    if args.out:
        adhoc.select(spark, args.sql).write.json(args.out)
    else:
        adhoc.select(spark, args.sql).show(truncate=False)


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="shelfscope", description=__doc__)
    commands = parser.add_subparsers(required=True)

    def command(run, *required: str) -> argparse.ArgumentParser:
        found = commands.add_parser(run.__name__)
        found.set_defaults(run=run)
        for name in required:
            found.add_argument(f"--{name}", required=True)
        return found

    command(load, "table").add_argument("csv", nargs="+", help="files, or folders of files")
    watching = command(watch, "folder", "home", "checkpoint")
    watching.add_argument("--filters-json", default="{}", help="one filter spec")
    watching.add_argument("--every", default="10 seconds")
    watching.add_argument("--files-per-batch", type=int, default=ingest.FILES_PER_BATCH)
    watching.add_argument("--existing", action="store_true", help="also take files that are there already")
    command(report, "table", "out").add_argument("--limit", type=int)
    packing = command(pack, "table", "out")
    packing.add_argument("--filters-json", default='{"pack": {}}', help="filter specs by pack name")
    packing.add_argument("--rating-everywhere", action="store_true", help="rating clauses apply to all tables")
    asking = command(ask, "table")
    asking.add_argument("sql", help="a query over the view products")
    asking.add_argument("--out", help="folder for JSON rows; without it the first rows are shown")
    return parser


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO)
    args = arguments().parse_args(argv)
    args.run(build_session(), args)


if __name__ == "__main__":
    main()
