"""Headline timings, printed as one JSON line.

The catalogue (one product per order line of ``$BENCH_SF_DIR``) is written as
CSV once, loaded into the products table under the clock, and then queried the
way a user would: every report and panel on its own, the whole report set from
one cube, one pack, and all packs together.
"""

from __future__ import annotations

import json
import os
import time

from shelfscope.operators.sinks import append_products
from shelfscope.plans import dashboard, loading, packs, reports, runner
from shelfscope.registry import ONE, SPECS
from shelfscope.schema import PRODUCTS
from shelfscope.session import build_session, scratch_dir
from shelfscope.sources.derived import products as derive

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session():
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def clocked(work) -> tuple[float, object]:
    start = time.perf_counter()
    result = work()
    return time.perf_counter() - start, result


def best(work) -> float:
    return round(min(clocked(work)[0] for _ in range(RUNS)), 3)


def main() -> None:
    spark = session()
    source = loading.write_csv(derive(spark, SF_DIR).repartition(int(CPUS)), scratch_dir(spark, "bench-csv"))

    def load() -> tuple[str, int]:
        table = scratch_dir(spark, "bench-table")
        return table, append_products(loading.loaded(spark, source), table)

    first, (table, rows) = clocked(load)
    took = {"ingest": best(load)}
    catalogue = spark.read.schema(PRODUCTS).parquet(table)

    for name in reports.NAMES:
        took[name] = best(lambda: reports.report(name, catalogue).collect())
    for name in dashboard.PANELS:
        took[name] = best(lambda: dashboard.panel(name, catalogue).collect())
    took["all_reports_from_cube"] = best(lambda: runner.collect_all(catalogue))
    took["insight_pack"] = best(lambda: packs.insight_pack(catalogue, SPECS[ONE]).collect())
    took["insight_packs_multi"] = best(lambda: packs.insight_packs(catalogue, SPECS).collect())

    print(
        json.dumps(
            {
                "metric": "catalogue load, reports, panels and packs",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "ingest_rows_per_sec": round(rows / took["ingest"]),
                "ingest_first_run": round(first, 3),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
