"""The report batch: every report to its own CSV, whatever becomes of the others."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, wait

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from shelfscope.operators.sinks import write_report
from shelfscope.plans import facts, reports

log = logging.getLogger(__name__)

AT_ONCE = 4  # small jobs that share the cluster while others wait for their last tasks


def collect_all(products: DataFrame) -> dict[str, list]:
    """Rows of every report. All of them are short: bands, single rows and top lists."""
    return _each(products, lambda name, levels: reports.report(name, products, levels).collect())


def write_all(products: DataFrame, folder: str, limit: int | None = None) -> dict[str, str]:
    """Write ``folder/<report>`` for each report and say how it went.

    An empty result is "no rows" and leaves no file; a failing report is logged
    with its message and the others go on.
    """

    def write(name: str, levels: DataFrame) -> str:
        try:
            saved = write_report(reports.report(name, products, levels), f"{folder}/{name}", limit)
            return "saved" if saved else "no rows"
        except PySparkException as error:
            log.error("%s: %s", name, error)
            return f"error: {error}"

    return _each(products, write)


def _each(products: DataFrame, work: Callable[[str, DataFrame], object]) -> dict:
    """Run the work for every report, the lists while the levels that the others share are built."""
    levels = facts.build_levels(products).persist(StorageLevel.MEMORY_AND_DISK)
    tag = inheritable_thread_target(products.sparkSession)

    def shared(name: str, ready: Future) -> object:
        wait([ready])
        return work(name, levels)

    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            ready = pool.submit(tag(levels.count))
            jobs = {name: pool.submit(tag(lambda name: work(name, levels)), name) for name in reports.LISTS}
            jobs |= {name: pool.submit(tag(shared), name, ready) for name in reports.AGGREGATES}
            return {name: jobs[name].result() for name in reports.NAMES}
    finally:
        levels.unpersist()
