"""Reports and packs that follow the stream.

Going over the whole table again after each file would cost more with every
file. Here each batch reduces its own rows to a cube and a rated list, and adds
them to the newest ones before it. A batch reads its own rows and the state,
which grows with brands and bands, not with rows; the figures are exactly those
of a full pass. The state of packs belongs to their specs: other specs start
from all products loaded so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfscope.functions.bands import discount_band
from shelfscope.operators.sinks import overwrite_batch, write_packs
from shelfscope.plans import facts, packs
from shelfscope.sources.catalog_csv import read_catalog
from shelfscope.streaming.ingest import DRAIN, batch_paths

Merge = Callable[[DataFrame], DataFrame]


def start_refresh(
    files: DataFrame, specs: packs.Specs, home: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Per batch of files: append the rows, bring the figures up to date, write the packs.

    Below ``home`` lie ``products``, ``report_levels``, and, by fingerprint of the
    specs, ``pack_cube-*``, ``pack_top-*``; further ``packs``; each with a folder
    per batch that had files. All but the first hold the state after that batch,
    so repeating a batch gives the same state again.
    """
    cube, top = pack_states(specs)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        paths = batch_paths(batch)
        if not paths:
            return
        overwrite_batch(read_catalog(spark, paths), f"{home}/products", batch_id)
        fresh = spark.read.parquet(f"{home}/products/batch_id={batch_id}")

        steps = {
            "report_levels": (facts.build_levels, facts.merge_levels),
            cube: (lambda rows: packs.pack_cube(rows, specs), packs.merge_pack_cubes),
            top: (lambda rows: packs.pack_top(rows, specs), lambda tops: packs.merge_pack_tops(tops, specs)),
        }

        @inheritable_thread_target(spark)
        def advance(name: str) -> DataFrame:
            build, merge = steps[name]
            return _advance(fresh, build, f"{home}/{name}", f"{home}/products", batch_id, merge)

        with ThreadPoolExecutor(len(steps)) as pool:
            state = dict(zip(steps, pool.map(advance, steps)))
        documents = packs.assemble(state[cube], state[top], specs)
        write_packs(documents, f"{home}/packs/batch_id={batch_id}")

    writer = files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or DRAIN)).start()


def pack_states(specs: packs.Specs) -> tuple[str, str]:
    """Folder names of the packs' state: other specs, other names."""
    mark = hashlib.sha256(repr(sorted(specs.items())).encode()).hexdigest()[:16]
    return f"pack_cube-{mark}", f"pack_top-{mark}"


def _advance(fresh: DataFrame, build: Merge, state: str, table: str, batch_id: int, merge: Merge) -> DataFrame:
    """The newest state before plus the fresh rows, written and read back; without one, a state of all rows so far."""
    spark = fresh.sparkSession
    before = newest(spark, state, batch_id)
    if before is None:
        loaded = spark.read.parquet(table).where(F.col("batch_id") <= batch_id).drop("batch_id")
        after = build(loaded)
    else:
        after = merge(before.unionByName(build(fresh)))
    overwrite_batch(after, state, batch_id)
    return spark.read.parquet(f"{state}/batch_id={batch_id}")


def newest(spark: SparkSession, state: str, before: int) -> DataFrame | None:
    """The last state written by an earlier batch; batches without files write none.

    The folders are looked at, not the rows, as a state may be empty.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(state)
    except AnalysisException:
        return None
    last = files.where(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]
    return None if last is None else spark.read.parquet(f"{state}/batch_id={last}")


def latest(spark: SparkSession, state: str, query: StreamingQuery) -> DataFrame:
    """The state after the last batch the query has finished."""
    progress = query.lastProgress
    found = newest(spark, state, progress["batchId"] + 1) if progress else None
    if found is None:
        raise ValueError("no batch with files has finished yet")
    return found


def brand_counts(rows: DataFrame) -> DataFrame:
    """Running number of products per brand and discount band."""
    band = discount_band(F.col("discount_percent")).alias("band")
    return rows.groupBy("brand", band).agg(F.count("*").alias("items"))


def start_brand_counts(rows: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write all counts after each batch; the counts live in the state store."""
    writer = brand_counts(rows).writeStream.outputMode("complete")
    writer = writer.foreachBatch(lambda counts, batch_id: overwrite_batch(counts, table, batch_id))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or DRAIN)).start()
