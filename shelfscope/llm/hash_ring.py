"""Operator 2, sharding: a consistent-hash ring with virtual nodes and bounded loads.

Every key sits on the ring by its hash and belongs to the next virtual node
clockwise. A shard takes no more rows than its capacity: keys that find it full
continue clockwise, first come first served in ring order, to the next shard
with room. With the default capacities, which add up to all rows, the counts of
the shards differ by one at most, and most keys stay with their own arc.

The walk needs only the number of keys on each arc. It is done on that table,
whose length is the number of virtual nodes, by one fold; each row then finds
its shard and slot from its rank on its arc. No row is gathered or moved by
shard. Only DataFrame functions are used.

Null texts have size 16 and crc 0. Null doc_ids sit where their text's crc
puts them. Repeated rows are placed each for itself (which of two equal rows
comes first doesn't show). An empty table gives an empty result. Further
columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.tables import lines_up, run_offsets, stored

SHARDS, VNODES = 40, 64
RING_BITS, CELL_BITS = 32, 18
OVERHEAD_BYTES = 16
#: Pieces into which the overflow is cut to be looked up by equality.
PIECES = 4096


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """arc, shard, position: the virtual nodes clockwise; their number is fixed by the parameters."""
    place = F.pmod(F.xxhash64(F.lit("virtual node"), "shard", "replica"), F.lit(1 << RING_BITS))
    nodes = spark.range(shards * vnodes, numPartitions=1).select(
        F.floor(F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("replica")
    )
    clockwise = Window.orderBy("position", "shard", "replica")
    return nodes.withColumn("position", place).withColumn("arc", F.row_number().over(clockwise) - 1).select("arc", "shard", "position")


def _cells(nodes: DataFrame) -> DataFrame:
    """Stretches of the ring by arc, and by the cell of the ring they touch, to look positions up."""
    before = F.lag("position").over(Window.orderBy("arc"))
    last = nodes.agg(F.max("position").alias("last"))
    stretches = nodes.select("arc", (F.coalesce(before, F.lit(-1)) + 1).alias("low"), F.col("position").alias("high"))
    rest = last.select(F.lit(0).alias("arc"), (F.col("last") + 1).alias("low"), F.lit((1 << RING_BITS) - 1).alias("high"))
    both = stretches.union(rest).where("low <= high")
    return both.withColumn("cell", F.explode(F.sequence(F.shiftright("low", CELL_BITS), F.shiftright("high", CELL_BITS))))


def _walk(arcs: DataFrame, capacities: str) -> DataFrame:
    """Arc by arc, twice around: what the arc's shard takes of the arc's own keys and of the overflow.

    ``over`` is the overflow's length when an arc is reached, ``pulled`` how much
    of it has been taken, ``base`` the shard's rows so far. Overflow is taken
    before own keys: it comes from further back.
    """
    room = "element_at(s.room, x.shard + 1)"
    pull = f"least(s.over - s.pulled, {room})"
    own = f"least(x.n, {room} - {pull})"
    step = f"""named_struct(
        'room', transform(s.room, (r, i) -> if(i = x.shard, r - {pull} - {own}, r)),
        'over', s.over + x.n - {own},
        'pulled', s.pulled + {pull},
        'found', concat(s.found, array(named_struct(
            'arc', x.arc, 'lap', x.lap, 'shard', x.shard, 'own', {own}, 'over', s.over, 'pull', {pull}, 'pulled', s.pulled,
            'base', element_at({capacities}, x.shard + 1) - {room}))))"""
    kind = "array<struct<arc:int,lap:int,shard:int,own:bigint,over:bigint,pull:bigint,pulled:bigint,base:bigint>>"
    fold = f"""aggregate(steps,
        named_struct('room', {capacities}, 'over', 0L, 'pulled', 0L, 'found', cast(array() as {kind})),
        (s, x) -> {step}).found"""
    laps = arcs.select("arc", "shard", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("lap")).select(
        F.struct("lap", "arc", "shard", F.when(F.col("lap") == 0, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n")).alias("x")
    )
    steps = laps.agg(F.array_sort(F.collect_list("x")).alias("steps"))
    return steps.select(F.inline(F.expr(fold)))


def _capacities(rows: int, shards: int, load: float | None) -> str:
    """Rows of each shard at most: even if ``load`` is None, else ``load`` times the mean."""
    if load is None:
        most = [rows // shards + (s < rows % shards) for s in range(shards)]
    elif load < 1:
        raise ValueError("a load below 1 leaves rows without a shard")
    else:
        most = [-int(-load * rows // shards)] * shards
    return f"array({', '.join(f'{n}L' for n in most)})"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the position on the ring."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("text"), "text_crc32")).otherwise(F.xxhash64("doc_id"))
    return own.withColumn("position", F.pmod(key, F.lit(1 << RING_BITS)))


def sharded(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, load: float | None = None) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, shard, slot (gapless from 0), home_shard (the arc's own)."""
    spark = docs.sparkSession
    nodes = stored(ring(spark, shards, vnodes), "ring")
    cell = F.shiftright("position", CELL_BITS)
    on_arcs = (
        keyed(docs)
        .withColumn("cell", cell)
        .join(F.broadcast(_cells(nodes)), "cell")  # cells of the ring and virtual nodes at most
        .where("position BETWEEN low AND high")
        .select("doc_id", "size", "text_crc32", "position", "arc")
    )
    keys = stored(lines_up(on_arcs, F.col("arc"), F.col("position"), F.col("doc_id"), F.col("text_crc32")), "keys")
    counts = keys.groupBy("arc").agg(F.count(F.lit(1)).alias("n"))
    arcs = nodes.join(F.broadcast(counts), "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    earlier = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    arcs = stored(arcs.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "arcs")
    rows = arcs.agg(F.sum("n")).first()[0]
    walked = stored(_walk(arcs, _capacities(rows, shards, load)), "walk")
    overflow = walked.agg(F.sum("pull")).first()[0] or 0
    width = max(1, -(-overflow // PIECES))
    homes = walked.where("lap = 0").select("arc", F.col("shard").alias("home_shard"), "own", "over", (F.col("base") + F.col("pull")).alias("home_slot"))
    pulls = (
        walked.where("pull > 0")
        .select(F.col("shard").alias("next_shard"), "pulled", (F.col("pulled") + F.col("pull")).alias("end"), F.col("base").alias("next_slot"))
        .withColumn("piece", F.explode(F.sequence(F.floor(F.col("pulled") / width), F.floor((F.col("end") - 1) / width))))
    )
    ranked = (
        keys.join(run_offsets(keys, F.count(F.lit(1))), "run")
        .join(F.broadcast(homes.join(arcs.select("arc", "first"), "arc")), "arc")
        .withColumn("rank", F.col("before") + F.col("at") - F.col("first"))
        .withColumn("late", F.when(F.col("rank") >= F.col("own"), F.col("over") + F.col("rank") - F.col("own")))
        .withColumn("piece", F.floor(F.col("late") / width))
    )
    lookup = F.broadcast(pulls.withColumnRenamed("piece", "its_piece"))  # PIECES and two rows per virtual node at most
    met = (F.col("piece") == F.col("its_piece")) & F.col("late").between(F.col("pulled"), F.col("end") - 1)
    return ranked.join(lookup, met, "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.coalesce("next_shard", "home_shard").alias("shard"),
        F.when(F.col("late").isNull(), F.col("home_slot") + F.col("rank")).otherwise(F.col("next_slot") + F.col("late") - F.col("pulled")).cast("long").alias("slot"),
        "home_shard",
    )
