"""Operator 11, hard-negative mining: residue-number-system GEMM, Chinese remaindering, windowed selection.

Vectors become whole numbers, ``floor(256 x)``. The score of a row and an
anchor is their exact integer inner product: both sides are reduced modulo a
few primes below 1024, multiplied as float32 matrices (every partial sum stays
below 2^24 and is exact), and the signed score is put together from its
residues. How many primes are needed follows from the longest vectors
(Cauchy-Schwarz), so that a score always lies within half their product.

Rows and anchors are packed into blocks of bounded size; each pair of blocks is
a cell, compared in one task. A cell hands on the few best rows of each anchor,
and a ranking window picks the best of all cells: first the positives, then, in
a second round, the negatives in each positive's score window.

Rows without an id take no part, nor do those with a null label or vector, a
null or non-finite component, or a vector so long that scores would leave 64
bits (``256 x`` with a sum of squares of 2^54 or more: components in the hundreds
of thousands). Missing trailing components count as zero, an empty vector scores
0 with all. Rows alike in id, label and vector count once; rows that share no
more than an id are rows of their own, but never each other's positives. Other
columns are ignored. Without rows or anchors the result is empty. Equal scores
rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfscope.llm.tables import stored

c = F.col
SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score in hundredths of its positive's: at least, at most.
WINDOW = (30, 90)
ANCHOR_EVERY = 100
#: Sums of squares from here on could take 100 times a score beyond 64 bits.
MOST_SQUARES = 2.0**54
#: Primes whose balanced residues, 64 products at a time, add up exactly in float32 (64 * 510^2 < 2^24).
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
DEPTH = 64
#: Rows and anchors of a block: what one task compares, of whatever table.
ROWS, ANCHORS = 8192, 1024
#: Anchors whose exact scores are in memory at a time.
SCORED = 64


# --- exact products -----------------------------------------------------------------


def primes_for(bound: float) -> tuple[int, ...]:
    """The first primes whose product exceeds twice the bound of an absolute score."""
    for n in range(1, len(PRIMES) + 1):
        if prod(PRIMES[:n]) > 2 * bound + 2:
            return PRIMES[:n]
    raise ValueError("scores beyond 64 bits")


def residues(codes: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """The matrix modulo each prime, balanced around zero, as float32."""
    found = []
    for p in primes:
        r = codes % p
        found.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return found


def _product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, 0 to p - 1; the inner dimension goes by in runs that stay exact."""
    whole = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], DEPTH):
        whole += (a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T).astype(np.int64)
    return whole % p


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact signed inner products of all rows of ``a`` with all of ``b``, from their residues."""
    found = _product(a[0], b[0], primes[0])
    modulus = primes[0]
    for x, y, p in zip(a[1:], b[1:], primes[1:]):
        step = (_product(x, y, p) - found) * pow(modulus, -1, p) % p
        found += modulus * step
        modulus *= p
    return np.where(found > modulus // 2, found - modulus, found)


# --- tables -------------------------------------------------------------------------


def quantised(vectors: DataFrame, label: Column, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id``, ``label``, whole ``codes`` and their sum of squares, of the rows that take part.

    A null or NaN component makes the first sum null or NaN, which is not below the bound.
    """
    about = F.aggregate(
        F.transform(vector, lambda x: F.pow(x.cast("double") * SCALE, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x
    )
    rows = vectors.where(about < MOST_SQUARES).select(
        c(ids).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("codes"),
    )
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL")
    squares = F.aggregate("codes", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.dropDuplicates(["id", "label", "codes"]).withColumn("squares", squares)


def _matrix(codes: list, width: int) -> np.ndarray:
    made = np.zeros((len(codes), width), np.int64)
    for row, found in zip(made, codes):
        row[: len(found)] = found
    return made


def _packed(schema: list[str], width: int):
    """Rows of one block, ordered by id and label, as columns of bytes."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in schema])
        made = {"block": table.column("block").slice(0, 1)}
        for name in schema:
            made[name] = pa.array([np.asarray(table.column(name), dtype=np.int64).tobytes()], pa.binary())
        made["codes"] = pa.array([_matrix(table.column("codes").to_pylist(), width).tobytes()], pa.binary())
        return pa.table(made)

    return pack


def _blocks(rows: DataFrame, names: list[str], n: int, width: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id", "label", "codes"), F.lit(n)).cast("int").alias("block")
    schema = ", ".join(["block int", *(f"{name} binary" for name in names), "codes binary"])
    return rows.select(block, *names, "codes").groupBy("block").applyInArrow(_packed(names, width), schema)


def _longs(raw: pa.Scalar) -> np.ndarray:
    return np.frombuffer(raw.as_py(), np.int64)


class _Cell:
    """A block of rows against a block of anchors: exact scores, some anchors at a time."""

    def __init__(self, rows: pa.Table, anchors: pa.Table, width: int, primes: tuple[int, ...]):
        self.ids, self.labels = (_longs(rows.column(n)[0]) for n in ("id", "label"))
        self.anchor, self.anchor_ids, self.anchor_labels = (
            _longs(anchors.column(n)[0]) for n in ("anchor", "id", "label")
        )
        self._rows = residues(_longs(rows.column("codes")[0]).reshape(len(self.ids), width), primes)
        self._anchors = residues(_longs(anchors.column("codes")[0]).reshape(len(self.anchor), width), primes)
        self._primes = primes

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each anchor's place in its block and the scores of all rows."""
        for first in range(0, len(self.anchor), SCORED):
            some = [m[first : first + SCORED] for m in self._anchors]
            for i, found in enumerate(scores(some, self._rows, self._primes), first):
                yield i, found


def _first(found: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place; places are in the order of ids."""
    if len(found) > 4 * k:
        least = np.partition(found, len(found) - k)[len(found) - k]
        places = np.flatnonzero(found >= least)
    else:
        places = np.arange(len(found))
    return places[np.argsort(-found[places], kind="stable")][:k]


def _positives(width: int, primes: tuple[int, ...], k: int):
    def pick(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        made = []
        if len(rows) and len(anchors):
            cell = _Cell(rows, anchors, width, primes)
            for i, found in cell:
                same = np.flatnonzero((cell.labels == cell.anchor_labels[i]) & (cell.ids != cell.anchor_ids[i]))
                best = same[_first(found[same], k)]
                made.append((np.full(len(best), cell.anchor[i]), cell.ids[best], found[best]))
        return _table(made, ["anchor", "positive_id", "positive_score"])

    return pick


def _negatives(width: int, primes: tuple[int, ...], k: int, window: tuple[int, int]):
    least, most = window

    def pick(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        made = []
        if len(rows) and len(anchors):
            cell = _Cell(rows, anchors, width, primes)
            wanted = _longs(anchors.column("scores")[0]).reshape(len(cell.anchor), -1)
            counts = _longs(anchors.column("n")[0])
            for i, found in cell:
                others = np.flatnonzero(cell.labels != cell.anchor_labels[i])
                order = others[np.argsort(-found[others], kind="stable")]
                falling = -found[order]
                for position, score in enumerate(wanted[i, : counts[i]].tolist()):
                    low, high = -(-least * score // 100), most * score // 100
                    begin = np.searchsorted(falling, -high)
                    end = min(begin + k, np.searchsorted(falling, -low, side="right"))
                    best = order[begin:end]
                    made.append((np.full(len(best), cell.anchor[i]), np.full(len(best), position), cell.ids[best], found[best]))
        return _table(made, ["anchor", "position", "negative_id", "negative_score"])

    return pick


def _table(made: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(x).astype(np.int64) for x in zip(*made)] if made else [np.zeros(0, np.int64)] * len(names)
    return pa.table(dict(zip(names, columns)))


def _gridded(rows: DataFrame, n_rows: int, anchors: DataFrame, n_anchors: int, pick, schema: str) -> DataFrame:
    """Every block of rows beside every block of anchors: a stated set of queries against all rows."""

    def spread(side: DataFrame, other: str, n: int) -> DataFrame:
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    left = spread(rows.withColumnRenamed("block", "of_rows"), "of_anchors", n_anchors)
    right = spread(anchors.withColumnRenamed("block", "of_anchors"), "of_rows", n_rows)
    keys = ["of_rows", "of_anchors"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pick, schema)


def _ranked(found: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(c(score).desc(), c(name))
    return found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def mined(
    vectors: DataFrame,
    label: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    every: int = ANCHOR_EVERY,
    block: tuple[int, int] = (ROWS, ANCHORS),
) -> DataFrame:
    """Per anchor (id divisible by ``every``) and positive: the ranked negatives with both scores."""
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, c("label") if label is None else label), "rns-rows")
    anchors = stored(rows.where(c("id") % every == 0).withColumn("anchor", F.monotonically_increasing_id()), "rns-anchors")
    seen = rows.agg(F.count("*").alias("n"), F.max("squares").alias("most"), F.max(F.size("codes")).alias("width")).first()
    asked = anchors.agg(F.count("*").alias("n"), F.max("squares").alias("most")).first()
    if not asked.n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")

    width, primes = max(1, seen.width), primes_for((seen.most * asked.most) ** 0.5 + 1)
    n_rows, n_anchors = -(-seen.n // block[0]), -(-asked.n // block[1])
    packed_rows = stored(_blocks(rows, ["id", "label"], n_rows, width), "rns-row-blocks", 1)
    packed = stored(_blocks(anchors, ["id", "label", "anchor"], n_anchors, width), "rns-anchor-blocks", 1)

    near = _gridded(packed_rows, n_rows, packed, n_anchors, _positives(width, primes, positives), "anchor long, positive_id long, positive_score long")
    near = stored(_ranked(near, ["anchor"], "positive_score", "positive_id", positives), "rns-positives")

    listed = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score"))).alias("found"))
    aimed = anchors.join(listed, "anchor").withColumn("scores", F.transform("found", lambda x: x["positive_score"]))
    aimed = stored(_aimed_blocks(aimed, n_anchors, width, positives), "rns-aimed-blocks", 1)
    cells = _gridded(packed_rows, n_rows, aimed, n_anchors, _negatives(width, primes, negatives, window), "anchor long, position long, negative_id long, negative_score long")
    found = _ranked(cells, ["anchor", "position"], "negative_score", "negative_id", negatives)

    named = near.select("anchor", (c("rank") - 1).cast("long").alias("position"), "positive_id", "positive_score")
    named = named.join(anchors.select("anchor", c("id").alias("anchor_id")), "anchor")
    return found.join(named, ["anchor", "position"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _aimed_blocks(anchors: DataFrame, n: int, width: int, positives: int) -> DataFrame:
    """Anchor blocks that also hold the scores of each anchor's positives."""
    names = ["id", "label", "anchor"]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in names])
        found = table.column("scores").to_pylist()
        made = _packed(names, width)(table)
        made = made.append_column("scores", pa.array([_matrix(found, positives).tobytes()], pa.binary()))
        return made.append_column("n", pa.array([np.array([len(x) for x in found], np.int64).tobytes()], pa.binary()))

    block = F.pmod(F.xxhash64("id", "label", "codes"), F.lit(n)).cast("int").alias("block")
    schema = ", ".join(["block int", *(f"{name} binary" for name in [*names, "codes", "scores", "n"])])
    return anchors.select(block, *names, "codes", "scores").groupBy("block").applyInArrow(pack, schema)
