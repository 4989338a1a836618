"""Operator 9, packing: power-of-two decomposition.

Each document's ids (with an end id) are cut into full sequences and, for the
rest, pieces whose lengths are the powers of two of its binary form, longest
first. Every piece is a sequence of its own: no sequence crosses documents and
none is padded. Sequences are numbered bucket by bucket, longest first, so that
a bucket of equal lengths is one stretch of sequence ids.

Null and empty texts have the end id alone. Repeated rows are packed each for
itself. Further columns of the documents are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tables import run_offsets, small, stored
from shelfscope.llm.tokens import END_ID, encoded

CAPACITY = 4096
PIECES = "run int, bucket int, at long, doc_id long, start long, length long, doc_tokens long, ids binary"
_ARROW = pa.schema(
    [
        ("run", pa.int32()),
        ("bucket", pa.int32()),
        ("at", pa.int64()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def powers(n: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the powers of two of the rest, longest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_up(run: int, seen: np.ndarray, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int = CAPACITY) -> pa.RecordBatch:
    """A row per piece of some documents; ``seen`` counts the run's pieces by bucket and goes on.

    The pieces follow each other without a gap, so their ids are not copied.
    """
    tokens = np.diff(bounds)
    cuts = [powers(n, capacity) for n in tokens.tolist()]
    doc = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    lengths = np.fromiter(chain.from_iterable(cuts), dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    buckets = np.bitwise_count(lengths - 1).astype(np.int64)
    at = np.empty(len(lengths), dtype=np.int64)
    for bucket in np.flatnonzero(np.bincount(buckets)):
        own = np.flatnonzero(buckets == bucket)
        at[own] = seen[bucket] + np.arange(len(own))
        seen[bucket] += len(own)
    offsets = pa.py_buffer(np.append(4 * begins, 4 * len(ids)).astype(np.int32))
    raw = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(ids)])
    numbers = [np.full(len(lengths), run), buckets, at, doc_ids.take(pa.array(doc)), begins - bounds[doc], lengths, tokens[doc]]
    columns = [pa.array(c, f.type) for c, f in zip(numbers, _ARROW, strict=False)]
    return pa.RecordBatch.from_arrays([*columns, raw], schema=_ARROW)


def _pieces(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seen = TaskContext.get().partitionId(), np.zeros(capacity.bit_length(), dtype=np.int64)
        for part, ids, bounds in encoded(batches, path, end_id):
            yield cut_up(run, seen, part.column("doc_id"), ids, bounds, capacity)

    return cut


def packed(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids (little-endian).

    ``capacity`` is a power of two. The cut pieces are stored once, so that
    their numbers hold whatever is lost later.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity of a sequence must be a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = stored(texts.mapInArrow(_pieces(path, end_id, capacity), PIECES), "pieces")
    earlier = run_offsets(pieces, F.count(F.lit(1)), "bucket")
    sizes = pieces.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    shorter = F.explode(F.sequence(F.lit(0), "bucket")).alias("at")
    counted = F.when(F.col("at") < F.col("bucket"), F.col("n")).otherwise(0)
    base = sizes.select("bucket", "n", shorter).groupBy(F.col("at").alias("bucket")).agg(F.sum(counted).alias("base"))
    firsts = stored(earlier.join(base, "bucket").select("bucket", "run", (F.col("base") + F.col("before")).cast("long").alias("first")), "firsts")
    return (
        pieces.join(small(firsts), ["bucket", "run"])
        .withColumn("sequence_id", F.col("first") + F.col("at"))
        .withColumn("offset", F.lit(0).cast("long"))
        .select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "ids")
    )


def unpacked(pieces: list[tuple[int, int, bytes]]) -> list[int]:
    """A document's ids from its (start, length, ids) pieces; for checks."""
    return [i for _, _, raw in sorted(pieces) for i in np.frombuffer(raw, dtype="<u4").tolist()]


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)
