"""Operator 4, token-id output: directly addressable codes.

Ids are split into chunks, lowest first. Level k holds the k-th chunk of all
ids that have one, a bitmap telling which of them go on, and a rank directory
over the bitmap, so that any id is reached by a few look-ups, without decoding
a block.

A file is one value of ``payload``; Spark's own commit of the table that holds
the files makes lost and repeated tasks safe. Layout, little-endian:

    magic "DAC1", u32 levels, u64 ids
    per level: u32 bits of a chunk, u64 chunks, u32 rank entries,
               chunks (u8 or u16 each), bitmap (8 per byte, low bit first),
               u32 rank entries (set bits before each block of 512)

Documents lie in ascending order of doc_id (null first; equal ids in any order)
over all files. Null and empty texts hold the end id alone; repeated rows are
kept each for itself; further columns are dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfscope.llm.tables import run_offsets, stored
from shelfscope.llm.tokens import END_ID, encoded

MAGIC = b"DAC1"
#: Bits of the chunks, lowest first; the last level takes what is left.
WIDTHS = (8, 8, 16)
BLOCK = 512
FILES = "run int, file int, n_docs long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
_ARROW = pa.schema(
    [
        ("run", pa.int32()),
        ("file", pa.int32()),
        ("n_docs", pa.int64()),
        ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
DOCS = "run int, file int, doc_id long, inside long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The bytes of a file that holds ``ids`` (below 2**32)."""
    if sum(widths) < 32 or any(w not in (8, 16) for w in widths):
        raise ValueError("chunks have 8 or 16 bits and reach 32 in all")
    rest, levels = ids.astype(np.uint32), []
    for width in widths:
        chunk = (rest & np.uint32((1 << width) - 1)).astype("<u1" if width == 8 else "<u2")
        more = (rest >> np.uint32(width)) > 0
        bits = np.packbits(more, bitorder="little")
        ranks = _ranks(bits)
        levels.append(struct.pack("<IQI", width, len(chunk), len(ranks)) + chunk.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> np.uint32(width)
        if not len(rest):
            break
    return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


def _ranks(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block."""
    padded = np.zeros(-(-len(bits) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
    padded[: len(bits)] = bits
    per_block = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.int64)
    return (np.cumsum(per_block) - per_block).astype("<u4")


class Codes:
    """A file opened for reading: one id by place, or all of them."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, self.n = struct.unpack_from("<IQ", raw, 4)
        at, self._levels = 16, []
        for _ in range(n_levels):
            width, n, n_ranks = struct.unpack_from("<IQI", raw, at)
            at += 16
            chunks = np.frombuffer(raw, "<u1" if width == 8 else "<u2", n, at)
            at += chunks.nbytes
            bits = np.frombuffer(raw, np.uint8, -(-n // 8), at)
            at += bits.nbytes
            ranks = np.frombuffer(raw, "<u4", n_ranks, at)
            at += ranks.nbytes
            self._levels.append((width, chunks, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value, shift = 0, 0
        for width, chunks, bits, ranks in self._levels:
            value |= int(chunks[place]) << shift
            shift += width
            byte, bit = divmod(place, 8)
            if not bits[byte] >> bit & 1:
                break
            block = place // BLOCK
            inside = int(np.bitwise_count(bits[block * (BLOCK // 8) : byte]).sum())
            inside += int(bits[byte] & ((1 << bit) - 1)).bit_count()
            place = int(ranks[block]) + inside
        return value

    def all(self) -> np.ndarray:
        found = None
        for width, chunks, bits, _ in reversed(self._levels):
            values = chunks.astype(np.uint32)
            if found is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                values[more] |= found << np.uint32(width)
            found = values
        return np.zeros(0, np.uint32) if found is None else found


def _to_files(path: str, end_id: int, widths: tuple[int, ...]):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, file = TaskContext.get().partitionId(), 0
        for part, ids, bounds in encoded(batches, path, end_id):
            row = (run, file, part.num_rows, len(ids), part.column("doc_id").to_pylist(), np.diff(bounds).tolist(), encode(ids, widths))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=True)], schema=_ARROW)
            file += 1

    return write


def _from_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            run, file, doc_ids, lengths, raw = (batch.column(c)[row].as_py() for c in ("run", "file", "doc_ids", "lengths", "payload"))
            ids, ends = memoryview(Codes(raw).all().astype("<u4").tobytes()), np.cumsum(lengths)
            begins = ends - lengths
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([run] * n, pa.int32()), pa.array([file] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())],
                names=["run", "file", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def written(docs: DataFrame, path: str, end_id: int = END_ID, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """The table of files: ``run`` and ``file`` give their order."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = texts.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return stored(ordered.mapInArrow(_to_files(path, end_id, widths), FILES), "token-files")


def read_back(files: DataFrame) -> DataFrame:
    """A row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    earlier = run_offsets(files, F.sum("n_tokens"))
    before = Window.partitionBy("run").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(earlier, "run").select("run", "file", (F.col("before") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).alias("first"))
    docs = files.select("run", "file", "doc_ids", "lengths", "payload").mapInArrow(_from_files, DOCS)
    return docs.join(starts, ["run", "file"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
