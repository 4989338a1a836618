"""Words of whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task looks at together.
SLICE_BYTES = 1_000_000


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches, in order, joined or cut to ``most`` bytes about, one row at least."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, text, most):
            if held and size + part.nbytes > most:
                run, held, size = pa.concat_batches(held), [], 0
                yield run
            held.append(part)
            size += part.nbytes
    if held:
        yield pa.concat_batches(held)


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    return pc.fill_null(batch.column(text), "")


def split(texts: pa.Array, blanks: str = r"[\t-\r]") -> tuple[pa.Array, np.ndarray]:
    """The non-empty runs between blanks (a space, or ``blanks``), and where each text's begin and end."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=blanks, replacement=" "), " ")
    offsets = np.asarray(lists.offsets)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(values), 0)
    counted = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return values.filter(full), counted[offsets - offsets[0]]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's code, and the distinct values by code."""
    dictionary = values.dictionary_encode()
    return np.asarray(dictionary.indices, dtype=np.int64), dictionary.dictionary
