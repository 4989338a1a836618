"""Operator 10, token counts: whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the
driver, over the whole vocabulary (its size is fixed). Pre-tokens among them
count one; each other distinct pre-token is merged by the library and
remembered for a while.

Pre-tokens are cut with the vocabulary's own published pattern as long as a
text holds only characters whose class every Unicode version agrees on; chunks
with any other character go to the library whole.

Null and empty texts have no token and no byte. Repeated rows are counted each
for itself. Further columns are dropped; the caller names those to carry.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tokens import byte_alphabet, tokenizer
from shelfscope.llm.words import slices, texts_of

LIMIT = 512
#: Pre-tokens that are remembered besides the proved ones, until all of them are forgotten at once.
REMEMBERED = 150_000
# The pre-token pattern of the byte-level vocabulary, with letters and digits spelt out.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGIT = "0-9²³¹¼½¾"
PRE_TOKEN = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTER}]+| ?[{DIGIT}]+| ?[^\s{LETTER}{DIGIT}]+|\s+(?!\S)|\s+"
)
#: Anything but characters that are letters, digits, blanks or neither in every Unicode version.
UNSURE = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞€]")
CHUNK = re.compile(r"(?<=\S)(?= \S)")


def whole_tokens(path: str) -> list[str]:
    """The vocabulary strings that are one pre-token and encode alone as their own single id."""
    library, alphabet = tokenizer(path), byte_alphabet()
    found = []
    for token, id_ in sorted(library.get_vocab(with_added_tokens=False).items()):
        try:
            text = bytes(alphabet[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if UNSURE.search(text) or PRE_TOKEN.findall(text) != [text]:
            continue
        if library.encode(text, add_special_tokens=False).ids == [id_]:
            found.append(text)
    return found


class _Merged(dict):
    """Tokens of a pre-token: proved ones first, others by the library when they come up."""

    def __init__(self, path: str, proved: list[str]):
        super().__init__((p, 1) for p in proved)
        self._library, self._proved = tokenizer(path), proved

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self._proved) + REMEMBERED:
            self.clear()
            self.update((p, 1) for p in self._proved)
        n = self[piece] = len(self._library.encode(piece, add_special_tokens=False).ids)
        return n


class TokenCounter:
    def __init__(self, path: str, proved: list[str]):
        self._merged = _Merged(path, proved)
        special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def _sure(self, text: str) -> int:
        get, parts = self._merged.__getitem__, self._special.split(text)
        return len(parts) - 1 + sum(sum(map(get, PRE_TOKEN.findall(p))) for p in parts)

    def count(self, text: str) -> int:
        if not UNSURE.search(text):
            return self._sure(text)
        return sum(self._merged[c] if UNSURE.search(c) else self._sure(c) for c in CHUNK.split(text))


def token_counts(docs: DataFrame, path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``carry`` columns with n_bytes, n_tokens and over_limit of every row."""
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, proved.value)
        for batch in batches:
            for part in slices(batch, "__text"):
                n = pa.array([counter.count(t) for t in texts_of(part, "__text").to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), part.column("n_bytes"), n], names=[*carry, "n_bytes", "n_tokens"])

    rows = docs.select(
        *carry,
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).cast("string").alias("__text"),
    )
    schema = rows.drop("__text").schema.add("n_tokens", "long")
    return rows.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)
