"""Operator 12, cross-tokenizer alignment: lockstep vectorised merging.

Two tokenizers, a byte-level BPE (A) and a sentencepiece model (B), encode the
same text. Each token covers a range of bytes; where tokens of both end at the
same byte, the text is cut, and between two cuts lies a group. An A and a B
token whose ranges overlap are linked.

The merge walks a pointer over A and one over B. It runs for all documents of a
slice in one NumPy state vector: every step links the tokens under all pointers,
marks a cut where both end together, and advances whichever ends first (or
both); finished walks are taken out. A document starts one walk per ``LANE`` of
its A tokens, so that a very long text takes no more steps than a short one.

Counts of linked id pairs are summed over the corpus from one row per distinct
pair of a slice, and brought back to the slices the same way.

Null and empty texts, and texts whose tokens do not spell " " + text byte by
byte (a U+2581 in the text, for one), have no tokens: all counts 0, no groups.
Special tokens' strings are plain text. Repeated rows are documents of their
own and count each. A text is encoded and aligned whole, in one task, whatever
its length. Of other columns only those named in ``carry`` are kept.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfscope.llm.tables import TEXT_ROWS, batches_of, stored
from shelfscope.llm.tokens import byte_alphabet
from shelfscope.llm.words import slices, texts_of

c = F.col
#: A tokens of one walk.
LANE = 256
#: Bytes of text that are aligned together.
SLICE = 4_000_000
#: Distinct chunks that a worker remembers; it starts anew beyond, which changes the speed alone.
REMEMBERED = 150_000
ENCODED = 2_000
#: Every character that some Unicode version or library takes for white space.
BLANK = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
BLANKS = frozenset(x for x in map(chr, range(0x10000)) if re.match(f"[{BLANK}]", x))
TWO_BLANKS = re.compile(f"[{BLANK}] | [{BLANK}]")
CHUNK_START = re.compile(f"(?<=[^{BLANK}])(?= )")
SPACE = "\u2581"
_SLICE_BITS = 32


# --- both tokenizers ----------------------------------------------------------------


@dataclass(frozen=True)
class Encoded:
    """Flat ids of all documents; those of document d lie from bounds[d] to bounds[d + 1]."""

    a: np.ndarray
    b: np.ndarray
    a_bounds: np.ndarray
    b_bounds: np.ndarray


class Tokenizers:
    """A and B side by side; a worker's memory of chunks and their ids.

    Text is encoded in chunks that begin with a space after a sure non-blank.
    Byte-level BPE with the usual pattern never joins across such a place, as a
    space before anything begins a pre-token. B never does if none of its pieces
    has a space behind another character, which is proved over its vocabulary.
    Where either proof fails, a chunk is a whole text.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = SentencePieceProcessor(model_file=path_b)
        rules, proto = json.loads(self._a.to_str()), ModelProto.FromString(self._b.serialized_model_proto())
        cut = rules["pre_tokenizer"]
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        norm = proto.normalizer_spec
        self.in_chunks = (
            rules["normalizer"] is None
            and (cut["type"], cut["add_prefix_space"], cut["use_regex"]) == ("ByteLevel", False, True)
            and (norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces) == (b"", True, False)
            and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        )
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(alphabet[x] for x in token)
        for i, token in self._a.get_added_tokens_decoder().items():
            self.a_bytes[i] = token.content.encode()
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self._b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self._a_pool, self._b_pool = (pa.array(t, pa.large_binary()) for t in (self.a_bytes, self.b_bytes))
        self._space = self._b.piece_to_id(SPACE)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._a_learnt, self._b_learnt = _Learnt(), _Learnt()
        self._spells: list[bool] = []

    def _chunks(self, text: str) -> list[str]:
        if not self.in_chunks:
            return [" " + text]
        if TWO_BLANKS.search(" " + text):
            return CHUNK_START.split(" " + text)
        return [" " + x for x in text.split(" ")]

    def _learn(self, chunks: list[str]) -> None:
        alone = [x for x in chunks if not self.in_chunks or SPACE in x or x[-1] in BLANKS]
        others = set(alone)
        together = [x for x in chunks if x not in others]
        for i in range(0, len(together), ENCODED):
            some = together[i : i + ENCODED]
            if not self._learn_together(some):
                alone += some
        for chunk in alone:
            a = self._a.encode(chunk, add_special_tokens=False).ids
            b = [self._space] if chunk == " " else self._b.encode(chunk[1:])
            spelt = [b"".join(map(t.__getitem__, ids)) for t, ids in ((self.a_bytes, a), (self.b_bytes, b))]
            self._keep([chunk], [len(a)], a, [len(b)], b, spelt == [chunk.encode()] * 2)

    def _learn_together(self, chunks: list[str]) -> bool:
        """Encode chunks as one text, which is cut where they end; False if the tokens don't spell it."""
        text = "".join(chunks)
        ends, raw, found = np.cumsum([len(x.encode()) for x in chunks]), text.encode(), []
        a = self._a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        for ids, sizes, pool in ((a, self.a_sizes, self._a_pool), (self._b.encode(text[1:]), self.b_sizes, self._b_pool)):
            ids = np.array(ids, np.int64)
            token_ends = np.cumsum(sizes[ids])
            after = np.searchsorted(token_ends, ends) + 1
            spelt = pool.take(pa.array(ids)).buffers()[2]
            if after[-1] > len(ids) or (token_ends[after - 1] != ends).any() or spelt.to_pybytes()[: token_ends[-1]] != raw:
                return False
            found += [np.diff(after, prepend=0), ids]
        self._keep(chunks, *found, True)
        return True

    def _keep(self, chunks: list[str], a_sizes, a_ids, b_sizes, b_ids, spells: bool) -> None:
        self._known.update(zip(chunks, range(len(self._spells), len(self._spells) + len(chunks))))
        self._spells += [spells] * len(chunks)
        self._a_learnt.add(a_sizes, a_ids)
        self._b_learnt.add(b_sizes, b_ids)

    def encode(self, texts: list[str]) -> Encoded:
        """Ids by both of " " + text; none where the tokens of either don't spell it."""
        if len(self._known) > REMEMBERED:
            self._forget()
        known = self._known
        chunks: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                chunks += self._chunks(text)
            ends.append(len(chunks))
        self._learn([x for x in dict.fromkeys(chunks) if x not in known])
        codes = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        ends = np.array(ends)
        spells = np.concatenate([[0], np.cumsum(~np.array(self._spells, bool)[codes])])
        for d in np.flatnonzero(spells[ends[1:]] > spells[ends[:-1]]):
            codes[ends[d] : ends[d + 1]] = -1
        kept = codes >= 0
        ends = np.concatenate([[0], np.cumsum(kept)])[ends]
        a, a_bounds = self._a_learnt.laid(codes[kept], ends)
        b, b_bounds = self._b_learnt.laid(codes[kept], ends)
        return Encoded(a, b, a_bounds, b_bounds)


class _Learnt:
    """The ids of chunks by their codes."""

    def __init__(self) -> None:
        self._sizes, self._ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, sizes, ids) -> None:
        self._sizes.append(np.asarray(sizes, np.int64))
        self._ids.append(np.asarray(ids, np.int64))

    def laid(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the coded chunks one after the other, and where those of each document end."""
        self._sizes, self._ids = [np.concatenate(self._sizes)], [np.concatenate(self._ids)]
        sizes = self._sizes[0]
        mine = sizes[codes]
        after = np.concatenate([[0], np.cumsum(mine)])
        places = np.repeat((np.cumsum(sizes) - sizes)[codes] - after[:-1], mine) + np.arange(after[-1])
        return self._ids[0][places], after[ends]


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """The worker's own, kept from task to task."""
    return Tokenizers(path_a, path_b)


# --- the merge ----------------------------------------------------------------------


@dataclass(frozen=True)
class Alignment:
    """Places of linked A and B tokens, and of the last A and B token of each group in order."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, lane: int = LANE) -> Alignment:
    """Walk all documents at once. Ends are bytes from the start of the first document; each has as many in A as in B."""
    sizes = np.diff(a_bounds)
    lanes = -(-sizes // lane)
    first = np.cumsum(lanes) - lanes
    i = np.repeat(a_bounds[:-1] - lane * first, lanes) + lane * np.arange(lanes.sum())
    stop = np.minimum(i + lane, np.repeat(a_bounds[1:], lanes))
    j = np.searchsorted(b_ends, np.where(i > 0, a_ends[i - 1], 0) if len(i) else i, side="right")
    found: tuple[list, ...] = [], [], [], []
    while len(i):
        at_a, at_b = a_ends[i], b_ends[j]
        cut = at_a == at_b
        for kept, places in zip(found, (i, j, i[cut], j[cut])):
            kept.append(places)
        i, j = i + (at_a <= at_b), j + (at_b <= at_a)
        on = i < stop
        if not on.all():
            i, j, stop = i[on], j[on], stop[on]
    link_a, link_b, cut_a, cut_b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    return Alignment(link_a, link_b, np.sort(cut_a), np.sort(cut_b))


class _Slice:
    """The aligned documents of one slice."""

    def __init__(self, both: Tokenizers, texts: list[str]):
        self.both, self.encoded = both, both.encode(texts)
        e = self.encoded
        self.found = lockstep(np.cumsum(both.a_sizes[e.a]), np.cumsum(both.b_sizes[e.b]), e.a_bounds)
        self.doc_of_a = np.repeat(np.arange(len(texts)), np.diff(e.a_bounds))
        self.n = len(texts)

    def per_doc(self, a_places: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc_of_a[a_places], minlength=self.n)

    def group_ends(self, cuts: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Per document, the number of its tokens up to the end of each group."""
        ends = np.cumsum(self.per_doc(self.found.cut_a))
        return [cuts[a:b] + 1 - start for a, b, start in zip([0, *ends], ends, bounds)]

    def digests(self, spelled: pa.Array) -> list[str]:
        """sha256 of the groups of each document in writing; '' without tokens."""
        e, f = self.encoded, self.found
        a_last, b_last = np.zeros(len(e.a), bool), np.zeros(len(e.b), bool)
        a_last[f.cut_a] = b_last[f.cut_b] = True
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        b_before = np.concatenate([[0], f.cut_b + 1])
        order = np.zeros(len(e.a) + len(e.b), np.int64)
        order[np.arange(len(e.a)) + b_before[a_group]] = 2 * e.a + a_last
        order[np.arange(len(e.b)) + f.cut_a[b_group] + 1] = 2 * len(self.both.a_bytes) + 2 * e.b + b_last
        _, offsets, data = spelled.take(pa.array(order)).buffers()
        ends = np.frombuffer(offsets, np.int64, len(order) + 1)[e.a_bounds + e.b_bounds]
        written = memoryview(data or b"")
        return ["" if a == b else sha256(written[a : b - 1]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs of each document, document by document: their number, the pairs, their links."""
        e, f, many = self.encoded, self.found, len(self.both.b_bytes)
        pairs = e.a[f.link_a] * many + e.b[f.link_b]
        span = len(self.both.a_bytes) * many
        keys, times = np.unique(self.doc_of_a[f.link_a] * span + pairs, return_counts=True)
        return np.bincount(keys // span, minlength=self.n), keys % span, times


@lru_cache(maxsize=2)
def _spelled(path_a: str, path_b: str) -> pa.Array:
    """Decimal ids of A, then of B, each inside and at the end of its side of a group."""
    both = tokenizers(path_a, path_b)
    a = [f"{i}{mark}" for i in range(len(both.a_bytes)) for mark in ",|"]
    return pa.array([*a, *(f"{i}{mark}" for i in range(len(both.b_bytes)) for mark in ",;")], pa.large_binary())


# --- tables -------------------------------------------------------------------------


def _rows(docs: DataFrame, text: str, carry: tuple[str, ...]) -> DataFrame:
    return docs.select(*carry, c(text).cast("string").alias("__text"))


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ids by both, and how many tokens of each lie before the end of every group."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                s = _Slice(both, texts_of(part, "__text").to_pylist())
                e = s.encoded
                lists = [
                    *([x[p:q] for p, q in zip(at, at[1:])] for x, at in ((e.a, e.a_bounds), (e.b, e.b_bounds))),
                    s.group_ends(s.found.cut_a, e.a_bounds),
                    s.group_ends(s.found.cut_b, e.b_bounds),
                ]
                made = [pa.array(x, pa.list_(pa.int32())) for x in lists]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in carry), *made], names=[*carry, *ALIGNED])

    rows = _rows(docs, text, carry)
    schema = rows.drop("__text").schema
    for name in ALIGNED:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(align, schema)


ALIGNED = ("a_ids", "b_ids", "a_group_ends", "b_group_ends")
COUNTED = ("n_a", "n_b", "n_groups", "n_links")


def _sliced(docs: DataFrame, path_a: str, path_b: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    """A row per slice: its documents, its distinct id pairs with their links, and which document holds which how often."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, spelled, number = tokenizers(path_a, path_b), _spelled(path_a, path_b), 0
        task = TaskContext.get().partitionId() << _SLICE_BITS
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                s = _Slice(both, texts_of(part, "__text").to_pylist())
                e = s.encoded
                held, pairs, times = s.pairs()
                distinct, codes = np.unique(pairs, return_inverse=True)
                tallies = np.bincount(codes, weights=times, minlength=len(distinct)).astype(np.int64)
                counts = [np.diff(e.a_bounds), np.diff(e.b_bounds), s.per_doc(s.found.cut_a), s.per_doc(s.found.link_a), held]
                fields = [*(part.column(n) for n in carry), *map(pa.array, counts), pa.array(s.digests(spelled), pa.string())]
                listed = pa.StructArray.from_arrays(fields, names=[*carry, *COUNTED, "held", "groups_sha256"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([task + number]),
                        pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed),
                        pa.array([distinct], pa.list_(pa.int64())),
                        pa.array([tallies], pa.list_(pa.int64())),
                        pa.array([codes.astype("<u4").tobytes()], pa.binary()),
                        pa.array([times.astype("<u4").tobytes()], pa.binary()),
                    ],
                    names=["slice", "docs", "pairs", "tallies", "codes", "times"],
                )
                number += 1

    rows = _rows(docs, text, carry)
    doc = rows.drop("__text").schema
    for name in (*COUNTED, "held"):
        doc = doc.add(name, "long")
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("slice", T.LongType()), T.StructField("docs", T.ArrayType(doc.add("groups_sha256", "string")))])
    schema = schema.add("pairs", longs).add("tallies", longs).add("codes", "binary").add("times", "binary")
    return rows.mapInArrow(align, schema)


def pair_counts(sliced: DataFrame, b_ids: int) -> DataFrame:
    """How many links hold each id pair, and whether no pair of its B id has more."""
    counts = sliced.select(F.inline(F.arrays_zip("pairs", "tallies"))).groupBy("pairs").agg(F.sum("tallies").alias("n"))
    counts = stored(counts.withColumnRenamed("pairs", "pair").withColumn("b", c("pair") % b_ids), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    # At most one row per B id of the vocabulary.
    return counts.join(F.broadcast(highest), "b").select("pair", "n", (c("n") == c("most")).alias("best"))


def _summed(carry: tuple[str, ...]):
    """Adds n_best and count_sum to the documents of one slice, from its row and the counts of its pairs in any order."""

    def add(sliced: pa.Table, scored: pa.Table) -> pa.Table:
        at = scored.column("at").to_numpy()
        docs = sliced.column("docs").combine_chunks().flatten()
        codes, times = (np.frombuffer(sliced.column(x)[0].as_buffer(), "<u4") for x in ("codes", "times"))
        ends = np.concatenate([[0], np.cumsum(np.asarray(docs.field("held")))])
        sums = []
        for worth in ("best", "n"):
            of_pair = np.zeros(len(at), np.int64)
            of_pair[at] = scored.column(worth).to_numpy()
            # Whole numbers wrap around without harm: each difference is right.
            run = np.concatenate([[0], np.cumsum(times * of_pair[codes])])
            sums.append(pa.array(run[ends[1:]] - run[ends[:-1]]))
        names = [*carry, *COUNTED, "groups_sha256"]
        return pa.Table.from_arrays([*(docs.field(x) for x in names), *sums], names=[*names, "n_best", "count_sum"])

    return add


def _rejoined(sliced: DataFrame, b_ids: int, carry: tuple[str, ...]) -> DataFrame:
    """The documents of all slices; counts of pairs go back to their slice row by row, so that no task holds more than one slice."""
    scored = pair_counts(sliced, b_ids)
    asked = sliced.select("slice", F.posexplode("pairs").alias("at", "pair"))
    back = asked.join(scored, "pair").select(c("slice").alias("of"), "at", "n", "best")
    whole = sliced.select("slice", "docs", "codes", "times")
    kinds = {f.name: f for f in sliced.schema["docs"].dataType.elementType}
    schema = T.StructType([kinds[n] for n in (*carry, *COUNTED, "groups_sha256")]).add("n_best", "long").add("count_sum", "long")
    return whole.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(_summed(carry), schema)


def linked(docs: DataFrame, path_a: str, path_b: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: sizes, links and groups, and how common its linked id pairs are in the whole corpus."""
    with batches_of(docs.sparkSession, TEXT_ROWS):
        sliced = stored(_sliced(docs, path_a, path_b, text, carry), "alignment")
    return _rejoined(sliced, len(tokenizers(path_a, path_b).b_bytes), carry)
