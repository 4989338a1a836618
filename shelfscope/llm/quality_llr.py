"""Operator 1, quality rules: log-likelihood ratio of hashed n-grams, trusted target against raw corpus.

Two multinomials over hashed words and word pairs are counted: one over the
trusted documents, one over all documents. A document's score is the mean log
ratio over its n-grams, so that its length doesn't count. One threshold decides
every document. It is found from the scores of the trusted documents, each half
of them scored with the other half as the target, as no document stands for
what it was itself counted into.

The base rule comes first: too few words, or too many words in repeated
windows. A document that fails it is not kept whatever its score.

Null and empty texts have no words and fail the base rule. Repeated rows are
judged alike. Documents labelled twice are trusted only if all their labels
agree. Without trusted documents in both halves every ratio is 0 and nothing is
rejected by score. Further columns are dropped; the caller names those to carry.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tables import lines_up, run_offsets, small, stored
from shelfscope.llm.words import coded, slices, split, texts_of

BUCKETS = 1 << 16
#: Share of the trusted documents that may fall below the threshold, and what is taken off it as slack.
TAIL, SLACK = 0.001, 0.02
MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SMOOTHING = 0.5
_MIX = np.uint64(0x9E3779B97F4A7C15)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: well-spread values for running numbers."""
    x = (x + _MIX) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of neighbouring words, and which text each belongs to.

    Words are lower-cased runs of letters and digits, and runs of marks.
    """
    apart = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"([^\pL\pN\s]+)", replacement=r" \1 ")
    values, bounds = split(apart)
    codes, distinct = coded(values)
    hashes = np.fromiter((zlib.crc32(w.encode()) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    words = _mixed(hashes)[codes] if len(codes) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    same = owner[1:] == owner[:-1]
    pairs = _mixed(words[:-1] * _MIX + words[1:])[same]
    found = np.concatenate([words, pairs]) % np.uint64(BUCKETS)
    return found.astype(np.int64), np.concatenate([owner, owner[1:][same]])


def repeated_words(codes: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in windows found twice or more in it."""
    n = len(codes) - width + 1
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    if n > 0:
        lengths = np.diff(bounds)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        words = _mixed(codes.astype(np.uint64))
        keys = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            keys = keys * _MIX + words[k : k + n]
        keys = _mixed(keys ^ _mixed(owner[:n].astype(np.uint64) + np.uint64(1 << 40)))
        whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
        order = whole[np.argsort(keys[whole], kind="stable")]
        alike = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(order), dtype=bool)
        twice[1:] |= alike
        twice[:-1] |= alike
        hits = order[twice]
        np.add.at(covered, hits, 1)
        np.add.at(covered, hits + width, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[bounds[1:]] - inside[bounds[:-1]]


def _repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def measures(texts: pa.Array) -> list[np.ndarray]:
    """The columns of MEASURES."""
    values, bounds = split(texts)
    codes, _ = coded(values)
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(values), dtype=np.int64))])
    return [
        np.diff(bounds),
        sizes[bounds[1:]] - sizes[bounds[:-1]],
        np.asarray(pc.count_substring_regex(texts, "[#*$%&|<>]"), dtype=np.int64),
        np.fromiter(map(_repeated_lines, texts.to_pylist()), dtype=np.int64, count=len(texts)),
        repeated_words(codes, bounds),
    ]


def mean_ratio(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    buckets, owner = ngram_buckets(texts)
    n = np.bincount(owner, minlength=len(texts))
    return np.bincount(owner, ratios[buckets], minlength=len(texts)) / np.maximum(n, 1)


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray
    threshold: float


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good and not toxic, and the half each is in."""
    agreed = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = agreed.where("doc_id IS NOT NULL AND quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")
    return good.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, targets = np.zeros(BUCKETS, np.int64), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            buckets, owner = ngram_buckets(texts_of(part, "text"))
            raw += np.bincount(buckets, minlength=BUCKETS)
            half = part.column("half").to_numpy(zero_copy_only=False)[owner]
            for k in (0, 1):
                targets[k] += np.bincount(buckets[half == k], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (np.arange(BUCKETS), raw, *targets)], names=["bucket", "raw", "target_0", "target_1"])


def _ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two smoothed multinomials, by bucket."""
    shares = [np.log((c + SMOOTHING) / (c + SMOOTHING).sum()) for c in (target, raw)]
    return shares[0] - shares[1]


def _ranked(scores: DataFrame, rank: int) -> float:
    """The score with so many below it, by a sort over many tasks."""
    lined = stored(lines_up(scores, F.col("score")), "scores-in-order")
    at = lined.join(run_offsets(lined, F.count(F.lit(1))), "run").where(F.col("before") + F.col("at") == rank)
    return float(at.select("score").head()[0])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts over all documents, then the threshold from the scores of all trusted ones.

    What reaches the driver is bounded: one row per bucket, and one score.
    """
    spark = docs.sparkSession
    good = small(stored(trusted_ids(labels), "trusted"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    marked = texts.join(good, "doc_id", "left").select("text", F.coalesce("half", F.lit(2)).alias("half"))
    names = ("raw", "target_0", "target_1")
    sums = (
        marked.mapInArrow(_counted, "bucket long, raw long, target_0 long, target_1 long")
        .groupBy("bucket")
        .agg(*(F.sum(n).alias(n) for n in names))
        .toArrow()
    )
    raw, *targets = counts = [np.zeros(BUCKETS) for _ in names]
    for name, count in zip(names, counts, strict=True):
        count[sums["bucket"].to_numpy()] = sums[name].to_numpy()
    if not all(t.any() for t in targets):
        return Model(np.zeros(BUCKETS), 0.0)
    shared = spark.sparkContext.broadcast([_ratios(targets[1 - k], raw) for k in (0, 1)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                halves = part.column("half").to_numpy()
                both = np.stack([mean_ratio(texts, r) for r in shared.value])
                long = np.asarray(pc.count_substring_regex(texts, r"[^\t-\r ]+")) >= MIN_WORDS
                yield pa.RecordBatch.from_arrays([pa.array(both[halves, np.arange(len(halves))][long])], names=["score"])

    own = texts.join(good, "doc_id").dropDuplicates(["doc_id"]).select("text", "half")
    scores = stored(own.mapInArrow(scored, "score double"), "scores")
    n = scores.count()
    threshold = _ranked(scores, int(TAIL * n)) - SLACK if n else float("-inf")
    return Model(_ratios(targets[0] + targets[1], raw), threshold)


def judged(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, the measures, base_failed, score and kept of every row."""
    shared, threshold = docs.sparkSession.sparkContext.broadcast(model.ratios), model.threshold

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = texts_of(part, "__text")
                found = [*map(pa.array, measures(texts)), pa.array(mean_ratio(texts, shared.value))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), *found], names=[*carry, *MEASURES, "score"])

    rows = docs.select(*carry, F.col("text").cast("string").alias("__text"))
    schema = rows.drop("__text").schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return (
        rows.mapInArrow(measured, schema.add("score", "double"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
