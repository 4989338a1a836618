"""Operator 13, toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. A text's vector holds the words
that tell the labels apart among them (by log-likelihood ratio), weighted
``(1 + ln tf) * idf``; document frequencies are counted over the whole corpus.
The examples' vectors lie in an inverted index whose postings are cut into
blocks of examples, with the highest weight of each word in each block. A
block's sum of maxima bounds the cosine of all its examples, so blocks are
opened from the highest bound down until no other can hold one of the nearest:
the neighbours are exact.

Each neighbour votes for its label, the more the nearer. An isotonic curve,
fitted on sampled rows that are not in the index, turns the vote into a score:
the share of such rows that are labelled toxic. Texts with no neighbour get the
share found among texts without one.

Null and empty texts have no words, so no neighbour. Repeated rows are scored
each for itself; equal texts of one id count as one example, and ids whose
labels contradict each other as none. Without any labelled row all scores are 0.
Equal cosines rank by the example's id. Texts are read whole. Of other columns
only those named in ``carry`` are kept. Labels and ids choose the examples but
are no input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from shelfscope.llm.tables import TEXT_ROWS, batches_of, stored
from shelfscope.llm.words import slices, texts_of

c = F.col
WORD = re.compile(r"[^\W_]+")
#: Labelled rows that are looked at, at most; a fifth of them calibrates, the others are examples.
LABELLED = 32_000
CALIBRATION = 5
#: Words of the index, at most, and what each must show: examples that hold it, surprise (G2, p about 1e-6), and how
#: often the overall toxic share (or its inverse) its examples have. Common words differ a little, but tell nothing.
VOCABULARY = 20_000
LEAST_EXAMPLES = 5
LEAST_SURPRISE = 24.0
LEAST_LIFT = 3.0
#: Postings of the index, at most: what bounds its size. Examples beyond are left out, in the order of their draw.
POSTINGS = 3_000_000
BLOCK = 64
NEIGHBOURS = 15
SHOWN = 5
#: Distance that every neighbour has besides its own, and the weight of the overall share in each vote.
NEARNESS, PRIOR_WEIGHT = 0.1, 1.0
#: Bounds are compared with this much room for rounding.
ROOM = 1e-9
#: Part of a score that follows the vote itself, so that flat steps of the curve keep their order.
SLOPE = 0.001


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(c(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


# --- the index ----------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """Examples by word. ``postings`` of a word lie block by block; ``directory`` has a row per word and block."""

    words: dict[str, int]
    idf: np.ndarray
    ids: list
    labels: np.ndarray
    rank: np.ndarray
    posting_example: np.ndarray
    posting_weight: np.ndarray
    word_starts: np.ndarray
    directory_block: np.ndarray
    directory_most: np.ndarray
    directory_start: np.ndarray

    @classmethod
    def build(cls, words: list[str], idf: np.ndarray, examples: list[tuple]) -> Index:
        """``examples``: id, label, word numbers in ascending order, term frequencies."""
        vectors = [weighed(np.asarray(w, np.int64), np.asarray(tf), idf) for _, _, w, tf in examples]
        # Like examples side by side, so that a block's maxima are near its members' weights.
        order = sorted(range(len(examples)), key=lambda e: (examples[e][1], examples[e][2][int(np.argmax(vectors[e]))], e))
        by_id = sorted(range(len(order)), key=lambda at: (str(examples[order[at]][0]).zfill(20), order[at]))
        rank = np.zeros(len(order), np.int64)
        rank[by_id] = np.arange(len(order))
        word = np.concatenate([np.asarray(examples[e][2], np.int64) for e in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[e] for e in order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(order)), [len(vectors[e]) for e in order])
        place = np.lexsort((example, word))
        word, weight, example = word[place], weight[place], example[place]
        entry = word * (len(order) // BLOCK + 1) + example // BLOCK
        starts = np.flatnonzero(np.diff(entry, prepend=-1))
        return cls(
            {w: i for i, w in enumerate(words)},
            idf,
            [examples[e][0] for e in order],
            np.array([examples[e][1] for e in order], np.int64),
            rank,
            example,
            weight,
            np.searchsorted(word[starts], np.arange(len(words) + 1)),
            example[starts] // BLOCK,
            np.maximum.reduceat(weight, starts) if len(starts) else weight,
            np.append(starts, len(word)),
        )

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        known = self.words
        counts = Counter(known[w] for w in WORD.findall(text.lower()) if w in known)
        words = np.array(sorted(counts), np.int64)
        return words, weighed(words, np.array([counts[w] for w in words.tolist()]), self.idf)

    def nearest(self, words: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with a positive cosine, and the cosines; ties by id."""
        sizes = self.word_starts[words + 1] - self.word_starts[words]
        entry = _runs(self.word_starts[words], sizes)
        asked = np.repeat(weights, sizes)
        block = self.directory_block[entry]
        bound = np.bincount(block, asked * self.directory_most[entry])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        opened = np.zeros(len(bound), bool)
        found, cosines = np.zeros(0, np.int64), np.zeros(0)
        done, step = 0, 2
        while done < len(order):
            if len(found) == k and bound[order[done]] < cosines[-1] - ROOM:
                break
            opened[:] = False
            opened[order[done : done + step]] = True
            mine = entry[opened[block]]
            sizes = self.directory_start[mine + 1] - self.directory_start[mine]
            posting = _runs(self.directory_start[mine], sizes)
            sums = np.bincount(self.posting_example[posting], np.repeat(asked[opened[block]], sizes) * self.posting_weight[posting])
            new = np.flatnonzero(sums)
            found, cosines = np.concatenate([found, new]), np.concatenate([cosines, sums[new]])
            best = np.lexsort((self.rank[found], -cosines))[:k]
            found, cosines = found[best], cosines[best]
            done, step = done + step, 2 * step
        return found, cosines


def weighed(words: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of unit length."""
    weights = (1 + np.log(tf)) * idf[words] if len(words) else np.zeros(0)
    return weights / np.sqrt((weights**2).sum()) if len(words) else weights


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


# --- votes --------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """The index, the share of toxic rows, and the curve from votes to scores."""

    index: Index
    prior: float
    votes: np.ndarray
    shares: np.ndarray
    alone: float

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float | None:
        """Share of the neighbours' weight that is toxic, drawn towards the overall share; None without any."""
        if not len(found):
            return None
        near = 1 / (1 - np.minimum(cosines, 1) + NEARNESS)
        return float((near @ self.index.labels[found] + PRIOR_WEIGHT * self.prior) / (near.sum() + PRIOR_WEIGHT))

    def score(self, vote: float | None) -> float:
        if vote is None:
            return self.alone
        share = float(np.interp(vote, self.votes, self.shares)) if len(self.votes) else vote
        return (1 - SLOPE) * share + SLOPE * vote


def isotonic(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean votes and shares of toxic rows, rising: neighbouring groups are pooled until they do.

    Each group counts one more row of the overall share.
    """
    pools: list[list[float]] = []
    for vote in np.unique(votes):
        mine = labels[votes == vote]
        pools.append([vote * len(mine), float(mine.sum()), len(mine)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    sums = np.array(pools).reshape(-1, 3)
    return sums[:, 0] / sums[:, 2], np.maximum.accumulate((sums[:, 1] + prior) / (sums[:, 2] + 1)) if len(sums) else sums[:, 0]


# --- fitting ------------------------------------------------------------------------


def sampled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """At most ``most`` labelled ids by the order of a hash: id, label, draw, and whether they calibrate."""
    sure = labels.where(c("doc_id").isNotNull() & c("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id")
    sure = sure.agg(F.min("toxic").cast("long").alias("label"), F.max("toxic").alias("high")).where("label = high")
    drawn = sure.select("doc_id", "label", F.xxhash64(c("doc_id").cast("string")).alias("draw"))
    # Twice the share that is wanted, so that few rows are left to be ordered.
    part = min(1.0, 2.0 * most / max(1, drawn.count()))
    drawn = drawn.where(c("draw") <= min(2**63 - 1, int((2 * part - 1) * 2**63))).orderBy("draw", "doc_id").limit(most)
    calibrates = F.pmod(F.xxhash64("draw", F.lit("calibration")), F.lit(CALIBRATION)) == 0
    return stored(drawn.withColumn("calibrates", calibrates), "labelled")


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and term frequencies of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            counts = [Counter(WORD.findall(t.lower())) for t in texts_of(part, "text").to_pylist()]
            made = [pa.array([list(x) for x in counts], pa.list_(pa.string())), pa.array([list(x.values()) for x in counts], pa.list_(pa.int64()))]
            kept = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), *made], names=[*kept, "words", "tf"])


def telling_words(bags: DataFrame) -> list[str]:
    """Words whose examples are labelled otherwise than the rest, the most telling first, in a bounded number."""
    total = bags.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    if not total.n or total.toxic in (0, total.n):
        return []
    held = bags.select("label", F.explode("words").alias("word")).groupBy("word")
    held = held.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).where(c("n") >= LEAST_EXAMPLES)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share, rest = total.toxic / total.n, total.n - c("n")
    cells = [(c("toxic"), c("n") * share), (c("n") - c("toxic"), c("n") * (1 - share))]
    cells += [(total.toxic - c("toxic"), rest * share), (rest - total.toxic + c("toxic"), rest * (1 - share))]
    surprise = 2 * sum((part(seen, expected) for seen, expected in cells), F.lit(0.0))
    lift = c("toxic") / (c("n") * share)
    told = held.withColumn("surprise", F.round(surprise, 6)).where(c("surprise") >= LEAST_SURPRISE)
    told = told.where((lift >= LEAST_LIFT) | (lift <= 1 / LEAST_LIFT))
    return [r.word for r in told.orderBy(c("surprise").desc(), "word").limit(VOCABULARY).collect()]


def document_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and of those that hold each word; counted in the tasks, a row per word and task."""
    numbers = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = numbers.value, np.zeros(len(numbers.value) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                for text in texts_of(part, "text").to_pylist():
                    held[[known[w] for w in known.keys() & WORD.findall(text.lower())]] += 1
                    n += 1
        held[-1] = n
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(words) + 1, np.int64)
    for r in rows:
        found[r.word] = r.n
    return int(found[-1]), found[:-1]


def _examples(bags: DataFrame, words: list[str]) -> list[tuple]:
    """Postings of the examples in the order of their draw, as far as the bound goes."""
    numbers = bags.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            rows = batch.select(["words", "tf"]).to_pylist()
            held = [sorted((known[w], n) for w, n in zip(r["words"], r["tf"]) if w in known) for r in rows]
            made = [pa.array([[x[i] for x in h] for h in held], pa.list_(pa.int64())) for i in (0, 1)]
            kept = ["doc_id", "label", "draw", "body"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *made], names=[*kept, "word", "tf"])

    schema = bags.select("doc_id", "label", "draw", "body").schema
    longs = T.ArrayType(T.LongType())
    rows = bags.mapInArrow(number, schema.add("word", longs).add("tf", longs)).where(F.size("word") > 0)
    rows = stored(rows, "examples")
    # LABELLED rows at most meet here.
    so_far = F.sum(F.size("word")).over(Window.orderBy("draw", "doc_id", "body"))
    rows = rows.withColumn("so_far", so_far).where(c("so_far") <= POSTINGS).orderBy("draw", "doc_id", "body")
    return [(r.doc_id, r.label, r.word, r.tf) for r in rows.select("doc_id", "label", "word", "tf").collect()]


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """Examples, words, document frequencies, index and calibration from the labelled rows that are not held out."""
    ids = sampled(labels, most)
    texts = docs.select("doc_id", c("text").cast("string").alias("text"))
    # At most LABELLED rows are broadcast.
    marked = texts.join(F.broadcast(ids), "doc_id").withColumn("body", F.xxhash64("text"))
    schema = marked.drop("text").schema.add("words", T.ArrayType(T.StringType())).add("tf", T.ArrayType(T.LongType()))
    with batches_of(docs.sparkSession, TEXT_ROWS):
        bags = stored(marked.mapInArrow(_bags, schema).dropDuplicates(["doc_id", "body"]), "bags")
        index_bags = bags.where("NOT calibrates")
        words = telling_words(index_bags)
        n, held = document_frequencies(texts, words)
        index = Index.build(words, np.log((n + 1) / (held + 0.5)), _examples(index_bags, words))
        seen = index_bags.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
        prior = (seen.toxic / seen.n) if seen.n else 0.0
        model = Model(index, prior, np.zeros(0), np.zeros(0), prior)
        tested = texts.join(F.broadcast(ids.where("calibrates").select("doc_id", "label")), "doc_id")
        # At most LABELLED / CALIBRATION ids come to the driver, with a number each.
        rows = voted(tested, model, ("doc_id", "label")).select("doc_id", "label", "vote").distinct().collect()
    votes = np.array([r.vote for r in rows if r.vote is not None])
    shares = np.array([r.label for r in rows if r.vote is not None])
    alone = [r.label for r in rows if r.vote is None]
    curve = isotonic(np.round(votes, 3), shares, prior)
    return Model(index, prior, *curve, (sum(alone) + prior) / (len(alone) + 1))


# --- scoring ------------------------------------------------------------------------


def voted(docs: DataFrame, model: Model, carry: tuple[str, ...], text: str = "text") -> DataFrame:
    """Vote, score and the nearest examples of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*carry, c(text).cast("string").alias("__text"))
    kind = docs.schema["doc_id"].dataType if "doc_id" in docs.columns else T.LongType()
    shown = T.StructType().add("doc_id", kind).add("cosine", "double").add("toxic", "long")
    schema = rows.drop("__text").schema.add("vote", "double").add("score", "double").add("nearest", T.ArrayType(shown))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        index = model.index
        for batch in batches:
            votes, scores, near = [], [], []
            for text in texts_of(batch, "__text").to_pylist():
                found, cosines = index.nearest(*index.vector(text), NEIGHBOURS)
                votes.append(model.vote(found, cosines))
                scores.append(model.score(votes[-1]))
                shown = list(zip(found.tolist(), cosines.tolist()))[:SHOWN]
                near.append([{"doc_id": index.ids[e], "cosine": x, "toxic": int(index.labels[e])} for e, x in shown])
            made = pa.array(near, to_arrow_type(schema["nearest"].dataType))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in carry), pa.array(votes, pa.float64()), pa.array(scores, pa.float64()), made],
                names=[*carry, "vote", "score", "nearest"],
            )

    return rows.mapInArrow(judge, schema)


def scored(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carry`` columns, score, predicted and the nearest examples of every row."""
    found = voted(docs, model, carry, text)
    return found.select(*carry, "score", (c("score") >= 0.5).cast("int").alias("predicted"), "nearest")
