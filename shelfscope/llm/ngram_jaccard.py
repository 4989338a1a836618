"""Operator 8, n-gram Jaccard join: Bayesian candidate pruning.

Texts alike in their words (lower case) form a class; one of each is compared.
Candidates are texts that share a band of MinHash values. Their values are then
compared a few at a time: with m of n equal, and a uniform prior, the chance of
a similarity of at least the threshold is a binomial tail, and pairs for which
it falls below the tolerance are dropped. The rest are verified exactly on
their whole sets of word five-grams.

Few texts in a band become pairs. Where many share one, pairs would grow with
the square of their number: such texts are joined to clusters, cut into blocks,
and each two blocks of a cluster are compared inside a task, which gives back
counts and one link per text instead of the pairs. Both ways prune and verify
alike and no pair goes both ways; whole classes are never expanded into pairs.

A pair at the threshold itself goes unseen by the bands with a chance of about
5e-6 and is pruned with one below 1e-6 a step; more similar pairs far less.

Texts shorter than five words have one gram, all their words. Null, empty and
blank texts have no words: they match nothing and are a group of their own
each. Repeated rows are in one class. Rows with a null doc_id take part as text
and are returned. Further columns are dropped by ``joined`` and kept by
``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tables import small, stored
from shelfscope.llm.words import coded, slices, split, texts_of

GRAM, THRESHOLD = 5, 0.8
ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
#: Values compared in one step, and the chance below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Texts that a band value may have to become pairs; and how many of a larger crowd make a block.
FEW, BLOCK = 8, 256
#: Pairs with their whole gram sets that a task looks at together.
PAIR_ROWS = 64
#: Grams whose hashes are laid out together.
_CHUNK = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    numbers = _mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * _ODD)
    factors = (numbers[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return factors[:, None], (numbers[HASHES:] >> np.uint64(32)).astype(np.uint32)[:, None]


def gram_sets(texts: pa.Array, gram: int = GRAM) -> Iterator[tuple[bytes | None, np.ndarray]]:
    """Of each text a digest of its words (None without any) and the sorted set of its word-gram hashes (64 bits)."""
    import xxhash

    values, bounds = split(pc.utf8_lower(texts))
    codes, distinct = coded(values)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    words = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = words[begin:end]
        width = min(gram, len(own))
        if not width:
            yield None, own
            continue
        keys = np.full(len(own) - width + 1, width, dtype=np.uint64)
        for k in range(width):
            keys = keys * _ODD + own[k : k + len(keys)]
        yield xxhash.xxh128_digest(own.tobytes()), np.unique(_mixed(keys))


def signature(grams: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set."""
    factors, terms = _functions()
    least = np.full(HASHES, np.iinfo(np.uint32).max, dtype=np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), _CHUNK):
        values = low[at : at + _CHUNK] * factors
        values += terms
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(values: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * _ODD + values[k::ROWS].astype(np.uint64))
    return keys.view(np.int64)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n values fewer than m equal ones drop a pair.

    With a uniform prior, P(J >= t | m of n) = P(Binomial(n + 1, t) <= m).
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        found.append((n, m))
    return found


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = []
            for key, grams in gram_sets(texts_of(part, "text")):
                values = signature(grams) if key else None
                found.append((key, values.tobytes() if key else None, bands(values) if key else None))
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()))
            arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), *arrays], names=["doc_id", "digest", "key", "signature", "bands"])


def _pruned(threshold: float, tolerance: float):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = least_matches(threshold, tolerance)
        for batch in batches:
            alive = np.arange(batch.num_rows)
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, HASHES) for c in ("signature_a", "signature_b"))
            equal = np.zeros(batch.num_rows, dtype=np.int64)
            for n, least in steps:
                equal[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1)
                alive = alive[equal[alive] >= least]
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return prune


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = [(k, g.tobytes()) for k, g in gram_sets(texts_of(part, "text"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["key", "grams"])


def _verified(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("grams_a", "grams_b")]
            keep = []
            for row in range(batch.num_rows):
                a, b = (np.frombuffer(c[row].as_buffer(), dtype=np.uint64) for c in columns)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= threshold * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return verify


def _alive(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of a row of ``a`` and a row of ``b`` no step drops (a matrix)."""
    equal, alive = np.zeros((len(a), len(b)), dtype=np.int16), np.ones((len(a), len(b)), dtype=bool)
    for n, least in steps:
        for k in range(n - STEP, n):
            equal += a[:, k, None] == b[None, :, k]
        alive &= equal >= least
        if not alive.any():
            break
    return alive


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many grams each of ``a`` has in common with each of ``b``, by products of 0/1 matrices, a stretch of grams at a time."""
    grams = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    found = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, len(grams), _CHUNK):
        some = grams[at : at + _CHUNK]
        sides = []
        for sets in (a, b):
            held = np.zeros((len(sets), len(some)), dtype=np.float32)
            for row, own in enumerate(sets):
                own = own[np.searchsorted(own, some[0]) : np.searchsorted(own, some[-1], side="right")]
                place = np.minimum(np.searchsorted(some, own), len(some) - 1)
                held[row, place[some[place] == own]] = 1
            sides.append(held)
        found += sides[0] @ sides[1].T
    return found


def _compared(threshold: float, tolerance: float):
    """Links between two blocks of a cluster (or within one): their number by text, and one link to each linked text."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        steps, block = least_matches(threshold, tolerance), np.asarray(table["block"])
        values = np.frombuffer(b"".join(table["signature"].to_pylist()), dtype=np.uint32).reshape(-1, HASHES)
        grams = [np.frombuffer(g.as_buffer(), dtype=np.uint64) for g in table["grams"]]
        first, last = (np.flatnonzero(block == x) for x in (block.min(), block.max()))
        # Both blocks are the group's own, unless it is one block compared with itself.
        only_one = table["low"][0].as_py() == table["high"][0].as_py()
        if not only_one and len(first) == len(block):
            return _ONE_WAY.empty_table()
        alive = _alive(values[first], values[last], steps)
        if only_one:
            alive &= first[:, None] < last[None, :]
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            return _ONE_WAY.empty_table()
        common = _common([grams[i] for i in first[rows]], [grams[i] for i in last[columns]])
        sizes = np.array([len(g) for g in grams], dtype=np.float32)
        union = sizes[first[rows], None] + sizes[None, last[columns]] - common
        linked = alive[np.ix_(rows, columns)] & (common.astype(np.float64) >= threshold * union.astype(np.float64))
        i, j = np.nonzero(linked)
        i, j = first[rows[i]], last[columns[j]]
        n = np.bincount(i, minlength=len(block)) + np.bincount(j, minlength=len(block))
        root = np.arange(len(block))
        while True:  # the least member that links lead to, inside this task
            lower = root.copy()
            np.minimum.at(lower, i, root[j])
            np.minimum.at(lower, j, root[i])
            lower = lower[lower]
            if (lower == root).all():
                break
            root = lower
        keys, hit = table["key"].combine_chunks(), np.flatnonzero(n)
        return pa.table([keys.take(pa.array(hit)), keys.take(pa.array(root[hit])), pa.array(n[hit])], schema=_ONE_WAY)

    return compare


_ONE_WAY = pa.schema([("key", pa.binary()), ("root", pa.binary()), ("n", pa.int64())])


def described(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, digest (of the text), key (of the words), signature, bands."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return stored(rows.mapInArrow(_described, "doc_id long, digest long, key binary, signature binary, bands array<bigint>"), "signatures")


def _ends(*edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [e.select(F.col(c).alias("key")) for e in edges for c in e.columns]).distinct()


def links(docs: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Of ``described`` rows: n_links by key, and links (a, b) enough to connect what is linked."""
    named = rows.where("key IS NOT NULL")
    banded = named.select("key", "bands").dropDuplicates(["key"]).select("key", F.explode("bands").alias("value"))  # a value tells its band
    # A band value found once leads nowhere; counting first keeps those rows out of the join.
    shared = banded.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
    met = stored(banded.join(shared, "value"), "bands")

    crowds = stored(met.where(F.col("n") > FEW).select(F.col("key").alias("a"), F.col("least").alias("b")).where("a <> b").distinct(), "crowds")
    inside = _ends(crowds)
    clusters = stored(components(inside.select("key", F.struct("key").alias("label")), crowds).select("key", F.col("label.key").alias("cluster")), "clusters")

    few = met.where(F.col("n") <= FEW).select("value", "key")
    pairs = few.withColumnRenamed("key", "a").join(few.withColumnRenamed("key", "b"), "value").where("a < b").select("a", "b").distinct()
    own = lambda c: clusters.select(F.col("key").alias(c), F.col("cluster").alias(f"cluster_{c}"))
    apart = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where("cluster_a IS NULL OR cluster_b IS NULL OR cluster_a <> cluster_b")
    apart = stored(apart.select("a", "b"), "pairs")

    # Signatures of texts that met none need not move where the others are few.
    ends = small(stored(_ends(apart, inside), "ends"))
    values = stored(named.select("key", "digest", "signature").join(ends, "key", "left_semi").dropDuplicates(["key"]), "values")
    side = lambda t, name, c: t.select(F.col("key").alias(name), F.col(c).alias(f"{c}_{name}"))
    held = apart.join(side(values, "a", "signature"), "a").join(side(values, "b", "signature"), "b")
    likely = stored(held.mapInArrow(_pruned(threshold, tolerance), "a binary, b binary"), "likely")

    wanted = stored(values.join(_ends(likely, inside), "key", "left_semi").select("digest").distinct(), "wanted")
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small(wanted), "digest", "left_semi").select("text")
    grams = stored(texts.mapInArrow(_gram_rows, "key binary, grams binary").where("key IS NOT NULL").dropDuplicates(["key"]), "grams")
    whole = likely.join(side(grams, "a", "grams"), "a").join(side(grams, "b", "grams"), "b")
    linked = stored(whole.mapInArrow(_verified(threshold), "a binary, b binary"), "links", rows=PAIR_ROWS)

    members = stored(clusters.withColumn("at", F.xxhash64("key")), "members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    block = members.join(sizes, "cluster").select("cluster", "key", F.pmod("at", "blocks").alias("block"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = block.select("cluster", "key", "block", other).select(
        "cluster", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    full = dealt.join(values.select("key", "signature"), "key").join(grams, "key")
    kind = "key binary, root binary, n long"
    crowd = stored(full.groupBy("cluster", "low", "high").applyInArrow(_compared(threshold, tolerance), kind), "crowd-links")

    each = [linked.select(F.col(c).alias("key"), F.lit(1).cast("long").alias("n")) for c in ("a", "b")]
    degrees = reduce(DataFrame.union, [*each, crowd.select("key", "n")]).groupBy("key").agg(F.sum("n").alias("n_links"))
    edges = linked.union(crowd.select("key", "root").where("key <> root")).distinct()
    return degrees, stored(edges, "links")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """key, label: the least label that links lead to, however far.

    ``nodes`` has key and label (a struct that holds the key as ``key``),
    ``edges`` a and b. Labels spread along links and jump through the labels
    found so far, so that chains take few rounds.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels, changed = stored(nodes, "labels"), 1
    while changed:
        near = both.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("key") == F.col("a"), "left").select("key", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jumps = spread.select(F.col("key").alias("root"), F.col("next").alias("further"))
        jumped = spread.join(jumps, F.col("next.key") == F.col("root"), "left")
        spread = stored(jumped.select("key", "label", F.least("next", F.coalesce("further", "next")).alias("next")), "labels")
        changed = spread.where("next < label").limit(1).count()
        labels = spread.select("key", F.col("next").alias("label"))
    return labels


def grouped(docs: DataFrame, rows: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """A row per class: key, first (none, doc_id, digest of its first member), n_copies, n_links, group (``first`` of the group's)."""
    degrees, edges = links(docs, rows, threshold, tolerance)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    classes = stored(rows.where("key IS NOT NULL").groupBy("key").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_copies")), "classes")
    label = F.struct("first.none", "first.doc_id", "first.digest", "key").alias("label")
    parts = components(classes.join(_ends(edges), "key", "left_semi").select("key", label), edges)
    top = F.struct("label.none", "label.doc_id", "label.digest").alias("group")
    return stored(
        classes.join(degrees, "key", "left")
        .join(parts.select("key", top), "key", "left")
        .select("key", "first", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group", "first").alias("group")),
        "known",
    )


def joined(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """A row per document: doc_id, class_id, copy_id, n_copies, n_links.

    ``copy_id`` is the first document with the same words, ``class_id`` the
    first one that links lead to, ``n_links`` the number of other texts that are
    similar, ``n_copies`` the documents with the same words, itself included.
    """
    rows = described(docs)
    known = grouped(docs, rows, threshold, tolerance)
    return (
        rows.select("doc_id", "key")
        .join(known, "key", "left")
        .select(
            "doc_id",
            F.coalesce("group.doc_id", "doc_id").alias("class_id"),
            F.coalesce("first.doc_id", "doc_id").alias("copy_id"),
            F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The documents with one of each group, the first by doc_id, all columns kept.

    Documents without words stay. Of rows alike in doc_id and text one stays.
    """
    rows = described(docs)
    known = grouped(docs, rows, threshold, tolerance)
    ids = rows.groupBy("doc_id", "digest", "key").agg(F.count(F.lit(1)).alias("n"))
    top = ids.join(known.select("key", "group"), "key", "left").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "n", "group")
    stays = F.col("group").isNull() | (F.col("group.doc_id").eqNullSafe(F.col("__id")) & (F.col("group.digest") == F.col("__digest")))
    judged = stored(top.select("__id", "__digest", "n", stays.alias("stays")), "judged")
    gone = small(judged.where("NOT stays").select("__id", "__digest"))
    again = judged.where("stays AND n > 1").select("__id", "__digest")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__digest"))
    kept = docs.join(gone, same, "left_anti")
    if not again.limit(1).count():
        return kept
    again = small(again)
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
