"""Many filter specs at once: an index of their clauses that every row is looked up in.

Each clause column has entries for the values that tell specs apart: brands that
some spec names, or elementary intervals between neighbouring bounds. An entry
holds one bit per spec, set where the spec lets the value pass, 64 specs to a
BIGINT. A product finds one entry per column, and the bitwise AND of all of them
is the set of specs it matches. The work on a row grows with the clause columns
and one word per 64 specs, not with the specs. Entries are rows of small tables, whose
size is bounded by the number of specs, and are broadcast.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfscope.operators.filters import FilterSpec, predicate
from shelfscope.sources.local_rows import local_rows

c = F.col
Specs = Mapping[str, FilterSpec]
WORD = 64
#: Specs of one index, which bounds its tables; more of them take further passes over the rows.
MOST_SPECS = 1024
#: Specs up to which each is asked on its own.
FEW_SPECS = 16
#: Brands up to which a list of them is worth pushing to the scan.
PUSHED_BRANDS = 100

#: Steps of the grid that leads to a bound: the fewest that leave few bounds to a step.
GRIDS = tuple(1 << i for i in range(4, 13))

_KEY = "__key"


def in_runs(specs: Specs) -> list[dict[str, FilterSpec]]:
    """The specs in runs that fit one index each."""
    items = list(specs.items())
    return [dict(items[i : i + MOST_SPECS]) for i in range(0, len(items), MOST_SPECS)]


@dataclass(frozen=True)
class _Interval:
    """A numeric column with a lower and an upper bound per spec, both inclusive."""

    column: str
    kind: T.DataType
    low: Callable[[FilterSpec], float | None]
    high: Callable[[FilterSpec], float | None]


def _between(name: str, end: int) -> Callable[[FilterSpec], float | None]:
    def bound(spec: FilterSpec) -> float | None:
        limits = getattr(spec, f"{name}_between")
        return limits[end] if limits else None

    return bound


def _given(name: str) -> Callable[[FilterSpec], float | None]:
    return lambda spec: getattr(spec, name)


def _open(_: FilterSpec) -> None:
    return None


SHELF = [
    _Interval("discount_percent", T.DoubleType(), _given("min_discount"), _given("max_discount")),
    _Interval("price", T.DoubleType(), _between("price", 0), _between("price", 1)),
    _Interval("mrp", T.DoubleType(), _between("mrp", 0), _between("mrp", 1)),
    _Interval("img_count", T.LongType(), _between("img_count", 0), _between("img_count", 1)),
]
RATING = [
    _Interval("rating", T.DoubleType(), _given("min_rating"), _given("max_rating")),
    _Interval("rating_total", T.LongType(), _given("min_reviews"), _open),
]


def _words(bits: np.ndarray) -> list[list[int]]:
    """Rows of one flag per spec as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // WORD) * WORD), bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<i8").tolist()


def _listed(values: list, kind: str) -> Column:
    """A constant array, handed over as one text."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class SpecIndex:
    """The set of matching specs of each row, as word columns ``names``; specs are numbered in their order."""

    def __init__(self, spark: SparkSession, specs: Specs, include_rating: bool) -> None:
        self.spark, self.specs, self._include_rating = spark, list(specs.values()), include_rating
        self.packs = list(specs)
        self._intervals = [x for x in SHELF + (RATING if include_rating else []) if self._bounds(x)]
        self.width = -(-len(self.specs) // WORD)
        self.names = [f"__specs{i}" for i in range(self.width)]

    # --- tables ---

    def _bounds(self, x: _Interval) -> list[float]:
        return sorted({b for s in self.specs for b in (x.low(s), x.high(s)) if b is not None})

    def _interval_bits(self, x: _Interval, bounds: list[float]) -> np.ndarray:
        """A row per cell: below all bounds 0, on bound i 2i+1, between bounds i-1 and i 2i; the last is NULL's."""
        place = {b: 2 * i + 1 for i, b in enumerate(bounds)}
        cells = 2 * len(bounds) + 1
        bits = np.zeros((cells + 1, len(self.specs)), bool)
        for n, spec in enumerate(self.specs):
            low, high = x.low(spec), x.high(spec)
            first = 0 if low is None else place[low]
            last = cells - 1 if high is None else place[high]
            bits[first : last + 1, n] = True
            bits[cells, n] = low is None and high is None
        return bits

    def _brand_table(self) -> tuple[DataFrame, list[int]]:
        """A row per named brand and one for NULL, and the words of all other brands."""
        named = sorted({b for s in self.specs for b in (*s.brands, *s.exclude_brands)})
        rows = [[(not s.brands or b in s.brands) and b not in s.exclude_brands for s in self.specs] for b in named]
        rows += [[not s.brands and not s.exclude_brands for s in self.specs], [not s.brands for s in self.specs]]
        *words, others = _words(np.array(rows, bool))
        schema = ", ".join([f"{_KEY} string", *(f"__b{i} bigint" for i in range(self.width))])
        return local_rows(self.spark, [(k, *w) for k, w in zip([*named, None], words)], schema), others

    def _relation_bits(self) -> np.ndarray:
        """A row each for a price that is the list price, is below it, or neither."""
        same = [s.only_no_discount or not s.only_discounted for s in self.specs]
        below = [not s.only_no_discount for s in self.specs]
        neither = [a and b for a, b in zip(same, below)]
        return np.array([same, below, neither, neither], bool)

    # --- rows ---

    def _with_cell(self, rows: DataFrame, x: _Interval, bounds: list[float], at: str) -> DataFrame:
        """The cell of a value: a grid of equal steps leads to the few bounds it has to be compared with.

        NaN lies above all bounds, as it does in comparisons; NULL has no cell.
        """
        finite = [float(b) for b in bounds if math.isfinite(b)] or [0.0]
        low, width = finite[0], finite[-1] - finite[0]
        for steps in GRIDS:
            scale = steps / width if 0 < width < math.inf else 1.0
            step_of = [int(min(max((float(b) - low) * scale, 0.0), steps - 1.0)) for b in bounds]
            crowd = max(Counter(step_of).values())
            if crowd == 1:
                break
        before = np.searchsorted(step_of, np.arange(steps)).tolist()
        value, step = c(x.column), c(f"{at}step")
        grid = F.least(F.greatest((value.cast("double") - F.lit(low)) * scale, F.lit(0.0)), F.lit(steps - 1.0))
        cell = 2 * F.get(_listed(before, "int"), step)
        for k in range(crowd):
            near = [bounds[n + k] if n + k < len(bounds) and step_of[n + k] == g else None for g, n in enumerate(before)]
            bound = F.get(_listed(near, x.kind.simpleString()), step)
            cell += F.when(bound < value, 2).when(bound == value, 1).otherwise(0)
        return rows.withColumn(f"{at}step", F.when(value.isNotNull(), grid.cast("int"))).withColumn(at, cell).drop(f"{at}step")

    def tagged(self, rows: DataFrame) -> DataFrame:
        """The rows with the word columns; rows without a spec have none but zeros, as far as they are not left out."""
        kept, parts = rows.columns, []
        if len(self.specs) <= FEW_SPECS:
            return self._asked_directly(rows)
        rows = rows.filter(self._hull())
        for n, x in enumerate(self._intervals):
            bounds = self._bounds(x)
            rows = self._with_cell(rows, x, bounds, f"__{n}_at")
            rows, words = self._looked_up(rows, self._interval_bits(x, bounds), f"__{n}_")
            parts.append(words)
        if any(s.only_no_discount or s.only_discounted for s in self.specs):
            relation = F.when(c("price") == c("mrp"), 0).when(c("price") < c("mrp"), 1).otherwise(2)
            rows, words = self._looked_up(rows.withColumn("__r_at", relation), self._relation_bits(), "__r_")
            parts.append(words)
        if any(s.brands or s.exclude_brands for s in self.specs):
            table, others = self._brand_table()
            # Bounded by the specs.
            rows = rows.join(F.broadcast(table), rows["brand"].eqNullSafe(table[_KEY]), "left").drop(_KEY)
            parts.append([F.coalesce(c(f"__b{i}"), F.lit(w)) for i, w in enumerate(others)])
        if any(s.title_ilike for s in self.specs):
            parts.append(self._title_words())
        everything = [[F.lit(w) for w in _words(np.ones((1, len(self.specs)), bool))[0]]]
        words = [reduce(Column.bitwiseAND, column) for column in zip(*(parts or everything))]
        return rows.select(*kept, *(w.cast("bigint").alias(n) for w, n in zip(words, self.names)))

    def _asked_directly(self, rows: DataFrame) -> DataFrame:
        """The same from one predicate per spec, which scans understand and which is cheaper while it is short."""
        rules = [predicate(s, self._include_rating) for s in self.specs]
        bits = reduce(Column.bitwiseOR, (F.when(r, 1 << i).otherwise(0) for i, r in enumerate(rules)))
        return rows.filter(reduce(Column.__or__, rules)).select("*", bits.cast("bigint").alias(self.names[0]))

    def _looked_up(self, rows: DataFrame, bits: np.ndarray, prefix: str) -> tuple[DataFrame, list[Column]]:
        """The words of the entry that ``<prefix>at`` points to; the last one is that of NULL."""
        at, names = f"{prefix}at", [f"{prefix}{i}" for i in range(self.width)]
        *words, unknown = _words(bits)
        table = local_rows(self.spark, [(i, *w) for i, w in enumerate(words)], ", ".join([f"{at} int", *(f"{n} bigint" for n in names)]))
        # Bounded by the specs.
        rows = rows.join(F.broadcast(table), at, "left").drop(at)
        return rows, [F.coalesce(c(n), F.lit(w)) for n, w in zip(names, unknown)]

    def any(self, names: Sequence[str]) -> Column:
        return reduce(Column.__or__, (c(n) != 0 for n in names))

    def _hull(self) -> Column:
        """What every spec asks for at least, in a form that scans understand."""
        found = [F.lit(True)]
        for x in self._intervals:
            for name, bound, pick in ((Column.__ge__, x.low, min), (Column.__le__, x.high, max)):
                given = [bound(s) for s in self.specs]
                if None not in given:
                    found.append(name(c(x.column), F.lit(pick(given))))
        if all(s.brands for s in self.specs):
            brands = sorted({b for s in self.specs for b in s.brands})
            if len(brands) <= PUSHED_BRANDS:
                found.append(c("brand").isin(*brands))
        return reduce(and_, found)

    # --- titles ---

    def _patterns(self) -> list[str]:
        return sorted({s.title_pattern for s in self.specs if s.title_ilike})

    def _title_words(self) -> list[Column]:
        """The words of all patterns that the title meets, and of specs without one. Each distinct pattern is compiled."""
        patterns = self._patterns()
        own = np.array([[bool(s.title_ilike) and s.title_pattern == p for s in self.specs] for p in patterns], bool)
        free = _words(np.array([[not s.title_ilike for s in self.specs]], bool))[0]
        met = [F.coalesce(c("title").ilike(p), F.lit(False)) for p in patterns]
        return [
            reduce(Column.bitwiseOR, (F.when(m, w).otherwise(0) for m, w in zip(met, column)), F.lit(start))
            for start, column in zip(free, zip(*_words(own)))
        ]

    # --- and back to packs ---

    def spread(self, rows: DataFrame) -> DataFrame:
        """Each row once per spec in its words, with ``pack_no``. Meant for rows that were counted or cut before."""

        def of_word(word: Column, first: int) -> Column:
            held = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(word, i) == 1)
            return F.transform(held, lambda i: i + first)

        numbers = F.concat(*(of_word(c(n), WORD * i) for i, n in enumerate(self.names)))
        return rows.withColumn("pack_no", F.explode(numbers)).drop(*self.names)

    def named(self, rows: DataFrame) -> DataFrame:
        """``pack_id`` in place of ``pack_no``."""
        table = local_rows(self.spark, list(enumerate(self.packs)), "pack_no int, pack_id string")
        return rows.join(F.broadcast(table), "pack_no").drop("pack_no")
