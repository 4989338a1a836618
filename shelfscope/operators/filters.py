"""Typed filter specifications and the predicate they stand for."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, functions as F

TOP_LIMIT = 10
TOP_LIMIT_RANGE = (1, 1000)

Range = tuple[float, float]


def _whole(value: Any) -> int | None:
    return None if value is None else int(value)


def _real(value: Any) -> float | None:
    return None if value is None else float(value)


def _names(value: Any) -> tuple[str, ...]:
    return tuple(str(v) for v in value or ())


def _range(value: Any, kind: type) -> Range | None:
    """Both bounds, or no clause unless exactly two were given."""
    if not isinstance(value, (list, tuple)) or len(value) != 2:
        return None
    return kind(value[0]), kind(value[1])


_READERS = {
    "brands": _names,
    "exclude_brands": _names,
    "min_discount": _whole,
    "max_discount": _whole,
    "price_between": lambda v: _range(v, float),
    "mrp_between": lambda v: _range(v, float),
    "img_count_between": lambda v: _range(v, int),
    "title_ilike": lambda v: v or None,
    "only_no_discount": bool,
    "only_discounted": bool,
    "min_rating": _real,
    "max_rating": _real,
    "min_reviews": _whole,
    "top_limit": lambda v: TOP_LIMIT if v is None else int(v),
}

ANALYST_KEYS = ("brands", "min_discount", "min_rating")


@dataclass(frozen=True)
class FilterSpec:
    """Optional clauses, joined by AND. Discount and image bounds are whole numbers."""

    brands: tuple[str, ...] = ()
    exclude_brands: tuple[str, ...] = ()
    min_discount: int | None = None
    max_discount: int | None = None
    price_between: Range | None = None
    mrp_between: Range | None = None
    img_count_between: Range | None = None
    title_ilike: str | None = None
    only_no_discount: bool = False
    only_discounted: bool = False
    min_rating: float | None = None
    max_rating: float | None = None
    min_reviews: int | None = None
    top_limit: int = TOP_LIMIT

    def __post_init__(self) -> None:
        for f in fields(self):
            object.__setattr__(self, f.name, _READERS[f.name](getattr(self, f.name)))

    @classmethod
    def from_dict(cls, values: Mapping[str, Any], only: Iterable[str] | None = None) -> FilterSpec:
        """Unknown keys are ignored and empty values mean "no clause"; zero is kept.

        ``only`` narrows the keys that count, e.g. to ``ANALYST_KEYS``.
        """
        known = set(_READERS if only is None else only)
        empty = (None, "", [], ())
        return cls(**{k: v for k, v in values.items() if k in known and v not in empty})

    @classmethod
    def from_json(cls, text: str) -> FilterSpec:
        return cls.from_dict(json.loads(text or "{}"))

    @property
    def rows(self) -> int:
        """Length of the rated list, held within its allowed range."""
        low, high = TOP_LIMIT_RANGE
        return max(low, min(self.top_limit, high))

    @property
    def title_pattern(self) -> str:
        """Text without a wildcard is searched anywhere in the title."""
        text = self.title_ilike or ""
        return text if "%" in text or "_" in text else f"%{text}%"


def predicate(spec: FilterSpec, include_rating: bool) -> Column:
    """The conjunction of the clauses; rating clauses only with ``include_rating``."""
    clauses = _shelf_clauses(spec)
    if include_rating:
        clauses += _rating_clauses(spec)
    return reduce(and_, clauses, F.lit(True))


def _shelf_clauses(spec: FilterSpec) -> list[Column]:
    c = F.col
    found: list[Column] = []
    if spec.brands:
        found.append(c("brand").isin(*spec.brands))
    if spec.exclude_brands:
        found.append(~c("brand").isin(*spec.exclude_brands))
    found += _bounds("discount_percent", spec.min_discount, spec.max_discount)
    for name in ("price", "mrp", "img_count"):
        limits = getattr(spec, f"{name}_between")
        if limits:
            found.append(c(name).between(*limits))
    if spec.title_ilike:
        found.append(c("title").ilike(spec.title_pattern))
    if spec.only_no_discount:
        found.append(c("price") == c("mrp"))
    elif spec.only_discounted:
        found.append(c("price") < c("mrp"))
    return found


def _rating_clauses(spec: FilterSpec) -> list[Column]:
    return _bounds("rating", spec.min_rating, spec.max_rating) + _bounds("rating_total", spec.min_reviews, None)


def _bounds(name: str, low: float | None, high: float | None) -> list[Column]:
    found = []
    if low is not None:
        found.append(F.col(name) >= low)
    if high is not None:
        found.append(F.col(name) <= high)
    return found
