"""Text to typed values, as a tolerant loader reads it. Nothing here raises.

All of it is built from native expressions, so a load never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Field texts that stand for "missing".
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# What counts as a number. Single underscores may part digits;
# white space around it and a sign in front are allowed.
WHOLE = r"^\s*[+-]?\d+(_\d+)*\s*$"
REAL = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?([eE][+-]?\d+(_\d+)*)?|\.\d+(_\d+)*([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity))\s*$"

# Texts of these characters alone can be left to the cast; they are nearly all.
WHOLE_CHARACTERS = r"^[\s0-9+-]+$"
REAL_CHARACTERS = r"^[\s0-9eE.+-]+$"


def present(text: Column) -> Column:
    return F.when(~text.isin(MISSING), text)


def as_text(text: Column) -> Column:
    """The text itself, unless it is missing or any spelling of "nan"."""
    known = present(text)
    return F.when(F.lower(known) != "nan", known)


def as_whole(text: Column) -> Column:
    """BIGINT; NULL for decimals ("12.0"), words, and numbers beyond 64 bits."""
    return _number(text, WHOLE_CHARACTERS, WHOLE, "bigint")


def as_real(text: Column) -> Column:
    """DOUBLE, infinities included; NULL for NaN and anything that is no number."""
    return _number(text, REAL_CHARACTERS, REAL, "double")


def _number(text: Column, characters: str, full: str, kind: str) -> Column:
    joined = F.replace(text, F.lit("_"), F.lit(""))
    return F.when(text.rlike(characters), text.try_cast(kind)).when(text.rlike(full), joined.try_cast(kind))


READERS = {T.LongType(): as_whole, T.DoubleType(): as_real, T.StringType(): as_text}


def typed(text: Column, kind: T.DataType) -> Column:
    return READERS[kind](text)
