"""Scores, labels and counts brought into their ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Old labels of scores (fixed values).
LEGACY = {"left": -1, "center": 0, "right": 1}


def strict(value: Column) -> Column:
    """A whole number from -2 to 2 written in any form, else null."""
    d = F.trim(value.cast("string")).try_cast("double")
    return F.when((d == F.floor(d)) & d.between(-2, 2), d.cast("int"))


def clamped(value: Column) -> Column:
    """A whole number moved into -2..2, else null."""
    d = value.cast("string").try_cast("double")
    return F.when(d == F.floor(d), F.greatest(F.lit(-2.0), F.least(F.lit(2.0), d)).cast("int"))


def confidence(value: Column) -> Column:
    d = value.cast("string").try_cast("double")
    return F.when(d.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d)))


def capped_confidence(value: Column, partial: Column, most: float) -> Column:
    """The confidence, at most `most` where only part of a text was read."""
    return F.when((F.coalesce(partial, F.lit(0)) == 1) & (value > most), F.lit(most)).otherwise(value)


def to_legacy(score: Column) -> Column:
    return F.when(score < 0, "left").when(score == 0, "center").when(score > 0, "right")


def from_legacy(label: Column, known: Column) -> Column:
    """The known score, else the one of the label."""
    c = F.when(F.lit(False), F.lit(None).cast("int"))
    for k, v in LEGACY.items():
        c = c.when(F.lower(label) == k, v)
    return F.coalesce(known, c)


def evidence(items: Column, most: int = 3, longest: int = 500) -> Column:
    """The first non-empty entries, trimmed and cut."""
    t = F.transform(items, lambda x: F.substring(F.trim(x), 1, longest))
    return F.slice(F.filter(t, lambda x: x.isNotNull() & (x != "")), 1, most)


def allowed(value: Column, names: Sequence[str], fallback: str) -> Column:
    return F.when(value.isin(*names), value).otherwise(fallback)
