"""Scores on a scale of -2 to 2, the buckets laid over it, and the figures drawn from bucket counts."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST, HIGHEST = -2, 2


@dataclass(frozen=True)
class Bucket:
    key: str
    low: int
    high: int


#: The two spectra in use (fixed values).
THREE = (Bucket("left", -2, -1), Bucket("center", 0, 0), Bucket("right", 1, 2))
FIVE = (Bucket("left", -2, -2), Bucket("lean_left", -1, -1), Bucket("center", 0, 0), Bucket("lean_right", 1, 1), Bucket("right", 2, 2))
#: Levels as (least value, name), highest first (fixed values).
BALANCE_LEVELS = ((70, "balanced"), (0, "unbalanced"))
DIVERGENCE_LEVELS = ((25, "high"), (15, "moderate"), (0, "low"))


def problems(buckets: Sequence[Bucket]) -> list[str]:
    """What is wrong with a spectrum; empty if every score has exactly one bucket and keys can name columns."""
    out = [f"key {b.key!r} can't name a column" for b in buckets if not re.fullmatch(r"[a-z][a-z0-9_]{0,30}", b.key)]
    out += [f"{b.key}: low is above high" for b in buckets if b.low > b.high]
    keys = [b.key for b in buckets]
    out += [f"key {k!r} is used twice" for k in sorted({k for k in keys if keys.count(k) > 1})]
    out += [f"{a.key} and {b.key} overlap or are out of order" for a, b in zip(buckets, buckets[1:]) if b.low <= a.high]
    out += [f"score {s} has no bucket" for s in range(LOWEST, HIGHEST + 1) if not any(b.low <= s <= b.high for b in buckets)]
    return out


def bucket(score: Column, buckets: Sequence[Bucket] = FIVE) -> Column:
    """The bucket's key; null outside of all buckets."""
    return reduce(lambda c, b: c.when(score.between(b.low, b.high), b.key), buckets, F.when(F.lit(False), F.lit(None).cast("string")))


def total(counts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, counts)


def percentages(counts: Sequence[Column]) -> list[Column]:
    """Whole percents that add up to 100, the last bucket taking what rounding leaves; all 0 without a count.

    Half percents round up, by whole numbers: (200 c + n) div 2 n.
    """
    n = total(counts)
    safe = F.when(n > 0, n)
    first = [F.coalesce(F.floor((200 * c + n) / (2 * safe)), F.lit(0)).cast("long") for c in counts[:-1]]
    last = F.when(n > 0, 100 - total(first) if first else F.lit(100)).otherwise(0)
    return [*first, last.cast("long")]


def balance(percents: Sequence[Column], counts: Sequence[Column]) -> Column:
    """100 for evenly filled buckets, less half of what each percentage is off; null without a count."""
    even = 100.0 / len(percents)
    off = total([F.abs(p - F.lit(even)) for p in percents])
    return F.when(total(counts) > 0, F.floor(100 - off / 2 + 0.5).cast("long"))


def level(value: Column, levels: Sequence[tuple[int, str]]) -> Column:
    c = reduce(lambda x, lv: x.when(value >= lv[0], lv[1]), levels, F.when(value.isNull(), F.lit("N/A")))
    return c


def primary(counts: Sequence[Column], buckets: Sequence[Bucket], declared: Column | None = None) -> Column:
    """The declared bucket, else the fullest one, the first on ties."""
    top = F.greatest(*counts)
    most = reduce(lambda c, kb: c.when(kb[0] == top, kb[1].key), zip(counts, buckets), F.when(F.lit(False), F.lit(None).cast("string")))
    return F.coalesce(declared, most) if declared is not None else most


def divergence(counts: Sequence[Column], buckets: Sequence[Bucket], main: Column) -> Column:
    """Percent of cards outside of the main bucket; null without a count."""
    n = total(counts)
    inside = reduce(lambda c, kb: c.when(main == kb[1].key, kb[0]), zip(counts, buckets), F.when(F.lit(False), F.lit(0)))
    return F.when(n > 0, F.floor((200 * (n - F.coalesce(inside, F.lit(0))) + n) / (2 * n)).cast("long"))
