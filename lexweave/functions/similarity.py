"""Similarity of short strings, as Arrow-batched functions over distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    """The better of comparing the strings and comparing their sorted words."""
    as_is = SequenceMatcher(None, a, b).ratio()
    words = (" ".join(sorted(x.split())) for x in (a, b))
    return max(as_is, SequenceMatcher(None, *words).ratio())


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_agreement(a: Column, b: Column) -> Column:
    """How well two case names agree. Names of two sides each are compared side by
    side and the weaker one decides: Spark tells whether one side's words are all
    in the other; only sides for which they aren't, and other names, are compared
    by ``similarity``."""
    sides = [F.split(c, " v ", -1) for c in (a, b)]
    both_have_two = (F.size(sides[0]) == 2) & (F.size(sides[1]) == 2)

    def side(i: int) -> Column:
        x, y = (F.get(s, i) for s in sides)
        p, q = (F.filter(F.split(s, r"\s+"), lambda w: w != "") for s in (x, y))
        held = (F.size(p) > 0) & (F.size(q) > 0) & ((F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0))
        # null arguments are passed over by the function
        return F.when(held, F.lit(1.0)).otherwise(similarity(F.when(both_have_two & ~held, x), F.when(both_have_two & ~held, y)))

    whole = similarity(F.when(~both_have_two, a), F.when(~both_have_two, b))
    return F.when(both_have_two, F.least(side(0), side(1))).otherwise(whole)


def _half_even(x: Column, scale: int) -> Column:
    """``x`` as a multiple of 1 / ``scale``, rounded as Python does: half to even on the exact binary value.

    ``twice`` is the value in half units. Where that is odd, the value lies next to
    the middle of two results; its difference from there is formed without error,
    from the two halves of its bits."""
    twice = F.rint(x * (2 * scale))
    big = x * 134217729.0
    high = big - (big - x)
    off = (high * (2 * scale) - twice) + (x - high) * (2 * scale)
    even = F.rint(twice / 4) * 2
    unit = F.when(twice % 2 == 0, twice / 2).when(off > 0, (twice + 1) / 2).when(off < 0, (twice - 1) / 2).otherwise(even)
    return unit / scale


def round4(x: Column) -> Column:
    return _half_even(x, 10_000)


def round2(x: Column) -> Column:
    return _half_even(x, 100)
