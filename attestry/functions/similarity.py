"""Text similarity. ``levenshtein`` runs in the JVM; ``gestalt`` is Ratcliff-Obershelp in Arrow batches.

The two differ in value. Every caller names the one it uses; thresholds tuned for one are
not moved to the other silently."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def levenshtein_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def _gestalt(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)],
        dtype="float64",
    )


def gestalt_ratio(a: Column, b: Column) -> Column:
    return _gestalt(a, b)


METRICS = {"levenshtein": levenshtein_ratio, "gestalt": gestalt_ratio}


def ladder(a: Column, b: Column, base: float = 0.92, span: float = 0.0, shortest: int = 0, metric: str = "levenshtein") -> Column:
    """Equal = 1; one contains the other = ``base`` + ``span`` * length share (if the shorter has
    ``shortest`` characters); else the ratio; empty = 0."""
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (a.contains(b) | b.contains(a)) & (small >= shortest)
    return (
        F.when(a.isNull() | b.isNull() | (small == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(inside, F.lit(base) + F.lit(span) * small / large)
        .otherwise(METRICS[metric](a, b))
    )


def ladder_from(a: Column, b: Column, least: float, **steps) -> Column:
    """The ladder where it can reach ``least``, else 0: unequal lengths rule a ratio out before any
    characters are compared."""
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((small / large >= least) | a.contains(b) | b.contains(a), ladder(a, b, **steps)).otherwise(F.lit(0.0))


def match_grade(a: Column, b: Column) -> Column:
    """100 equal, 75..95 contained, 0 otherwise: the grade of request-to-master fields."""
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (
        F.when(a.isNull() | b.isNull() | (small == 0), F.lit(0))
        .when(a == b, F.lit(100))
        .when((a.contains(b) | b.contains(a)) & (small >= 4), F.floor(75 + small / large * 20).cast("int"))
        .otherwise(F.lit(0))
    )
