"""Set operations over records and arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    """Union of record sources with different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_candidates(candidates: Column, size: int | None = None) -> Column:
    """Date candidates of one record: best score per date, by score then date; the first ``size`` if it is given.

    ``candidates`` is ``array<struct<date:string, score:int>>`` in order of appearance."""
    best = F.transform(
        F.array_distinct(F.transform(candidates, lambda c: c["date"])),
        lambda d: F.struct(
            (-F.array_max(F.transform(F.filter(candidates, lambda c: c["date"] == d), lambda c: c["score"]))).alias("rank"),
            d.alias("date"),
        ),
    )
    return F.array_sort(best) if size is None else F.slice(F.array_sort(best), 1, size)


def has_all(values: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), values)) == 0


def common(values: Column, wanted: Sequence[str]) -> Column:
    return F.array_intersect(values, F.array(*[F.lit(w) for w in wanted]))


def diff_runs(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Record-level difference of two runs: ADDED, REMOVED or CHANGED with the changed fields."""
    a = old.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_in_a"))
    b = new.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_in_b"))
    both = a.join(b, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]))
    kind = (
        F.when(F.col("_in_a").isNull(), F.lit("ADDED")).when(F.col("_in_b").isNull(), F.lit("REMOVED")).otherwise(F.lit("CHANGED"))
    )
    out = both.select(key, kind.alias("kind"), changed.alias("changed"))
    return out.filter((F.col("kind") != "CHANGED") | (F.size("changed") > 0))
