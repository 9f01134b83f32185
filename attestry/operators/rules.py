"""Rule tables compiled to expressions.

A rule table is configuration handed over by the caller as Python rows. It is unrolled
into one projection, so its size is bounded by ``MAX_UNROLLED``; larger vocabularies go
through a join (:func:`canonicalise`, :mod:`attestry.operators.linkage`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X

MAX_UNROLLED = 500


def _bounded(rows: Sequence) -> Sequence:
    if len(rows) > MAX_UNROLLED:
        raise ValueError(f"{len(rows)} rules: pass them as a DataFrame and join")
    return rows


def decide(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Ordered (predicate, outcome) rows; the first predicate that holds decides."""
    out = None
    for predicate, outcome in _bounded(cases):
        value = outcome if isinstance(outcome, Column) else F.lit(outcome)
        out = F.when(predicate, value) if out is None else out.when(predicate, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def reasons(cases: Sequence[tuple[Column, str]]) -> Column:
    """Names of all predicates that hold, in rule order."""
    return F.array_compact(F.array(*[F.when(p, F.lit(name)) for p, name in _bounded(cases)]))


def points(cases: Sequence[tuple[Column, int]]) -> Column:
    """Sum of the weights whose predicate holds."""
    return reduce(
        lambda a, b: a + b,
        [F.when(p, F.lit(w)).otherwise(F.lit(0)) for p, w in _bounded(cases)],
    )


def first_contained(c: Column, rows: Sequence[tuple[str, str]], default: str | None) -> Column:
    return decide([(c.contains(part), outcome) for part, outcome in rows], default)


def any_contained(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in _bounded(parts)])


def canonicalise(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """Alias table (alias, canonical, priority): exact spelling first, then equal key.

    Both sides of each join are reduced to one row per alias, so no join multiplies rows."""
    exact = aliases.groupBy(F.upper(F.trim("alias")).alias("_exact")).agg(F.min_by("canonical", "priority").alias("_by_exact"))
    keyed = aliases.groupBy(X.norm_key(F.col("alias")).alias("_key")).agg(F.min_by("canonical", "priority").alias("_by_key"))
    out = df.withColumn("_exact", F.upper(F.trim(col))).withColumn("_key", X.norm_key(F.col(col)))
    out = out.join(exact, "_exact", "left").join(keyed, "_key", "left")
    return out.withColumn("canonical", F.coalesce("_by_exact", "_by_key")).drop("_exact", "_key", "_by_exact", "_by_key")


def json_value(payload: Column, *keys: str) -> Column:
    """First non-empty of several keys; broken JSON gives NULL."""
    return F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{k}"), F.lit("")) for k in keys])


def fingerprint(fields: Mapping[str, Column]) -> Column:
    """Hash of the record as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def sigmoid(gap: Column) -> Column:
    return 1 / (1 + F.exp(-gap))


def country_match(made_in: Column, certified_in: Column) -> Column:
    return decide([(made_in.isNull() | certified_in.isNull(), "CHECK"), (made_in == certified_in, "MATCH")], "MISMATCH")


def _opening(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


def weighted_text(pages: Column, first: int | None = None, rest: int | None = None, more: int | None = None) -> Column:
    """First page three times, then the next pages: the text a classifier is trained on.

    ``first`` and ``rest`` cut pages to so many characters, ``more`` takes so many next pages; None is whole."""
    pages = F.filter(F.transform(pages, X.squash), lambda p: p != "")
    head = _opening(F.get(pages, 0), first)
    tail = F.slice(pages, F.lit(2), F.size(pages) if more is None else F.lit(more))
    tail = F.transform(tail, lambda p: _opening(p, rest))
    return X.squash(F.array_join(F.concat(F.array(head, head, head), tail), " "))


def marker_windows(c: Column, markers: Sequence[str], before: int, after: int, max_chars: int | None = None, whole: int | None = None) -> Column:
    """Text around label markers, marker by marker; a window that overlaps a kept one is left out.

    Texts of at most ``whole`` characters (``max_chars`` if not given) stay whole, as do texts without markers. The result is
    cut to ``max_chars`` where that is given."""
    whole = (max_chars or 0) if whole is None else whole

    def compact(text: Column) -> Column:
        size = F.length(text)
        hits = F.flatten(F.array(*[X.occurrences(text, "(?i)\\Q" + m + "\\E") for m in _bounded(markers)]))
        spans = F.transform(
            hits,
            lambda h: F.struct(
                F.greatest(h["start"] - before, F.lit(1)).alias("l"), F.least(h["start"] + after, size + 1).alias("r")
            ),
        )
        none = F.array().cast("array<struct<l:int,r:int>>")
        kept = F.aggregate(
            spans,
            none,
            lambda acc, s: F.when(
                F.exists(acc, lambda k: (s["r"] >= k["l"]) & (s["l"] <= k["r"])), acc
            ).otherwise(F.concat(acc, F.array(s))),
        )
        joined = F.array_join(F.transform(kept, lambda s: F.trim(F.substring(text, s["l"], s["r"] - s["l"]))), "\n...\n")
        return F.when(size <= whole, text).otherwise(
            X.let(joined, lambda j: F.trim(_opening(F.when(j == "", text).otherwise(j), max_chars)))
        )

    return X.let(F.trim(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+", " ")), compact)
