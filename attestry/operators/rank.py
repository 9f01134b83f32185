"""Ranking that stays parallel inside a hot group.

* one row per key: ``max_by``/``min_by`` aggregates, combined map-side;
* k rows per key: ``row_number() <= k``, which Spark turns into a per-task group limit
  before the shuffle, so a hot key sends at most k rows per task;
* full numbering of a group: two levels, by bucket of the order key and inside the bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], largest: bool = True) -> DataFrame:
    """The whole row with the largest (or smallest) order tuple per key."""
    pick = F.max_by if largest else F.min_by
    names = df.columns
    return df.groupBy(*keys).agg(pick(F.struct(*names), F.struct(*order)).alias("_r")).select("_r.*")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank_no") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def top_two(df: DataFrame, keys: Sequence[str], score: str, ident: str) -> DataFrame:
    """Best row, its score, the runner-up's score and the margin per group."""
    top = top_per_group(df, keys, [F.desc(score), F.asc(ident)], 2, "_n")
    first = F.col("_n") == 1
    out = top.groupBy(*keys).agg(
        F.max(F.when(first, F.col(ident))).alias(ident),
        F.max(F.when(first, F.col(score))).alias("top_score"),
        F.max(F.when(~first, F.col(score))).alias("second_score"),
    )
    return out.withColumn("margin", F.col("top_score") - F.coalesce("second_score", F.lit(0).cast(df.schema[score].dataType)))


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, values: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums per group in two levels.

    ``bucket`` must never fall along ``order``. Sums of whole buckets are small; the rows of one
    (group, bucket) are summed in one task, so a group of any size spreads over its buckets."""
    keyed = df.withColumn("_b", bucket)
    totals = keyed.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_p_{n}") for n in values]
    )
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = keyed.select("*", *[F.sum(v).over(inside).alias(f"_o_{n}") for n, v in values.items()])
    joined = own.join(before, [*keys, "_b"])
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_p_{n}")).alias(n) for n in values])


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "row_no") -> DataFrame:
    return running_sums(df, keys, order, bucket, {name: F.lit(1).cast("bigint")})


def diverse_top(
    df: DataFrame, cls: str, group: str, score: str, ident: str, per_class: int, bucket: Column
) -> DataFrame:
    """At most ``per_class`` rows per class and one per validation group, with an overall rank.

    A blank group never blocks another row."""
    own_group = F.when(F.coalesce(F.trim(group), F.lit("")) == "", F.concat(F.lit("row:"), F.col(ident).cast("string"))).otherwise(F.col(group))
    single = best_per_key(
        df.withColumn("_g", own_group), [cls, "_g"], [F.col(score), -F.col(ident)]
    ).drop("_g")
    kept = top_per_group(single, [cls], [F.desc(score), F.asc(ident)], per_class, "class_rank")
    return number_rows(kept, [], [F.desc(score), F.asc(ident)], bucket, "overall_rank")


def latest_flags(df: DataFrame, key: str, ident: str, success: Column, failure: Column) -> DataFrame:
    """Latest job and latest success per key, and whether a failure is stale (a later success exists)."""
    latest = df.groupBy(key).agg(
        F.max(ident).alias("latest_id"), F.coalesce(F.max(F.when(success, F.col(ident))), F.lit(0)).alias("latest_success_id")
    )
    joined = df.join(latest, key)
    return joined.withColumn("is_latest", F.col(ident) == F.col("latest_id")).withColumn(
        "is_stale", failure & (F.col("latest_success_id") > F.col(ident))
    )


def hard_negatives(lines: DataFrame, doc: str, positive: str, position: str, hardness: str, k: int, strided: int = 8) -> DataFrame:
    """Positives, the ``k`` hardest negatives, and every n-th of the rest up to ``strided`` rows.

    The group is one document, which is read from one row and therefore bounded."""
    whole = W.partitionBy(doc)
    order = W.partitionBy(doc, positive).orderBy(F.desc(hardness), F.asc("_dist"), F.asc(position))
    near = lines.withColumn("_first", F.min(F.when(F.col(positive) == 1, F.col(position))).over(whole))
    ranked = (
        near.filter(F.col("_first").isNotNull())
        .withColumn("_dist", F.abs(F.col(position) - F.col("_first")))
        .withColumn("_n", F.row_number().over(order))
        .withColumn("_left", F.sum(F.when(F.col(positive) == 0, 1).otherwise(0)).over(whole) - k)
    )
    stride = F.greatest(F.lit(1), F.floor(F.col("_left") / strided))
    rest = F.col("_n") - k - 1
    picked = (rest % stride == 0) & (F.floor(rest / stride) < strided)
    return ranked.filter((F.col(positive) == 1) | (F.col("_n") <= k) | picked).drop("_first", "_dist", "_n", "_left")


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, fields: Sequence[str]) -> DataFrame:
    """``prev`` and ``next`` row (as structs of ``fields``) inside each group, in two levels.

    Neighbours inside a bucket come from a window; the first and last row of a bucket take the
    edge rows of the nearest bucket, of which there are few. A hot group spreads over buckets."""
    record = F.struct(*fields)
    keyed = df.withColumn("_b", bucket)
    position = F.struct(*order)
    edges = keyed.groupBy(*keys, "_b").agg(F.min_by(record, position).alias("_first"), F.max_by(record, position).alias("_last"))
    across = W.partitionBy(*keys).orderBy("_b")
    edges = edges.select(*keys, "_b", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order)
    own = keyed.select("*", F.lag(record).over(inside).alias("_p"), F.lead(record).over(inside).alias("_n"))
    joined = own.join(edges, [*keys, "_b"])
    return joined.select(*df.columns, F.coalesce("_p", "_before").alias("prev"), F.coalesce("_n", "_after").alias("next"))
