"""Summaries. All are hash aggregates with map-side combination; lists are only built from
values that were made distinct first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.functions import text as X
from attestry.operators import rank, rules

# Request kinds and their limits in days before expiry.
NOTICE_DAYS = 30
UPCOMING_FROM, UPCOMING_TO = 60, 90


def request_kind(org: Column, expiry: Column, as_of: str, maintained: str = "BPJPH") -> Column:
    """Which request an expiry calls for. The maintained issuer is only asked to confirm."""
    left = F.datediff(expiry, F.lit(as_of).cast("date"))
    kept = F.upper(X.squash(org)) == maintained
    return rules.decide([
        (expiry.isNull(), None),
        (kept & (left < 0), "KEEP_CHECK"),
        (kept, None),
        (left <= NOTICE_DAYS, "NOTICE"),
        (left.between(UPCOMING_FROM, UPCOMING_TO), "UPCOMING"),
    ])


def supplier_summary(long: DataFrame) -> DataFrame:
    """Per supplier: any certificate, number of certificates, distinct issuers."""
    keyed = long.filter(F.col("supplier").isNotNull()).withColumn("supplier_key", X.entity_key(F.col("supplier")))
    certified = F.col("org").isNotNull() | F.col("cert_no").isNotNull() | F.col("expiry").isNotNull()
    return keyed.filter("supplier_key <> ''").groupBy("supplier_key").agg(
        F.bool_or(certified).alias("has_certificate"),
        F.count_if(certified).alias("cert_count"),
        F.array_join(F.sort_array(F.collect_set("org")), ", ").alias("orgs"),
    )


def request_items(certificates: DataFrame, as_of: str) -> DataFrame:
    """Certificates that need a request now, with the expiry a maintained one would get."""
    kind = request_kind(F.col("org"), F.col("expiry"), as_of)
    items = certificates.withColumn("mail_type", kind).filter(F.col("mail_type").isNotNull())
    return items.withColumn("planned_expiry", F.when(F.col("mail_type") == "KEEP_CHECK", D.next_year(F.col("expiry"))))


def request_targets(items: DataFrame) -> DataFrame:
    """One row per (supplier, kind): item count, first receiver, expiry span, attachment rule."""
    grouped = items.groupBy("supplier", "mail_type").agg(
        F.count("*").alias("item_count"),
        F.min_by("receiver", "item_id").alias("receiver"),
        F.min("expiry").alias("first_expiry"),
        F.max("expiry").alias("last_expiry"),
    )
    return grouped.withColumn("attach_pdf", F.when(F.col("mail_type") == "KEEP_CHECK", F.lit("N")).otherwise(F.lit("Y")))


def value_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts per value of several dimensions in one scan; blanks count as EMPTY."""
    pairs = [
        F.struct(
            F.lit(c).alias("dimension"),
            F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("EMPTY")).alias("value"),
        )
        for c in dims
    ]
    return df.select(F.inline(F.array(*pairs))).groupBy("dimension", "value").agg(F.count("*").alias("n"))


# Text signs of a failed reading, tested in this order.
FAILURE_SIGNS = (
    ("ENGINE_ERROR", r"tesseract is not installed|not in your path|tesseractnotfounderror|\[tesseract_error\]"),
    ("PDF_RENDER_ERROR", r"pdfinfo|unable to get page count|\[pdf_render_error\]"),
    ("IMAGE_READ_ERROR", r"cannot identify image file|\[image_read_error\]"),
    ("SCANNED_NEED_OCR", r"scanned_need_ocr|text layer is empty"),
    ("NO_TEXT", r"\[no_text\]|no text"),
)


def failure_kind(status: Column, *texts: Column) -> Column:
    blob = F.lower(F.concat_ws("\n", status, *texts))
    return rules.decide([(blob.rlike(sign), kind) for kind, sign in FAILURE_SIGNS], F.upper(status))


def status_coverage(df: DataFrame, keys: Sequence[str], status: str, states: Sequence[str], ready: str) -> DataFrame:
    counts = [F.count_if(F.col(status) == s).alias(s.lower()) for s in states]
    out = df.groupBy(*keys).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("ready_rate", F.round(F.col(ready.lower()) / F.col("total"), 4))


def group_summary(df: DataFrame, keys: Sequence[str], distinct: str, shares: dict[str, Column], means: Sequence[str]) -> DataFrame:
    """Counts, distinct sources, conditional counts with rates and means by any key columns."""
    aggs = [F.count("*").alias("rows_n"), F.countDistinct(distinct).alias("sources_n")]
    aggs += [F.count_if(c).alias(f"{n}_n") for n, c in shares.items()]
    aggs += [F.round(F.avg(m), 4).alias(f"mean_{m}") for m in means]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select("*", *[F.round(F.col(f"{n}_n") / F.col("rows_n"), 4).alias(f"{n}_rate") for n in shares])


def duplicate_keys(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The frame itself, or an error naming a duplicate key when it is evaluated."""
    row = duplicate_keys(df, keys).head(1)
    if row:
        raise ValueError(f"duplicate key: {row[0].asDict()}")
    return df


def ordered_values(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Distinct values per key in the order first seen, ignoring case."""
    first = df.groupBy(*keys, F.upper(value).alias("_u")).agg(F.min_by(F.struct(order, value), order).alias("_f"))
    listed = F.transform(F.array_sort(F.collect_list("_f")), lambda s: s[value])
    return first.groupBy(*keys).agg(listed.alias("values"))


def rank_pivot(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, k: int = 2) -> DataFrame:
    top = rank.top_per_group(df, keys, order, k, "_n")
    return top.groupBy(*keys).agg(*[F.max(F.when(F.col("_n") == i, F.col(value))).alias(f"top{i}") for i in range(1, k + 1)])


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Several one-row frames as one row, by union and aggregate instead of a cross join."""
    union = rows[0]
    for row in rows[1:]:
        union = union.unionByName(row, allowMissingColumns=True)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    parts = [df.agg(F.count("*").alias("rows_n")).select(F.lit(name).alias("store"), "rows_n") for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
