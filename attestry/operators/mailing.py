"""Names of files and folders, and the rendered request bodies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import rank


def file_name_parts(name: Column, marker: str) -> dict[str, Column]:
    """Prefix number, maker, issuer tag and marker flag of a file name."""
    stem = X.file_stem(name)
    return {
        "prefix": F.regexp_extract(stem, r"^([0-9]+(?:_[0-9]+)?)\.\s*.+$", 1),
        "maker_hint": F.regexp_extract(stem, r"\(([^()]*)\)", 1),
        "org_hint": F.regexp_extract(stem, r"\[([A-Za-z0-9]+)_[0-9]{4}-[0-9]{2}-[0-9]{2}\]", 1),
        "expiry_hint": F.regexp_extract(stem, r"\[[A-Za-z0-9]+_([0-9]{4}-[0-9]{2}-[0-9]{2})\]", 1),
        "has_marker": name.contains(marker),
    }


def target_names(
    material_no: Column, english_name: Column, maker: Column, supplier: Column, org: Column, expiry: Column,
    extension: str = ".pdf",
) -> dict[str, Column]:
    """Folder and file name of a filed certificate. The issuer BPJPH never carries a date;
    for all others a missing expiry gives a NULL name, so nothing is filed undated."""
    issuer = F.upper(F.replace(X.safe_component(org), F.lit(" "), F.lit("_")))
    tag = F.when(issuer == "BPJPH", F.lit("[BPJPH]")).otherwise(
        F.concat(F.lit("["), issuer, F.lit("_"), F.date_format(expiry, "yyyy-MM-dd"), F.lit("]"))
    )
    head = F.concat(
        X.safe_component(material_no), F.lit(". "), X.safe_component(english_name),
        F.lit("("), X.maker_abbreviation(maker), F.lit(")"),
    )
    initial = X.first_letter(supplier)
    return {
        "folder_name": X.safe_component(F.concat(head, F.lit("_ⓗ"), initial)).alias("folder_name"),
        "file_name": F.concat(X.safe_component(F.concat(head, tag, initial)), F.lit(extension)).alias("file_name"),
    }


def item_blocks(items: DataFrame, keys: Sequence[str], order: str, path: str, fields: Mapping[str, str], bucket: int = 10000) -> DataFrame:
    """One numbered text block per item, in order within its group: (keys, item_no, block).

    The form does not depend on the size of a group; a caller that sends messages joins the blocks it
    wants to send together. Items are numbered in two levels, so a large group spreads over tasks."""
    numbered = rank.number_rows(items, list(keys), [F.asc(order)], F.floor(F.col(order) / bucket), "item_no")
    parts = [F.concat(F.col("item_no").cast("string"), F.lit(". "), F.col(path))]
    parts += [F.concat(F.lit(f"- {label}: "), F.coalesce(F.col(col), F.lit("-"))) for label, col in fields.items()]
    return numbered.select(*keys, "item_no", F.concat_ws("\n", *parts).alias("block"))


def render_bodies(
    items: DataFrame, keys: Sequence[str], order: str, path: str, fields: Mapping[str, str], template: str, per_message: int, bucket: int = 10000
) -> DataFrame:
    """Item blocks put into the template, ``per_message`` in each message (``part``), with running numbers.

    The caller says how many items a message takes; no task holds more than that of one group."""
    blocks = item_blocks(items, keys, order, path, fields, bucket)
    blocks = blocks.select(*keys, F.floor((F.col("item_no") - 1) / per_message).alias("part"), F.col("item_no").alias("_no"), F.col("block").alias("_b"))
    listed = blocks.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("_no", "_b"))).alias("rows"))
    body = F.replace(
        F.replace(F.lit(template), F.lit("[SUPPLIER]"), F.col(keys[0])),
        F.lit("[ITEMS]"),
        F.array_join(F.transform("rows", lambda r: r["_b"]), "\n"),
    )
    return listed.select(*keys, "part", F.size("rows").cast("bigint").alias("item_count"), body.alias("body"))
