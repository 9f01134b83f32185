"""Writers: append-only logs, exports, review sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export(records: DataFrame, folder: str, summary: Sequence[str]) -> None:
    """Records as JSON lines and a flat CSV with header, written by the tasks."""
    records.write.mode("overwrite").json(f"{folder}/records")
    records.select(*summary).write.mode("overwrite").csv(f"{folder}/summary", header=True)


def review_sheet(df: DataFrame, reviewer_columns: Sequence[str], path: str) -> None:
    blank = df.select("*", *[F.lit("").alias(c) for c in reviewer_columns])
    blank.write.mode("overwrite").csv(path, header=True, emptyValue="")
