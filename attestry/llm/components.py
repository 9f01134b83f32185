"""Connected components of a link table, by large-star and small-star rounds (Kiveris et al., 2014).

Every round is two aggregations and joins over the links; nothing is collected but two sums per round. Each round's
table is written to the shared folder, which cuts the lineage and survives lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link touches; the component is its smallest node."""
    state = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct())
    sums = None
    while True:
        state = cut_lineage(_small_star(_large_star(state)).filter("a <> b").distinct())
        new = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if tuple(new) == sums:
            break
        sums = tuple(new)
    roots = state.select("b").distinct()
    return state.unionAll(roots.select("b", F.col("b").alias("b2"))).select(F.col("a").alias("node"), F.col("b").alias("component"))
