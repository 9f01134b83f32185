"""The best k texts per query by weighted terms, without a row per pair of query and text.

A text's score for a query is the sum of the weights of the query's terms that it holds, so it depends on which of them it
holds and on nothing else. For a set S of terms, only the first k texts (in tie order) that hold all of S can be among a query's
best k through S: each of them scores at least as much as S and comes earlier. So the distinct sets of all queries are looked up
once, each through its rarest term, and keep k texts; queries then meet k texts per set. A term that stands in every text and
in every query is one set with one row per text, whatever the number of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import rank

MOST_TERMS = 10  # queries of more terms have too many sets and are scored pair by pair


def held_sets(hits: DataFrame, holder: str, term: str, sets: DataFrame) -> DataFrame:
    """(holder, key) for every set ``key`` (an array of distinct terms) that the holder has all terms of.

    ``hits``: distinct (holder, term). A set is looked up at its rarest term; the rows of its other terms are counted."""
    seen = hits.groupBy(F.col(term).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    known = sets.select("key", F.explode("key").alias("_t")).join(seen, "_t").groupBy("key")
    rarest = known.agg(F.min(F.struct("_n", "_t"))["_t"].alias("_t"), F.count(F.lit(1)).alias("_found")).filter(F.col("_found") == F.size("key"))
    met = hits.select(F.col(holder).alias("_h"), F.col(term).alias("_t")).join(rarest.select("key", "_t"), "_t")
    single = met.filter(F.size("key") == 1).select("_h", "key")
    rest = met.filter(F.size("key") > 1).select("_h", "key", F.explode(F.array_remove("key", F.col("_t"))).alias("_t"))
    counted = rest.join(hits.select(F.col(holder).alias("_h"), F.col(term).alias("_t")), ["_h", "_t"]).groupBy("_h", "key").agg(F.count(F.lit(1)).alias("_n"))
    several = counted.filter(F.col("_n") == F.size("key") - 1).select("_h", "key")
    return single.unionAll(several).select(F.col("_h").alias(holder), "key")


def top_holders(
    hits: DataFrame, holder: str, queries: DataFrame, query: str, term: str = "term", weight: str = "weight", k: int = 5, most_terms: int = MOST_TERMS
) -> DataFrame:
    """(query, holder, score, rank_no): the k holders of largest score per query, ties by the holder's own order.

    ``hits``: distinct (holder, term); ``queries``: (query, term, weight), positive whole weights, a term counted once per row.
    Queries of more than ``most_terms`` distinct terms meet every holder that shares a term with them, which gives the same result."""
    rows = queries.filter(F.col(term).isNotNull()).groupBy(query, term).agg(F.sum(weight).alias("w"))
    size = rows.groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(term).alias("t"), "w"))).alias("terms"))
    few, many = size.filter(F.size("terms") <= most_terms), size.filter(F.size("terms") > most_terms)
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("terms")) - 1)
    cut = few.select(query, "terms", F.explode(masks).alias("mask"))
    part = F.filter("terms", lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1)
    sets = cut.select(query, part.alias("part")).select(
        query, F.transform("part", lambda x: x["t"]).alias("key"), F.aggregate("part", F.lit(0).cast("bigint"), lambda a, x: a + x["w"]).alias("score")
    )
    held = held_sets(hits, holder, term, sets.select("key").distinct())
    first = rank.top_per_group(held, ["key"], [F.asc(holder)], k, "_n").select(holder, "key")
    found = sets.join(first, "key").groupBy(query, holder).agg(F.max("score").alias("score"))
    direct = many.select(query, F.explode("terms").alias("x")).select(query, F.col("x.t").alias(term), F.col("x.w").alias("w"))
    paired = direct.join(hits, term).groupBy(query, holder).agg(F.sum("w").alias("score"))
    return rank.top_per_group(found.unionByName(paired), [query], [F.desc("score"), F.asc(holder)], k, "rank_no")


def holder_counts(hits: DataFrame, holder: str, queries: DataFrame, query: str, term: str = "term", most_terms: int = MOST_TERMS) -> DataFrame:
    """(query, total): in how many holders any term of the query stands, by inclusion and exclusion over the sets of its terms."""
    rows = queries.filter(F.col(term).isNotNull()).select(query, term).distinct()
    size = rows.groupBy(query).agg(F.array_sort(F.collect_list(term)).alias("terms"))
    few, many = size.filter(F.size("terms") <= most_terms), size.filter(F.size("terms") > most_terms)
    cut = few.select(query, "terms", F.explode(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("terms")) - 1)).alias("mask"))
    sets = cut.select(query, F.filter("terms", lambda x, i: F.call_function("shiftright", F.col("mask"), i).bitwiseAND(F.lit(1)) == 1).alias("key"))
    held = held_sets(hits, holder, term, sets.select("key").distinct()).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    signed = F.when(F.size("key") % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    exact = sets.join(held, "key").groupBy(query).agg(F.sum(signed).alias("total"))
    direct = many.select(query, F.explode("terms").alias(term)).join(hits, term).groupBy(query).agg(F.countDistinct(holder).alias("total"))
    return exact.unionByName(direct)
