"""State changes as pure functions: (current version, changes) -> next version.

Nothing is updated in place; the caller writes the result as a new version."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import rank


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Latest row per key of current and changes; a max_by aggregate, so a hot key combines map-side."""
    return rank.best_per_key(current.unionByName(changes), keys, [F.col(version)])


def drop_rolled_back(events: DataFrame, ident: str = "id", action: str = "action", target: str = "target_id") -> DataFrame:
    """Events without the rolled back ones and without the rollback events themselves."""
    undone = events.filter(F.col(action) == "ROLLBACK").select(F.col(target).alias(ident))
    return events.filter(F.col(action) != "ROLLBACK").join(undone, ident, "left_anti")


def with_legacy(events: DataFrame, master: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A material whose first event meets a certificate already in the master gets that one as a
    first primary, with id 0, so that it is superseded instead of lost."""
    first = events.filter(F.col("action").isin("UPDATE_CURRENT", "REPLACE_CURRENT")).groupBy(*keys).agg(F.min("at").alias("at"))
    legacy = master.filter(F.col("org").isNotNull()).join(first, list(keys)).select(
        F.lit(0).cast("bigint").alias("id"), *keys, *fields, F.lit("LEGACY_IMPORT").alias("action"), "at"
    )
    return events.select("id", *keys, *fields, "action", "at").unionByName(legacy)


def certificate_history(events: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """History with validity intervals (SCD2) from an action log.

    A primary is superseded by the next primary of its material and links back to it. Secondaries
    are never superseded, so a repeated (org, number, expiry) keeps its first event. Both rules
    need no state beyond the neighbours of an event."""
    primary = F.col("action").isin("UPDATE_CURRENT", "REPLACE_CURRENT", "LEGACY_IMPORT")
    chain = rank.with_neighbours(events.filter(primary), keys, ["at", "id"], bucket, ["id", "at"])
    primaries = chain.withColumn("role", F.lit("PRIMARY")).withColumn(
        "status", F.when(F.col("next").isNull(), F.lit("ACTIVE")).otherwise(F.lit("SUPERSEDED"))
    )
    primaries = primaries.withColumn("supersedes_id", F.col("prev.id")).withColumn("valid_to", F.col("next.at")).drop("prev", "next")
    seconds = rank.best_per_key(
        events.filter("action = 'ADD_SECONDARY'"), [*keys, "org", "cert_no", "expiry"], [F.col("at"), F.col("id")], largest=False
    )
    seconds = seconds.select(
        "*", F.lit("SECONDARY").alias("role"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("bigint").alias("supersedes_id"),
        F.lit(None).cast(events.schema["at"].dataType).alias("valid_to"),
    )
    return primaries.unionByName(seconds).withColumnRenamed("at", "valid_from")


def set_flag(df: DataFrame, ids: DataFrame, ident: str, flag: str, value: object, protected: Column, forced: bool = False) -> DataFrame:
    """Flag the listed rows; protected rows only change when forced."""
    marked = df.join(ids.select(ident).distinct().withColumn("_hit", F.lit(True)), ident, "left")
    allowed = F.col("_hit").isNotNull() & (F.lit(forced) | ~protected)
    old = F.col(flag) if flag in df.columns else F.lit(None)
    return marked.withColumn(flag, F.when(allowed, F.lit(value)).otherwise(old)).drop("_hit")


def insert_new(current: DataFrame, arriving: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Arriving rows whose key is neither present nor repeated before them."""
    first = rank.best_per_key(arriving, keys, [F.col(order)], largest=False)
    return first.join(current.select(*keys), list(keys), "left_anti")


def lifecycle_state(events: DataFrame, ident: str, kind: str, order: Sequence[str]) -> DataFrame:
    """State of each rule candidate: PENDING, VALIDATED, APPLIED or REJECTED. Applying needs an earlier
    validation and no earlier rejection. All from first times per event kind."""
    stamp = F.struct(*order)
    first = events.groupBy(ident).agg(
        F.min(F.when(F.col(kind) == "VALIDATE", stamp)).alias("validated"),
        F.min(F.when(F.col(kind) == "REJECT", stamp)).alias("rejected"),
    )
    # an apply counts if it comes after validation and before any rejection
    valid = events.join(first.select(ident, "validated", "rejected"), ident).filter(
        (F.col(kind) == "APPLY") & (F.struct(*order) > F.col("validated")) & (F.col("rejected").isNull() | (F.struct(*order) < F.col("rejected")))
    )
    applied = valid.groupBy(ident).agg(F.min(stamp).alias("applied"))
    out = first.join(applied, ident, "left")
    state = (
        F.when(F.col("applied").isNotNull(), F.lit("APPLIED")).when(F.col("rejected").isNotNull(), F.lit("REJECTED"))
        .when(F.col("validated").isNotNull(), F.lit("VALIDATED")).otherwise(F.lit("PENDING"))
    )
    return out.select(ident, state.alias("state"))


def parent_status(parents: DataFrame, results: DataFrame, parent: str, ident: str, status: str) -> DataFrame:
    """Parent rows with the outcome of their newest result: error states give ERROR, others DONE."""
    newest = results.groupBy(parent).agg(F.max_by(status, ident).alias("_s"), F.count("*").alias("results_n"))
    joined = parents.join(newest, parent, "left")
    state = F.when(F.upper("_s").isin("ERROR", "FAILED"), F.lit("ERROR")).when(F.col("_s").isNotNull(), F.lit("DONE")).otherwise(F.lit("WAITING"))
    return joined.withColumn("ocr_status", state).withColumn("results_n", F.coalesce("results_n", F.lit(0))).drop("_s")


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of a parent that has new ones are replaced by them."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def apply_updates(master: DataFrame, updates: DataFrame, key: str, fields: Mapping[str, str], expiry: str, allow_earlier: bool = False) -> DataFrame:
    """Next master version: blank never overwrites, an earlier expiry is refused unless allowed.

    ``fields`` maps master columns to update columns. Each row reports its outcome and what changed."""
    joined = master.join(updates.withColumn("_upd", F.lit(True)), key, "left")
    new = {m: F.nullif(F.trim(F.col(u).cast("string")), F.lit("")).cast(master.schema[m].dataType) for m, u in fields.items()}
    earlier = F.coalesce(new[expiry] < F.col(expiry), F.lit(False))
    refused = earlier if not allow_earlier else F.lit(False)
    take = F.col("_upd").isNotNull() & ~refused
    after = {m: F.when(take, F.coalesce(c, F.col(m))).otherwise(F.col(m)) for m, c in new.items()}
    changed = F.array_compact(F.array(*[F.when(~F.col(m).eqNullSafe(after[m]), F.lit(m)) for m in fields]))
    outcome = (
        F.when(F.col("_upd").isNull(), F.lit("UNTOUCHED")).when(refused, F.lit("REFUSED_EARLIER_EXPIRY"))
        .when(F.size(changed) == 0, F.lit("NO_CHANGE")).otherwise(F.lit("UPDATED"))
    )
    kept = [after[c].alias(c) if c in fields else F.col(c) for c in master.columns]
    return joined.select(*kept, outcome.alias("outcome"), changed.alias("changed"))
