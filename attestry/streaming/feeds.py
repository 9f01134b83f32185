"""The three polled feeds as streams.

State that must survive is Spark's own (latest status) or a table written per micro-batch under the
shared folder. Every batch writes to its own ``batch=N`` folder in overwrite mode, so a replayed batch
replaces itself. No feed has a watermark: late rows count like any others."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators import rank, state


def landed(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str, write: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what has landed, then stop. Without ``write`` rows go to parquet files at ``out``."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(write).start() if write else writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def inbox_batches(out: str, uid: str, bounced: Column, status: Column, names: str) -> Callable[[DataFrame, int], None]:
    """Messages once per uid for ever, bounces out, classified, one row per attachment.

    A batch leaves out the uids of all earlier batches, however old; of one uid within a batch one
    message stays. New rows go to ``rows``, new uids to ``uids``."""

    def write(messages: DataFrame, batch: int) -> None:
        spark = messages.sparkSession
        once = messages.filter(~bounced).dropDuplicates([uid])
        if batch:
            seen = spark.read.parquet(f"{out}/uids").filter(F.col("batch") < batch).select(uid)
            once = once.join(seen, uid, "left_anti")
        once.write.mode("overwrite").parquet(f"{out}/new/batch={batch}")
        fresh = spark.read.schema(once.schema).parquet(f"{out}/new/batch={batch}")
        fresh.select(uid).write.mode("overwrite").parquet(f"{out}/uids/batch={batch}")
        kept = fresh.withColumn("match_status", status).filter("match_status <> 'excluded'")
        rows = kept.select("*", F.posexplode(F.col(names)).alias("pos", "name"))
        rows = rows.withColumn("saved_name", F.concat_ws("__", uid, F.lpad((F.col("pos") + 1).cast("string"), 3, "0"), "name")).drop("pos")
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    return write


def latest_status(jobs: DataFrame, key: str, ident: str, success: Column) -> DataFrame:
    """Running latest job and latest success per key; combines map-side before the state."""
    return jobs.groupBy(key).agg(
        F.max(ident).alias("latest_id"), F.coalesce(F.max(F.when(success, F.col(ident))), F.lit(0)).alias("latest_success_id")
    )


def window_counts(rows: DataFrame, ts: str, size: str, by: str) -> DataFrame:
    counted = rows.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")


def count_batches(out: str, ts: str, size: str, by: str) -> Callable[[DataFrame, int], None]:
    """Counts of each batch in a folder of their own; :func:`summed_counts` adds them up, so no row is ever too late."""

    def write(rows: DataFrame, batch: int) -> None:
        window_counts(rows, ts, size, by).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def summed_counts(spark: SparkSession, out: str, by: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("window_start", by).agg(F.sum("n").alias("n"))


def keep_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: the rows of each batch in a folder of their own."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return write


def newest_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Last update per key over all batches."""
    rows = spark.read.parquet(out)
    return rank.best_per_key(rows, keys, [F.col("batch")]).drop("batch")


def history_batches(keys: Sequence[str], out: str, bucket: Column) -> Callable[[DataFrame, int], None]:
    """Certificate history over micro-batches.

    A batch is folded with the same neighbour operator as the batch job; what the stream carries on
    is the last primary of each material and the secondaries seen. New rows go to ``opened``; the
    end of a row opened in an earlier batch goes to ``closed``."""

    def write(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        history = state.certificate_history(events, keys, bucket)
        fresh_primary = F.col("role") == "PRIMARY"
        carry, known = _carried(spark, out, batch)
        if carry is not None:
            last = carry.select(*keys, F.col("id").alias("_last_id"))
            joined = history.join(last, list(keys), "left")
            first = fresh_primary & F.col("supersedes_id").isNull()
            history = joined.withColumn("supersedes_id", F.when(first, F.col("_last_id")).otherwise(F.col("supersedes_id"))).drop("_last_id")
            seen = [*keys, "org", "cert_no", "expiry"]
            old = known.select(*seen).withColumn("role", F.lit("SECONDARY"))
            history = history.join(old, [*seen, "role"], "left_anti")
        history.write.mode("overwrite").partitionBy("role").parquet(f"{out}/opened/batch={batch}")
        opened = spark.read.parquet(f"{out}/opened/batch={batch}")
        firsts = rank.best_per_key(opened.filter("role = 'PRIMARY'"), keys, [F.col("valid_from"), F.col("id")], largest=False)
        closed = firsts.filter("supersedes_id is not null").select(*keys, F.col("supersedes_id").alias("id"), F.col("valid_from").alias("closed_at"))
        closed.write.mode("overwrite").parquet(f"{out}/closed/batch={batch}")
        newest = opened.filter("role = 'PRIMARY' and status = 'ACTIVE'").select(*keys, "id")
        if carry is not None:
            newest = newest.unionByName(carry.select(*keys, "id").join(newest.select(*keys), list(keys), "left_anti"))
        newest.write.mode("overwrite").parquet(f"{out}/carry/batch={batch}")

    return write


def _carried(spark: SparkSession, out: str, batch: int) -> tuple[DataFrame | None, DataFrame | None]:
    if batch == 0:
        return None, None
    carry = spark.read.parquet(f"{out}/carry/batch={batch - 1}")
    known = spark.read.parquet(f"{out}/opened").filter((F.col("batch") < batch) & (F.col("role") == "SECONDARY"))
    return carry, known


def read_history(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """History as of the last batch: rows opened, with the ends that came later."""
    opened = spark.read.parquet(f"{out}/opened").drop("batch")
    closed = spark.read.parquet(f"{out}/closed").drop("batch")
    joined = opened.join(closed, [*keys, "id"], "left")
    ended = F.coalesce("valid_to", "closed_at")
    status = F.when((F.col("role") == "PRIMARY") & ended.isNotNull(), F.lit("SUPERSEDED")).otherwise(F.lit("ACTIVE"))
    return joined.withColumn("valid_to", ended).withColumn("status", status).drop("closed_at")
