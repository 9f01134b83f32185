"""Structured Streaming jobs over landed files, each with its batch twin as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.plans.aggregates import JOBS_SQL
from attestry.plans.registry import query, table
from attestry.session import shared_path as fresh
from attestry.streaming import feeds


def stream_table(spark, d, name):
    # as a glob the path may be one file or a folder of files
    return feeds.landed(spark, f"{d}/{name}.parque[t]", table(spark, d, name).schema)


@query(
    "str_1_inbox_stream",
    """
    WITH m AS (SELECT DISTINCT event_id // 2 AS uid FROM events WHERE event_type <> 'error')
    SELECT 'U' || CAST(uid AS VARCHAR) AS message_uid, name, 'U' || CAST(uid AS VARCHAR) || '__00' || CAST(n AS VARCHAR) || '__' || name AS saved_name
    FROM m, (SELECT unnest(['cert.pdf', 'list.xlsx']) AS name, unnest([1, 2]) AS n) WHERE uid % 3 <> 0
    """,
)
def inbox_stream(spark, d):
    out = fresh(spark, "inbox")
    events = stream_table(spark, d, "events")
    number = F.floor(F.col("event_id") / 2)
    messages = events.select(
        F.concat(F.lit("U"), number.cast("string")).alias("message_uid"), F.col("ts").cast("timestamp").alias("ts"), "event_type", number.alias("k"),
        F.array(F.lit("cert.pdf"), F.lit("list.xlsx")).alias("attachments"),
    )
    status = F.when(F.col("k") % 3 == 0, F.lit("excluded")).when(F.col("k") % 3 == 1, F.lit("exact")).otherwise(F.lit("probable"))
    write = feeds.inbox_batches(out, "message_uid", F.col("event_type") == "error", status, "attachments")
    feeds.run_available(messages, out, f"{out}-checkpoint", "append", write)
    return spark.read.parquet(f"{out}/rows").select("message_uid", "name", "saved_name")


@query("str_2_job_status", f"WITH {JOBS_SQL} SELECT path, latest_id, ok_id AS latest_success_id FROM latest")
def job_status(spark, d):
    out = fresh(spark, "status")
    events = stream_table(spark, d, "events").select(
        F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("path"), (F.col("event_id") + 1).alias("id"), "event_type"
    )
    running = feeds.latest_status(events, "path", "id", F.col("event_type") == "purchase")
    feeds.run_available(running, out, f"{out}-checkpoint", "update", feeds.keep_batch(out))
    return feeds.newest_rows(spark, out, ["path"])


@query(
    "str_3_history_stream",
    """
    WITH src AS (SELECT event_id + 1 AS id, user_id AS material, event_type AS org, CAST(user_id % 3 AS VARCHAR) AS cert_no, '2026-01-01' AS expiry, event_id AS at_, CASE event_id % 3 WHEN 0 THEN 'ADD_SECONDARY' WHEN 1 THEN 'REPLACE_CURRENT' ELSE 'UPDATE_CURRENT' END AS action FROM events),
    pr AS (SELECT *, lag(id) OVER w AS sid, lead(at_) OVER w AS vt FROM src WHERE action <> 'ADD_SECONDARY' WINDOW w AS (PARTITION BY material ORDER BY at_, id)),
    se AS (SELECT *, row_number() OVER (PARTITION BY material, org, cert_no, expiry ORDER BY at_, id) AS rn FROM src WHERE action = 'ADD_SECONDARY')
    SELECT id, material, 'PRIMARY' AS role, CASE WHEN vt IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, coalesce(sid, -1) AS supersedes_id, coalesce(vt, -1) AS valid_to FROM pr
    UNION ALL SELECT id, material, 'SECONDARY', 'ACTIVE', -1, -1 FROM se WHERE rn = 1
    """,
)
def history_stream(spark, d):
    out = fresh(spark, "history")
    action = F.when(F.col("event_id") % 3 == 0, F.lit("ADD_SECONDARY")).when(F.col("event_id") % 3 == 1, F.lit("REPLACE_CURRENT")).otherwise(F.lit("UPDATE_CURRENT"))
    events = stream_table(spark, d, "events").select(
        (F.col("event_id") + 1).alias("id"), F.col("user_id").alias("material"), F.col("event_type").alias("org"), (F.col("user_id") % 3).cast("string").alias("cert_no"),
        F.lit("2026-01-01").alias("expiry"), action.alias("action"), F.col("event_id").alias("at"),
    )
    feeds.run_available(events, out, f"{out}-checkpoint", "append", feeds.history_batches(["material"], out, F.floor(F.col("at") / 100000)))
    h = feeds.read_history(spark, out, ["material"])
    return h.select("id", "material", "role", "status", F.coalesce("supersedes_id", F.lit(-1)).alias("supersedes_id"), F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


@query(
    "str_4_window_counts",
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2",
)
def window_counts(spark, d):
    out = fresh(spark, "windows")
    events = stream_table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    feeds.run_available(events, out, f"{out}-checkpoint", "append", feeds.count_batches(out, "ts", "1 hour", "status"))
    rows = feeds.summed_counts(spark, out, "status")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "status", "n")
