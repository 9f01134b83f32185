"""Sources, sinks and landed feeds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions import text as X
from attestry.operators import filters, reshape
from attestry.operators.state import upsert
from attestry.plans.common import WIDE_SQL, wide_master
from attestry.plans.registry import query, table
from attestry.session import shared_path as fresh
from attestry.sources import readers, sinks


@query(
    "src_1_positional_sheet",
    f"WITH {WIDE_SQL} SELECT material_no, supplier, name, coalesce(org, '-') AS org, expiry FROM master WHERE depth = 0",
)
def positional_sheet(spark, d):
    folder = fresh(spark, "sheet")
    wide_master(spark, d).drop("row_pos").write.csv(folder)
    rows = readers.sheet(spark, {"Raw Material Management": folder}, "rawmaterial MANAGEMENT", 51)
    long = reshape.flatten_master(rows.withColumn("row_pos", F.col("c0").cast("bigint")))
    return long.filter("depth = 0").select("material_no", "supplier", "name", X.to_dash(F.col("org")).alias("org"), "expiry")


@query("src_2_newest_file", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def newest_file(spark, d):
    import time

    folder = fresh(spark, "snapshots")
    orders = table(spark, d, "orders")
    orders.filter("o_orderstatus = 'O'").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)
    orders.filter("o_orderstatus = 'F'").coalesce(1).write.mode("append").parquet(folder)
    return readers.newest_file(spark.read.parquet(folder)).select("o_orderkey", "o_custkey")


@query(
    "src_3_lenient_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type NOT IN ('error', 'click', 'view')",
)
def lenient_json(spark, d):
    line = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"k": '), "event_type"))
        .when(F.col("event_type") == "click", F.lit("  "))
        .when(F.col("event_type") == "view", F.concat(F.lit("["), "props", F.lit("]")))
        .otherwise(F.col("props"))
    )
    lines = table(spark, d, "events").select("event_id", line.alias("line"))
    return readers.json_objects(lines, "line", "k bigint").select("event_id", F.col("_r.k").alias("k"))


@query("src_4_strict_json", "SELECT event_id, event_type, user_id FROM events")
def strict_json(spark, d):
    folder = fresh(spark, "strict")
    events = table(spark, d, "events").select("event_id", "event_type", "user_id")
    events.write.json(folder)
    return readers.json_lines(spark, folder, events.schema, strict=True)


@query("src_5_content_hash", "SELECT doc_id, sha256(text) AS sha256, length(text) AS size FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("bigint").alias("size"))


@query("src_5_file_manifest")
def file_manifest(spark, d):
    files = readers.file_manifest(spark, d, [".parquet"])
    return files.select(X.file_name(F.col("path")).alias("name"), "size", "sha256")


@query(
    "src_6_registry_ingest",
    """
    SELECT 'L' || CAST(n_nationkey AS VARCHAR) AS lph_id, n_name AS name, 'R' || CAST(n_regionkey AS VARCHAR) AS abbreviation, CASE WHEN n_nationkey % 2 = 0 THEN 'ACTIVE' ELSE 'OLD' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS page_no
    FROM nation
    """,
)
def registry_ingest(spark, d):
    nation = table(spark, d, "nation")

    def page(number, status, rows):
        item = F.struct(
            F.concat(F.lit("L"), F.col("n_nationkey").cast("string")).alias("lph_id"),
            F.concat("n_name", F.lit("  (R"), F.col("n_regionkey").cast("string"), F.lit(") ")).alias("name"),
            F.lit("-").alias("city"), F.lit("ID").alias("country"), F.lit(status).alias("status"),
        )
        body = F.to_json(F.struct(F.struct(F.array(item, F.struct(F.lit(" ").alias("lph_id"), F.lit("x").alias("name"), F.lit("").alias("city"), F.lit("").alias("country"), F.lit("").alias("status"))).alias("datas")).alias("data")))
        return rows.select(F.lit(number).alias("page_no"), body.alias("payload"))

    pages = page(1, "OLD", nation).unionByName(page(2, "ACTIVE", nation.filter("n_nationkey % 2 = 0")))
    records = readers.registry_records(pages, "payload")
    merged = upsert(records.filter("page_no = 1"), records.filter("page_no = 2"), ["lph_id"], "page_no")
    return merged.select("lph_id", "name", "abbreviation", "status", F.col("page_no").cast("bigint").alias("page_no"))


@query(
    "src_7_inbox_ingest",
    """
    WITH m AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id HAVING conv_id % 5 <> 0),
    a AS (SELECT conv_id, turn, unnest(['cert.pdf', 'list.xlsx']) AS name, unnest([1, 2]) AS n FROM m)
    SELECT 'U' || CAST(conv_id AS VARCHAR) AS message_uid, name, CASE WHEN conv_id % 2 = 0 THEN 'REQ-20260630-0000000A' ELSE 'NOREQ' END || '__00' || CAST(n AS VARCHAR) || '__' || name AS saved_name FROM a
    """,
)
def inbox_ingest(spark, d):
    turns = table(spark, d, "conversations")
    raw = turns.select(
        F.concat(F.lit("U"), F.col("conv_id").cast("string")).alias("message_uid"), F.col("turn").alias("seen_at"), "role",
        F.when(F.col("conv_id") % 5 == 0, F.lit("MAILER-DAEMON@host")).otherwise(F.lit("a@b.example")).alias("sender"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("REQ-20260630-0000000A")).otherwise(F.lit("")).alias("request_id"),
        F.array(F.lit("cert.pdf"), F.lit("list.xlsx")).alias("attachments"),
    )
    messages = readers.inbox_messages(raw, filters.bounced(F.col("sender")), F.col("role") == "user")
    return readers.attachment_rows(messages, "request_id", "attachments").select("message_uid", "name", "saved_name")


@query("src_8_append_log", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def append_log(spark, d):
    folder = fresh(spark, "log")
    events = table(spark, d, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    sinks.append_log(events.filter("event_id % 2 = 0"), folder)
    sinks.append_log(events.filter("event_id % 2 = 1"), folder)
    log = spark.read.schema(events.schema).json(folder)
    return filters.listing(log, {}, [F.desc("at"), F.desc("event_id")], 50).select("event_id", "event_type")


@query("src_9_export", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def export(spark, d):
    folder = fresh(spark, "export")
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    sinks.export(table(spark, d, "orders"), folder, cols)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderpriority", T.StringType())])
    return spark.read.schema(schema).csv(f"{folder}/summary", header=True)


@query(
    "src_10_log_migration",
    """
    SELECT o_orderkey, 'R' || CAST(o_custkey AS VARCHAR) AS request_id, o_orderpriority AS subject, o_orderstatus = 'F' AS success FROM orders o WHERE o_orderkey % 2 = 1
      AND NOT EXISTS (SELECT 1 FROM orders n WHERE n.o_orderkey % 2 = 0 AND n.o_custkey = o.o_custkey AND n.o_orderpriority = o.o_orderpriority)
    """,
)
def log_migration(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("R"), F.col("o_custkey").cast("string")).alias("request_id"), F.col("o_orderpriority").alias("subject"),
        F.lit(None).cast("string").alias("sent_at"), F.when(F.col("o_orderstatus") == "F", F.lit("Success")).otherwise(F.lit("fail")).alias("result"),
    )
    old, new = orders.filter("o_orderkey % 2 = 1"), orders.filter("o_orderkey % 2 = 0")
    fresh_rows = readers.missing_in(old, new, ["request_id", "subject", "sent_at"])
    return fresh_rows.select("o_orderkey", "request_id", "subject", (F.lower("result") == "success").alias("success"))


@query(
    "src_11_checked_manifest",
    """
    WITH m AS (SELECT doc_id, sha256(text) AS sha, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1), u AS (SELECT sha FROM m GROUP BY 1 HAVING count(*) = 1)
    SELECT lang, count(*) AS n, count(*) >= 5 AS trainable FROM m JOIN u USING (sha) GROUP BY 1
    """,
)
def checked_manifest(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(
        "doc_id", F.sha2("text", 256).alias("sha"), "lang", F.when(F.col("quality") == 1, F.lit("READY")).otherwise(F.lit("LOW_TEXT")).alias("status")
    )
    ready = readers.checked_manifest(joined, ["doc_id", "sha", "lang", "status"], "sha", "status", "READY")
    return ready.groupBy("lang").agg(F.count("*").alias("n")).withColumn("trainable", F.col("n") >= 5)


@query("src_12_latest_run", "SELECT event_id, user_id % 4 AS run_id FROM events WHERE user_id % 4 = 3")
def latest_run(spark, d):
    runs = table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("run_id"))
    return readers.latest_run(runs, "run_id").select("event_id", "run_id")


@query(
    "src_13_text_by_hash",
    """
    SELECT doc_id, md5(text) AS digest, CASE WHEN EXISTS (SELECT 1 FROM documents c WHERE c.text = d.text AND c.lang = 'en') THEN 'FOUND' ELSE 'MISSING' END AS state FROM documents d
    """,
)
def text_by_hash(spark, d):
    docs = table(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    keys = docs.select("doc_id", "sha", F.md5("text").alias("digest"))
    found, missing = readers.attach_text(keys, docs.filter("lang = 'en'").select("sha", "text"), "sha", "text")
    return found.select("doc_id", "digest", F.lit("FOUND").alias("state")).unionByName(missing.select("doc_id", "digest", F.lit("MISSING").alias("state")))


@query(
    "src_14_review_sheet",
    "SELECT doc_id, source, quality::BIGINT AS quality, '' AS reviewer_decision FROM documents JOIN labels USING (doc_id)",
)
def review_sheet(spark, d):
    folder = fresh(spark, "review")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("quality").cast("bigint").alias("quality"))
    sinks.review_sheet(rows, ["reviewer_decision"], folder)
    schema = "doc_id bigint, source string, quality bigint, reviewer_decision string"
    back = spark.read.schema(schema).csv(folder, header=True)
    return back.withColumn("reviewer_decision", F.coalesce("reviewer_decision", F.lit("")))


@query(
    "src_16_labelled_files",
    r"""
    SELECT page_id, upper(regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]+)', 1)) AS label FROM pages WHERE page_id % 3 <> 0 AND lower(regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]+)', 1)) NOT IN ('', 'de')
    """,
)
def labelled_files(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    known = pages.filter("page_id % 3 = 0")
    return readers.labelled_files(pages, "url", ["de"], known, "page_id").select("page_id", "label")
