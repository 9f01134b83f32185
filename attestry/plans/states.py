"""State changes: upserts, history, flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import rank, state
from attestry.plans.registry import query, table


@query(
    "sta_1_upsert",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '-2' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM customer",
)
def upsert(spark, d):
    current = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.lit(1).cast("bigint").alias("version"))
    changes = current.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.upper("segment"), F.lit("-2")).alias("segment"), F.lit(2).cast("bigint").alias("version"))
    return state.upsert(current, changes, ["c_custkey"], "version")


def history_events(spark, d):
    """Orders as certificate actions of a material (the customer)."""
    k = F.col("o_orderkey")
    action = (
        F.when(k % 29 == 0, F.lit("ROLLBACK")).when(k % 4 == 0, F.lit("ADD_SECONDARY")).when(k % 4 == 1, F.lit("REPLACE_CURRENT")).otherwise(F.lit("UPDATE_CURRENT"))
    )
    return table(spark, d, "orders").select(
        (k + 1).alias("id"), F.col("o_custkey").alias("material"), F.col("o_orderstatus").alias("org"), F.concat(F.lit("CN"), F.substring("o_orderpriority", 1, 1)).alias("cert_no"),
        F.date_format(F.trunc(F.to_date("o_orderdate"), "year"), "yyyy-MM-dd").alias("expiry"), action.alias("action"), F.floor(k / 3).alias("at"),
        F.when(k % 29 == 0, k + 3).alias("target_id"),
    )


EVENT_SQL = """
ev AS (SELECT o_orderkey + 1 AS id, o_custkey AS material, o_orderstatus AS org, 'CN' || substr(o_orderpriority, 1, 1) AS cert_no, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS expiry,
   CASE WHEN o_orderkey % 29 = 0 THEN 'ROLLBACK' WHEN o_orderkey % 4 = 0 THEN 'ADD_SECONDARY' WHEN o_orderkey % 4 = 1 THEN 'REPLACE_CURRENT' ELSE 'UPDATE_CURRENT' END AS action, o_orderkey // 3 AS at_, CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey + 3 END AS target_id FROM orders)
"""
HIST_SQL = """
leg AS (SELECT 0::BIGINT AS id, material, 'LEG' AS org, 'CN0' AS cert_no, '1990-01-01' AS expiry, 'LEGACY_IMPORT' AS action, min(at_) AS at_ FROM src WHERE action IN ('UPDATE_CURRENT', 'REPLACE_CURRENT') AND material % 2 = 0 GROUP BY material),
al AS (SELECT id, material, org, cert_no, expiry, action, at_ FROM src UNION ALL SELECT * FROM leg),
pr AS (SELECT *, lag(id) OVER w AS supersedes_id, lead(at_) OVER w AS valid_to, lead(id) OVER w AS nid FROM al WHERE action <> 'ADD_SECONDARY' WINDOW w AS (PARTITION BY material ORDER BY at_, id)),
se AS (SELECT *, row_number() OVER (PARTITION BY material, org, cert_no, expiry ORDER BY at_, id) AS rn FROM al WHERE action = 'ADD_SECONDARY'),
hist AS (SELECT id, material, org, 'PRIMARY' AS role, CASE WHEN nid IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status, coalesce(supersedes_id, -1) AS supersedes_id, at_ AS valid_from, coalesce(valid_to, -1) AS valid_to FROM pr
  UNION ALL SELECT id, material, org, 'SECONDARY', 'ACTIVE', -1, at_, -1 FROM se WHERE rn = 1)
"""


def history(spark, d, events):
    master = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("material"), F.lit("LEG").alias("org"), F.lit("CN0").alias("cert_no"), F.lit("1990-01-01").alias("expiry")
    )
    log = state.with_legacy(events, master, ["material"], ["org", "cert_no", "expiry"])
    out = state.certificate_history(log, ["material"], F.floor(F.col("at") / 50000))
    return out.select(
        "id", "material", "org", "role", "status", F.coalesce("supersedes_id", F.lit(-1)).alias("supersedes_id"), "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to")
    )


@query("sta_2_certificate_history", f"WITH {EVENT_SQL}, src AS (SELECT * FROM ev WHERE action <> 'ROLLBACK'), {HIST_SQL} SELECT * FROM hist")
def certificate_history(spark, d):
    return history(spark, d, history_events(spark, d).filter("action <> 'ROLLBACK'"))


@query(
    "sta_3_rollback",
    f"WITH {EVENT_SQL}, src AS (SELECT * FROM ev WHERE action <> 'ROLLBACK' AND id NOT IN (SELECT target_id FROM ev WHERE target_id IS NOT NULL)), {HIST_SQL} SELECT * FROM hist",
)
def rollback(spark, d):
    return history(spark, d, state.drop_rolled_back(history_events(spark, d)))


@query(
    "sta_4_hide_flags",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'HIDDEN' ELSE 'SHOWN' END AS flag FROM orders
    """,
)
def hide_flags(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit("SHOWN").alias("flag"))
    return state.set_flag(orders, orders.filter("o_orderkey % 3 = 0"), "o_orderkey", "flag", "HIDDEN", F.col("o_orderstatus") == "F").select("o_orderkey", "flag")


@query(
    "sta_5_insert_new",
    "SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents d WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM documents c WHERE c.lang = 'en' AND c.text = d.text) GROUP BY text",
)
def insert_new(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    return state.insert_new(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), ["sha"], "doc_id").select("doc_id", "sha")


@query(
    "sta_6_rule_lifecycle",
    """
    WITH e AS (SELECT user_id * 100 + event_id % 100 AS subject, event_id, CASE event_type WHEN 'signup' THEN 'VALIDATE' WHEN 'purchase' THEN 'APPLY' WHEN 'error' THEN CASE WHEN event_id % 40 = 0 THEN 'REJECT' ELSE 'NOTE' END ELSE 'NOTE' END AS kind FROM events),
    f AS (SELECT subject, min(event_id) FILTER (kind = 'VALIDATE') AS v, min(event_id) FILTER (kind = 'REJECT') AS r FROM e GROUP BY 1),
    a AS (SELECT subject, min(event_id) AS ap FROM e JOIN f USING (subject) WHERE kind = 'APPLY' AND event_id > v AND (r IS NULL OR event_id < r) GROUP BY 1)
    SELECT subject, CASE WHEN ap IS NOT NULL THEN 'APPLIED' WHEN r IS NOT NULL THEN 'REJECTED' WHEN v IS NOT NULL THEN 'VALIDATED' ELSE 'PENDING' END AS state FROM f LEFT JOIN a USING (subject)
    """,
)
def rule_lifecycle(spark, d):
    kind = (
        F.when(F.col("event_type") == "signup", F.lit("VALIDATE")).when(F.col("event_type") == "purchase", F.lit("APPLY"))
        .when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), F.lit("REJECT")).otherwise(F.lit("NOTE"))
    )
    subject = F.col("user_id") * 100 + F.col("event_id") % 100
    events = table(spark, d, "events").select(subject.alias("subject"), "event_id", kind.alias("kind"))
    return state.lifecycle_state(events, "subject", "kind", ["event_id"])


@query(
    "sta_7_parent_status",
    """
    WITH e AS (SELECT user_id * 100 + event_id % 100 AS subject, event_id, event_type FROM events),
    r AS (SELECT subject, arg_max(event_type, event_id) AS s, count(*) AS n FROM e WHERE event_type IN ('error', 'purchase') GROUP BY 1)
    SELECT subject, CASE WHEN s = 'error' THEN 'ERROR' WHEN s IS NOT NULL THEN 'DONE' ELSE 'WAITING' END AS ocr_status, coalesce(n, 0) AS results_n FROM (SELECT DISTINCT subject FROM e) LEFT JOIN r USING (subject)
    """,
)
def parent_status(spark, d):
    events = table(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("subject"), "event_id", "event_type")
    results = events.filter(F.col("event_type").isin("error", "purchase"))
    return state.parent_status(events.select("subject").distinct(), results, "subject", "event_id", "event_type").select("subject", "ocr_status", "results_n")


@query(
    "sta_8_replace_children",
    """
    WITH n AS (SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS rn FROM lineitem WHERE l_orderkey % 5 = 0)
    SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS slot FROM lineitem WHERE l_orderkey % 5 <> 0 UNION ALL SELECT l_orderkey, l_partkey, rn FROM n WHERE rn <= 2
    """,
)
def replace_children(spark, d):
    li = table(spark, d, "lineitem")
    children = li.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("bigint").alias("slot"))
    new = rank.top_per_group(li.filter("l_orderkey % 5 = 0"), ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_partkey"), F.asc("l_linenumber")], 2, "slot")
    return state.replace_children(children, new.select("l_orderkey", "l_partkey", F.col("slot").cast("bigint").alias("slot")), "l_orderkey")
