"""Aggregations and evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import aggregate, metrics, rank, reshape, rules
from attestry.plans.common import WIDE_SQL, wide_master
from attestry.plans.registry import query, table

AS_OF = "1998-06-30"



def certificates(spark, d):
    """orders as certificates, customer as supplier."""
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("item_id"), "o_custkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("BPJPH")).otherwise(F.concat(F.lit("ORG-"), "o_orderstatus")).alias("org"),
        F.to_date("o_orderdate").alias("expiry"), F.col("o_orderpriority").alias("priority"),
    )
    customers = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("supplier"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("receiver"),
    )
    return orders.join(customers, "o_custkey")


CERT_SQL = """
cert AS (SELECT o_orderkey AS item_id, o_custkey, CASE o_orderstatus WHEN 'P' THEN 'BPJPH' ELSE 'ORG-' || o_orderstatus END AS org, CAST(o_orderdate AS DATE) AS expiry,
   c_name AS supplier, lower(c_mktsegment) || '@example.com' AS receiver, date_diff('day', DATE '1998-06-30', CAST(o_orderdate AS DATE)) AS dd FROM orders JOIN customer ON o_custkey = c_custkey),
items AS (SELECT *, CASE WHEN org = 'BPJPH' THEN CASE WHEN dd < 0 THEN 'KEEP_CHECK' END WHEN dd <= 30 THEN 'NOTICE' WHEN dd BETWEEN 60 AND 90 THEN 'UPCOMING' END AS mail_type FROM cert)
"""


@query(
    "agg_1_supplier_summary",
    f"""
    WITH {WIDE_SQL} SELECT lower(replace(supplier, ' ', '')) AS supplier_key, TRUE AS has_certificate, count(*) AS cert_count,
      coalesce(string_agg(DISTINCT org, ', ' ORDER BY org), '') AS orgs FROM master WHERE supplier IS NOT NULL GROUP BY 1
    """,
)
def supplier_summary(spark, d):
    return aggregate.supplier_summary(reshape.flatten_master(wide_master(spark, d)))


@query(
    "agg_2_request_targets",
    f"""
    WITH {CERT_SQL} SELECT supplier, mail_type, count(*) AS item_count, arg_min(receiver, item_id) AS receiver, CAST(min(expiry) AS VARCHAR) AS first_expiry,
      CAST(max(expiry) AS VARCHAR) AS last_expiry, CASE mail_type WHEN 'KEEP_CHECK' THEN 'N' ELSE 'Y' END AS attach_pdf FROM items WHERE mail_type IS NOT NULL GROUP BY 1, 2
    """,
)
def request_targets(spark, d):
    targets = aggregate.request_targets(aggregate.request_items(certificates(spark, d), AS_OF))
    return targets.withColumn("first_expiry", F.col("first_expiry").cast("string")).withColumn("last_expiry", F.col("last_expiry").cast("string"))


@query(
    "agg_3_registry_status",
    """
    SELECT n_regionkey::BIGINT AS region, count(*) AS entries, count(DISTINCT n_name) AS names, arg_max(n_name, n_nationkey) AS last_synced FROM nation GROUP BY 1
    """,
)
def registry_status(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("bigint").alias("region")).agg(
        F.count("*").alias("entries"), F.countDistinct("n_name").alias("names"), F.max_by("n_name", "n_nationkey").alias("last_synced")
    )


@query(
    "agg_4_diagnostics",
    """
    WITH e AS (SELECT event_type AS org, CASE WHEN value > 50 THEN 'HIGH' WHEN user_id % 5 = 0 THEN ' ' ELSE 'LOW' END AS confidence FROM events)
    SELECT 'org' AS dimension, org AS value, count(*) AS n FROM e GROUP BY 2
    UNION ALL SELECT 'confidence', CASE WHEN trim(confidence) = '' THEN 'EMPTY' ELSE confidence END, count(*) FROM e GROUP BY 2
    """,
)
def diagnostics(spark, d):
    conf = F.when(F.col("value") > 50, F.lit("HIGH")).when(F.col("user_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("LOW"))
    recs = table(spark, d, "events").select(F.col("event_type").alias("org"), conf.alias("confidence"))
    return aggregate.value_counts(recs, ["org", "confidence"])


def scan_jobs(spark, d):
    """events as scan jobs: purchase is a success, error a failure with a message."""
    k = F.get_json_object("props", "$.k").cast("int")
    message = (
        F.when(F.col("event_type") != "error", F.lit(""))
        .when(k % 4 == 0, F.lit("Tesseract is not installed")).when(k % 4 == 1, F.lit("Unable to get page count"))
        .when(k % 4 == 2, F.lit("cannot identify image file x")).otherwise(F.lit("timeout"))
    )
    return table(spark, d, "events").select(
        (F.col("event_id") + 1).alias("id"), F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("path"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).when(F.col("event_type") == "purchase", F.lit("DONE")).otherwise(F.lit("RUNNING")).alias("status"),
        message.alias("message"), "ts",
    )


JOBS_SQL = """
jobs AS (SELECT event_id + 1 AS id, 'F' || CAST(user_id AS VARCHAR) AS path, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'DONE' ELSE 'RUNNING' END AS status,
   CASE WHEN event_type <> 'error' THEN CASE event_type WHEN 'purchase' THEN 'DONE' ELSE 'RUNNING' END ELSE CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'ENGINE_ERROR' WHEN 1 THEN 'PDF_RENDER_ERROR' WHEN 2 THEN 'IMAGE_READ_ERROR' ELSE 'ERROR' END END AS kind, ts FROM events),
latest AS (SELECT path, max(id) AS latest_id, coalesce(max(id) FILTER (status = 'DONE'), 0) AS ok_id FROM jobs GROUP BY 1)
"""


@query(
    "agg_5_failure_buckets",
    f"""
    WITH {JOBS_SQL} SELECT kind, count(*) AS n, count(*) FILTER (kind = 'ENGINE_ERROR' AND ok_id > id) AS stale, count(*) FILTER (id = latest_id) AS latest
    FROM jobs JOIN latest USING (path) WHERE status = 'ERROR' AND contains(lower(path), '1') GROUP BY kind
    """,
)
def failure_buckets(spark, d):
    jobs = scan_jobs(spark, d).withColumn("kind", aggregate.failure_kind(F.col("status"), F.col("message")))
    flagged = rank.latest_flags(jobs, "path", "id", F.col("kind") == "DONE", F.col("kind") == "ENGINE_ERROR")
    failed = flagged.filter((F.col("status") == "ERROR") & F.lower("path").contains("1"))
    return failed.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_stale").alias("stale"), F.count_if("is_latest").alias("latest"))


STATES = ["F", "O", "P"]


@query(
    "agg_6_coverage",
    """
    SELECT c_nationkey::BIGINT AS nation, o_orderpriority AS field, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o,
      count(*) FILTER (o_orderstatus = 'P') AS p, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS ready_rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
    """,
)
def coverage(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").cast("bigint").alias("nation"), F.col("o_orderpriority").alias("field"), "o_orderstatus"
    )
    return aggregate.status_coverage(rows, ["nation", "field"], "o_orderstatus", STATES, "F")


@query(
    "agg_7_text_audit",
    """
    SELECT source, lang, count(*) AS docs, count(*) FILTER (n_chars >= 500) AS text_direct, count(*) FILTER (n_chars < 500) AS ocr_required,
      round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents GROUP BY 1, 2
    """,
)
def text_audit(spark, d):
    direct = F.col("n_chars") >= 500
    return table(spark, d, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("docs"), F.count_if(direct).alias("text_direct"), F.count_if(~direct).alias("ocr_required"),
        F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"),
    )


@query(
    "agg_8_rule_validation",
    r"""
    WITH f AS (SELECT source AS org, CAST(contains(text, '@') AS INTEGER) + CAST(lang = 'en' AS INTEGER) AS before_n,
       CAST(contains(text, '@') AS INTEGER) + CAST(lang = 'en' AS INTEGER) + CAST(regexp_matches(text, '[0-9]{16}') AS INTEGER) - CAST(contains(text, '@') AND length(text) < 1000 AS INTEGER) AS after_n FROM documents)
    SELECT org, count(*) AS records, round(avg(before_n / 3), 4) AS before_rate, round(avg(after_n / 3), 4) AS after_rate, round(avg((after_n - before_n) / 3), 4) AS delta,
      count(*) FILTER (after_n > before_n) AS improved, count(*) FILTER (after_n < before_n) AS regressed FROM f GROUP BY 1
    """,
)
def rule_validation(spark, d):
    at, en = F.col("text").contains("@"), F.col("lang") == "en"
    before = at.cast("int") + en.cast("int")
    after = before + F.col("text").rlike("[0-9]{16}").cast("int") - (at & (F.length("text") < 1000)).cast("int")
    f = table(spark, d, "documents").select(F.col("source").alias("org"), before.alias("b"), after.alias("a"))
    return f.groupBy("org").agg(
        F.count("*").alias("records"), F.round(F.avg(F.col("b") / 3), 4).alias("before_rate"), F.round(F.avg(F.col("a") / 3), 4).alias("after_rate"),
        F.round(F.avg((F.col("a") - F.col("b")) / 3), 4).alias("delta"),
        F.count_if(F.col("a") > F.col("b")).alias("improved"), F.count_if(F.col("a") < F.col("b")).alias("regressed"),
    )


@query(
    "agg_9_field_accuracy",
    """
    WITH g AS (SELECT c_custkey, c_name, c_mktsegment FROM customer),
    l AS (SELECT c_custkey, 'name' AS field, c_name AS t, CASE WHEN c_custkey % 3 = 0 THEN lower(replace(c_name, '#', ' #')) ELSE c_name END AS r, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS m FROM g
      UNION ALL SELECT c_custkey, 'segment', c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN 'OTHER' ELSE c_mktsegment END, c_mktsegment || '.' FROM g),
    x AS (SELECT c_custkey, field, t, 'rule' AS method, r AS v FROM l UNION ALL SELECT c_custkey, field, t, 'model', m FROM l UNION ALL SELECT c_custkey, field, t, 'hybrid', CASE WHEN c_custkey % 2 = 0 THEN m ELSE r END FROM l),
    s AS (SELECT *, lower(trim(t)) = lower(trim(v)) AS strict, regexp_replace(upper(t), '[^A-Z0-9]+', '', 'g') = regexp_replace(upper(v), '[^A-Z0-9]+', '', 'g') AS norm FROM x),
    dm AS (SELECT c_custkey, method, bool_and(strict) AS fs, bool_and(norm) AS fn FROM s GROUP BY 1, 2),
    fm AS (SELECT method, count(*) FILTER (fs) AS full_strict, count(*) FILTER (fn) AS full_normalised FROM dm GROUP BY 1)
    SELECT s.method, field, count(*) AS docs, round(100.0 * avg(CAST(strict AS INTEGER)), 1) AS strict_acc, round(100.0 * avg(CAST(norm AS INTEGER)), 1) AS normalised_acc,
      any_value(full_strict) AS full_strict, any_value(full_normalised) AS full_normalised FROM s JOIN fm USING (method) GROUP BY 1, 2
    """,
)
def field_accuracy(spark, d):
    key = F.col("c_custkey")
    rule_name = F.when(key % 3 == 0, F.lower(F.replace("c_name", F.lit("#"), F.lit(" #")))).otherwise(F.col("c_name"))
    model_name = F.when(key % 4 == 0, F.lit("")).otherwise(F.upper("c_name"))
    rule_seg = F.when(key % 5 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment"))
    model_seg = F.concat("c_mktsegment", F.lit("."))
    low = key % 2 == 0
    values = []
    for field, truth, by_rule, by_model in (("name", F.col("c_name"), rule_name, model_name), ("segment", F.col("c_mktsegment"), rule_seg, model_seg)):
        for method, v in (("rule", by_rule), ("model", by_model), ("hybrid", F.when(low, by_model).otherwise(by_rule))):
            values.append(F.struct(F.lit(field).alias("field"), F.lit(method).alias("method"), truth.alias("t"), v.alias("v")))
    long = table(spark, d, "customer").select("c_custkey", F.inline(F.array(*values)))
    hits = metrics.method_accuracy(long, "c_custkey", "field", "method", F.col("t"), F.col("v"), lambda c: X.norm_key(c, keep="A-Z0-9"))
    full = hits.groupBy("c_custkey", "method").agg(F.bool_and("strict").alias("s"), F.bool_and("normalised").alias("n"))
    full = full.groupBy("method").agg(F.count_if("s").alias("full_strict"), F.count_if("n").alias("full_normalised"))
    per = hits.groupBy("method", "field").agg(
        F.count("*").alias("docs"), F.round(F.avg(F.col("strict").cast("int")) * 100, 1).alias("strict_acc"),
        F.round(F.avg(F.col("normalised").cast("int")) * 100, 1).alias("normalised_acc"),
    )
    return per.join(full, "method")


PRED_SQL = "pred AS (SELECT doc_id, quality::BIGINT AS actual, CAST(n_chars > 600 AS BIGINT) + CAST(contains(text, '@') AS BIGINT) AS predicted FROM documents JOIN labels USING (doc_id))"


def label_predictions(spark, d):
    guess = (F.col("n_chars") > 600).cast("bigint") + F.col("text").contains("@").cast("bigint")
    docs = table(spark, d, "documents").select("doc_id", guess.alias("predicted"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("bigint").alias("actual")), "doc_id")


@query(
    "agg_10_class_metrics",
    f"""
    WITH {PRED_SQL}, c AS (SELECT actual AS k FROM pred UNION SELECT predicted FROM pred),
    m AS (SELECT k AS class, (SELECT count(*) FROM pred WHERE actual = k) AS support, (SELECT count(*) FROM pred WHERE predicted = k) AS named, (SELECT count(*) FROM pred WHERE predicted = k AND actual = k) AS hits FROM c),
    r AS (SELECT *, CASE WHEN named > 0 THEN hits / named ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM m),
    f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM r)
    SELECT CAST(class AS VARCHAR) AS class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM f
    UNION ALL SELECT 'all', sum(support)::BIGINT, round(sum(hits) / sum(support), 6), round(avg(r), 6), round(sum(f * support) / sum(support), 6) FROM f WHERE support > 0
    """,
)
def class_metrics(spark, d):
    per = metrics.class_metrics(label_predictions(spark, d), "actual", "predicted")
    total = per.filter("support > 0").agg(
        F.sum("support").alias("support"), F.round(F.sum("hits") / F.sum("support"), 6).alias("precision"),
        F.round(F.avg("recall"), 6).alias("recall"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("f1"),
    )
    rows = per.select(F.col("class").cast("string").alias("class"), "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])
    return rows.unionByName(total.withColumn("class", F.lit("all")))


@query(
    "agg_11_confusion",
    f"""
    WITH {PRED_SQL}, c AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY 1, 2)
    SELECT actual, predicted, n, round(n / sum(n) OVER (PARTITION BY actual), 6) AS row_share, CASE WHEN actual <> predicted THEN row_number() OVER (PARTITION BY actual <> predicted ORDER BY n DESC, actual, predicted) ELSE 0 END AS confusion_rank FROM c
    """,
)
def confusion(spark, d):
    cells = metrics.confusion(label_predictions(spark, d), "actual", "predicted")
    off = rank.number_rows(
        cells.filter("actual <> predicted"), [], [F.desc("n"), F.asc("actual"), F.asc("predicted")], -F.col("n"), "confusion_rank"
    )
    return off.unionByName(cells.filter("actual = predicted").withColumn("confusion_rank", F.lit(0).cast("bigint")))


def vector_candidates(spark, d):
    """Each vector as a query; its components are candidate scores, the one of its class is positive."""
    e = table(spark, d, "embeddings")
    rows = e.select("vec_id", "label", F.posexplode("embedding").alias("cand", "v"))
    return rows.select(
        "vec_id", F.col("cand").cast("bigint").alias("cand"), F.round(F.col("v").cast("double"), 4).alias("score"),
        (F.col("cand") == F.col("label")).cast("int").alias("positive"),
    )


CAND_SQL = """
cand AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS cand, round(CAST(embedding[i] AS DOUBLE), 4) AS score, CAST(i - 1 = label AS INTEGER) AS positive FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
"""


@query(
    "agg_12_ranking_metrics",
    f"""
    WITH {CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cand) AS rn, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, cand) AS nx FROM cand),
    q AS (SELECT vec_id, min(rn) FILTER (positive = 1) AS pr, max(score - nx) FILTER (rn = 1) AS gap FROM r GROUP BY 1),
    g AS (SELECT score, sum(positive) AS pos, sum(1 - positive) AS neg FROM cand GROUP BY 1),
    t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)
    SELECT count(*) AS documents, round(avg(CAST(pr = 1 AS INTEGER)), 6) AS top1_accuracy, round(avg(CAST(pr <= 3 AS INTEGER)), 6) AS top3_accuracy, round(avg(1 / pr), 6) AS mrr,
      round(quantile_cont(round(gap, 6), 0.1) FILTER (pr = 1), 6) AS review_gap,
      (SELECT round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) FROM t) AS roc_auc, (SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) FROM t) AS average_precision
    FROM q WHERE pr IS NOT NULL
    """,
)
def ranking_metrics(spark, d):
    cands = vector_candidates(spark, d)
    summary = metrics.ranking_summary(metrics.ranking_per_query(cands, "vec_id", "score", "positive", "cand"))
    areas = metrics.curve_areas(cands, "score", "positive", -F.floor(F.col("score") * 100))
    return aggregate.side_by_side(summary, areas)


def flagged_items(spark, d):
    family = F.when(F.col("l_returnflag") == "N", F.lit("OCR_REQUIRED")).otherwise(F.lit("NATIVE_TEXT"))
    status = F.when(F.col("l_discount") < F.when(F.col("l_returnflag") == "N", 0.03).otherwise(0.07), F.lit("AUTO_READY")).otherwise(F.lit("REVIEW_REQUIRED"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", family.alias("family"), status.alias("status"), "l_tax", "l_quantity")


FLAG_SQL = """
fi AS (SELECT l_orderkey, l_suppkey, l_partkey, CASE l_returnflag WHEN 'N' THEN 'OCR_REQUIRED' ELSE 'NATIVE_TEXT' END AS family,
   CASE WHEN l_discount < CASE l_returnflag WHEN 'N' THEN 0.03::DOUBLE ELSE 0.07::DOUBLE END THEN 'AUTO_READY' ELSE 'REVIEW_REQUIRED' END AS status, l_tax, l_quantity FROM lineitem)
"""


@query(
    "agg_13_source_bias",
    f"""
    WITH {FLAG_SQL}, docs AS (SELECT l_orderkey, max(family) AS family FROM fi GROUP BY 1),
    c AS (SELECT count(*) AS rows_n, count(*) FILTER (status = 'AUTO_READY') AS ready_n, count(*) FILTER (status <> 'AUTO_READY') AS review_n, count(*) FILTER (family = 'OCR_REQUIRED') AS scanned_n,
       count(*) FILTER (family = 'NATIVE_TEXT') AS native_n, count(*) FILTER (family = 'OCR_REQUIRED' AND status = 'AUTO_READY') AS scanned_ready, count(*) FILTER (family = 'NATIVE_TEXT' AND status = 'AUTO_READY') AS native_ready,
       count(*) FILTER (family = 'OCR_REQUIRED' AND status <> 'AUTO_READY') AS scanned_review FROM fi),
    dd AS (SELECT count(*) AS docs_n, count(*) FILTER (family = 'OCR_REQUIRED') AS scanned_docs FROM docs),
    x AS (SELECT *, round(scanned_review / review_n, 4) AS scanned_review_share, round(round(native_ready / native_n, 4) - round(scanned_ready / scanned_n, 4), 4) AS ready_rate_gap,
       round(round(scanned_docs / docs_n, 4) - round(scanned_ready / ready_n, 4), 4) AS representation_gap FROM c, dd)
    SELECT *, CASE WHEN (scanned_review_share >= 0.65 AND ready_rate_gap >= 0.15) OR representation_gap >= 0.2 THEN 'HIGH' WHEN scanned_review_share >= 0.5 OR ready_rate_gap >= 0.1 OR representation_gap >= 0.1 THEN 'MEDIUM' ELSE 'LOW' END AS bias_level FROM x
    """,
)
def source_bias(spark, d):
    items = flagged_items(spark, d)
    docs = items.groupBy("l_orderkey").agg(F.max("family").alias("family"))
    return metrics.source_bias(items, docs, "family", "OCR_REQUIRED", "NATIVE_TEXT", "status", "AUTO_READY")


@query(
    "agg_14_quality_buckets",
    """
    WITH q AS (SELECT CASE l_returnflag WHEN 'N' THEN 'OCR_REQUIRED' WHEN 'A' THEN 'NATIVE_TEXT' ELSE 'OTHER' END AS family, CASE WHEN l_linestatus = 'O' OR l_linenumber > 2 THEN 'READY' ELSE 'NO_TEXT' END AS st,
       l_linenumber::BIGINT AS pages, least(l_linenumber, CAST(l_discount * 100 AS INTEGER))::BIGINT AS ok, CAST(l_quantity AS DOUBLE) / 50 AS conf FROM lineitem),
    b AS (SELECT CASE WHEN family = 'NATIVE_TEXT' THEN 'NATIVE_TEXT' WHEN family <> 'OCR_REQUIRED' THEN 'UNKNOWN' WHEN st <> 'READY' THEN 'OCR_NOT_READY' WHEN ok = 0 THEN 'OCR_FAILED'
       WHEN conf >= 0.85 AND pages = ok THEN 'OCR_HIGH' WHEN conf >= 0.65 AND (pages - ok) / pages <= 0.2 THEN 'OCR_MEDIUM' WHEN conf > 0 THEN 'OCR_LOW' ELSE 'OCR_UNSCORED' END AS bucket FROM q)
    SELECT bucket, count(*) AS n, list_position(['NATIVE_TEXT', 'OCR_HIGH', 'OCR_MEDIUM', 'OCR_LOW', 'OCR_UNSCORED', 'OCR_FAILED', 'OCR_NOT_READY', 'UNKNOWN'], bucket)::BIGINT AS position FROM b GROUP BY bucket
    """,
)
def quality_buckets(spark, d):
    family = F.when(F.col("l_returnflag") == "N", F.lit("OCR_REQUIRED")).when(F.col("l_returnflag") == "A", F.lit("NATIVE_TEXT")).otherwise(F.lit("OTHER"))
    state = F.when((F.col("l_linestatus") == "O") | (F.col("l_linenumber") > 2), F.lit("READY")).otherwise(F.lit("NO_TEXT"))
    ok = F.least(F.col("l_linenumber"), F.round(F.col("l_discount") * 100).cast("int"))
    bucket = metrics.quality_bucket(family, state, F.col("l_linenumber"), ok, F.col("l_linenumber") - ok, F.col("l_quantity") / 50)
    place = F.array_position(F.array(*[F.lit(b) for b in metrics.BUCKET_ORDER]), F.col("bucket"))
    rows = table(spark, d, "lineitem").select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return rows.withColumn("position", place.cast("bigint"))


def near_copy_tokens(spark, d):
    """Every labelled document against its reading: the text without its last sentence, digits misread."""
    docs = table(spark, d, "documents")
    # ASCII letters alone are raised, before the words are cut: a run of two and more is a word
    words = lambda c: F.regexp_extract_all(F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit("[A-Z0-9]{2,}"), F.lit(0))
    read = F.regexp_replace(F.replace("text", F.lit("7"), F.lit("1")), r"\.[^.]*\.[^.]*$", ".")
    return docs.select("doc_id", words(F.col("text")).alias("expected"), words(read).alias("observed"))


TOKEN_SQL = r"""
tk AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda w: length(w) >= 2) AS e,
   list_filter(regexp_split_to_array(regexp_replace(replace(text, '7', '1'), '\.[^.]*\.[^.]*$', '.'), '[^A-Za-z0-9]+'), lambda w: length(w) >= 2) AS o FROM documents),
ec AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, upper(unnest(e)) AS t FROM tk) GROUP BY 1, 2), oc AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, upper(unnest(o)) AS t FROM tk) GROUP BY 1, 2),
bc AS (SELECT doc_id, t, coalesce(ec.n, 0) AS e, coalesce(oc.n, 0) AS o FROM ec FULL JOIN oc USING (doc_id, t)),
ov AS (SELECT doc_id, sum(e)::BIGINT AS expected_n, sum(o)::BIGINT AS observed_n, sum(least(e, o))::BIGINT AS matched_n, CASE WHEN sum(e) = 0 THEN 1.0::DOUBLE ELSE sum(least(e, o)) / sum(e) END AS recall,
   CASE WHEN sum(o) = 0 THEN 0.0::DOUBLE ELSE sum(least(e, o)) / sum(o) END AS precision,
   CASE WHEN coalesce(sum(e) FILTER (regexp_matches(t, '[0-9]')), 0) = 0 THEN 1.0::DOUBLE ELSE sum(least(e, o)) FILTER (regexp_matches(t, '[0-9]')) / sum(e) FILTER (regexp_matches(t, '[0-9]')) END AS number_recall FROM bc GROUP BY 1)
"""


@query(
    "agg_15_token_overlap",
    f"""
    WITH {TOKEN_SQL} SELECT doc_id, expected_n, observed_n, matched_n, round(recall, 6) AS recall, round(precision, 6) AS precision, round(number_recall, 6) AS number_recall,
      round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1 FROM ov
    """,
)
def token_overlap(spark, d):
    out = metrics.multiset_overlap(near_copy_tokens(spark, d), "doc_id", "expected", "observed")
    return out.select("doc_id", "expected_n", "observed_n", "matched_n", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "number_recall", "f1")])


@query(
    "agg_16_group_summary",
    """
    SELECT l_suppkey, l_returnflag, count(*) AS rows_n, count(DISTINCT l_partkey) AS sources_n, count(*) FILTER (l_discount < 0.03::DOUBLE) AS pass_n, count(*) FILTER (l_tax > 0.05::DOUBLE) AS fail_n,
      round(avg(l_quantity), 4) AS mean_l_quantity, round(count(*) FILTER (l_discount < 0.03::DOUBLE) / count(*), 4) AS pass_rate, round(count(*) FILTER (l_tax > 0.05::DOUBLE) / count(*), 4) AS fail_rate FROM lineitem GROUP BY 1, 2
    """,
)
def group_summary(spark, d):
    shares = {"pass": F.col("l_discount") < 0.03, "fail": F.col("l_tax") > 0.05}
    return aggregate.group_summary(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_partkey", shares, ["l_quantity"])


@query(
    "agg_17_field_retention",
    r"""
    WITH f AS (SELECT doc_id, source, unnest(['code', 'date', 'maker']) AS field, unnest([[regexp_extract(text, '[0-9]{16}'), regexp_extract(text, '[0-9]{3}-[0-9]{4}')], [regexp_extract(text, '20[0-9]{2}')], [source]]) AS vals, upper(regexp_replace(replace(text, '7', '1'), '[^0-9A-Za-z]+', '', 'g')) AS obs FROM documents),
    v AS (SELECT doc_id, field, unnest(list_filter(vals, lambda x: x <> '')) AS v, obs FROM f),
    s AS (SELECT doc_id, field, round(avg(CASE WHEN contains(obs, upper(regexp_replace(v, '[^0-9A-Za-z]+', '', 'g'))) THEN 1.0 ELSE 0.0 END), 4) AS score, count(*) AS n FROM v GROUP BY 1, 2)
    SELECT doc_id, field, n AS expected_n, score, CASE WHEN score >= CASE field WHEN 'code' THEN 0.9 ELSE 0.8 END THEN 'ADMIT' WHEN score >= 0.5 THEN 'REVIEW' ELSE 'REJECT' END AS verdict FROM s
    """,
)
def field_retention(spark, d):
    observed = X.norm_key(F.replace("text", F.lit("7"), F.lit("1")), keep="0-9A-Z")
    expected = [
        F.struct(F.lit("code").alias("field"), F.array(F.regexp_extract("text", "[0-9]{16}", 0), F.regexp_extract("text", "[0-9]{3}-[0-9]{4}", 0)).alias("v"), F.lit(0.9).alias("admit")),
        F.struct(F.lit("date").alias("field"), F.array(F.regexp_extract("text", "20[0-9]{2}", 0)).alias("v"), F.lit(0.8).alias("admit")),
        F.struct(F.lit("maker").alias("field"), F.array(F.col("source")).alias("v"), F.lit(0.8).alias("admit")),
    ]
    docs = table(spark, d, "documents").select("doc_id", observed.alias("obs"), F.array(*expected).alias("e"))
    # scores stay inside the document's row: values of one field never meet a shuffle
    def score(e):
        vals = F.filter(e["v"], lambda x: x != "")
        hits = F.filter(vals, lambda x: F.contains(F.col("obs"), X.norm_key(x, keep="0-9A-Z")))
        return F.struct(e["field"].alias("field"), F.size(vals).cast("bigint").alias("expected_n"),
                        F.round(F.try_divide(F.size(hits), F.size(vals)), 4).alias("score"), e["admit"].alias("admit"))

    rows = docs.select("doc_id", F.inline(F.transform("e", score))).filter("expected_n > 0")
    verdict = metrics.field_verdict(F.col("score"), F.lit(1.0), F.col("admit"), 0.5)
    return rows.select("doc_id", "field", "expected_n", "score", verdict.alias("verdict"))


@query(
    "agg_18_family_weights",
    """
    WITH g AS (SELECT doc_id, sha256(text) AS sha, lang, CASE WHEN n_chars % 3 = 0 THEN 'ADMIT' WHEN n_chars % 3 = 1 THEN 'REVIEW' ELSE 'NOT_EVALUABLE' END AS st FROM documents),
    n AS (SELECT sha, count(*) FILTER (st = 'ADMIT') AS admitted, count(*) FILTER (st = 'REVIEW') AS review FROM g GROUP BY 1)
    SELECT doc_id, admitted, round(1 / (1 + admitted), 6) AS weight, CASE WHEN admitted > 0 THEN 'HAS_ADMITTED_FIELDS' WHEN review > 0 THEN 'REVIEW_REQUIRED' ELSE 'NOT_EVALUABLE' END AS pack_status FROM g JOIN n USING (sha)
    """,
)
def family_weights(spark, d):
    state = F.when(F.col("n_chars") % 3 == 0, F.lit("ADMIT")).when(F.col("n_chars") % 3 == 1, F.lit("REVIEW")).otherwise(F.lit("NOT_EVALUABLE"))
    fields = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), state.alias("st"))
    # counts per family are aggregated and joined back: a family of any size never sits in one window
    family = fields.groupBy("sha").agg(F.count_if(F.col("st") == "ADMIT").alias("admitted"), F.count_if(F.col("st") == "REVIEW").alias("review"))
    pack = rules.decide([(F.col("admitted") > 0, "HAS_ADMITTED_FIELDS"), (F.col("review") > 0, "REVIEW_REQUIRED")], "NOT_EVALUABLE")
    return fields.join(family, "sha").select("doc_id", "admitted", F.round(1 / (1 + F.col("admitted")), 6).alias("weight"), pack.alias("pack_status"))


@query(
    "agg_19_duplicate_keys",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def duplicate_keys(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return aggregate.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query(
    "agg_20_rank_pivot",
    """
    WITH s AS (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS rn FROM s)
    SELECT l_suppkey, max(CASE WHEN rn = 1 THEN l_partkey END) AS top1, max(CASE WHEN rn = 2 THEN l_partkey END) AS top2 FROM r WHERE rn <= 2 GROUP BY 1
    """,
)
def rank_pivot(spark, d):
    sold = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return aggregate.rank_pivot(sold, ["l_suppkey"], [F.desc("q"), F.asc("l_partkey")], "l_partkey")


@query(
    "agg_21_ordered_values",
    """
    WITH b AS (SELECT l_orderkey, min(l_linenumber * 1000000 + l_partkey) AS o, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 3)
    SELECT l_orderkey, string_agg(p_brand, '|' ORDER BY o) AS brands FROM b GROUP BY 1
    """,
)
def ordered_values(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "p_brand", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord")
    )
    return aggregate.ordered_values(li, ["l_orderkey"], "p_brand", "ord").select("l_orderkey", F.array_join("values", "|").alias("brands"))


@query(
    "agg_22_run_summary",
    """
    SELECT o_orderpriority AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders GROUP BY 1
    """,
)
def run_summary(spark, d):
    ok = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed")
    )


_STORES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")


@query("agg_23_store_overview", " UNION ALL ".join(f"SELECT '{t}' AS store, count(*) AS rows_n FROM {t}" for t in _STORES))
def store_overview(spark, d):
    return aggregate.row_counts({t: table(spark, d, t) for t in _STORES})
