"""Filters, predicates and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.functions import text as X
from attestry.operators import filters, lines, reshape, rules
from attestry.plans.common import LINES_SQL, WIDE_SQL, wide_master
from attestry.plans.registry import query, table


@query(
    "flt_1_valid_names",
    """
    SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Name of material' WHEN 1 THEN 'SUPPLIER' WHEN 2 THEN '-' ELSE p_name END AS name FROM part)
    WHERE name NOT IN ('Name of material', 'SUPPLIER', '-')
    """,
)
def valid_names(spark, d):
    k = F.col("p_partkey") % 5
    name = F.when(k == 0, F.lit("Name of material")).when(k == 1, F.lit("SUPPLIER")).when(k == 2, F.lit("-")).otherwise(F.col("p_name"))
    named = table(spark, d, "part").select("p_partkey", name.alias("name"))
    return named.filter(filters.valid_material(F.col("name")) & ~filters.cell_noise(F.col("name")))


@query(
    "flt_2_level_search",
    f"""
    WITH {WIDE_SQL}, hits AS (SELECT *, row_number() OVER (PARTITION BY row_pos ORDER BY depth) AS rn FROM master
      WHERE contains(lower(concat_ws(' ', name, maker, cert_no)), 'maker 1'))
    SELECT row_pos, depth, name, maker, cert_no FROM hits WHERE rn = 1 ORDER BY row_pos LIMIT 200
    """,
)
def level_search(spark, d):
    long = reshape.flatten_master(wide_master(spark, d)).withColumn("depth", F.col("depth").cast("bigint"))
    return filters.search_levels(long, "Maker 1", "row_pos", "depth", ["name", "maker", "cert_no"], 200)


@query(
    "flt_3_scannable",
    r"""
    WITH a AS (SELECT page_id, length(html) AS size, CASE page_id % 5 WHEN 0 THEN 'cert.PDF' WHEN 1 THEN 'logo.png' WHEN 2 THEN 'scan.jpg' WHEN 3 THEN 'notes.docx' ELSE 'Page.TIF' END AS name FROM pages)
    SELECT page_id, name, name = 'cert.PDF' AS auto_read FROM a WHERE name IN ('cert.PDF', 'Page.TIF') OR (name = 'scan.jpg' AND size >= 20000)
    """,
)
def scannable(spark, d):
    k = F.col("page_id") % 5
    name = (
        F.when(k == 0, F.lit("cert.PDF")).when(k == 1, F.lit("logo.png")).when(k == 2, F.lit("scan.jpg"))
        .when(k == 3, F.lit("notes.docx")).otherwise(F.lit("Page.TIF"))
    )
    files = table(spark, d, "pages").select("page_id", name.alias("name"), F.length("html").alias("size"))
    return files.filter(filters.scannable(F.col("name"), F.col("size"))).select(
        "page_id", "name", (X.file_ext(F.col("name")) == ".pdf").alias("auto_read")
    )


@query(
    "flt_4_bounces",
    """
    SELECT conv_id, turn, (conv_id + turn) % 7 = 0 OR regexp_matches(lower(text), 'postmaster|undeliverable|returned mail') AS bounced FROM conversations
    """,
)
def bounces(spark, d):
    subject = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit("Delivery Status Notification (failure)")).otherwise(F.lit("Re: request"))
    return table(spark, d, "conversations").select("conv_id", "turn", filters.bounced(subject, F.col("role"), F.col("text")).alias("bounced"))


DOC_MARKERS = ["license", "copyright", "terms of use"]


@query(
    "flt_5_non_certificates",
    "SELECT doc_id FROM documents WHERE regexp_matches(upper(source || ' ' || text), 'LICENSE|COPYRIGHT|TERMS OF USE')",
)
def non_certificates(spark, d):
    blob = F.upper(F.concat_ws(" ", "source", "text"))
    return table(spark, d, "documents").filter(rules.any_contained(blob, [m.upper() for m in DOC_MARKERS])).select("doc_id")


def reviewed(spark, d):
    """Documents with their label and fields as a scanner would leave them."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", "text", "lang", "source", "quality",
        F.when(F.col("quality") == 0, F.lit("LOW_CONFIDENCE")).when(F.col("quality") == 1, F.lit("RULE_MATCHED")).otherwise(F.lit("NO_TEXT")).alias("parse_status"),
        F.when(F.col("lang") == "de", F.lit("UNKNOWN")).when(F.col("lang") == "fr", F.lit("BPJPH")).otherwise(F.upper("lang")).alias("org"),
        F.regexp_extract("text", r"[0-9]{3}-[0-9]{4}", 0).alias("cert_no"),
        F.when(F.col("text").contains("@"), F.lit("2026-01-01")).otherwise(F.lit("")).alias("expiry"),
        F.when(F.length("text") % 3 == 0, F.lit("")).otherwise(F.col("source")).alias("maker"),
    )


REVIEWED_SQL = """
rev AS (SELECT doc_id, text, lang, source, quality, CASE quality WHEN 0 THEN 'LOW_CONFIDENCE' WHEN 1 THEN 'RULE_MATCHED' ELSE 'NO_TEXT' END AS parse_status,
   CASE lang WHEN 'de' THEN 'UNKNOWN' WHEN 'fr' THEN 'BPJPH' ELSE upper(lang) END AS org, regexp_extract(text, '[0-9]{3}-[0-9]{4}') AS cert_no,
   CASE WHEN contains(text, '@') THEN '2026-01-01' ELSE '' END AS expiry, CASE WHEN length(text) % 3 = 0 THEN '' ELSE source END AS maker
   FROM documents LEFT JOIN labels USING (doc_id))
"""


@query(
    "flt_6_problem_cases",
    f"""
    WITH {REVIEWED_SQL}, r AS (SELECT *, list_filter([CASE WHEN parse_status = 'LOW_CONFIDENCE' THEN 'low_confidence' END,
      CASE WHEN org <> 'UNKNOWN' AND cert_no = '' THEN 'no_cert_no' END,
      CASE WHEN org NOT IN ('UNKNOWN', 'BPJPH') AND expiry = '' THEN 'no_expiry' END,
      CASE WHEN org <> 'UNKNOWN' AND maker = '' THEN 'no_maker' END,
      CASE WHEN org = 'UNKNOWN' THEN 'unknown_org' END], lambda x: x IS NOT NULL) AS why FROM rev WHERE parse_status <> 'NO_TEXT' AND length(trim(text)) >= 80),
    k AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM r WHERE len(why) > 0),
    p AS (SELECT doc_id, array_to_string(why, ' / ') AS reasons, CAST(CASE WHEN list_contains(why, 'no_cert_no') THEN 35 ELSE 0 END + CASE WHEN list_contains(why, 'no_maker') THEN 25 ELSE 0 END
      + CASE WHEN list_contains(why, 'unknown_org') THEN 18 ELSE 0 END + CASE WHEN list_contains(why, 'low_confidence') THEN 10 ELSE 0 END AS BIGINT) AS priority FROM k WHERE rn = 1)
    SELECT * FROM p ORDER BY priority DESC, doc_id LIMIT 100
    """,
)
def problem_cases(spark, d):
    known = F.col("org") != "UNKNOWN"
    why = rules.reasons([
        (F.col("parse_status") == "LOW_CONFIDENCE", "low_confidence"),
        (known & (F.col("cert_no") == ""), "no_cert_no"),
        (known & (F.col("org") != "BPJPH") & (F.col("expiry") == ""), "no_expiry"),
        (known & (F.col("maker") == ""), "no_maker"),
        (~known, "unknown_org"),
    ])
    cases = reviewed(spark, d).filter((F.col("parse_status") != "NO_TEXT") & (F.length(F.trim("text")) >= 80))
    cases = cases.select("doc_id", F.sha2("text", 256).alias("sha"), why.alias("why")).filter(F.size("why") > 0)
    first = cases.groupBy("sha").agg(F.min_by(F.struct("doc_id", "why"), "doc_id").alias("c")).select("c.*")
    weight = rules.points([
        (F.array_contains("why", "no_cert_no"), 35), (F.array_contains("why", "no_maker"), 25),
        (F.array_contains("why", "unknown_org"), 18), (F.array_contains("why", "low_confidence"), 10),
    ])
    ranked = first.select("doc_id", F.array_join("why", " / ").alias("reasons"), weight.cast("bigint").alias("priority"))
    return ranked.orderBy(F.desc("priority"), "doc_id").limit(100)


@query(
    "flt_7_issue_reasons",
    f"""
    WITH {REVIEWED_SQL} SELECT doc_id, array_to_string(list_filter([CASE WHEN org = 'UNKNOWN' THEN 'org_unknown' END,
      CASE WHEN parse_status IN ('LOW_CONFIDENCE', 'NO_TEXT') THEN 'status_' || parse_status END, CASE WHEN coalesce(quality, 0) = 0 THEN 'confidence_low' END,
      CASE WHEN org NOT IN ('BPJPH', 'UNKNOWN') AND cert_no = '' THEN 'no_cert_no' END, CASE WHEN org NOT IN ('BPJPH', 'UNKNOWN') AND expiry = '' THEN 'no_expiry' END,
      CASE WHEN maker = '' THEN 'no_maker' END, CASE WHEN length(trim(text)) < 80 THEN 'short_text' END,
      CASE WHEN quality = 1 AND maker = '' THEN 'changed_since_saved' END, CASE WHEN lang = 'es' AND source = 'src1' THEN 'text_image_conflict' END], lambda x: x IS NOT NULL), ' / ') AS reasons FROM rev
    """,
)
def issue_reasons(spark, d):
    dated = ~F.col("org").isin("BPJPH", "UNKNOWN")
    why = rules.reasons([
        (F.col("org") == "UNKNOWN", "org_unknown"),
        (F.col("parse_status") == "LOW_CONFIDENCE", "status_LOW_CONFIDENCE"),
        (F.col("parse_status") == "NO_TEXT", "status_NO_TEXT"),
        (F.coalesce("quality", F.lit(0)) == 0, "confidence_low"),
        (dated & (F.col("cert_no") == ""), "no_cert_no"),
        (dated & (F.col("expiry") == ""), "no_expiry"),
        (F.col("maker") == "", "no_maker"),
        (F.length(F.trim("text")) < 80, "short_text"),
        ((F.col("quality") == 1) & (F.col("maker") == ""), "changed_since_saved"),
        ((F.col("lang") == "es") & (F.col("source") == "src1"), "text_image_conflict"),
    ])
    return reviewed(spark, d).select("doc_id", F.array_join(why, " / ").alias("reasons"))


@query(
    "flt_8_eligible_lines",
    rf"""
    WITH {LINES_SQL} SELECT doc_id, line_no, f AS field FROM lines, (SELECT unnest(['cert_no', 'expiry_date', 'manufacturer']) AS f)
    WHERE length(line) BETWEEN 2 AND 280 AND CASE f WHEN 'cert_no' THEN regexp_matches(line, '[0-9]') OR regexp_matches(upper(line), 'CERT|REGISTRATION')
      WHEN 'expiry_date' THEN regexp_matches(upper(line), 'VALID|EXPIR|UNTIL|PERIOD|DATE')
      ELSE regexp_matches(line, '[A-Za-z가-힣]') AND length(regexp_replace(upper(line), '[^A-Z0-9가-힣]+', '', 'g')) >= 3 END
    """,
)
def eligible_lines(spark, d):
    rows = lines.document_lines(table(spark, d, "documents"), "text", ["doc_id"])
    fields = ["cert_no", "expiry_date", "manufacturer"]
    fit = [F.when(lines.eligible(f, F.col("line"), F.col("page")), F.lit(f)) for f in fields]
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.explode(F.array_compact(F.array(*fit))).alias("field"))


@query(
    "flt_9_listing",
    """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100
    """,
)
def listing(spark, d):
    rows = filters.listing(
        table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": None},
        [F.desc("o_orderdate"), F.desc("o_orderkey")], 100,
    )
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "flt_10_footer_dates",
    """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '2027-03-15' ELSE '' END AS dates FROM documents
    """,
)
def footer_dates(spark, d):
    stamp = F.when(F.col("doc_id") % 2 == 0, F.lit("\nVALID UNTIL 15 March 2027\n")).otherwise(F.lit("\nF.8.2-01/B-0/ 06 Oktober 2023\n"))
    found = D.find_dates(F.concat(F.col("text"), stamp))
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(F.transform(found, lambda x: x["date"].cast("string")), ",").alias("dates")
    )


@query(
    "flt_11_not_yet_sent",
    """
    SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders l WHERE l.o_custkey = o.o_custkey AND l.o_orderpriority = o.o_orderpriority AND l.o_orderstatus = 'F')
    """,
)
def not_yet_sent(spark, d):
    orders = table(spark, d, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    log = orders.select(*keys, (F.col("o_orderstatus") == "F").alias("success"))
    return filters.not_yet_sent(orders.select("o_orderkey", *keys), log, keys).select("o_orderkey")


@query(
    "flt_12_class_sample",
    """
    SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || 'scan-1'), doc_id) AS rn
      FROM documents WHERE source IN ('src1', 'src2', 'src5') AND length(text) >= 100) WHERE rn <= 12
    """,
)
def class_sample(spark, d):
    docs = table(spark, d, "documents").filter(F.length("text") >= 100).select("doc_id", "source")
    return filters.per_class_sample(docs, ["src1", "src2", "src5"], "source", "doc_id", 12, "scan-1")


@query(
    "flt_13_point_lookup",
    f"""
    WITH {WIDE_SQL}, k AS (SELECT row_pos, d AS depth FROM roots, (SELECT unnest([0, 4, 9]) AS d))
    SELECT k.row_pos, CAST(k.depth AS BIGINT) AS depth, coalesce(name, '-') AS name,
      CASE WHEN k.depth > 4 THEN 'OUT_OF_RANGE' WHEN m.name IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status
    FROM k LEFT JOIN master m ON m.row_pos = k.row_pos AND m.depth = k.depth
    """,
)
def point_lookup(spark, d):
    wide = wide_master(spark, d)
    keys = wide.select("row_pos", F.explode(F.array(F.lit(0), F.lit(4), F.lit(9))).alias("depth"))
    rows = reshape.flatten_master(wide).select("row_pos", "depth", "name")
    found = filters.lookup(keys, rows, ["row_pos", "depth"], "name")
    return found.select("row_pos", F.col("depth").cast("bigint").alias("depth"), X.to_dash(F.col("name")).alias("name"), "status")
