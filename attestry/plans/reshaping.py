"""Reshape, flatten, generate."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import lines, mailing, reshape
from attestry.plans.common import LINES_SQL, WIDE_SQL, wide_master
from attestry.plans.registry import query, table

BIG = lambda c: F.col(c).cast("bigint").alias(c)


@query("rsh_1_flatten_master", f"WITH {WIDE_SQL} SELECT row_pos, depth, supplier, name, english_name, maker, org, cert_no, expiry FROM master")
def flatten_master(spark, d):
    long = reshape.flatten_master(wide_master(spark, d))
    return long.select("row_pos", BIG("depth"), "supplier", "name", "english_name", "maker", "org", "cert_no", "expiry")


@query(
    "rsh_2_paths",
    f"""
    WITH {WIDE_SQL} SELECT row_pos, depth, string_agg(name, ' > ') OVER (PARTITION BY row_pos ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM master
    """,
)
def paths(spark, d):
    return reshape.with_paths(reshape.flatten_master(wide_master(spark, d))).select("row_pos", BIG("depth"), "path")


@query(
    "rsh_3_fill_from_above",
    """
    WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) END AS v FROM events)
    SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND CURRENT ROW), '-') AS filled FROM e
    """,
)
def fill_from_above(spark, d):
    sheet = table(spark, d, "events").select(
        F.lit("main").alias("sheet"), "event_id", F.when(F.col("event_type") == "error", F.col("user_id").cast("string")).alias("v")
    )
    return reshape.fill_from_above(sheet, "sheet", "event_id", "v", chunk=1000).select(
        "event_id", F.coalesce("filled", F.lit("-")).alias("filled")
    )


_CELLS = r"""
cells AS (SELECT doc_id, string_split(text, '. ') AS c FROM documents WHERE contains(text, '@')),
ex AS (SELECT doc_id, unnest(c) AS cell, generate_subscripts(c, 1) AS i FROM cells),
good AS (SELECT doc_id, i, trim(cell) AS cell FROM ex WHERE length(trim(regexp_replace(cell, '\s+', ' ', 'g'))) > 1 AND lower(trim(cell)) NOT IN ('nan', 'none', 'nat', 'null', 'mail', 'e-mail', 'email', 'contact', 'supplier', 'remark')
    AND NOT regexp_matches(lower(trim(regexp_replace(cell, '\s+', ' ', 'g'))), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')),
hit AS (SELECT e.doc_id, e.i, list_distinct(list_transform(regexp_extract_all(e.cell, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x))) AS mails,
    coalesce((SELECT arg_max(g.cell, g.i) FROM good g WHERE g.doc_id = e.doc_id AND g.i < e.i), (SELECT arg_min(g.cell, g.i) FROM good g WHERE g.doc_id = e.doc_id)) AS sup FROM ex e),
m AS (SELECT regexp_replace(lower(trim(regexp_replace(sup, '\s+', ' ', 'g'))), 'x^', '') AS s, unnest(mails) AS email FROM hit WHERE len(mails) > 0)
"""
_K = "s"
for _w in X.LEGAL_WORDS:
    _K = f"replace({_K}, '{_w}', '')"


@query(
    "rsh_4_email_cells",
    rf"""
    WITH {_CELLS}, k AS (SELECT DISTINCT regexp_replace({_K}, '[^0-9a-zA-Z가-힣]', '', 'g') AS supplier_key, email FROM m)
    SELECT supplier_key, string_agg(email, '; ' ORDER BY email) AS emails FROM k WHERE supplier_key <> '' GROUP BY 1
    """,
)
def email_cells(spark, d):
    docs = table(spark, d, "documents").filter(F.col("text").contains("@"))
    found = reshape.email_cells(docs, "doc_id", F.split("text", r"\. "))
    return found.select("supplier_key", F.array_join(F.array_sort(F.split("emails", "; ")), "; ").alias("emails"))


ITEM_LABELS = {"maker": "maker", "issuer": "org", "expiry": "expiry"}


@query(
    "rsh_5_parse_items",
    """
    SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS supplier, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS item_index, s_name AS path,
      'M' || CAST(s_suppkey AS VARCHAR) AS maker, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'HQC' END AS org, '2026-01-31' AS expiry FROM supplier
    """,
)
def parse_items(spark, d):
    items = table(spark, d, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("supplier"), F.col("s_suppkey").alias("ord"), F.col("s_name").alias("path"),
        F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("maker"),
        F.when(F.col("s_suppkey") % 3 != 0, F.lit("HQC")).alias("org"), F.lit("2026-01-31").alias("expiry"),
    )
    bodies = mailing.render_bodies(items, ["supplier"], "ord", "path", {"maker": "maker", "issuer": "org", "expiry": "expiry"}, "Dear [SUPPLIER]<br>[ITEMS]</div>", per_message=100)
    parsed = reshape.parse_items(bodies, ["supplier"], "body", ITEM_LABELS)
    return parsed.withColumn("item_index", F.col("item_index").cast("bigint"))


@query(
    "rsh_6_pages_and_lines",
    r"""
    WITH raw AS (SELECT conv_id, turn + 1 AS page, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations),
    ok AS (SELECT conv_id, page, CAST(k + 1 AS BIGINT) AS line_no, trim(regexp_replace(ln, '\s+', ' ', 'g')) AS line FROM raw)
    SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY page, line_no) - 1 AS BIGINT) AS global_index, page, line_no, line FROM ok WHERE line <> ''
    """,
)
def pages_and_lines(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    rows = lines.page_lines(turns, "conv_id", "page", "text", header_lines=1)
    return rows.select("conv_id", BIG("global_index"), BIG("page"), BIG("line_no"), "line")


@query(
    "rsh_6_marked_text",
    r"""
    WITH m AS (SELECT doc_id, regexp_split_to_array(text, '\. ') AS parts FROM documents),
    p AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS page FROM m),
    raw AS (SELECT doc_id, page, unnest(string_split(chr(10) || t, chr(10))) AS ln, generate_subscripts(string_split(chr(10) || t, chr(10)), 1) AS line_no FROM p),
    ok AS (SELECT doc_id, page, line_no, trim(regexp_replace(ln, '\s+', ' ', 'g')) AS line FROM raw)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, line_no) - 1 AS BIGINT) AS global_index, CAST(page AS BIGINT) AS page, CAST(line_no AS BIGINT) AS line_no, md5(line) AS digest FROM ok WHERE line <> ''
    """,
)
def marked_text(spark, d):
    """Texts whose sentences are separate pages, told apart by page markers inside the text."""
    parts = F.transform(F.split("text", r"\. "), lambda t, i: F.concat(F.lit("[PAGE "), (i + 1).cast("string"), F.lit("]\n"), t))
    docs = table(spark, d, "documents").select("doc_id", F.array_join(parts, "").alias("text"))
    rows = lines.document_lines(docs, "text", ["doc_id"])
    return rows.select("doc_id", BIG("global_index"), BIG("page"), BIG("line_no"), F.md5("line").alias("digest"))


@query(
    "rsh_7_line_spans",
    rf"""
    WITH {LINES_SQL}, s AS (SELECT doc_id, gi, n, CASE n WHEN 1 THEN line WHEN 2 THEN line || ' ' || lead(line, 1) OVER w ELSE line || ' ' || lead(line, 1) OVER w || ' ' || lead(line, 2) OVER w END AS span
      FROM lines, (SELECT unnest([1, 2, 3]) AS n) WINDOW w AS (PARTITION BY doc_id, n ORDER BY gi))
    SELECT doc_id, gi AS first_index, CAST(n AS BIGINT) AS span_lines, md5(span) AS digest FROM s WHERE span IS NOT NULL
    """,
)
def line_spans(spark, d):
    rows = lines.line_spans(table(spark, d, "documents"), "text", ["doc_id"])
    return rows.select("doc_id", BIG("first_index"), BIG("span_lines"), F.md5("span").alias("digest"))


@query(
    "rsh_8_line_features",
    rf"""
    WITH {LINES_SQL} SELECT doc_id, line_no, md5('field=cert_no issuer=' || regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') || ' page=1 tenth=' || least(line_no // 10, 9)
      || ' digits=' || least(length(regexp_replace(line, '[^0-9]', '', 'g')), 9) || ' capitals=' || least(length(regexp_replace(line, '[^A-Z]', '', 'g')), 9)
      || ' signs=' || least(length(regexp_replace(line, '[^:/.-]', '', 'g')), 9) || ' dated=' || regexp_matches(line, '{lines.HAS_DATE}')
      || ' firm=' || regexp_matches(line, '{lines.COMPANY_SUFFIX}') || ' size=' || least(length(line) // 20, 9)
      || chr(10) || 'above ' || prev || chr(10) || 'here ' || line || chr(10) || 'below ' || next) AS digest
    FROM lines
    """,
)
def line_features(spark, d):
    rows = lines.document_lines(table(spark, d, "documents"), "text", ["doc_id", "source"])
    text = lines.feature_text("cert_no", F.col("source"), F.col("line"), F.col("prev"), F.col("next"), F.col("page"), F.col("line_no"))
    return rows.select("doc_id", BIG("line_no"), F.md5(text).alias("digest"))


@query(
    "rsh_9_flat_summary",
    """
    SELECT event_id, event_type AS org, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 2::BIGINT AS page_count,
      CAST(json_extract_string(props, '$.k') AS BIGINT) + 7 AS text_length FROM events
    """,
)
def flat_summary(spark, d):
    record = F.from_json(
        F.concat(
            F.lit('{"rule": {"org": "'), "event_type", F.lit('"}, "k": '), F.get_json_object("props", "$.k"),
            F.lit(', "pages": [{"page_no": 1, "char_count": '), F.get_json_object("props", "$.k"), F.lit('}, {"page": 2, "text_length": 7}]}'),
        ),
        "rule struct<org:string>, k bigint, pages array<struct<page:int,page_no:int,method:string,text_length:bigint,char_count:bigint>>",
    )
    rec = table(spark, d, "events").select("event_id", record.alias("r"))
    pages = F.transform(
        "r.pages",
        lambda p, i: F.struct(
            F.coalesce(p["page"], p["page_no"], i + 1).alias("page"), F.coalesce(p["method"], F.lit("")).alias("method"),
            F.coalesce(p["text_length"], p["char_count"], F.lit(0)).alias("text_length"),
        ),
    )
    flat = rec.select("event_id", F.col("r.rule.org").alias("org"), F.col("r.k").alias("k"), pages.alias("pages"))
    total = F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + p["text_length"])
    return flat.select("event_id", "org", "k", F.size("pages").cast("bigint").alias("page_count"), total.alias("text_length"))


@query(
    "rsh_10_keywords",
    f"""
    WITH {WIDE_SQL}, w AS (SELECT row_pos, 'cert_no' AS kind, cert_no AS v, 60 AS wt FROM master UNION ALL SELECT row_pos, 'english_name', english_name, 18 FROM master
      UNION ALL SELECT row_pos, 'name', name, 16 FROM master UNION ALL SELECT row_pos, 'maker', maker, 12 FROM master
      UNION ALL SELECT row_pos, 'org', org, 8 FROM master UNION ALL SELECT row_pos, 'supplier', supplier, 6 FROM master)
    SELECT row_pos, kind, lower(v) AS word, CAST(max(wt) AS BIGINT) AS weight FROM w WHERE v IS NOT NULL AND length(v) >= 2 GROUP BY 1, 2, 3
    """,
)
def keywords(spark, d):
    rows = reshape.master_levels(wide_master(spark, d))
    weights = {"cert_no": 60, "english_name": 18, "name": 16, "maker": 12, "org": 8, "supplier": 6}
    return reshape.weighted_keywords(rows, "row_pos", weights).withColumn("weight", F.col("weight").cast("bigint"))


# Table-specific patterns of the demo: phone and card numbers stand for certificate numbers.
PRODUCT_PATTERNS = {
    "code": r"[0-9]{3}-[0-9]{4}|[0-9]{16}", "product_header": "(?i)ther", "cert_header": "(?i)tion nt|sh the", "halal_id": r"[A-Z][0-9]{4,7}",
    "product_code": r"[0-9]{8}", "company": "(?i)ltd|inc[.]", "generic": r"(?i)^(page|total|no)[ .0-9]*$",
}
_P = PRODUCT_PATTERNS


@query(
    "rsh_11_product_rows",
    rf"""
    WITH {LINES_SQL},
    h AS (SELECT *, max(CASE WHEN regexp_matches(line, '{_P["product_header"]}') OR regexp_matches(line, '{_P["cert_header"]}') THEN gi END)
            OVER (PARTITION BY doc_id ORDER BY gi ROWS UNBOUNDED PRECEDING) AS above, count(*) FILTER (regexp_matches(line, '{_P["code"]}')) OVER (PARTITION BY doc_id) AS code_lines FROM lines),
    c AS (SELECT doc_id, gi, code_lines, coalesce(above, greatest(0, gi - 8)) AS head, list_distinct(regexp_extract_all(line, '{_P["code"]}')) AS codes FROM h WHERE regexp_matches(line, '{_P["code"]}')),
    n AS (SELECT c.doc_id, c.gi, l.gi AS at_gi, l.line, round(CASE WHEN l.gi < c.gi THEN 2.0 ELSE 0 END + greatest(0.0, 2.5 - (c.gi - l.gi) * 0.55) - CASE WHEN regexp_matches(l.line, '{_P["company"]}') THEN 2.5 ELSE 0 END
            - CASE WHEN regexp_matches(l.line, '{_P["product_header"]}') THEN 3.0 ELSE 0 END + CASE WHEN length(l.line) <= 180 THEN 0.5 ELSE 0 END
            + CASE WHEN regexp_matches(l.line, '^\s*[0-9]+[.)]') THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches(l.line, '{_P["code"]}') THEN 1.0 ELSE 0 END, 4) AS score
          FROM c JOIN lines l ON l.doc_id = c.doc_id AND l.gi BETWEEN greatest(c.head, c.gi - 4) AND c.gi
          WHERE NOT regexp_matches(l.line, '{_P["generic"]}') AND NOT regexp_matches(l.line, '{_P["cert_header"]}')
            AND length(regexp_replace(upper(l.line), '[^A-Z0-9가-힣]+', '', 'g')) >= 3 AND length(regexp_replace(l.line, '\P{{L}}', '', 'g')) >= 2
            AND length(regexp_replace(l.line, '[^0-9]', '', 'g')) <= 2 * length(regexp_replace(l.line, '\P{{L}}', '', 'g'))),
    b AS (SELECT doc_id, gi, line AS product FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, gi ORDER BY score DESC, at_gi DESC) AS rn FROM n) WHERE rn = 1),
    blk AS (SELECT c.doc_id, c.gi, string_agg(l.line, ' | ' ORDER BY l.gi) AS block FROM c JOIN lines l ON l.doc_id = c.doc_id AND l.gi BETWEEN greatest(c.head, c.gi - 4) AND c.gi + 2 GROUP BY 1, 2),
    r AS (SELECT c.doc_id, c.gi, unnest(c.codes) AS code, c.code_lines, hl.line AS header_line, coalesce(b.product, '') AS product, block FROM c LEFT JOIN b ON b.doc_id = c.doc_id AND b.gi = c.gi
          JOIN lines hl ON hl.doc_id = c.doc_id AND hl.gi = c.head JOIN blk ON blk.doc_id = c.doc_id AND blk.gi = c.gi),
    s AS (SELECT *, round(greatest(0.0, least(1.0, CASE WHEN product <> '' THEN 0.32 ELSE 0 END + CASE WHEN regexp_matches(header_line, '{_P["product_header"]}') THEN 0.18 ELSE 0 END
            + CASE WHEN regexp_matches(header_line, '{_P["cert_header"]}') THEN 0.22 ELSE 0 END + CASE WHEN regexp_matches(block, '{_P["halal_id"]}') THEN 0.08 ELSE 0 END
            + CASE WHEN regexp_matches(block, '{_P["product_code"]}') THEN 0.05 ELSE 0 END + CASE WHEN code_lines >= 2 THEN 0.16 ELSE 0 END
            - CASE WHEN product = '' THEN 0.25 ELSE 0 END - CASE WHEN regexp_matches(product, '{_P["company"]}') THEN 0.12 ELSE 0 END)), 4)::DOUBLE AS row_score FROM r),
    f AS (SELECT *, regexp_replace(code, '[^0-9]', '', 'g') AS code_key, row_number() OVER (PARTITION BY doc_id, regexp_replace(code, '[^0-9]', '', 'g') ORDER BY row_score DESC, gi) AS rn FROM s)
    SELECT doc_id, 1::BIGINT AS page, code_key, CAST(gi AS BIGINT) AS line_index, md5(product) AS product_digest, row_score,
      CASE WHEN row_score >= 0.72 THEN 'AUTO_READY' WHEN row_score >= 0.48 THEN 'REVIEW_REQUIRED' ELSE 'CANDIDATE_ONLY' END AS row_status FROM f WHERE rn = 1
    """,
)
def product_rows(spark, d):
    rows = reshape.product_rows(table(spark, d, "documents"), "doc_id", "text", PRODUCT_PATTERNS, lines.PAGE_MARKER)
    return rows.select(
        "doc_id", BIG("page"), "code_key", BIG("line_index"), F.md5(F.coalesce("product", F.lit(""))).alias("product_digest"), "row_score", "row_status"
    )


@query(
    "rsh_12_page_choice",
    r"""
    WITH p AS (SELECT conv_id, turn, CASE WHEN length(trim(text)) >= 200 THEN trim(text) WHEN turn % 4 = 3 THEN '' ELSE trim(replace(text, 'e', 'c')) END AS t, length(trim(text)) >= 200 AS direct, turn % 4 = 3 AS broken,
       CAST(length(text) % 100 AS DOUBLE) AS conf FROM conversations),
    d AS (SELECT conv_id, count(*) FILTER (direct) AS native_pages, count(*) FILTER (NOT direct) AS scanned_pages, count(*) FILTER (NOT direct AND broken) AS failed_pages,
      round(coalesce(avg(conf) FILTER (NOT direct), -1), 6) AS mean_confidence, CAST(sum(length(t)) AS BIGINT) AS text_length,
      CASE WHEN count(*) FILTER (NOT direct AND broken) > 0 AND sum(length(t)) = 0 THEN 'OCR_ERROR' WHEN sum(length(t)) = 0 THEN 'NO_TEXT' WHEN sum(length(t)) < 400 THEN 'LOW_TEXT' ELSE 'READY' END AS status
      FROM p GROUP BY conv_id),
    t AS (SELECT conv_id, CAST(turn // 500 AS BIGINT) AS part, md5(string_agg('[PAGE ' || CAST(turn + 1 AS VARCHAR) || ']' || chr(10) || t, chr(10) ORDER BY turn)) AS digest FROM p GROUP BY 1, 2)
    SELECT conv_id, native_pages, scanned_pages, failed_pages, mean_confidence, text_length, part, digest, status FROM d JOIN t USING (conv_id)
    """,
)
def page_choice(spark, d):
    turns = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text").alias("native"), F.when(F.col("turn") % 4 != 3, F.replace("text", F.lit("e"), F.lit("c"))).alias("scanned"),
        (F.length("text") % 100).cast("double").alias("conf"),
    )
    pages, docs = reshape.choose_pages(turns, "conv_id", "turn", "native", "scanned", "conf", 200, 400)
    text = reshape.join_pages(pages, "conv_id", "turn", "text")
    return docs.join(text, "conv_id").select(
        "conv_id", "native_pages", "scanned_pages", "failed_pages", F.round(F.coalesce("mean_confidence", F.lit(-1.0)), 6).alias("mean_confidence"),
        "text_length", BIG("part"), F.md5("text").alias("digest"), "status",
    )
