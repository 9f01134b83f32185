"""Normalisers and scalar derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.functions import text as X
from attestry.operators import mailing, rules
from attestry.plans.registry import query, table

TERM_STOPS = ("certificate", "request", "valid", "until")


@query(
    "prj_1_missing_tokens",
    """
    SELECT doc_id, CASE WHEN lower(trim(v)) IN ('', '-', 'nan', 'none', 'nat', 'null') THEN '-' ELSE trim(v) END AS cleaned
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' NaN ' WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 4 = 2 THEN ' None'
                 ELSE '  ' || source || ' ' END AS v FROM documents)
    """,
)
def missing_tokens(spark, d):
    raw = (
        F.when(F.col("doc_id") % 4 == 0, F.lit(" NaN "))
        .when(F.col("doc_id") % 4 == 1, F.lit(""))
        .when(F.col("doc_id") % 4 == 2, F.lit(" None"))
        .otherwise(F.concat(F.lit("  "), "source", F.lit(" ")))
    )
    return table(spark, d, "documents").select("doc_id", X.to_dash(raw).alias("cleaned"))


@query(
    "prj_2_unicode_form",
    r"""
    SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS digest FROM documents
    """,
)
def unicode_form(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.nfkc(F.col("text"))).alias("digest"))


_ENTITY_SQL = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
for _word in X.LEGAL_WORDS:
    _ENTITY_SQL = f"replace({_ENTITY_SQL}, '{_word}', '')"
_ENTITY_SQL = f"regexp_replace({_ENTITY_SQL}, '[^0-9a-zA-Z가-힣]', '', 'g')"


@query(
    "prj_3_entity_key",
    f"""
    SELECT name, {_ENTITY_SQL.format('name')} AS entity_key FROM (
      SELECT c_name || ' Co., Ltd' AS name FROM customer
      UNION ALL SELECT '(주) ' || s_name || ' INC.' FROM supplier)
    """,
)
def entity_key(spark, d):
    names = (
        table(spark, d, "customer").select(F.concat("c_name", F.lit(" Co., Ltd")).alias("name"))
        .unionAll(table(spark, d, "supplier").select(F.concat(F.lit("(주) "), "s_name", F.lit(" INC.")).alias("name")))
    )
    return names.select("name", X.entity_key(F.col("name")).alias("entity_key"))


@query(
    "prj_4_key_family",
    r"""
    SELECT p_partkey, regexp_replace(upper(v), '[^A-Z0-9가-힣]+', '', 'g') AS compact,
      trim(regexp_replace(upper(v), '[^A-Z0-9가-힣]+', ' ', 'g')) AS spaced,
      regexp_replace(upper(v), '[^A-Z0-9]+', '', 'g') AS ascii_only,
      regexp_replace(lower(v), '[^0-9a-z가-힣]+', '', 'g') AS lower_key
    FROM (SELECT p_partkey, p_name || '-' || p_brand || ' (원료)' AS v FROM part)
    """,
)
def key_family(spark, d):
    v = F.concat("p_name", F.lit("-"), "p_brand", F.lit(" (원료)"))
    return table(spark, d, "part").select(
        "p_partkey",
        X.norm_key(v).alias("compact"),
        X.norm_key(v, sep=" ").alias("spaced"),
        X.norm_key(v, keep="A-Z0-9").alias("ascii_only"),
        X.norm_key(v, case="lower", keep="0-9a-z가-힣").alias("lower_key"),
    )


@query(
    "prj_5_scan_cleanup",
    r"""
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
           '^\s+|\s+$', '', 'g'))) AS digest,
      regexp_replace(replace('VALID 2O' || right(CAST(doc_id AS VARCHAR), 1) || 'O8', '2O', '20'), 'O([0-9])', '0\1', 'g') AS repaired
    FROM documents
    """,
)
def scan_cleanup(spark, d):
    stamp = F.concat(F.lit("VALID 2O"), F.right(F.col("doc_id").cast("string"), F.lit(1)), F.lit("O8"))
    return table(spark, d, "documents").select(
        "doc_id", F.md5(X.clean_scan(F.col("text"))).alias("digest"), X.repair_digits(stamp).alias("repaired")
    )


@query(
    "prj_6_company_core",
    f"""
    SELECT name, regexp_replace(regexp_replace(upper(name), '[^A-Z0-9]+', '', 'g'), '^(.+?)(?:{"|".join(X.LEGAL_SUFFIXES)})*$', '\\1') AS core
    FROM (SELECT s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Company Limited' WHEN 2 THEN ' Corp. Inc' ELSE '' END AS name
          FROM supplier)
    """,
)
def company_core(spark, d):
    tail = (
        F.when(F.col("s_suppkey") % 4 == 0, F.lit(" Pvt. Ltd."))
        .when(F.col("s_suppkey") % 4 == 1, F.lit(" Company Limited"))
        .when(F.col("s_suppkey") % 4 == 2, F.lit(" Corp. Inc"))
        .otherwise(F.lit(""))
    )
    return (
        table(spark, d, "supplier").select(F.concat("s_name", tail).alias("name"))
        .select("name", X.company_core(F.col("name")).alias("core"))
    )


@query(
    "prj_7_cert_no_key",
    r"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN body ELSE 'ID' || body END AS raw_key, body AS match_key,
      CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS variants
    FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 11, '0') AS body FROM orders)
    """,
)
def cert_no_key(spark, d):
    body = F.lpad(F.col("o_orderkey").cast("string"), 11, "0")
    raw = F.when(F.col("o_orderkey") % 2 == 0, body).otherwise(F.concat(F.lit("id-"), body))
    return table(spark, d, "orders").select(
        "o_orderkey",
        X.norm_key(raw).alias("raw_key"),
        X.cert_no_key(raw).alias("match_key"),
        F.size(X.cert_no_variants(raw)).cast("bigint").alias("variants"),
    )


def styled_dates(orders):
    """Order dates, moved into the 2020s, written in six notations."""
    day = F.add_months(F.to_date("o_orderdate"), 300)
    style = F.col("o_orderkey") % 6
    text = (
        F.when(style == 0, F.date_format(day, "yyyy.M.d"))
        .when(style == 1, F.date_format(day, "d/M/yyyy"))
        .when(style == 2, F.concat(F.upper(F.date_format(day, "MMMM")), F.date_format(day, " d"), F.lit("th, "), F.date_format(day, "yyyy")))
        .when(style == 3, F.date_format(day, "dd MMM yyyy"))
        .when(style == 4, F.concat(F.lit("~"), F.date_format(day, "yy.MM.dd")))
        .otherwise(F.concat(F.date_format(day, "yyyy"), F.lit("-02-31")))
    )
    return orders.select("o_orderkey", text.alias("written"))


@query(
    "prj_8_parse_date",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL
      ELSE strftime(CAST(o_orderdate AS DATE) + INTERVAL 300 MONTH, '%Y-%m-%d') END AS parsed FROM orders
    """,
)
def parse_date(spark, d):
    return styled_dates(table(spark, d, "orders")).select(
        "o_orderkey", D.parse_date_text(F.col("written")).cast("string").alias("parsed")
    )


@query(
    "prj_9_date_repair",
    """
    SELECT o_orderkey, CAST(strftime(CAST(o_orderdate AS DATE) + INTERVAL 300 MONTH, '%Y-%m-%d') AS VARCHAR) AS parsed FROM orders
    """,
)
def date_repair(spark, d):
    day = F.add_months(F.to_date("o_orderdate"), 300)
    month, rest, year = F.date_format(day, "MMMM"), F.date_format(day, " d"), F.date_format(day, "yyyy")
    torn = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(month, rest, F.lit(" \n TH, "), year))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(month, rest, F.lit("°, "), year))
        .otherwise(F.concat(F.ltrim(rest), F.lit("º "), month, F.lit(" "), year))
    )
    return table(spark, d, "orders").select(
        "o_orderkey", D.parse_date_text(D.repair_date_text(torn)).cast("string").alias("parsed")
    )


@query(
    "prj_10_html_lines",
    r"""
    WITH raw AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<br\s*/?>|</div\s*>|</p\s*>|\r', chr(10), 'g'), '<[^>]+>', '', 'g') AS t FROM pages),
    un AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&middot;', chr(183)), '&copy;', chr(169)), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM raw),
    ln AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS a FROM un)
    SELECT page_id, CAST(len(a) AS BIGINT) AS line_count, md5(array_to_string(a, chr(10))) AS digest FROM ln
    """,
)
def html_lines(spark, d):
    lines = table(spark, d, "pages").select("page_id", X.html_lines(F.col("html")).alias("a"))
    return lines.select(
        "page_id", F.size("a").cast("bigint").alias("line_count"), F.md5(F.array_join("a", "\n")).alias("digest")
    )


@query(
    "prj_11_mail_subject",
    r"""
    SELECT conv_id, turn, md5(trim(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))) AS digest FROM conversations
    """,
)
def mail_subject(spark, d):
    prefixed = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("RE: ")).otherwise(F.lit(" Fwd : ")), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.mail_subject(prefixed)).alias("digest"))


@query(
    "prj_12_email_list",
    rf"""
    WITH hits AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{X.EMAIL}'), lambda x: lower(x)) AS l FROM documents)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') AS emails FROM hits WHERE len(l) > 0
    """,
)
def email_list(spark, d):
    mails = table(spark, d, "documents").filter(F.col("text").contains("@")).select(
        "doc_id", X.email_list(F.col("text")).alias("l")
    )
    return mails.filter(F.size("l") > 0).select("doc_id", F.array_join("l", "; ").alias("emails"))


@query(
    "prj_12_recipients",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || '@a.example;office@b.example' ELSE lower(c_mktsegment) || '@a.example' END AS receivers, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM customer
    """,
)
def recipients(spark, d):
    first = F.concat(F.lower("c_mktsegment"), F.lit("@a.example"))
    field = F.concat(first, F.when(F.col("c_custkey") % 2 == 0, F.lit(" , office@b.example;none; ")).otherwise(F.lit("; ")), first)
    parts = table(spark, d, "customer").select("c_custkey", X.recipients(field).alias("r"))
    return parts.select("c_custkey", F.array_join("r", ";").alias("receivers"), F.size("r").cast("bigint").alias("n"))


@query(
    "prj_13_file_name_parts",
    r"""
    WITH n AS (SELECT page_id, CAST(page_id AS VARCHAR) || '_2. ' || regexp_extract(url, '//([^/]*)/', 1) || '(MK' || CAST(length(html) % 97 AS VARCHAR)
        || ')[HQC_2026-09-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ']ⓗ.pdf' AS name FROM pages)
    SELECT page_id, regexp_extract(name, '^([0-9]+(?:_[0-9]+)?)\.\s*', 1) AS prefix, regexp_extract(name, '\(([^()]*)\)', 1) AS maker_hint,
      'HQC' AS org_hint, '2026-09-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') AS expiry_hint, TRUE AS has_marker FROM n
    """,
)
def file_name_parts(spark, d):
    name = F.concat(
        F.col("page_id").cast("string"), F.lit("_2. "), F.regexp_extract("url", "//([^/]*)/", 1), F.lit("(MK"),
        (F.length("html") % 97).cast("string"), F.lit(")[HQC_2026-09-"),
        F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"), F.lit("]ⓗ.pdf"),
    )
    parts = mailing.file_name_parts(name, marker="ⓗ")
    return table(spark, d, "pages").select("page_id", *[c.alias(k) for k, c in parts.items()])


_SAFE = r"""trim(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '[<>:"/\\|?*]', '_', 'g'))"""


@query(
    "prj_14_target_names",
    rf"""
    WITH m AS (SELECT p_partkey, p_name, p_brand, p_retailprice, 'Supplier' AS sup, CASE WHEN p_size % 5 = 0 THEN 'BPJPH' ELSE 'HQC' END AS org,
        CAST(DATE '2026-01-01' + CAST(p_size AS INTEGER) AS VARCHAR) AS expiry FROM part)
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) || '. ' || p_name || '(BRAND)_ⓗS' AS folder_name,
      CAST(p_partkey AS VARCHAR) || '. ' || p_name || '(BRAND)' || CASE WHEN org = 'BPJPH' THEN '[BPJPH]' ELSE '[HQC_' || expiry || ']' END || 'S.pdf' AS file_name
    FROM m
    """,
)
def target_names(spark, d):
    org = F.when(F.col("p_size") % 5 == 0, F.lit("bpjph")).otherwise(F.lit("hqc"))
    names = mailing.target_names(
        material_no=F.col("p_partkey").cast("string"),
        english_name=F.concat(F.lit("  "), "p_name"),
        maker=F.concat(F.lit("CO "), "p_brand"),
        supplier=F.lit("#supplier"),
        org=org,
        expiry=F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size")),
    )
    return table(spark, d, "part").select("p_partkey", names["folder_name"], names["file_name"])


PATH_CATEGORIES = [("/en/", "MAIL_RECEIVED_FILE"), ("/fr/", "MANUAL_UPLOAD_FILE"), ("blog.", "TEMPLATE_RELATED_FILE")]


@query(
    "prj_15_source_category",
    """
    SELECT page_id, CASE WHEN contains(lower(url), '/en/') THEN 'MAIL_RECEIVED_FILE' WHEN contains(lower(url), '/fr/') THEN 'MANUAL_UPLOAD_FILE'
      WHEN contains(lower(url), 'blog.') THEN 'TEMPLATE_RELATED_FILE' ELSE 'SCAN_JOB' END AS category FROM pages
    """,
)
def source_category(spark, d):
    return table(spark, d, "pages").select(
        "page_id", rules.first_contained(F.lower("url"), PATH_CATEGORIES, "SCAN_JOB").alias("category")
    )


@query(
    "prj_16_request_id",
    """
    WITH r AS (SELECT o_orderkey, 'REQ-20260630-' || upper(substr(md5(CAST(o_custkey AS VARCHAR) || '|' || o_orderstatus || '|' || o_orderpriority), 1, 8)) AS request_id FROM orders)
    SELECT o_orderkey, request_id, request_id AS found FROM r
    """,
)
def request_id(spark, d):
    rid = X.request_id(F.col("o_custkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"), "20260630")
    ids = table(spark, d, "orders").select("o_orderkey", rid.alias("request_id"))
    texts = [F.lit("no id here"), F.concat(F.lit("Re: "), F.lower("request_id"), F.lit(" thanks")), F.lit("REQ-00000000-00000000")]
    return ids.select("o_orderkey", "request_id", X.first_code(texts, r"(?i)REQ-\d{8}-[0-9A-F]{8}").alias("found"))


@query(
    "prj_17_alias_canonical",
    """
    SELECT c_custkey, 'N' || CAST(c_nationkey AS VARCHAR) || '-R' || CAST(n_regionkey AS VARCHAR) AS canonical
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def alias_canonical(spark, d):
    nation = table(spark, d, "nation")
    aliases = nation.select(
        F.col("n_name").alias("alias"),
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit("-R"), F.col("n_regionkey").cast("string")).alias("canonical"),
        F.col("n_nationkey").alias("priority"),
    )
    written = (
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
        .otherwise(F.concat(F.lit(" nation-"), F.col("c_nationkey").cast("string"), F.lit(".")))
    )
    values = table(spark, d, "customer").select("c_custkey", written.alias("written"))
    return rules.canonicalise(values, "written", aliases).select("c_custkey", "canonical")


@query(
    "prj_18_json_first_value",
    """
    SELECT event_id, COALESCE(NULLIF(json_extract_string(p, '$.cert_no'), ''), NULLIF(json_extract_string(p, '$.number'), ''), '') AS value
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"cert_no": "", "number": "' || event_type || '"}'
      WHEN event_id % 3 = 1 THEN '{"cert_no": "' || CAST(user_id AS VARCHAR) || '"}' ELSE '{}' END AS p FROM events)
    """,
)
def json_first_value(spark, d):
    payload = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"cert_no": "", "number": "'), "event_type", F.lit('"}')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"cert_no": "'), F.col("user_id").cast("string"), F.lit('"}')))
        .otherwise(F.lit('{"broken'))
    )
    return table(spark, d, "events").select(
        "event_id", F.coalesce(rules.json_value(payload, "cert_no", "number"), F.lit("")).alias("value")
    )


@query(
    "prj_19_fingerprint",
    """
    SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user_id":' || CAST(user_id AS VARCHAR) || '}') AS fingerprint,
      CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 AS changed FROM events
    """,
)
def fingerprint(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    saved = {"user_id": F.col("user_id"), "event_type": F.col("event_type"), "k": k}
    current = dict(saved, k=F.least(k, F.lit(50)))
    return table(spark, d, "events").select(
        "event_id",
        rules.fingerprint(saved).alias("fingerprint"),
        (~rules.fingerprint(saved).eqNullSafe(rules.fingerprint(current))).alias("changed"),
    )


@query(
    "prj_20_redaction",
    rf"""
    SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{X.EMAIL}', '<MAIL>', 'g'), '/home/[A-Za-z0-9_]+', '<HOME>', 'g')) AS text,
      lang, '<SRC>' || substr(source, 4) AS source FROM documents
    """,
)
def redaction(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.struct("text", F.array("lang", "source").alias("tags")).alias("rec"))
    pairs = [(X.EMAIL, "<MAIL>"), ("/home/[A-Za-z0-9_]+", "<HOME>"), ("^src(?=[0-9]+$)", "<SRC>")]
    clean = docs.select(*X.redact_all(docs.schema, pairs))
    return clean.select("doc_id", F.md5("rec.text").alias("text"), F.col("rec.tags")[0].alias("lang"), F.col("rec.tags")[1].alias("source"))


@query(
    "prj_21_candidate_terms",
    r"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '[\n\r,/|;:()\[\]<>]+'), lambda x: trim(x)),
         lambda x: length(x) BETWEEN 3 AND 80 AND NOT regexp_matches(lower(x), 'certificate|request|valid|until')) AS a FROM documents),
    q AS (SELECT doc_id, a, list_transform(a, lambda x: lower(x)) AS l FROM p)
    SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(l, lower(x)) = i), '|') AS terms FROM q
    """,
)
def candidate_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.simple_terms(F.col("text"), TERM_STOPS), "|").alias("terms"))


@query("prj_22_marker_windows")
def marker_windows(spark, d):
    compact = rules.marker_windows(F.col("text"), ["certificate", "thanks", "email", "license", "tion"], 180, 520, whole=6000)
    return table(spark, d, "documents").select("doc_id", compact.alias("compact"))


@query(
    "prj_23_weighted_text",
    r"""
    WITH c AS (SELECT conv_id, string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), chr(12) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, list_filter(string_split(t, chr(12)), lambda x: x <> '') AS a FROM c)
    SELECT conv_id, md5(trim(regexp_replace(array_to_string(list_concat([coalesce(a[1], ''), coalesce(a[1], ''), coalesce(a[1], '')], a[2:]), ' '), '\s+', ' ', 'g'))) AS digest FROM p
    """,
)
def weighted_text(spark, d):
    # the turns of a conversation stand for the pages of a document; all of them count, whole
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda p: p["text"]).alias("pages"))
    return pages.select("conv_id", F.md5(rules.weighted_text(F.col("pages"))).alias("digest"))


@query(
    "prj_24_next_year",
    "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH, '%Y-%m-%d') AS next_expiry FROM orders",
)
def next_year(spark, d):
    return table(spark, d, "orders").select("o_orderkey", D.next_year(F.to_date("o_orderdate")).cast("string").alias("next_expiry"))


@query(
    "prj_25_softmax",
    """
    WITH s AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
    m AS (SELECT vec_id, max(v) AS mx, min(v) AS mn FROM s GROUP BY vec_id),
    e AS (SELECT s.vec_id, s.i, exp(s.v - mx) AS x, mx - mn AS gap FROM s JOIN m USING (vec_id))
    SELECT vec_id, CAST(i AS BIGINT) AS class_no, round(x / sum(x) OVER (PARTITION BY vec_id), 6) AS share, round(1 / (1 + exp(-gap)), 6) AS confidence FROM e
    """,
)
def softmax(spark, d):
    scores = F.transform("embedding", lambda v: v.cast("double"))
    rows = table(spark, d, "embeddings").select(
        "vec_id",
        F.posexplode(rules.softmax(scores)).alias("i", "share"),
        rules.sigmoid(F.array_max(scores) - F.array_min(scores)).alias("confidence"),
    )
    return rows.select("vec_id", (F.col("i") + 1).cast("bigint").alias("class_no"), F.round("share", 6).alias("share"), F.round("confidence", 6).alias("confidence"))


@query(
    "prj_26_country_match",
    """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN s_nationkey IS NULL OR c_nationkey IS NULL OR s_nationkey = 0 THEN 'CHECK'
      WHEN s_nationkey = c_nationkey THEN 'MATCH' ELSE 'MISMATCH' END AS status,
      CASE WHEN s_nationkey = 0 THEN 'DEFAULT' ELSE 'N' || CAST(s_nationkey AS VARCHAR) END AS cert_country
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
    """,
)
def country_match(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.nullif("s_nationkey", F.lit(0)).alias("made_in"))
    cust = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(
        table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left"
    )
    joined = lines.join(sup, "l_suppkey", "left").join(cust, "l_orderkey", "left")
    named = F.concat(F.lit("N"), F.col("made_in").cast("string"))
    return joined.select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        rules.country_match(F.col("made_in"), F.col("c_nationkey")).alias("status"),
        F.coalesce(named, F.lit("DEFAULT")).alias("cert_country"),
    )


@query(
    "prj_27_request_body",
    """
    WITH i AS (SELECT s_nationkey, s_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS idx FROM supplier),
    b AS (SELECT *, CAST(idx AS VARCHAR) || '. ' || s_name || chr(10) || '- maker: M' || CAST(s_suppkey AS VARCHAR) || chr(10) || '- expiry: 2026-01-31' AS block FROM i)
    SELECT 'N' || CAST(s_nationkey AS VARCHAR) AS supplier, CAST(idx AS BIGINT) AS item_no, block FROM b
    """,
)
def request_body(spark, d):
    items = table(spark, d, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("supplier"),
        F.col("s_suppkey").alias("ord"), F.col("s_name").alias("path"),
        F.concat(F.lit("M"), F.col("s_suppkey").cast("string")).alias("maker"), F.lit("2026-01-31").alias("expiry"),
    )
    return mailing.item_blocks(items, ["supplier"], "ord", "path", {"maker": "maker", "expiry": "expiry"})


@query(
    "prj_28_table_date",
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS cell_date,
      CASE WHEN o_orderkey % 4 <> 0 AND year(o_orderdate) BETWEEN 2000 AND 2100 THEN strftime(o_orderdate, '%Y-%m-%d') END AS ranged FROM orders
    """,
)
def table_date(spark, d):
    cell = (
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" NaT "))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy/M/d"))
        .otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    )
    return table(spark, d, "orders").select(
        "o_orderkey", D.table_date(cell).cast("string").alias("cell_date"), D.ranged_date(cell).cast("string").alias("ranged")
    )


@query(
    "prj_30_material_no",
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) || '_1' END AS material_no FROM part",
)
def material_no(spark, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit(".0"))).otherwise(
        F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit("_1"))
    )
    return table(spark, d, "part").select("p_partkey", X.material_no(raw).alias("material_no"))
