"""Text-to-field extraction. Each document carries a certificate block appended to its whole text."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import dates as D
from attestry.operators import decisions as DEC
from attestry.operators import extract as EX
from attestry.operators import lines, rules
from attestry.plans.registry import query, table


def doc():
    return F.col("doc_id")


ALIASES = [
    ("HQC", ["HALAL QUALITY COUNCIL", "HQC-REG"], 1),
    ("IFB", ["ISLAMIC FOOD BOARD"], 1),
    ("ISA", ["ISA-MARK", "ISLAMIC SERVICES"], 2),
]
MARKERS = [
    ("HQC", r"HALAL\s+QUALITY\s+COUNCIL", 120), ("HQC", r"HQC-REG", 20), ("IFB", r"ISLAMIC\s+FOOD\s+BOARD", 120), ("ISA", r"ISA-MARK", 30), ("IFB", r"HQC-REG", 10),
]
NAME_MARKERS = [("HQC", r"HQC"), ("HQCX", r"HQC-X"), ("IFB", r"IFB"), ("ISA", r"ISA")]
CODES = {"HQC": [(r"HC-[0-9]{7}", 0), (r"REF ([A-Z]{2}[0-9]{4})", 1)], "IFB": [(r"REF ([A-Z]{2}[0-9]{4})", 1), (r"HC-[0-9]{7}", 0)]}
COUNTRIES = {"KOREA": "KR", "NORTH KOREA": "KP", "VIET NAM": "VN", "CHINA": "CN"}
COUNTRY_OF = ["KOREA", "NORTH KOREA", "VIET NAM", "CHINA"]


def pick(n: int, *values):
    out = None
    for i, v in enumerate(values):
        c = F.lit(v) if isinstance(v, str) else v
        out = F.when(doc() % n == i, c) if out is None else out.when(doc() % n == i, c)
    return out


def expiry_day():
    return F.date_add(F.lit("2026-01-01").cast("date"), (doc() % 700).cast("int"))



def certificate_docs(spark, d):
    """documents with an appended certificate block whose fields follow from doc_id."""
    issuer = pick(4, "HALAL QUALITY COUNCIL HQC-REG", "Islamic Food Board", "ISA-MARK", "no issuer here")
    number = F.when(doc() % 5 == 4, F.lit("Certificate pending")).otherwise(F.concat(F.lit("Certificate No: HC-"), F.lpad(doc().cast("string"), 7, "0"), F.lit(" REF AB"), F.lpad((doc() % 10000).cast("string"), 4, "0")))
    dated = pick(3, F.date_format(expiry_day(), "yyyy-MM-dd"), F.date_format(expiry_day(), "d MMMM yyyy"), F.date_format(expiry_day(), "dd/MM/yyyy"))
    expiry = F.when(doc() % 7 == 6, F.lit("Valid while listed")).otherwise(F.concat(F.lit("Valid until "), dated))
    maker = pick(
        6, *[F.concat(F.lit("Manufactured by: Solaris "), "source", F.lit(" Co., Ltd. 12 Harbour Road"))] * 4,
        F.concat(F.lit("Manufactured by:\nPlot 9 east side\nDelta "), "source", F.lit(" GmbH")), F.lit("maker not stated"),
    )
    country = F.concat(F.lit("Factory Address: block 4, "), pick(4, *COUNTRY_OF))
    products = F.concat(F.lit("1. Rice Bran Oil "), (doc() % 9).cast("string"), F.lit("\n2\nCitric Acid\n3. Page 3 of 9\n4. rice bran oil "), (doc() % 9).cast("string"))
    block = F.concat_ws("\n", F.lit(""), issuer, number, F.lit("Date of issue: 05/01/2024"), expiry, maker, country, products)
    name = F.concat(doc().cast("string"), F.lit("_Rice Bran Oil["), pick(4, "HQC-X", "IFB", "ISA", "none"), F.lit("_"), F.date_format(expiry_day(), "yyyy-MM-dd"), F.lit("](ACME).pdf"))
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.concat("text", block).alias("text"), name.alias("file_name"))


ISSUER_SQL = "CASE doc_id % 4 WHEN 0 THEN 'HQC' WHEN 1 THEN 'IFB' WHEN 2 THEN 'ISA' ELSE 'UNKNOWN' END"
CODE_SQL = "CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'HC-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') END"
REF_SQL = "CASE WHEN doc_id % 5 = 4 THEN '' ELSE 'AB' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') END"
EXP_SQL = "CASE WHEN doc_id % 7 = 6 THEN '' ELSE CAST(DATE '2026-01-01' + CAST(doc_id % 700 AS INTEGER) AS VARCHAR) END"
MAKER_SQL = "CASE doc_id % 6 WHEN 5 THEN '' WHEN 4 THEN 'Delta ' || source || ' GmbH' ELSE 'Solaris ' || source || ' Co., Ltd.' END"
COUNTRY_SQL = "CASE doc_id % 4 WHEN 0 THEN 'KR' WHEN 1 THEN 'KP' WHEN 2 THEN 'VN' ELSE 'CN' END"


def text_lines(df, *keep):
    arrays = df.select("doc_id", *keep, lines.lines_of(F.col("text")).alias("_r"))
    return arrays.withColumn("lines", F.transform("_r", lambda r: r["line"])).drop("_r")


@query("ext_1_ordered_aliases", f"SELECT doc_id, {ISSUER_SQL} AS issuer FROM documents")
def ordered_aliases(spark, d):
    return certificate_docs(spark, d).select("doc_id", EX.detect_issuer(F.col("text"), ALIASES).alias("issuer"))


@query(
    "ext_2_weighted_markers",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'HQC' WHEN 1 THEN 'IFB' ELSE 'UNKNOWN' END AS issuer, CASE doc_id % 4 WHEN 0 THEN 140 WHEN 1 THEN 120 WHEN 2 THEN 30 ELSE 0 END::BIGINT AS score, CASE doc_id % 4 WHEN 0 THEN 130 WHEN 1 THEN 120 WHEN 2 THEN 30 ELSE 0 END::BIGINT AS margin FROM documents",
)
def weighted_markers(spark, d):
    w = certificate_docs(spark, d).select("doc_id", EX.weigh_issuers(F.col("text"), MARKERS).alias("w"))
    return w.select("doc_id", "w.issuer", F.col("w.score").cast("bigint").alias("score"), F.col("w.margin").cast("bigint").alias("margin"))


@query("ext_3_issuer_in_name", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'HQCX' WHEN 1 THEN 'IFB' WHEN 2 THEN 'ISA' ELSE 'UNKNOWN' END AS issuer FROM documents")
def issuer_in_name(spark, d):
    return certificate_docs(spark, d).select("doc_id", EX.issuer_in_name(F.col("file_name"), NAME_MARKERS).alias("issuer"))


@query(
    "ext_4_code_patterns",
    f"""
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {CODE_SQL} WHEN 1 THEN {REF_SQL} ELSE {CODE_SQL} END AS cert_no, CASE WHEN doc_id % 5 = 4 THEN 0 WHEN doc_id % 4 IN (0, 1) THEN 2 ELSE 1 END::BIGINT AS candidates FROM documents
    """,
)
def code_patterns(spark, d):
    docs = certificate_docs(spark, d).withColumn("issuer", pick(4, "HQC", "IFB", "ISA", "UNKNOWN"))
    codes = docs.select("doc_id", EX.find_codes(F.col("text"), F.col("issuer"), CODES, [(r"HC-[0-9]{7}", 0)]).alias("c"))
    return codes.select("doc_id", F.coalesce(F.get("c", 0), F.lit("")).alias("cert_no"), F.size("c").cast("bigint").alias("candidates"))


@query("ext_5_date_after_label", f"SELECT doc_id, {EXP_SQL} AS expiry FROM documents")
def date_after_label(spark, d):
    found = D.date_after(F.col("text"), ["EXPIRY DATE", "VALID UNTIL"])
    return certificate_docs(spark, d).select("doc_id", F.coalesce(found.cast("string"), F.lit("")).alias("expiry"))


@query("ext_6_latest_near_label", f"SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN '2024-01-05' ELSE {EXP_SQL} END AS latest FROM documents")
def latest_near_label(spark, d):
    found = D.latest_date_near(F.col("text"), ["VALID"], before=60, after=40)
    return certificate_docs(spark, d).select("doc_id", found.cast("string").alias("latest"))


@query("ext_7_dates_in_order", f"SELECT doc_id, '2024-01-05' || CASE WHEN doc_id % 7 = 6 THEN '' ELSE ',' || {EXP_SQL} END AS dates FROM documents")
def dates_in_order(spark, d):
    found = D.find_dates(F.col("text"))
    return certificate_docs(spark, d).select("doc_id", F.array_join(F.transform(found, lambda x: x["date"].cast("string")), ",").alias("dates"))


@query(
    "ext_8_scored_dates",
    """
    SELECT conv_id, turn, '90:' || CAST(DATE '2026-01-01' + CAST((conv_id + turn) % 700 AS INTEGER) AS VARCHAR) || CASE WHEN turn % 2 = 0 THEN ',50:2024-05-01' ELSE '' END AS candidates FROM conversations
    """,
)
def scored_dates(spark, d):
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), ((F.col("conv_id") + F.col("turn")) % 700).cast("int")), "dd MMMM yyyy")
    gap = F.lit(" -" * 150)
    mail = F.concat(F.when(F.col("turn") % 2 == 0, F.lit("sent 2024-05-01 ")).otherwise(F.lit("")), gap, "text", gap, F.lit(" expiry "), day)
    rows = table(spark, d, "conversations").select("conv_id", "turn", EX.scored_dates(mail).alias("c"))
    return rows.select("conv_id", "turn", F.array_join(F.transform("c", lambda x: F.concat(x["score"].cast("string"), F.lit(":"), x["date"])), ",").alias("candidates"))


@query("ext_9_company", f"SELECT doc_id, {MAKER_SQL} AS maker FROM documents")
def company(spark, d):
    label = F.concat(pick(5, "Company Name", "Company", "Manufacturer", "Name of Company", "Company Name & Address"), F.lit(": Solaris "))
    docs = certificate_docs(spark, d).withColumn("text", F.replace("text", F.lit("Manufactured by: Solaris "), F.concat(F.lit("Manufactured by: "), label)))
    return text_lines(docs).select("doc_id", F.coalesce(EX.find_company(F.col("lines"), r"manufactured by"), F.lit("")).alias("maker"))


@query("ext_10_country", f"SELECT doc_id, {COUNTRY_SQL} AS country FROM documents")
def country(spark, d):
    found = EX.find_country(F.col("text"), COUNTRIES, r"factory address", r"(?i)does not circulate[^.\n]*")
    return certificate_docs(spark, d).select("doc_id", found.alias("country"))


@query(
    "ext_11_products",
    "SELECT doc_id, '1:Rice Bran Oil ' || CAST(doc_id % 9 AS VARCHAR) || '|2:Citric Acid' AS products, CASE WHEN doc_id % 9 = 3 THEN 1.0 ELSE 0.933333 END::DOUBLE AS best_score, 'Rice Bran Oil ' || CAST(doc_id % 9 AS VARCHAR) AS best FROM documents",
)
def products(spark, d):
    rows = text_lines(certificate_docs(spark, d)).select("doc_id", EX.find_products(F.col("lines")).alias("p"))
    rows = rows.withColumn("b", EX.best_product(F.col("p"), F.lit("RICE BRAN OIL 3")))
    listed = F.transform("p", lambda x: F.concat(x["no"].cast("string"), F.lit(":"), x["name"]))
    return rows.select("doc_id", F.array_join(listed, "|").alias("products"), F.col("b.score").alias("best_score"), F.col("b.name").alias("best"))


OVERRIDES = [
    {"rule_kind": "date_anchor", "target_org": "HQC", "target_field": "expiry", "anchors": ["VALID UNTIL"], "window": 200},
    {"rule_kind": "date_anchor", "target_org": "ISA", "target_field": "expiry", "anchors": ["Date of issue"], "window": 200, "stop_before": ["05/01/2024"]},
    {"rule_kind": "date_anchor", "target_org": "IFB", "target_field": "expiry", "anchors": ["VALID UNTIL"], "window": 200, "enabled": False},
    {"rule_kind": "code_pattern", "target_org": "IFB", "target_field": "cert_no", "patterns": ["ZZ-[0-9]+", "REF AB[0-9]{4}"]},
    {"rule_kind": "maker_cleanup", "target_org": "ALL"},
    {"rule_kind": "non_cert_doc", "target_org": "*", "markers": ["license"]},
]


@query(
    "ext_12_overrides",
    f"""
    WITH b AS (SELECT doc_id, text, {ISSUER_SQL} AS issuer, contains(upper(text), 'LICENSE') AS nc FROM documents)
    SELECT doc_id, CASE WHEN nc THEN 'UNKNOWN' ELSE issuer END AS issuer, CASE WHEN nc THEN '' WHEN issuer = 'IFB' AND doc_id % 5 <> 4 THEN 'REFAB' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') ELSE 'OLD' END AS cert_no,
      CASE WHEN nc THEN '' WHEN issuer = 'HQC' AND doc_id % 7 <> 6 THEN {EXP_SQL} ELSE '1999-01-01' END AS expiry, CASE WHEN nc THEN '' ELSE 'Acme Foods Ltd' END AS maker, CASE WHEN nc THEN 'NON_CERTIFICATE_DOC' ELSE 'LOW_CONFIDENCE' END AS parse_status FROM b
    """,
)
def overrides(spark, d):
    base = certificate_docs(spark, d).select(
        "doc_id", "text", pick(4, "HQC", "IFB", "ISA", "UNKNOWN").alias("issuer"), F.lit("OLD").alias("cert_no"), F.lit("1999-01-01").alias("expiry"),
        F.concat(pick(5, "Company Name", "Company", "Manufacturer", "Manufactured by", "Name of Company"), F.lit(": Acme Foods Ltd 25 Long Street, Town")).alias("maker"), F.lit("LOW_CONFIDENCE").alias("parse_status"),
    )
    return EX.apply_overrides(base, "text", "issuer", OVERRIDES).drop("text")


@query(
    "ext_13_evidence",
    f"""
    WITH v AS (SELECT doc_id, {EXP_SQL} AS e, {MAKER_SQL} AS m FROM documents)
    SELECT doc_id, CASE WHEN e = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS expiry_score, e <> '' AS expiry_found, CASE WHEN m = '' THEN FALSE ELSE TRUE END AS maker_found FROM v
    """,
)
def evidence(spark, d):
    expiry = F.when(doc() % 7 == 6, F.lit("2031-01-01")).otherwise(expiry_day().cast("string"))
    maker = pick(6, *[F.concat(F.lit("SOLARIS "), "source", F.lit(" CO LTD"))] * 4, F.concat(F.lit("Delta "), "source", F.lit(" GmbH")), F.lit("qqqq xxxx zzzz jjjj"))
    rows = text_lines(certificate_docs(spark, d), "source")
    ev = rows.select("doc_id", EX.value_evidence(F.col("lines"), expiry, F.lit("expiry")).alias("e"), EX.value_evidence(F.col("lines"), maker, F.lit("maker")).alias("m"))
    return ev.select("doc_id", F.col("e.score").alias("expiry_score"), F.col("e.found").alias("expiry_found"), F.col("m.found").alias("maker_found"))


def read_documents(docs):
    """All fields of a document in one pass: EXT-1..11 and the reading status."""
    arrays = docs.select("doc_id", "text", lines.lines_of(F.col("text")).alias("_r")).withColumn("lines", F.transform("_r", lambda r: r["line"])).drop("_r")
    fields = arrays.select(
        "doc_id",
        EX.detect_issuer(F.col("text"), ALIASES).alias("issuer"),
        D.date_after(F.col("text"), ["EXPIRY DATE", "VALID UNTIL"]).alias("expiry"),
        EX.find_company(F.col("lines"), r"manufactured by").alias("maker"),
        EX.find_country(F.col("text"), COUNTRIES, r"factory address").alias("country"),
        EX.find_products(F.col("lines")).alias("products"),
        "text",
    )
    fields = fields.withColumn("codes", EX.find_codes(F.col("text"), F.col("issuer"), CODES, [(r"HC-[0-9]{7}", 0)]))
    fields = fields.withColumn("best", EX.best_product(F.col("products"), F.lit("Rice Bran Oil 3")))
    status, confidence = DEC.parse_status(
        F.lit(False), rules.any_contained(F.upper("text"), ["LICENSE"]), F.trim("text") != "", F.col("issuer"), F.col("expiry").isNotNull(), F.size("codes") > 0,
        F.col("maker").isNotNull(), F.size("products") > 0, F.coalesce(F.col("best.score"), F.lit(0.0)), F.lit(False),
    )
    return fields.select("doc_id", "issuer", F.get("codes", 0).alias("cert_no"), "expiry", "maker", "country", F.size("products").alias("products_n"), status.alias("status"), confidence.alias("confidence"))


@query(
    "ext_14_read_documents",
    f"""
    WITH b AS (SELECT doc_id, {ISSUER_SQL} AS issuer, CASE doc_id % 4 WHEN 1 THEN {REF_SQL} ELSE {CODE_SQL} END AS cert_no, {EXP_SQL} AS expiry, {MAKER_SQL} AS maker, {COUNTRY_SQL} AS country, contains(upper(text), 'LICENSE') AS nc FROM documents)
    SELECT doc_id, issuer, cert_no, expiry, maker, country, 2::BIGINT AS products_n, CASE WHEN nc THEN 'NON_CERTIFICATE_DOC' WHEN issuer <> 'UNKNOWN' AND expiry <> '' THEN 'RULE_MATCHED' WHEN issuer <> 'UNKNOWN' AND cert_no <> '' THEN 'LOW_CONFIDENCE' ELSE 'MANUAL_REVIEW' END AS status,
      CASE WHEN nc THEN 'HIGH' WHEN issuer <> 'UNKNOWN' AND expiry <> '' THEN 'HIGH' WHEN issuer <> 'UNKNOWN' AND cert_no <> '' THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM b
    """,
)
def read_all(spark, d):
    r = read_documents(certificate_docs(spark, d))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return r.select("doc_id", "issuer", blank("cert_no"), blank("expiry"), blank("maker"), "country", F.col("products_n").cast("bigint").alias("products_n"), "status", "confidence")


@query(
    "ext_15_line_values",
    f"""
    SELECT doc_id, 'HC-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS cert_no, 'Solaris ' || source || ' Co., Ltd' AS maker, CAST(DATE '2026-01-01' + CAST(doc_id % 700 AS INTEGER) AS VARCHAR) AS expiry, {COUNTRY_SQL} AS country FROM documents
    """,
)
def line_values(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    number = F.concat(F.lit("Halal certificate number: HC-"), F.lpad(doc().cast("string"), 7, "0"), F.lit(" page A1"))
    maker = F.concat(F.lit("Manufactured by: Solaris "), "source", F.lit(" Co., Ltd."))
    dated = F.concat(F.lit("valid until "), F.date_format(expiry_day(), "d MMMM yyyy"))
    place = F.concat(F.lit("Plant site, "), pick(4, *COUNTRY_OF))
    return docs.select(
        "doc_id", EX.value_of_line("cert_no", number, COUNTRIES).alias("cert_no"), EX.value_of_line("maker", maker, COUNTRIES).alias("maker"),
        EX.value_of_line("expiry", dated, COUNTRIES).alias("expiry"), EX.value_of_line("country", place, COUNTRIES).alias("country"),
    )


@query(
    "ext_16_value_lists",
    rf"""
    SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(text, '[0-9]{{3}}-[0-9]{{4}}')), ',') AS numbers_raw, len(list_distinct(regexp_extract_all(text, '[0-9]{{16}}')))::BIGINT AS long_numbers FROM documents WHERE FALSE
    UNION ALL SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{{3}}-[0-9]{{4}}'))), ','), len(list_distinct(regexp_extract_all(text, '[0-9]{{16}}')))::BIGINT FROM documents
    """,
)
def value_lists(spark, d):
    short = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{3}-[0-9]{4}"), F.lit(0))))
    long = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0)))
    return table(spark, d, "documents").select("doc_id", F.array_join(short, ",").alias("numbers_raw"), F.size(long).cast("bigint").alias("long_numbers"))


@query(
    "ext_17_name_hints",
    """
    SELECT page_id, CAST(DATE '2026-01-01' + CAST(page_id % 700 AS INTEGER) AS VARCHAR) AS expiry_hint, regexp_extract(url, '//([^/]*)/', 1) || ' oil' AS product_hint FROM pages
    """,
)
def name_hints(spark, d):
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 700).cast("int")), "yyyy-MM-dd")
    name = F.concat(F.lit("AB12CD34EF56__"), (F.col("page_id") + 1).cast("string"), F.lit("_ "), F.regexp_extract("url", "//([^/]*)/", 1), F.lit(" oil(ACME)[HQC_"), day, F.lit("].pdf"))
    hints = EX.name_hints(name, F.lit("HQC"))
    return table(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in hints.items()])


@query(
    "dec_4_canonical_names",
    f"""
    WITH b AS (SELECT doc_id, source, {MAKER_SQL} AS maker FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 6 < 4 AND doc_id % 4 <> 1 THEN TRUE ELSE FALSE END AS replaced, CASE WHEN doc_id % 6 < 4 AND doc_id % 4 <> 1 THEN 'SOLARIS ' || upper(source) || ' CO LTD' ELSE maker END AS maker FROM b
    """,
)
def canonical_names(spark, d):
    rows = text_lines(certificate_docs(spark, d), "source", "text")
    expected = F.concat(F.lit("SOLARIS "), F.upper("source"), F.lit(" CO LTD"))
    seen = DEC.name_in_text(F.col("text"), F.col("lines"), expected)
    read = F.coalesce(EX.find_company(F.col("lines"), r"manufactured by"), F.lit(""))
    rows = rows.select("doc_id", read.alias("read"), expected.alias("expected"), seen.alias("seen"), (doc() % 4 == 1).alias("conflict"))
    name = DEC.canonical_name(F.col("read"), F.col("expected"), F.col("seen.matched"), F.col("conflict"))
    return rows.select("doc_id", (F.col("seen.matched") & ~F.col("conflict")).alias("replaced"), name.alias("maker"))
