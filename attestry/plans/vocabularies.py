"""Extraction by rule tables of thousands of rows. The phrases of the tables are those of ``benchmark``, which documents quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import vocabulary as V
from attestry.plans.registry import query, table


def phrases(spark, d) -> DataFrame:
    """(no, item_id, phrase): all stretches of two to four words of each benchmark text."""
    words = table(spark, d, "benchmark").select("item_id", F.split(X.squash(F.col("text")), " ").alias("w"))
    sized = words.select("item_id", "w", F.explode(F.sequence(F.lit(2), F.lit(4))).alias("k")).filter(F.size("w") >= F.col("k"))
    at = sized.select("item_id", "w", "k", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("j"))
    no = F.col("item_id") * 1000 + F.col("j") * 3 + F.col("k")
    return at.select(no.cast("bigint").alias("no"), "item_id", F.array_join(F.slice("w", F.col("j") + 1, F.col("k")), " ").alias("phrase"))


PHRASES_SQL = r"""
bw AS (SELECT item_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM benchmark),
phrases AS (SELECT CAST(item_id * 1000 + j * 3 + k AS BIGINT) AS no, item_id, upper(array_to_string(w[j + 1 : j + k], ' ')) AS u
  FROM bw, unnest([2, 3, 4]) AS a(k), unnest(range(CAST(len(w) AS BIGINT))) AS b(j) WHERE j <= len(w) - k),
folded AS (SELECT *, upper(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents),
met AS (SELECT doc_id, no, item_id, u FROM folded JOIN phrases ON contains(t, u))
"""


@query(
    "ext_1_alias_table",
    f"""
    WITH {PHRASES_SQL},
    once AS (SELECT doc_id, item_id % 20 AS k, u, min(no) AS p FROM met GROUP BY ALL),
    scored AS (SELECT doc_id, k, count(*) < 1 + k % 3 * 30 AS weak, min(p) AS p FROM once GROUP BY doc_id, k),
    best AS (SELECT doc_id, arg_min('ORG-' || k, (weak, p)) AS issuer FROM scored GROUP BY doc_id)
    SELECT doc_id, coalesce(issuer, 'UNKNOWN') AS issuer FROM documents LEFT JOIN best USING (doc_id)
    """,
)
def alias_table(spark, d):
    org = F.col("item_id") % 20
    aliases = phrases(spark, d).select(F.concat(F.lit("ORG-"), org.cast("string")).alias("issuer"), F.col("phrase").alias("alias"), F.col("no").alias("priority"), (1 + org % 3 * 30).alias("needed"))
    return V.issuer_by_alias(table(spark, d, "documents"), aliases)


@query(
    "ext_2_marker_table",
    f"""
    WITH {PHRASES_SQL},
    sums AS (SELECT doc_id, 'ORG-' || item_id % 20 AS issuer, sum(1 + no % 5) AS score FROM met GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, issuer) AS place FROM sums),
    best AS (SELECT doc_id, max(CASE WHEN place = 1 THEN issuer END) AS issuer, max(CASE WHEN place = 1 THEN score END) AS score, coalesce(max(CASE WHEN place = 2 THEN score END), 0) AS second FROM placed GROUP BY doc_id)
    SELECT doc_id, CASE WHEN score >= 40 AND (second = 0 OR score - second >= 25) THEN issuer ELSE 'UNKNOWN' END AS issuer, coalesce(score, 0)::BIGINT AS score, (coalesce(score, 0) - coalesce(second, 0))::BIGINT AS margin
    FROM documents LEFT JOIN best USING (doc_id)
    """,
)
def marker_table(spark, d):
    org = F.concat(F.lit("ORG-"), (F.col("item_id") % 20).cast("string"))
    markers = phrases(spark, d).select(org.alias("issuer"), F.col("phrase").alias("marker"), (1 + F.col("no") % 5).alias("weight"))
    return V.issuer_by_marker(table(spark, d, "documents"), markers)


@query(
    "ext_4_code_table",
    r"""
    WITH b AS (SELECT doc_id, doc_id % 25 AS k, text || chr(10) || 'REF ' || (doc_id % 25) || 'AB' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || ' issued'
        || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' n' || (doc_id % 25) || '-' || (1000 + doc_id % 9000) || ' and N' || (doc_id % 25) || '-' || (1000 + doc_id % 9000) || '-1.' END
        || ' decree ' || (10 + doc_id % 90) || ' V ' || (2000 + doc_id % 30) || ' PRN' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') AS text FROM documents),
    f AS (SELECT doc_id, k, upper(text) AS t FROM b),
    c AS (SELECT doc_id, k, t, list_filter(regexp_extract_all(t, '\bN[0-9]+-[0-9]{3,6}(?:-[0-9])?\b'), lambda x: starts_with(x, 'N' || k || '-')) AS own,
        list_filter(regexp_extract_all(t, 'REF\s*([0-9]{1,2}AB[0-9]{2})', 1), lambda x: starts_with(x, k || 'AB') AND k % 2 = 0) AS refs FROM f),
    l AS (SELECT doc_id, k, t, list_concat(own, refs) AS found FROM c),
    u AS (SELECT *, list_filter(found, lambda x, i: list_position(found, x) = i) AS once FROM l),
    o AS (SELECT *, CASE WHEN k % 5 = 0 THEN list_transform(list_sort(list_transform(once, lambda x, i: {'n': -len(x), 'h': len(replace(x, '-', '')) - len(x), 'i': i, 'v': x})), lambda s: s.v) ELSE once END AS codes FROM u),
    m AS (SELECT doc_id, k, codes, coalesce(codes[1], '') AS first, regexp_extract(t, 'DECREE\s+([0-9]+ V [0-9]+)', 1) AS decree, regexp_extract(t, 'PRN[0-9]{4}') AS prn FROM o)
    SELECT doc_id, array_to_string(codes, ',') AS codes, CASE WHEN k % 3 = 0 AND decree <> '' THEN replace(decree, ' V ', '/') WHEN k % 3 = 1 AND first = '' THEN prn ELSE first END AS cert_no,
      CASE WHEN k % 3 = 0 AND decree <> '' THEN 'DECREE' WHEN k % 3 = 1 AND first = '' THEN 'PRN' WHEN first <> '' THEN 'BASE' ELSE '' END AS source FROM m
    """,
)
def code_table(spark, d):
    key = F.col("n_nationkey")
    name = F.concat(F.lit("N"), key.cast("string"))
    nations = table(spark, d, "nation")
    own = nations.select(name.alias("issuer"), F.lit(1).alias("priority"), F.concat(F.lit(r"\b"), name, F.lit(r"-[0-9]{3,6}(?:-[0-9])?\b")).alias("pattern"), F.lit(0).alias("part"), (key % 5 == 0).alias("longest_first"))
    refs = nations.filter(key % 2 == 0).select(
        name.alias("issuer"), F.lit(2).alias("priority"), F.concat(F.lit(r"REF\s*("), key.cast("string"), F.lit("AB[0-9]{2})")).alias("pattern"), F.lit(1).alias("part"), F.lit(False).alias("longest_first")
    )
    decree = nations.filter(key % 3 == 0).select(
        name.alias("issuer"), F.lit(1).alias("priority"), F.lit(r"DECREE\s+([0-9]+ V [0-9]+)").alias("pattern"), F.lit(1).alias("part"), F.lit(False).alias("if_empty"),
        F.lit(r"\s*V\s*").alias("find"), F.lit("/").alias("put"), F.lit("DECREE").alias("source"),
    )
    prn = nations.filter(key % 3 == 1).select(
        name.alias("issuer"), F.lit(1).alias("priority"), F.lit("PRN[0-9]{4}").alias("pattern"), F.lit(0).alias("part"), F.lit(True).alias("if_empty"),
        F.lit(r"\s+").alias("find"), F.lit("").alias("put"), F.lit("PRN").alias("source"),
    )
    doc = F.col("doc_id")
    org = (doc % 25).cast("string")
    number = (1000 + doc % 9000).cast("string")
    codes = F.when(doc % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" n"), org, F.lit("-"), number, F.lit(" and N"), org, F.lit("-"), number, F.lit("-1.")))
    text = F.concat(
        "text", F.lit("\nREF "), org, F.lit("AB"), F.lpad((doc % 100).cast("string"), 2, "0"), F.lit(" issued"), codes, F.lit(" decree "), (10 + doc % 90).cast("string"),
        F.lit(" V "), (2000 + doc % 30).cast("string"), F.lit(" PRN"), F.lpad((doc % 10000).cast("string"), 4, "0"),
    )
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"), F.concat(F.lit("N"), org).alias("issuer"))
    return V.codes_by_table(docs, own.unionAll(refs), decree.unionAll(prn)).select("doc_id", F.array_join("codes", ",").alias("codes"), "cert_no", "source")


def _ruled_sql(enabled: str) -> str:
    """Result of the rules that ``enabled`` leaves switched on."""
    return f"""
    WITH {PHRASES_SQL},
    b AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'UNKNOWN' END AS org,
        trim(regexp_replace(replace(text, chr(10), ' ' || CAST(DATE '2026-01-01' + CAST(doc_id % 700 AS INTEGER) AS VARCHAR) || ' '), '\\s+', ' ', 'g')) AS line FROM documents),
    f AS (SELECT *, upper(line) AS t FROM b),
    r AS (SELECT no, u, CASE WHEN no % 97 = 0 THEN 'non' WHEN no % 50 = 1 THEN 'code' WHEN no % 199 = 2 THEN 'maker' ELSE 'date' END AS kind,
        CASE no % 5 WHEN 0 THEN 'ALL' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' ELSE 'UNKNOWN' END AS target FROM phrases WHERE {enabled}),
    h AS (SELECT doc_id, org, line, t, no, u, kind, target FROM f JOIN r ON target IN ('ALL', 'UNKNOWN', org) AND contains(t, u) AND kind IN ('non', 'date')),
    split AS (SELECT doc_id, no, line, u, unnest(list_transform(range(1, len(string_split(t, u))::BIGINT), lambda k: 1 + (k - 1) * len(u) + list_sum(list_transform(string_split(t, u)[1:k], lambda x: len(x))))) AS pos FROM h WHERE kind = 'date'),
    chunk AS (SELECT doc_id, no, pos, regexp_extract(substr(line, CAST(pos AS BIGINT), 200 + no % 3 * 100), '\\b20[0-9]{{2}}-[0-9]{{1,2}}-[0-9]{{1,2}}\\b') AS x FROM split),
    dated AS (SELECT doc_id, no, arg_min(CAST(try_strptime(x, '%Y-%m-%d') AS DATE), pos) FILTER (try_strptime(x, '%Y-%m-%d') IS NOT NULL) AS v FROM chunk GROUP BY doc_id, no),
    one AS (SELECT doc_id, min(no) AS first FROM h WHERE kind = 'non' AND target IN ('ALL', org) GROUP BY doc_id),
    reset AS (SELECT one.doc_id, first, greatest(first, coalesce(max(h.no), 0)) AS last FROM one LEFT JOIN h ON h.doc_id = one.doc_id AND h.kind = 'non' AND h.no > first AND h.target IN ('ALL', 'UNKNOWN') GROUP BY one.doc_id, first),
    live AS (SELECT f.doc_id, f.org, coalesce(last, -1) AS last, last IS NOT NULL AS gone FROM f LEFT JOIN reset USING (doc_id)),
    x AS (SELECT l.doc_id, arg_max(v, h.no) AS v FROM live l JOIN h USING (doc_id) JOIN dated e ON e.doc_id = h.doc_id AND e.no = h.no
      WHERE v IS NOT NULL AND h.no > l.last AND h.target IN ('ALL', CASE WHEN l.gone THEN 'UNKNOWN' ELSE l.org END) GROUP BY l.doc_id),
    c AS (SELECT DISTINCT l.doc_id FROM live l JOIN r ON r.kind = 'code' AND r.no > l.last AND r.target IN ('ALL', CASE WHEN l.gone THEN 'UNKNOWN' ELSE l.org END) AND r.no % 7 = l.doc_id % 7),
    m AS (SELECT DISTINCT l.doc_id FROM live l JOIN r ON r.kind = 'maker' AND NOT l.gone AND r.target IN ('ALL', l.org))
    SELECT l.doc_id, CASE WHEN l.gone THEN 'UNKNOWN' ELSE l.org END AS issuer, CASE WHEN c.doc_id IS NOT NULL THEN 'QQ' || l.doc_id % 7 || l.doc_id WHEN l.gone THEN '' ELSE 'OLD' END AS cert_no,
      CASE WHEN x.doc_id IS NOT NULL THEN CAST(x.v AS VARCHAR) WHEN l.gone THEN '' ELSE '1999-01-01' END AS expiry,
      CASE WHEN l.gone THEN '' WHEN m.doc_id IS NOT NULL THEN 'Acme Foods Ltd' ELSE 'Company Name: Acme Foods Ltd 25 Long Street, Town' END AS maker,
      CASE WHEN l.gone THEN 'NON_CERTIFICATE_DOC' ELSE 'LOW_CONFIDENCE' END AS parse_status
    FROM live l LEFT JOIN x USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
    """


def _rules(spark, d, enabled) -> DataFrame:
    no = F.col("no")
    kind = F.when(no % 97 == 0, "non_cert_doc").when(no % 50 == 1, "code_pattern").when(no % 199 == 2, "maker_cleanup").otherwise("date_anchor")
    target = F.when(no % 5 == 0, "ALL").when(no % 5 == 1, "A").when(no % 5 == 2, "B").when(no % 5 == 3, "C").otherwise("UNKNOWN")
    own = F.array("phrase")
    none = F.lit(None).cast("array<string>")
    return phrases(spark, d).select(
        no.alias("rule_id"), no.alias("priority"), enabled.alias("enabled"), target.alias("target_org"), kind.alias("rule_kind"), F.when(kind == "date_anchor", "expiry").alias("target_field"),
        own.alias("anchors"), none.alias("stop_before"), (200 + no % 3 * 100).cast("int").alias("window"),
        F.array(F.concat(F.lit("qq"), (no % 7).cast("string"), F.lit("[0-9]{1,9}"))).alias("patterns"), own.alias("markers"),
    )


def _read(spark, d) -> DataFrame:
    """documents with dates at line ends and a code, and what was read from them before."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2026-01-01").cast("date"), (doc % 700).cast("int")).cast("string")
    dated = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit(" "), day, F.lit(" ")))
    text = F.concat(dated, F.lit(" QQ"), (doc % 7).cast("string"), doc.cast("string"))
    org = F.when(doc % 4 == 0, "A").when(doc % 4 == 1, "B").when(doc % 4 == 2, "C").otherwise("UNKNOWN")
    return table(spark, d, "documents").select(
        "doc_id", text.alias("text"), org.alias("issuer"), F.lit("OLD").alias("cert_no"), F.lit("1999-01-01").alias("expiry"),
        F.lit("Company Name: Acme Foods Ltd 25 Long Street, Town").alias("maker"), F.lit("LOW_CONFIDENCE").alias("parse_status"),
    )


@query("ext_12_rule_table", _ruled_sql("no % 11 <> 0"))
def rule_table(spark, d):
    return V.apply_rule_table(_read(spark, d), _rules(spark, d, F.col("no") % 11 != 0)).drop("text", "applied")


@query(
    "ext_12_what_if",
    f"""
    WITH a AS ({_ruled_sql("no % 11 <> 0")}), b AS ({_ruled_sql("no % 13 <> 0")}),
    pairs AS (SELECT a.doc_id, unnest([{{'f': 'issuer', 'x': a.issuer, 'y': b.issuer}}, {{'f': 'cert_no', 'x': a.cert_no, 'y': b.cert_no}}, {{'f': 'expiry', 'x': a.expiry, 'y': b.expiry}},
      {{'f': 'maker', 'x': a.maker, 'y': b.maker}}, {{'f': 'parse_status', 'x': a.parse_status, 'y': b.parse_status}}]) AS p FROM a JOIN b USING (doc_id))
    SELECT doc_id, p.f AS field, p.x AS before, p.y AS after, CASE WHEN p.x = '' THEN 'ADDED' WHEN p.y = '' THEN 'REMOVED' ELSE 'CHANGED' END AS kind FROM pairs WHERE p.x <> p.y
    """,
)
def rule_change(spark, d):
    no = F.col("no")
    return V.what_if(_read(spark, d), _rules(spark, d, no % 11 != 0), _rules(spark, d, no % 13 != 0)).drop("rule_id")
