"""Decision tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import aggregate, decisions as DEC, metrics, rank, state
from attestry.plans.aggregates import AS_OF, CERT_SQL, TOKEN_SQL, certificates, near_copy_tokens
from attestry.plans.registry import query, table


@query("dec_1_expiry_action", f"WITH {CERT_SQL} SELECT item_id, coalesce(mail_type, 'NONE') AS kind FROM items")
def expiry_action(spark, d):
    c = certificates(spark, d)
    return c.select("item_id", F.coalesce(aggregate.request_kind(F.col("org"), F.col("expiry"), AS_OF), F.lit("NONE")).alias("kind"))


def certificate_pairs(spark, d):
    """Consecutive orders of a customer as current and incoming certificate."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        "o_custkey", k.alias("id"), F.when(k % 23 == 0, F.lit("UNKNOWN")).otherwise(F.col("o_orderstatus")).alias("org"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("CN-"), F.substring("o_orderpriority", 1, 1))).alias("cert_no"),
        F.when(k % 13 != 0, F.to_date("o_orderdate")).alias("expiry"),
        F.when(k % 7 == 0, F.lit("Apex Trading")).when(k % 3 == 0, F.lit("Solaris Foods Co., Ltd.")).otherwise(F.lit("SOLARIS FOODS PTE LTD")).alias("maker"),
    )
    return rank.with_neighbours(o, ["o_custkey"], ["id"], F.floor(F.col("id") / 100000), ["id", "org", "cert_no", "expiry", "maker"])


PAIR_SQL = """
o AS (SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % 23 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS org, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'CN-' || substr(o_orderpriority, 1, 1) END AS cert_no,
   CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS expiry, CASE WHEN o_orderkey % 7 = 0 THEN 'Apex Trading' WHEN o_orderkey % 3 = 0 THEN 'Solaris Foods Co., Ltd.' ELSE 'SOLARIS FOODS PTE LTD' END AS maker FROM orders),
p AS (SELECT *, lag(id) OVER w AS pid, lag(org) OVER w AS porg, lag(cert_no) OVER w AS pno, lag(expiry) OVER w AS pexp, lag(maker) OVER w AS pmaker FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY id)),
code AS (SELECT *, CASE WHEN id % 17 = 0 THEN 'WRONG_CERTIFICATE' WHEN pid IS NOT NULL AND (maker = 'Apex Trading') <> (pmaker = 'Apex Trading') THEN 'MANUFACTURER_CHANGED' WHEN org = 'UNKNOWN' THEN 'OCR_REVIEW_REQUIRED'
   WHEN pid IS NULL THEN 'NEW_CERTIFICATE' WHEN org <> porg THEN 'AUTHORITY_CHANGE_REVIEW' WHEN cert_no = '' OR expiry IS NULL THEN 'INCOMPLETE_CERTIFICATE_REVIEW'
   WHEN pno = cert_no AND pexp IS NOT DISTINCT FROM expiry THEN 'DUPLICATE' WHEN pno = cert_no AND expiry > pexp THEN 'SAME_AUTHORITY_RENEWAL' WHEN pno = cert_no AND expiry < pexp THEN 'OLDER_CERTIFICATE'
   WHEN pno = cert_no THEN 'SAME_AUTHORITY_UPDATE_REVIEW' ELSE 'CERTIFICATE_NUMBER_CHANGED' END AS decision FROM p)
"""


def judged(spark, d):
    pairs = certificate_pairs(spark, d)
    cur = {f: F.col(f"prev.{f}") for f in ("org", "cert_no", "expiry", "maker")}
    inc = {f: F.col(f) for f in cur}
    code = DEC.change_code(cur, inc, F.col("id") % 17 != 0, DEC.same_maker(cur["maker"], inc["maker"]))
    return pairs.withColumn("decision", code).withColumn("changes", DEC.field_changes(cur, inc))


@query(
    "dec_2_certificate_change",
    f"""
    WITH {PAIR_SQL} SELECT id, decision, decision NOT IN ('DUPLICATE', 'SAME_AUTHORITY_RENEWAL') AS requires_review, decision IN ('WRONG_CERTIFICATE', 'MANUFACTURER_CHANGED', 'OCR_REVIEW_REQUIRED') AS blocked,
      CASE WHEN decision IN ('WRONG_CERTIFICATE', 'MANUFACTURER_CHANGED') THEN 'BLOCK' WHEN decision = 'DUPLICATE' THEN 'SKIP' WHEN decision = 'SAME_AUTHORITY_RENEWAL' THEN 'UPDATE_CURRENT' ELSE 'REVIEW' END AS auto_action,
      upper(coalesce(porg, '')) <> org AS org_changed, regexp_replace(coalesce(pno, ''), '[^A-Z0-9]', '', 'g') <> regexp_replace(cert_no, '[^A-Z0-9]', '', 'g') AS cert_no_changed FROM code
    """,
)
def certificate_change(spark, d):
    out = DEC.change_outcome(F.col("decision"))
    return judged(spark, d).select(
        "id", "decision", out["requires_review"].alias("requires_review"), out["blocked"].alias("blocked"), out["auto_action"].alias("auto_action"),
        F.col("changes")["org"]["changed"].alias("org_changed"), F.col("changes")["cert_no"]["changed"].alias("cert_no_changed"),
    )


@query(
    "dec_3_parse_status",
    r"""
    WITH f AS (SELECT doc_id, contains(text, 'zzz-engine') AS failed, contains(lower(text), 'license') AS non_cert, CASE lang WHEN 'de' THEN 'UNKNOWN' WHEN 'es' THEN 'BPJPH' ELSE upper(lang) END AS org,
       contains(text, '@') OR doc_id % 2 = 0 AS expiry, regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS cert_no, doc_id % 3 = 0 AS maker, regexp_matches(text, '[0-9]{16}') AS products, source = 'src19' AS fonly FROM documents)
    SELECT doc_id, CASE WHEN non_cert THEN 'NON_CERTIFICATE_DOC' WHEN org = 'BPJPH' THEN 'BPJPH_MAINTENANCE_ONLY' WHEN fonly THEN 'FILENAME_ONLY' WHEN org <> 'UNKNOWN' AND expiry AND products THEN 'RULE_MATCHED'
       WHEN org <> 'UNKNOWN' AND (expiry OR cert_no) THEN 'LOW_CONFIDENCE' ELSE 'MANUAL_REVIEW' END AS status,
      CASE WHEN non_cert THEN 'HIGH' WHEN org = 'BPJPH' THEN CASE WHEN cert_no OR products THEN 'MEDIUM' ELSE 'LOW' END WHEN fonly THEN 'LOW' WHEN org <> 'UNKNOWN' AND expiry AND products THEN 'HIGH'
       WHEN org <> 'UNKNOWN' AND (expiry OR cert_no) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM f
    """,
)
def parse_status(spark, d):
    t = F.col("text")
    org = F.when(F.col("lang") == "de", F.lit("UNKNOWN")).when(F.col("lang") == "es", F.lit("BPJPH")).otherwise(F.upper("lang"))
    status, conf = DEC.parse_status(
        t.contains("zzz-engine"), F.lower(t).contains("license"), F.trim(t) != "", org, t.contains("@") | (F.col("doc_id") % 2 == 0),
        t.rlike("[0-9]{3}-[0-9]{4}"), F.col("doc_id") % 3 == 0, t.rlike("[0-9]{16}"), F.lit(0.8), F.col("source") == "src19",
    )
    return table(spark, d, "documents").select("doc_id", status.alias("status"), conf.alias("confidence"))


@query(
    "dec_4_context_gate",
    """
    WITH f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS rel, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'P' ELSE 'F' END AS eorg, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' ELSE o_orderstatus END AS rorg,
       o_orderkey % 2 = 0 AS mk, o_orderkey % 4 = 1 AS pr, o_orderkey % 10 = 0 AS cn, DATE '1998-01-01' AS cur, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS exp, o_orderkey % 19 = 0 AS blk FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT *, rorg <> 'UNKNOWN' AND rorg <> eorg AS conflict, rorg = eorg OR (rorg = 'UNKNOWN' AND rel <> 'LOW') AS om, coalesce(exp < cur, FALSE) AS reg FROM f),
    s AS (SELECT *, CAST(om AS INTEGER) * 35 + CAST(mk AS INTEGER) * 30 + CAST(pr AS INTEGER) * 25 + CAST(cn AS INTEGER) * 10 AS score, rel = 'HIGH' AND NOT conflict AND NOT blk AND NOT reg AND om AND (mk OR pr) AND exp IS NOT NULL AS ok FROM g),
    t AS (SELECT *, CASE WHEN conflict THEN 'CONFLICT' WHEN blk THEN 'PROFILE_REVIEW' WHEN ok THEN 'VERIFIED' WHEN score >= 35 THEN 'ASSISTED' ELSE 'UNVERIFIED' END AS context_status FROM s)
    SELECT o_orderkey, CAST(score AS BIGINT) AS context_score, context_status, CASE WHEN context_status IN ('CONFLICT', 'PROFILE_REVIEW') THEN 'MANUAL_REVIEW' WHEN context_status = 'VERIFIED' THEN 'RULE_MATCHED' WHEN context_status = 'ASSISTED' THEN 'LOW_CONFIDENCE' ELSE 'UNCHANGED' END AS parse_status, reg AS date_regression, ok AS auto_confirm FROM t
    """,
)
def context_gate(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = DEC.reconcile(
        F.when(k % 3 == 0, F.lit("HIGH")).when(k % 3 == 1, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("P")).otherwise(F.lit("F")),
        F.when(k % 5 == 0, F.lit("UNKNOWN")).otherwise(F.col("o_orderstatus")),
        k % 2 == 0, k % 4 == 1, k % 10 == 0, F.lit("1998-01-01").cast("date"), F.when(k % 7 != 0, F.to_date("o_orderdate")), k % 19 == 0,
    )
    cols = ["context_score", "context_status", "parse_status", "date_regression", "auto_confirm"]
    return rows.select("o_orderkey", *[out[c].cast("bigint").alias(c) if c == "context_score" else out[c].alias(c) for c in cols])


@query(
    "dec_5_profile",
    r"""
    WITH f AS (SELECT doc_id, CASE WHEN contains(text, ' the ') THEN 'EN' WHEN contains(text, ' der ') THEN 'DE' ELSE 'UNKNOWN' END AS body, CASE WHEN source IN ('src1', 'src2') THEN 'EN' WHEN source = 'src3' THEN 'DE' ELSE 'UNKNOWN' END AS nm, upper(lang) AS base,
       regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS no, doc_id % 4 <> 0 AS exp, doc_id % 8 = 1 AS fromname, contains(text, 'tion') AS anchor, doc_id % 9 = 0 AS susp FROM documents),
    g AS (SELECT *, CASE WHEN body <> 'UNKNOWN' THEN body WHEN nm <> 'UNKNOWN' THEN nm ELSE base END AS org, CASE WHEN body <> 'UNKNOWN' THEN 'TEXT_STRONG' WHEN nm <> 'UNKNOWN' THEN 'FILENAME_FALLBACK' ELSE 'BASE_RULE' END AS org_source FROM f)
    SELECT doc_id, org, org_source, concat_ws(',', CASE WHEN body <> 'UNKNOWN' AND nm <> 'UNKNOWN' AND body <> nm THEN 'FILENAME_ORG_CONFLICT' END, CASE WHEN org <> base THEN 'ORG_CHANGED_FROM_BASE_RULE' END, CASE WHEN org_source = 'FILENAME_FALLBACK' THEN 'FILENAME_DEPENDENT_ORG' END,
      CASE WHEN NOT no THEN 'CERT_NO_MISSING' END, CASE WHEN NOT exp THEN 'EXPIRY_MISSING' END, CASE WHEN susp THEN 'MANUFACTURER_UNRELIABLE' END, CASE WHEN exp AND fromname THEN 'EXPIRY_FROM_FILENAME' END, CASE WHEN exp AND fromname AND anchor THEN 'EXPIRY_LABEL_UNREADABLE' END) AS flags,
      concat_ws(',', CASE WHEN NOT no THEN 'CERT_NO_MISSING' END, CASE WHEN exp AND fromname AND anchor THEN 'EXPIRY_LABEL_UNREADABLE' END, CASE WHEN NOT exp THEN 'EXPIRY_MISSING' END, CASE WHEN body <> 'UNKNOWN' AND nm <> 'UNKNOWN' AND body <> nm THEN 'FILENAME_ORG_CONFLICT' END, CASE WHEN susp THEN 'MANUFACTURER_UNRELIABLE' END) AS blocking FROM g
    """,
)
def profile(spark, d):
    t, k = F.col("text"), F.col("doc_id")
    out = DEC.finalise_profile(
        F.when(t.contains(" the "), F.lit("EN")).when(t.contains(" der "), F.lit("DE")).otherwise(F.lit("UNKNOWN")),
        F.when(F.col("source").isin("src1", "src2"), F.lit("EN")).when(F.col("source") == "src3", F.lit("DE")).otherwise(F.lit("UNKNOWN")),
        F.upper("lang"), t.rlike("[0-9]{3}-[0-9]{4}"), k % 4 != 0, k % 8 == 1, t.contains("tion"), k % 9 == 0,
    )
    return table(spark, d, "documents").select(
        "doc_id", out["org"].alias("org"), out["org_source"].alias("org_source"), F.array_join(out["flags"], ",").alias("flags"), F.array_join(out["blocking"], ",").alias("blocking")
    )


@query(
    "dec_6_final_issuer",
    """
    WITH f AS (SELECT doc_id, coalesce(toxic, 0) = 1 AS ex, CASE WHEN doc_id % 10 = 0 THEN 'ADM' END AS adm, CASE doc_id % 3 WHEN 0 THEN 'AUTO_IMAGE' WHEN 1 THEN 'REVIEW' ELSE 'MANUAL_REVIEW' END AS dec, upper(source) AS img, CASE WHEN quality = 0 THEN 'UNKNOWN' WHEN doc_id % 4 = 0 THEN upper(source) ELSE upper(lang) END AS txt FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN ex THEN '-' WHEN adm IS NOT NULL THEN adm WHEN dec = 'AUTO_IMAGE' THEN img WHEN txt <> 'UNKNOWN' THEN txt ELSE img END AS issuer,
      CASE WHEN ex THEN 'ADMIN_EXCLUDED' WHEN adm IS NOT NULL THEN 'ADMIN' WHEN dec = 'AUTO_IMAGE' THEN 'IMAGE_AUTO' WHEN txt <> 'UNKNOWN' THEN 'TEXT_RULE' ELSE 'IMAGE_REVIEW_CANDIDATE' END AS origin,
      CASE WHEN ex OR txt = 'UNKNOWN' THEN FALSE ELSE img <> txt END AS conflict FROM f
    """,
)
def final_issuer(spark, d):
    k = F.col("doc_id")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    text_org = F.when(F.col("quality") == 0, F.lit("UNKNOWN")).when(k % 4 == 0, F.upper("source")).otherwise(F.upper("lang"))
    image = F.when(k % 3 == 0, F.lit("AUTO_IMAGE")).when(k % 3 == 1, F.lit("REVIEW")).otherwise(F.lit("MANUAL_REVIEW"))
    org, source, conflict = DEC.final_issuer(F.coalesce("toxic", F.lit(0)) == 1, F.when(k % 10 == 0, F.lit("ADM")), image, F.upper("source"), text_org)
    return rows.select("doc_id", org.alias("issuer"), source.alias("origin"), conflict.alias("conflict"))


def votes(spark, d):
    """Four readings of each customer's segment and name, with noise."""
    k = F.col("c_custkey")
    rows = []
    for field, col in (("maker", "c_name"), ("cert_no", "c_mktsegment")):
        v = F.col(col)
        rows += [
            (field, "master", F.when(k % 3 == 0, F.lit("")).otherwise(v)), (field, "full_rule", F.when(k % 5 == 0, F.concat(v, F.lit("X"))).otherwise(F.lower(v))),
            (field, "conditional_rule", F.when(k % 4 == 0, F.concat(v, F.lit("X"))).otherwise(v)), (field, "filename", F.when(k % 2 == 0, F.lit("other")).otherwise(F.lit("-"))),
        ]
    structs = [F.struct(F.lit(f).alias("field"), F.lit(s).alias("source"), v.alias("value")) for f, s, v in rows]
    return table(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.inline(F.array(*structs)))


VOTE_SQL = """
b AS (SELECT c_custkey AS k, 'maker' AS field, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'cert_no', c_mktsegment FROM customer),
v AS (SELECT k, field, 'master' AS s, 5 AS w, CASE WHEN k % 3 = 0 THEN '' ELSE v END AS v FROM b UNION ALL SELECT k, field, 'full_rule', 4, CASE WHEN k % 5 = 0 THEN v || 'X' ELSE lower(v) END FROM b
   UNION ALL SELECT k, field, 'conditional_rule', 3, CASE WHEN k % 4 = 0 THEN v || 'X' ELSE v END FROM b UNION ALL SELECT k, field, 'filename', 2, CASE WHEN k % 2 = 0 THEN 'other' ELSE '-' END FROM b),
g AS (SELECT k, field, regexp_replace(upper(v), '[^A-Z0-9]+', '', 'g') AS vk, sum(w)::BIGINT AS w, count(*) AS n, string_agg(s, ',' ORDER BY s) AS sources, arg_max(v, w) AS value FROM v WHERE v NOT IN ('', '-') GROUP BY 1, 2, 3),
c AS (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY w DESC, n DESC, vk DESC) AS rn, count(*) OVER (PARTITION BY k, field) AS nv FROM g),
st AS (SELECT k AS doc, field, value, sources, w AS weight, nv > 1 AS conflict, (k % 10) / 10.0 + 0.05 AS ev, k % 6 <> 0 AS strong FROM c WHERE rn = 1)
"""


def consensus_rows(spark, d):
    best = DEC.consensus(votes(spark, d), ["doc", "field"], "source", "value")
    evidence = F.round((F.col("doc") % 10) / 10 + 0.05, 2)
    status = DEC.consensus_status(
        F.col("field"), F.lit("HQC"), F.col("value"), F.col("sources"), F.col("conflict"), F.col("evidence"), F.col("doc") % 6 != 0
    )
    return best.withColumn("evidence", evidence).withColumn("status", status)


_STATUS = """
CASE WHEN conflict THEN 'REVIEW_REQUIRED' WHEN field = 'cert_no' AND contains(sources, 'full_rule') AND contains(sources, 'conditional_rule') AND ev >= 0.95 THEN 'AUTO_READY' WHEN strong AND contains(sources, 'master') AND ev >= 0.72 THEN 'AUTO_READY'
     WHEN field = 'maker' AND contains(sources, 'full_rule') AND contains(sources, 'conditional_rule') AND ev >= 0.9 THEN 'AUTO_READY' ELSE 'CANDIDATE_ONLY' END
"""


@query("dec_7_consensus", f"WITH {VOTE_SQL} SELECT doc, field, value, sources, weight, conflict, {_STATUS} AS status FROM st")
def consensus(spark, d):
    return consensus_rows(spark, d).select("doc", "field", "value", F.array_join("sources", ",").alias("sources"), "weight", "conflict", "status")


@query(
    "dec_8_promotion",
    f"""
    WITH {VOTE_SQL}, x AS (SELECT *, {_STATUS} AS status FROM st)
    SELECT doc, field, status = 'REVIEW_REQUIRED' AND contains(sources, 'full_rule') AND contains(sources, 'conditional_rule')
      AND CASE field WHEN 'cert_no' THEN ev >= 0.95 AND length(value) >= 5 ELSE ev >= 0.9 AND contains(upper(value), 'CUSTOMER') END AS promoted FROM x
    """,
)
def promotion(spark, d):
    c = consensus_rows(spark, d)
    ok = DEC.promotable(F.col("field"), F.col("status"), F.col("value"), F.col("sources"), F.col("evidence"), F.upper("value").contains("CUSTOMER"))
    return c.select("doc", "field", ok.alias("promoted"))


@query(
    "dec_9_field_change",
    """
    WITH f AS (SELECT c_mktsegment AS org, unnest(['name', 'expiry', 'org']) AS field, unnest([CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, '2026-01-15', c_mktsegment]) AS b,
       unnest([CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END, CASE WHEN c_custkey % 97 = 0 THEN '2025-12-31' WHEN c_custkey % 2 = 0 THEN '2026-02-01' ELSE '2026-01-15' END, CASE WHEN c_custkey % 9 = 0 THEN 'NEW' ELSE c_mktsegment END]) AS a,
       c_custkey % 50 = 0 AS expected FROM customer),
    c AS (SELECT org, field, CASE WHEN a = b THEN 'UNCHANGED' WHEN expected AND a = '2026-02-01' THEN 'IMPROVED' WHEN b = '' AND a <> '' THEN 'IMPROVED' WHEN b <> '' AND a = '' THEN 'REGRESSION' WHEN field = 'expiry' AND a < b THEN 'REGRESSION' WHEN field = 'org' THEN 'MANUAL_REVIEW' ELSE 'CHANGED_REVIEW' END AS change FROM f)
    SELECT org, field, count(*) FILTER (change = 'IMPROVED') AS improved, count(*) FILTER (change = 'REGRESSION') AS regressions, count(*) FILTER (change IN ('CHANGED_REVIEW', 'MANUAL_REVIEW')) AS reviews,
      field <> 'org' AND count(*) FILTER (change = 'REGRESSION') = 0 AND count(*) FILTER (change = 'IMPROVED') >= 1 AS auto_apply FROM c GROUP BY 1, 2
    """,
)
def field_change(spark, d):
    k = F.col("c_custkey")
    pairs = F.array(
        F.struct(F.lit("name").alias("field"), F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("b"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_name")).alias("a")),
        F.struct(F.lit("expiry").alias("field"), F.lit("2026-01-15").alias("b"), F.when(k % 97 == 0, F.lit("2025-12-31")).when(k % 2 == 0, F.lit("2026-02-01")).otherwise(F.lit("2026-01-15")).alias("a")),
        F.struct(F.lit("org").alias("field"), F.col("c_mktsegment").alias("b"), F.when(k % 9 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")).alias("a")),
    )
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("org"), F.when(k % 50 == 0, F.array(F.lit("2026-02-01"))).alias("expected"), F.inline(pairs))
    change = DEC.classify_field_change(F.col("field"), F.col("b"), F.col("a"), F.col("expected"))
    stats = rows.withColumn("change", change).groupBy("org", "field").agg(
        F.count_if(F.col("change") == "IMPROVED").alias("improved"), F.count_if(F.col("change") == "REGRESSION").alias("regressions"),
        F.count_if(F.col("change").isin("CHANGED_REVIEW", "MANUAL_REVIEW")).alias("reviews"),
    )
    return stats.withColumn("auto_apply", DEC.may_auto_apply(F.col("org"), F.col("field"), F.lit("LOW"), F.col("regressions"), F.col("improved")))


@query(
    "dec_10_filing_checks",
    """
    WITH f AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 'RUNNING' ELSE 'done' END AS js, CASE WHEN o_orderkey % 3 = 0 THEN 'LOW_CONFIDENCE' ELSE 'RULE_MATCHED' END AS ps, CASE o_orderstatus WHEN 'P' THEN 'BPJPH' WHEN 'O' THEN 'HQC' ELSE 'UNKNOWN' END AS org, o_orderkey % 5 <> 0 AS exp, o_orderkey % 4 <> 0 AS no, o_orderkey % 7 <> 0 AS item, o_orderkey % 2 = 0 AS plan, o_orderpriority FROM orders)
    SELECT k AS o_orderkey, CASE WHEN no THEN '' ELSE 'no_cert_no' END AS warnings, CASE WHEN item THEN '' ELSE 'no_request_item' END AS hard_blockers,
      concat_ws(',', CASE WHEN NOT item THEN 'no_request_item' END, CASE WHEN js <> 'done' THEN 'job_not_done' END, CASE WHEN ps = 'LOW_CONFIDENCE' THEN 'reading_not_confirmed' END, CASE WHEN org = 'UNKNOWN' THEN 'no_issuer' END,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'no_maker' END, CASE WHEN org <> 'BPJPH' AND NOT exp THEN 'no_expiry' END, CASE WHEN org = 'BPJPH' AND item AND NOT plan THEN 'no_planned_expiry' END) AS blockers,
      k % 300 >= 150 AND k % 11 <> 0 AND ps <> 'LOW_CONFIDENCE' AND item AS auto_match FROM f
    """,
)
def filing_checks(spark, d):
    k = F.col("o_orderkey")
    out = DEC.filing_checks(
        F.when(k % 10 == 0, F.lit("RUNNING")).otherwise(F.lit("done")), F.when(k % 3 == 0, F.lit("LOW_CONFIDENCE")).otherwise(F.lit("RULE_MATCHED")),
        F.when(F.col("o_orderstatus") == "P", F.lit("BPJPH")).when(F.col("o_orderstatus") == "O", F.lit("HQC")).otherwise(F.lit("UNKNOWN")),
        F.when(k % 5 != 0, F.to_date("o_orderdate")), F.when(k % 4 != 0, F.lit("CN")), {"maker": F.when(F.col("o_orderpriority") == "5-LOW", F.lit("-")).otherwise(F.col("o_orderpriority"))},
        k % 7 != 0, F.when(k % 2 == 0, F.to_date("o_orderdate")),
    )
    parse = F.when(k % 3 == 0, F.lit("LOW_CONFIDENCE")).otherwise(F.lit("RULE_MATCHED"))
    auto = DEC.auto_match(out["hard_blockers"], parse, k % 300, k % 11 != 0)
    return table(spark, d, "orders").select("o_orderkey", *[F.array_join(c, ",").alias(n) for n, c in out.items()], auto.alias("auto_match"))


@query(
    "dec_11_confirm_gate",
    f"""
    WITH {PAIR_SQL}, r AS (SELECT id, decision, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'APPROVE_RENEWAL' WHEN 2 THEN 'REPLACE_CURRENT' WHEN 3 THEN 'ADD_SECONDARY' WHEN 4 THEN 'HOLD' ELSE 'REGISTER_AS_PRIMARY' END AS req FROM code),
    w AS (SELECT *, CASE WHEN req IN ('APPROVE_RENEWAL', 'REGISTER_AS_PRIMARY') THEN 'UPDATE_CURRENT' ELSE req END AS want, decision NOT IN ('DUPLICATE', 'SAME_AUTHORITY_RENEWAL') AS rev, CASE decision WHEN 'DUPLICATE' THEN 'SKIP' WHEN 'SAME_AUTHORITY_RENEWAL' THEN 'UPDATE_CURRENT' END AS auto,
       CASE decision WHEN 'NEW_CERTIFICATE' THEN ['UPDATE_CURRENT'] WHEN 'AUTHORITY_CHANGE_REVIEW' THEN ['REPLACE_CURRENT', 'ADD_SECONDARY', 'HOLD'] WHEN 'SAME_AUTHORITY_UPDATE_REVIEW' THEN ['UPDATE_CURRENT'] WHEN 'CERTIFICATE_NUMBER_CHANGED' THEN ['UPDATE_CURRENT', 'ADD_SECONDARY'] ELSE [] END AS opts FROM r),
    e AS (SELECT *, CASE WHEN rev THEN want ELSE auto END AS act, CASE WHEN decision IN ('WRONG_CERTIFICATE', 'MANUFACTURER_CHANGED', 'OCR_REVIEW_REQUIRED') THEN 'BLOCKED' WHEN rev AND want = '' THEN 'ACTION_REQUIRED' WHEN rev AND NOT list_contains(opts, want) THEN 'ACTION_NOT_ALLOWED'
       WHEN NOT rev AND want <> '' AND want <> auto THEN 'CANNOT_OVERRIDE' WHEN (CASE WHEN rev THEN want ELSE auto END) NOT IN ('UPDATE_CURRENT', 'REPLACE_CURRENT', 'ADD_SECONDARY') THEN 'NOT_A_CONFIRMATION' END AS error FROM w)
    SELECT id, CASE WHEN error IS NULL THEN act END AS action, CASE WHEN error IS NULL THEN CASE act WHEN 'UPDATE_CURRENT' THEN 'CONFIRMED' WHEN 'REPLACE_CURRENT' THEN 'REPLACED' ELSE 'SECONDARY_ADDED' END END AS status, error FROM e
    """,
)
def confirm_gate(spark, d):
    k = F.col("id") % 6
    req = F.when(k == 0, F.lit("")).when(k == 1, F.lit("approve_renewal")).when(k == 2, F.lit("REPLACE_CURRENT")).when(k == 3, F.lit("ADD_SECONDARY")).when(k == 4, F.lit("HOLD")).otherwise(F.lit("REGISTER_AS_PRIMARY"))
    action, status, error = DEC.confirm_gate(F.col("decision"), req)
    return judged(spark, d).select("id", action.alias("action"), status.alias("status"), error.alias("error"))


@query(
    "dec_12_structure",
    """
    WITH s AS (SELECT l_orderkey, list_distinct(list(l_partkey) FILTER (l_discount >= 0.05::DOUBLE)) AS items, list_distinct(list(l_partkey) FILTER (l_linenumber <= 2)) AS docs FROM lineitem GROUP BY 1),
    n AS (SELECT l_orderkey, len(coalesce(items, [])) AS i, len(list_filter(coalesce(docs, []), lambda x: NOT list_contains(coalesce(items, []), x))) > 0 AS own FROM s)
    SELECT l_orderkey, CASE WHEN i >= 2 AND own THEN 'MIXED' WHEN i >= 2 THEN 'ITEM_LEVEL' WHEN own THEN 'DOCUMENT_LEVEL' ELSE 'UNKNOWN' END AS structure FROM n
    """,
)
def structure(spark, d):
    numbers = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", (F.col("l_discount") >= 0.05).alias("item"), (F.col("l_linenumber") <= 2).alias("doc")
    )
    return DEC.structure(numbers, "l_orderkey", "l_partkey", "item", "doc")


@query(
    "dec_13_quality_grades",
    f"""
    WITH {TOKEN_SQL}, m AS (SELECT doc_id, recall AS tk, recall AS cr, number_recall AS nr, CASE WHEN doc_id % 20 = 0 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END AS pg, CASE WHEN doc_id % 3 = 0 THEN 0.84::DOUBLE ELSE 0.95::DOUBLE END AS cf FROM ov),
    r AS (SELECT *, round(tk, 9) AS a, least(tk, nr) AS lo, (tk + nr) / 2 AS av FROM m)
    SELECT doc_id, CASE WHEN tk >= 0.85 AND cr >= 0.9 AND nr >= 0.9 AND pg >= 1 AND cf >= 0.9 THEN 'PASS' WHEN tk >= 0.7 AND cr >= 0.75 AND nr >= 0.75 AND pg >= 0.9 AND cf >= 0.8 THEN 'REVIEW' ELSE 'FAIL' END AS grade,
      concat_ws(',', CASE WHEN tk < 0.8 THEN 'token' END, CASE WHEN cr < 0.85 THEN 'critical' END, CASE WHEN nr < 0.85 THEN 'number' END, CASE WHEN pg < 1 THEN 'pages' END, CASE WHEN cf < 0.85 THEN 'confidence' END) AS short_of,
      CASE WHEN pg = 1 AND av >= 0.85 AND tk >= 0.85 AND lo >= 0.65 THEN 'USABLE' WHEN pg >= 0.9 AND av >= 0.65 AND tk >= 0.65 THEN 'REVIEW' ELSE 'EXCLUDED' END AS document_grade FROM r
    """,
)
def quality_grades(spark, d):
    ov = metrics.multiset_overlap(near_copy_tokens(spark, d), "doc_id", "expected", "observed")
    pages = F.when(F.col("doc_id") % 20 == 0, F.lit(0.95)).otherwise(F.lit(1.0))
    conf = F.when(F.col("doc_id") % 3 == 0, F.lit(0.84)).otherwise(F.lit(0.95))
    grade, why = metrics.grade({"token": F.col("recall"), "critical": F.col("recall"), "number": F.col("number_recall"), "pages": pages, "confidence": conf})
    doc = metrics.document_grade((F.col("recall") + F.col("number_recall")) / 2, F.col("recall"), F.least("recall", "number_recall"), pages)
    return ov.select("doc_id", grade.alias("grade"), F.array_join(why, ",").alias("short_of"), doc.alias("document_grade"))


@query(
    "dec_14_master_update",
    """
    WITH m AS (SELECT o_orderkey, o_orderstatus AS org, o_orderpriority AS cert_no, CAST(o_orderdate AS DATE) AS expiry FROM orders),
    u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'NEW' END AS norg, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS nno, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE DATE '1998-06-30' END AS nexp FROM orders WHERE o_orderkey % 2 = 0),
    j AS (SELECT m.*, u.o_orderkey IS NOT NULL AS upd, nullif(trim(norg), '') AS norg, nullif(nno, '') AS nno, nexp, coalesce(nexp < expiry, FALSE) AS ref FROM m LEFT JOIN u USING (o_orderkey)),
    a AS (SELECT *, CASE WHEN upd AND NOT ref THEN coalesce(norg, org) ELSE org END AS aorg, CASE WHEN upd AND NOT ref THEN coalesce(nno, cert_no) ELSE cert_no END AS ano, CASE WHEN upd AND NOT ref THEN coalesce(nexp, expiry) ELSE expiry END AS aexp FROM j)
    SELECT o_orderkey, aorg AS org, ano AS cert_no, CAST(aexp AS VARCHAR) AS expiry, concat_ws(',', CASE WHEN aorg <> org THEN 'org' END, CASE WHEN ano <> cert_no THEN 'cert_no' END, CASE WHEN aexp <> expiry THEN 'expiry' END) AS changed,
      CASE WHEN NOT upd THEN 'UNTOUCHED' WHEN ref THEN 'REFUSED_EARLIER_EXPIRY' WHEN aorg = org AND ano = cert_no AND aexp = expiry THEN 'NO_CHANGE' ELSE 'UPDATED' END AS outcome FROM a
    """,
)
def master_update(spark, d):
    k = F.col("o_orderkey")
    orders = table(spark, d, "orders")
    master = orders.select(k, F.col("o_orderstatus").alias("org"), F.col("o_orderpriority").alias("cert_no"), F.to_date("o_orderdate").alias("expiry"))
    updates = orders.filter(k % 2 == 0).select(
        k, F.when(k % 4 == 0, F.lit(" ")).otherwise(F.lit("NEW")).alias("norg"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("nno"),
        F.when(k % 6 != 0, F.lit("1998-06-30").cast("date")).alias("nexp"),
    )
    out = state.apply_updates(master, updates, "o_orderkey", {"org": "norg", "cert_no": "nno", "expiry": "nexp"}, "expiry")
    return out.select("o_orderkey", "org", "cert_no", F.col("expiry").cast("string").alias("expiry"), F.array_join("changed", ",").alias("changed"), "outcome")
