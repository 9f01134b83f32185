"""Joins and record linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import linkage as L
from attestry.operators import rank, reshape, rules, vectors
from attestry.operators import search as S
from attestry.operators import vocabulary as V
from attestry.plans.common import WIDE_SQL, wide_master
from attestry.plans.registry import query, table
from attestry.session import cut_lineage


@query(
    "jn_1_selected_attachments",
    """
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND coalesce(o_orderkey % 10, 0) <> 0 AND l_returnflag = 'A'
    """,
)
def selected_attachments(spark, d):
    mail = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % 10 == 0).alias("is_excluded"))
    files = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey")
    kept = files.join(mail, "l_orderkey", "left").filter((F.col("o_orderstatus") == "F") & ~F.coalesce("is_excluded", F.lit(False)))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderpriority")


@query(
    "jn_2_two_tier_lookup",
    r"""
    WITH a AS (SELECT page_id AS id, lower(url) AS path, regexp_extract(regexp_replace(lower(url), '[?#].*$', ''), '([^/]*)/?$', 1) AS name FROM pages),
    s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN lower(url) ELSE 'gone' END AS path, regexp_extract(regexp_replace(lower(url), '[?#].*$', ''), '([^/]*)/?$', 1) AS name FROM pages),
    p AS (SELECT path, max(id) AS id, count(*) AS n FROM a GROUP BY 1), q AS (SELECT name, max(id) AS id, count(*) AS n FROM a GROUP BY 1)
    SELECT page_id, coalesce(p.id, q.id, -1) AS attachment_id, coalesce(p.n, q.n, 0)::BIGINT AS match_count, CASE WHEN p.id IS NOT NULL THEN 'PATH' WHEN q.id IS NOT NULL THEN 'NAME' ELSE 'NONE' END AS tier FROM s LEFT JOIN p USING (path) LEFT JOIN q ON q.name = s.name
    """,
)
def two_tier_lookup(spark, d):
    name = F.regexp_extract(F.regexp_replace(F.lower("url"), "[?#].*$", ""), "([^/]*)/?$", 1)
    pages = table(spark, d, "pages").select("page_id", F.lower("url").alias("path"), name.alias("name"))
    by_path = pages.groupBy("path").agg(F.max("page_id").alias("pid"), F.count("*").alias("pn"))
    by_name = pages.groupBy("name").agg(F.max("page_id").alias("nid"), F.count("*").alias("nn"))
    jobs = pages.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.lit("gone")).alias("path"), "name")
    j = jobs.join(by_path, "path", "left").join(by_name, "name", "left")
    tier = rules.decide([(F.col("pid").isNotNull(), "PATH"), (F.col("nid").isNotNull(), "NAME")], "NONE")
    return j.select("page_id", F.coalesce("pid", "nid", F.lit(-1)).alias("attachment_id"), F.coalesce("pn", "nn", F.lit(0)).cast("bigint").alias("match_count"), tier.alias("tier"))


@query(
    "jn_3_latest_log",
    "SELECT c_custkey, coalesce(max(o_orderkey), -1) AS log_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND o_orderkey % 6 <> 0 GROUP BY 1",
)
def latest_log(spark, d):
    log = table(spark, d, "orders").filter("o_orderstatus = 'F' AND o_orderkey % 6 <> 0").select(F.upper(F.concat(F.lit("req-"), F.col("o_custkey").cast("string"))).alias("rid"), "o_orderkey")
    newest = log.groupBy("rid").agg(F.max("o_orderkey").alias("log_id"))
    jobs = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("REQ-"), F.col("c_custkey").cast("string")).alias("rid"))
    return jobs.join(newest, "rid", "left").select("c_custkey", F.coalesce("log_id", F.lit(-1)).alias("log_id"))


@query(
    "jn_4_single_country",
    """
    WITH k AS (SELECT l_partkey, min(s_nationkey) AS a, max(s_nationkey) AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)
    SELECT l_partkey, CASE WHEN a = b THEN 'NATION_' || CAST(a AS VARCHAR) ELSE '-' END AS country FROM k
    """,
)
def single_country(spark, d):
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(
        table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")), "l_suppkey"
    ).join(table(spark, d, "nation"), "n_nationkey")
    one = pairs.groupBy("l_partkey").agg(F.min("n_name").alias("a"), F.max("n_name").alias("b"))
    return one.select("l_partkey", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.lit("-")).alias("country"))


@query(
    "jn_5_receiver_cascade",
    """
    WITH s AS (SELECT DISTINCT p_name, replace(p_name, ' ', '') AS k, length(p_name) % 5 AS m FROM part),
    x AS (SELECT p_name, CASE WHEN m = 0 THEN k || 'x' ELSE k END AS k, m FROM s),
    c AS (SELECT k, k || '@mail.example' AS emails FROM s WHERE m <> 3),
    f AS (SELECT x.k, c.k AS r, c.emails, 1 - levenshtein(x.k, c.k) / greatest(length(x.k), length(c.k)) AS score, row_number() OVER (PARTITION BY x.k ORDER BY 1 - levenshtein(x.k, c.k) / greatest(length(x.k), length(c.k)) DESC, c.k) AS rn
       FROM x, c WHERE 1 - levenshtein(x.k, c.k) / greatest(length(x.k), length(c.k)) >= 0.82)
    SELECT p_name, CASE WHEN m = 1 THEN 'fixed@mail.example' WHEN m = 2 THEN 'own@mail.example' ELSE coalesce(c.emails, f.emails, '') END AS "to",
      CASE WHEN m = 1 THEN 'override' WHEN m = 2 THEN 'own_column' WHEN c.emails IS NOT NULL THEN 'equal_key' WHEN f.emails IS NOT NULL THEN 'similar_key' ELSE 'missing' END AS source,
      CASE WHEN m = 1 THEN 1.0::DOUBLE WHEN m = 2 THEN 0.95::DOUBLE WHEN c.emails IS NOT NULL THEN 0.9::DOUBLE WHEN f.emails IS NOT NULL THEN round(f.score, 3) ELSE 0.0::DOUBLE END AS score
    FROM x LEFT JOIN c ON c.k = x.k LEFT JOIN f ON f.k = x.k AND f.rn = 1
    """,
)
def receiver_cascade(spark, d):
    names = table(spark, d, "part").select("p_name").distinct().withColumn("m", F.length("p_name") % 5).withColumn("k", X.entity_key(F.col("p_name")))
    suppliers = names.select(
        "p_name", F.when(F.col("m") == 0, F.concat("k", F.lit("x"))).otherwise(F.col("k")).alias("supplier_key"), F.when(F.col("m") == 2, F.lit("own@mail.example")).alias("own_email")
    )
    overrides = names.filter("m = 1").select(F.col("k").alias("supplier_key"), F.lit("fixed@mail.example").alias("final_to"))
    candidates = names.filter("m <> 3").select(F.col("k").alias("supplier_key"), F.concat("k", F.lit("@mail.example")).alias("emails"))
    return L.resolve_receivers(suppliers, overrides, candidates).select("p_name", "to", "source", "score")


_TYPO = "CASE WHEN length(p_name) % 3 = 0 THEN replace(p_name, 'o', '0') WHEN length(p_name) % 3 = 1 THEN p_name || 's' ELSE upper(p_name) END"


@query(
    "jn_6_fuzzy_best",
    f"""
    WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT DISTINCT {_TYPO} AS w FROM part),
    p AS (SELECT w, p_name, 1 - levenshtein(w, p_name) / greatest(length(w), length(p_name)) AS s FROM t, n),
    r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY s DESC, p_name) AS rn FROM p WHERE s >= 0.8)
    SELECT w AS left_key, p_name AS right_key, round(s, 6) AS score FROM r WHERE rn = 1
    """,
)
def fuzzy_best(spark, d):
    n = F.length("p_name") % 3
    typo = F.when(n == 0, F.replace("p_name", F.lit("o"), F.lit("0"))).when(n == 1, F.concat("p_name", F.lit("s"))).otherwise(F.upper("p_name"))
    parts = table(spark, d, "part")
    pairs = L.fuzzy_pairs(parts.select(typo.alias("w")), "w", parts, "p_name", 0.8)
    return L.best_fuzzy(pairs).withColumn("score", F.round("score", 6))


@query("jn_6_gestalt_best")
def gestalt_best(spark, d):
    parts = table(spark, d, "part")
    pairs = L.fuzzy_pairs(parts.select(F.concat("p_name", F.lit("s")).alias("w")), "w", parts, "p_name", 0.82, metric="gestalt")
    return L.best_fuzzy(pairs).withColumn("score", F.round("score", 6))


WEIGHTS = {"cert_no": 120, "name": 90, "maker": 60, "org": 35, "expiry": 25, "supplier": 35}


def master_and_items(spark, d):
    long = reshape.flatten_master(wide_master(spark, d)).select("row_pos", "depth", *WEIGHTS)
    items = table(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(
        F.max(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")).alias("x")
    )
    items = items.select(
        F.col("l_orderkey").alias("item"), F.when(F.col("l_orderkey") % 4 == 0, F.concat(F.lit("CN-"), F.col("l_orderkey").cast("string"), F.lit("-0"))).alias("cert_no"),
        F.concat(F.lit("P"), F.col("x.l_partkey").cast("string")).alias("name"), F.concat(F.lit("Maker "), F.col("x.l_suppkey").cast("string")).alias("maker"),
        F.concat(F.lit("ORG-"), "x.l_returnflag").alias("org"), F.date_format("x.l_shipdate", "yyyy-MM-dd").alias("expiry"), F.lit("Supplier 1").alias("supplier"),
    )
    return long, items


@query(
    "jn_7_weighted_linkage",
    f"""
    WITH {WIDE_SQL},
    x AS (SELECT l_orderkey AS item, max({{'p': l_partkey, 's': l_suppkey, 'f': l_returnflag, 'd': l_shipdate}}) AS x FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
    i AS (SELECT item, CASE WHEN item % 4 = 0 THEN 'CN-' || CAST(item AS VARCHAR) || '-0' END AS cert_no, 'P' || CAST(x.p AS VARCHAR) AS name, 'Maker ' || CAST(x.s AS VARCHAR) AS maker, 'ORG-' || x.f AS org, strftime(x.d, '%Y-%m-%d') AS expiry, 'Supplier 1' AS supplier FROM x),
    c AS (SELECT i.item, m.row_pos, m.depth, coalesce(i.maker = m.maker, FALSE) AS mk, CASE WHEN i.cert_no = m.cert_no THEN 120 ELSE 0 END + CASE WHEN i.name = m.name THEN 90 ELSE 0 END + CASE WHEN i.maker = m.maker THEN 60 ELSE 0 END + CASE WHEN i.org = m.org THEN 35 ELSE 0 END
        + CASE WHEN i.expiry = m.expiry THEN 25 ELSE 0 END + CASE WHEN i.supplier = m.supplier THEN 35 ELSE 0 END AS score FROM i JOIN master m ON i.name = m.name OR i.cert_no = m.cert_no),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, depth, row_pos) AS rn FROM c),
    t AS (SELECT item, max(CASE WHEN rn = 1 THEN score END) AS top_score, max(CASE WHEN rn = 2 THEN score END) AS second_score, bool_or(rn = 1 AND mk) AS strong, count(*) AS candidates FROM r WHERE rn <= 5 GROUP BY 1)
    SELECT item, top_score::BIGINT AS top_score, candidates, coalesce(top_score - second_score < 25, FALSE) AS ambiguous, CASE WHEN strong AND NOT coalesce(top_score - second_score < 25, FALSE) THEN 'AUTO_READY' ELSE 'REVIEW_REQUIRED' END AS link_status FROM t
    """,
)
def weighted_linkage(spark, d):
    long, items = master_and_items(spark, d)
    top = L.top_matches(items, "item", long, ["depth", "row_pos"], WEIGHTS, ["cert_no", "name"])
    status = L.link_status(top.withColumn("strong", F.col("same_maker")), "item")
    return status.select("item", F.col("top_score").cast("bigint").alias("top_score"), "candidates", "ambiguous", "link_status")


_GRADE = "CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 100 WHEN least(length({a}), length({b})) >= 4 AND (contains({a}, {b}) OR contains({b}, {a})) THEN CAST(floor(75 + least(length({a}), length({b})) / greatest(length({a}), length({b})) * 20) AS INTEGER) ELSE 0 END"


@query(
    "jn_7_field_grades",
    f"""
    WITH {WIDE_SQL}, n AS (SELECT row_pos, depth, lower(regexp_replace(name, '[^0-9A-Za-z]', '', 'g')) AS name, lower(regexp_replace(maker, '[^0-9A-Za-z]', '', 'g')) AS maker, lower(regexp_replace(coalesce(org, ''), '[^0-9A-Za-z]', '', 'g')) AS org FROM master),
    q AS (SELECT *, CASE row_pos % 3 WHEN 0 THEN name || 'x' WHEN 1 THEN name ELSE 'zz' END AS qname, CASE row_pos % 4 WHEN 0 THEN maker || 'koreaplant' WHEN 1 THEN '' ELSE maker END AS qmaker, CASE WHEN row_pos % 2 = 0 THEN org ELSE 'other' END AS qorg FROM n),
    g AS (SELECT row_pos, depth, {_GRADE.format(a='qname', b='name')} AS gn, {_GRADE.format(a='qmaker', b='maker')} AS gm, {_GRADE.format(a='qorg', b='org')} AS go FROM q)
    SELECT row_pos, depth, CAST(CASE WHEN gn = 100 THEN 90 WHEN gn >= 75 THEN 58 ELSE 0 END + CASE WHEN gm = 100 THEN 60 WHEN gm >= 75 THEN 39 ELSE 0 END + CASE WHEN go = 100 THEN 35 WHEN go >= 75 THEN 22 ELSE 0 END AS BIGINT) AS score,
      CASE WHEN gm >= 90 AND gn >= 90 THEN 'STRONG' WHEN gm >= 75 AND gn >= 75 THEN 'REVIEW' ELSE 'WEAK' END AS level FROM g
    """,
)
def field_grades(spark, d):
    key = lambda c: X.norm_key(F.coalesce(F.col(c), F.lit("")), case="lower", keep="0-9a-z가-힣")
    m = reshape.flatten_master(wide_master(spark, d)).select("row_pos", F.col("depth").cast("bigint").alias("depth"), *[key(c).alias(c) for c in ("name", "maker", "org")])
    k = F.col("row_pos")
    pairs = m.select(
        "*", F.when(k % 3 == 0, F.concat("name", F.lit("x"))).when(k % 3 == 1, F.col("name")).otherwise(F.lit("zz")).alias("q_name"),
        F.when(k % 4 == 0, F.concat("maker", F.lit("koreaplant"))).when(k % 4 == 1, F.lit("")).otherwise(F.col("maker")).alias("q_maker"),
        F.when(k % 2 == 0, F.col("org")).otherwise(F.lit("other")).alias("q_org"),
    )
    return L.grade_pairs(pairs, {"name": 90, "maker": 60, "org": 35}, "maker", ["name"]).select("row_pos", "depth", "score", "level")


@query(
    "jn_8_document_scoring",
    """
    WITH e AS (SELECT item_id, regexp_replace(upper(text), '[^A-Z0-9가-힣]+', '', 'g') AS english, regexp_replace(upper(split_part(text, '. ', 2)), '[^A-Z0-9가-힣]+', '', 'g') AS cert_no, 'SRC' || CAST(item_id % 20 AS VARCHAR) AS maker FROM benchmark),
    t AS (SELECT doc_id, upper(source) AS source, regexp_replace(upper(text), '[^A-Z0-9가-힣]+', '', 'g') AS k FROM documents),
    s AS (SELECT doc_id, item_id, CASE WHEN length(cert_no) >= 12 AND contains(k, cert_no) THEN 130 ELSE 0 END + CASE WHEN contains(k, english) THEN 65 ELSE 0 END + CASE WHEN maker = source THEN 45 ELSE 0 END AS score, contains(k, cert_no) OR contains(k, english) AS exact FROM t, e WHERE (length(cert_no) >= 12 AND contains(k, cert_no)) OR contains(k, english)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rn FROM s)
    SELECT doc_id, max(CASE WHEN rn = 1 THEN item_id END) AS item_id, max(CASE WHEN rn = 1 THEN score END)::BIGINT AS score, max(CASE WHEN rn = 1 THEN score END) >= 130 AS strong FROM r GROUP BY 1
    """,
)
def document_scoring(spark, d):
    key = lambda c: X.norm_key(c)
    entries = table(spark, d, "benchmark").select(
        "item_id", key(F.col("text")).alias("english"), key(F.coalesce(F.get(F.split("text", r"\. "), 1), F.lit(""))).alias("cert_no"), F.concat(F.lit("SRC"), (F.col("item_id") % 20).cast("string")).alias("maker")
    )
    docs = table(spark, d, "documents").select("doc_id", F.upper("source").alias("read_maker"), key(F.col("text")).alias("body"))
    words = entries.select("item_id", "maker", F.inline(F.array(F.struct(F.col("cert_no").alias("word"), F.lit(130).alias("w")), F.struct(F.col("english").alias("word"), F.lit(65).alias("w")))))
    hits = L.contains_join(docs, "doc_id", "body", words, "word", q=12, shortest=12).join(words, "word")
    scored = hits.groupBy("doc_id", "item_id", "maker").agg(F.sum("w").alias("w")).join(docs.select("doc_id", "read_maker"), "doc_id")
    # exact identity: every hit here is a number or an English name found in the text
    total = scored.withColumn("score", F.col("w") + F.when(F.col("maker") == F.col("read_maker"), F.lit(45)).otherwise(F.lit(0)))
    best = rank.best_per_key(total.select("doc_id", "item_id", "score"), ["doc_id"], [F.col("score"), -F.col("item_id")])
    return best.withColumn("score", F.col("score").cast("bigint")).withColumn("strong", F.col("score") >= 130)


@query(
    "jn_9_item_choice",
    """
    WITH i AS (SELECT l_orderkey AS k, l_linenumber AS idx, max(l_returnflag) AS org, max(l_partkey) AS part FROM lineitem GROUP BY 1, 2),
    j AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 3 = 0 THEN 2 END AS aidx, min(l_returnflag) AS org, min(l_partkey) AS part FROM lineitem GROUP BY 1),
    s AS (SELECT i.k, i.idx, j.aidx, CASE WHEN i.idx = j.aidx THEN 500 ELSE 0 END + CASE WHEN i.org = j.org THEN 140 ELSE 0 END + CASE WHEN i.part = j.part THEN 80 ELSE 0 END AS score, i.org <> j.org AS hard FROM i JOIN j USING (k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, idx) AS rn, lead(score) OVER (PARTITION BY k ORDER BY score DESC, idx) AS nx, count(*) OVER (PARTITION BY k) AS n, bool_or(idx = aidx) OVER (PARTITION BY k) AS has FROM s)
    SELECT k AS l_orderkey, idx::BIGINT AS item_index, score::BIGINT AS score, CASE WHEN has THEN 'ATTACHMENT_INDEX' WHEN n = 1 THEN 'SINGLE_ITEM' WHEN score >= 80 AND score - nx >= 40 THEN 'UNIQUE_SCORE' ELSE 'AMBIGUOUS' END AS reason, hard AS blocked FROM r WHERE rn = 1
    """,
)
def item_choice(spark, d):
    li = table(spark, d, "lineitem")
    items = li.groupBy("l_orderkey", F.col("l_linenumber").alias("idx")).agg(F.max("l_returnflag").alias("org"), F.max("l_partkey").alias("part"))
    jobs = li.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("jorg"), F.min("l_partkey").alias("jpart")).withColumn("aidx", F.when(F.col("l_orderkey") % 3 == 0, F.lit(2)))
    pts = rules.points([(F.coalesce(F.col("idx") == F.col("aidx"), F.lit(False)), 500), (F.col("org") == F.col("jorg"), 140), (F.col("part") == F.col("jpart"), 80)])
    scored = items.join(jobs, "l_orderkey").withColumn("score", pts)
    best = scored.groupBy("l_orderkey").agg(
        F.max_by(F.struct("idx", "score", (F.col("org") != F.col("jorg")).alias("hard")), F.struct("score", -F.col("idx"))).alias("b"), F.count("*").alias("n"), F.bool_or(F.col("idx") == F.col("aidx")).alias("has")
    )
    two = rank.top_two(scored, ["l_orderkey"], "score", "idx").select("l_orderkey", "margin")
    reason = rules.decide([
        (F.coalesce("has", F.lit(False)), "ATTACHMENT_INDEX"), (F.col("n") == 1, "SINGLE_ITEM"), ((F.col("b.score") >= 80) & (F.col("margin") >= 40), "UNIQUE_SCORE"),
    ], "AMBIGUOUS")
    return best.join(two, "l_orderkey").select("l_orderkey", F.col("b.idx").cast("bigint").alias("item_index"), F.col("b.score").cast("bigint").alias("score"), reason.alias("reason"), F.col("b.hard").alias("blocked"))


@query(
    "jn_10_keyword_scoring",
    """
    WITH m AS (SELECT DISTINCT p_name AS material FROM part), w AS (SELECT DISTINCT material, unnest(string_split(material, ' ')) AS word, unnest([18, 16]) AS weight FROM m),
    x AS (SELECT 'doc' AS kind, doc_id AS id, lower(text) AS t FROM documents UNION ALL SELECT 'page', page_id, lower(url) FROM pages),
    s AS (SELECT material, kind, id, sum(weight) AS score FROM w JOIN x ON contains(t, word) WHERE length(word) >= 3 GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY material ORDER BY score DESC, kind, id) AS rn, count(*) OVER (PARTITION BY material) AS total FROM s)
    SELECT material, kind, id, score::BIGINT AS score, total::BIGINT AS total FROM r WHERE rn <= 5
    """,
)
def keyword_scoring(spark, d):
    parts = F.split("material", " ")
    words = table(spark, d, "part").select(F.col("p_name").alias("material")).distinct().select(
        "material", F.inline(F.arrays_zip(parts.alias("word"), F.array(F.lit(18), F.lit(16)).alias("weight")))
    ).select("material", F.col("word").alias("term"), "weight")
    docs = table(spark, d, "documents").select(F.struct(F.lit("doc").alias("kind"), F.col("doc_id").alias("id")).alias("ref"), F.lower("text").alias("t"))
    pages = table(spark, d, "pages").select(F.struct(F.lit("page").alias("kind"), F.col("page_id").alias("id")).alias("ref"), F.lower("url").alias("t"))
    # read twice: for the best and for the totals
    hits = cut_lineage(L.contains_join(docs.unionByName(pages), "ref", "t", words, "term", q=3))
    top = S.top_holders(hits, "ref", words, "material", k=5)
    total = S.holder_counts(hits, "ref", words, "material")
    return top.join(total, "material").select("material", "ref.kind", "ref.id", F.col("score").cast("bigint").alias("score"), "total")


_HOST = "regexp_extract(url, '//([^/]*)/', 1)"


@query(
    "jn_11_path_scoring",
    f"""
    WITH f AS (SELECT page_id, lower(CAST(page_id % 40 AS VARCHAR) || '_1. ' || {_HOST} || '/' || url) AS path, CAST(page_id % 40 AS VARCHAR) || '_1' AS prefix FROM pages),
    m AS (SELECT DISTINCT split_part({_HOST}, '.', 1) AS word FROM pages WHERE length(split_part({_HOST}, '.', 1)) >= 3), mm AS (SELECT word, CAST(length(word) AS VARCHAR) || '_1' AS row_no FROM m),
    s AS (SELECT word, page_id, CASE WHEN prefix = row_no THEN 90 ELSE 0 END + CASE WHEN contains(path, word) THEN 45 ELSE 0 END AS score FROM mm, f WHERE prefix = row_no OR contains(path, word)),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, page_id) AS rn FROM s) SELECT word, page_id, score::BIGINT AS score FROM r WHERE rn <= 10
    """,
)
def path_scoring(spark, d):
    host = F.regexp_extract("url", "//([^/]*)/", 1)
    number = F.concat((F.col("page_id") % 40).cast("string"), F.lit("_1"))
    files = table(spark, d, "pages").select("page_id", F.lower(F.concat(number, F.lit(". "), host, F.lit("/"), "url")).alias("path"), number.alias("prefix"))
    materials = table(spark, d, "pages").select(F.get(F.split(host, r"\."), 0).alias("word")).filter(F.length("word") >= 3).distinct()
    materials = materials.withColumn("row_no", F.concat(F.length("word").cast("string"), F.lit("_1")))
    by_number = materials.join(files, F.col("row_no") == F.col("prefix")).select("word", "page_id", F.lit(90).alias("p"))
    by_name = L.contains_join(files, "page_id", "path", materials, "word").select("word", "page_id", F.lit(45).alias("p"))
    scored = by_number.unionByName(by_name).groupBy("word", "page_id").agg(F.sum("p").alias("score"))
    return rank.top_per_group(scored, ["word"], [F.desc("score"), F.asc("page_id")], 10, "_n").drop("_n").withColumn("score", F.col("score").cast("bigint"))


@query(
    "jn_12_folder_chain",
    """
    SELECT CAST(p_partkey AS VARCHAR) || '_2_1' AS row_no, CASE WHEN p_partkey % 3 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 7 = 0 THEN 2 ELSE 3 END::BIGINT AS level,
      CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) || '. ' || p_name WHEN p_partkey % 7 = 0 THEN CAST(p_partkey AS VARCHAR) || '_2. sub' ELSE CAST(p_partkey AS VARCHAR) || '_2_1. leaf' END AS folder FROM part
    """,
)
def folder_chain(spark, d):
    k = F.col("p_partkey").cast("string")
    parts = table(spark, d, "part")
    names = F.array(
        F.when(F.col("p_partkey") % 3 != 0, F.concat(k, F.lit(". "), "p_name")), F.when(F.col("p_partkey") % 5 != 0, F.concat(k, F.lit("_2. sub"))), F.when(F.col("p_partkey") % 7 != 0, F.concat(k, F.lit("_2_1. leaf"))),
    )
    folders = parts.select(F.explode(F.array_compact(names)).alias("folder")).select("folder", F.regexp_extract("folder", r"^([0-9_]+)\.", 1).alias("prefix"))
    rows = parts.select(F.concat(k, F.lit("_2_1")).alias("row_no"))
    return L.deepest_folder(rows, "row_no", folders).select("row_no", F.col("level").cast("bigint").alias("level"), "folder")


@query(
    "jn_13_inbound_matching",
    r"""
    WITH sent AS (SELECT conv_id, min(trim(regexp_replace(lower(split_part(text, '.', 1)), '\s+', ' ', 'g'))) AS subj FROM conversations WHERE turn = 0 GROUP BY conv_id),
    inb AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, lower(text) AS body, CASE WHEN turn % 2 = 0 THEN trim(regexp_replace(lower(split_part(text, '.', 1) || ' / ' || split_part(text, '.', 2)), '\s+', ' ', 'g')) ELSE 'other ' || CAST(turn AS VARCHAR) END AS subj FROM conversations),
    ss AS (SELECT subj, min(conv_id) AS conv FROM sent WHERE length(subj) >= 10 GROUP BY 1),
    hit AS (SELECT i.id, min(s.conv) AS ref FROM inb i JOIN ss s ON contains(i.subj, s.subj) OR contains(s.subj, i.subj) GROUP BY 1),
    fold AS (SELECT conv_id * 100 + turn AS id, turn, text, trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '\s+', ' ', 'g')) AS t FROM conversations),
    piece AS (SELECT trim(regexp_replace(upper(replace(unnest(regexp_split_to_array(text, '[\n\r,/|;:()\[\]<>]+')), 'ß', 'ss')), '\s+', ' ', 'g')) AS term FROM fold WHERE turn = 0),
    held AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY length(term) DESC, term) AS n FROM fold JOIN (SELECT DISTINCT term FROM piece WHERE length(term) BETWEEN 3 AND 80) ON contains(t, term)),
    term AS (SELECT id, string_agg(term, ', ' ORDER BY n) AS terms FROM held WHERE n <= 5 GROUP BY 1)
    SELECT i.id, CASE WHEN i.conv_id % 9 = 0 THEN 'exact' WHEN h.ref IS NOT NULL THEN 'probable' WHEN regexp_matches(body, 'certificate|halal') THEN 'unmatched_candidate' WHEN m.terms IS NOT NULL THEN 'unmatched_candidate' ELSE 'excluded' END AS status,
      CASE WHEN i.conv_id % 9 = 0 OR h.ref IS NOT NULL OR regexp_matches(body, 'certificate|halal') THEN '' ELSE coalesce(m.terms, '') END AS terms,
      CASE WHEN i.conv_id % 9 = 0 THEN 'REQ-20260630-0000000' || CAST(i.conv_id % 10 AS VARCHAR) WHEN h.ref IS NOT NULL THEN CAST(h.ref AS VARCHAR) ELSE '' END AS matched FROM inb i LEFT JOIN hit h ON h.id = i.id LEFT JOIN term m ON m.id = i.id
    """,
)
def inbound_matching(spark, d):
    turns = table(spark, d, "conversations")
    sent = turns.filter("turn = 0").select("conv_id", X.squash(F.lower(F.get(F.split("text", r"\."), 0))).alias("subj")).filter(F.length("subj") >= 10)
    # read twice, for either way round
    sent = cut_lineage(sent.groupBy("subj").agg(F.min("conv_id").alias("conv")))
    inbound = turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "conv_id", F.lower("text").alias("body"),
        F.when(F.col("turn") % 2 == 0, X.mail_subject(F.concat(F.get(F.split("text", r"\."), 0), F.lit(" / "), F.coalesce(F.get(F.split("text", r"\."), 1), F.lit(""))))).otherwise(F.concat(F.lit("other "), F.col("turn").cast("string"))).alias("insubj"),
        F.when(F.col("conv_id") % 9 == 0, F.concat(F.lit("ref req-20260630-0000000"), (F.col("conv_id") % 10).cast("string"))).otherwise(F.lit("")).alias("foot"),
    )
    # subjects meet once each, however many mails have them; the mails' ids come after
    names = cut_lineage(inbound.select("insubj").distinct())
    inside = L.contains_join(names, "insubj", "insubj", sent, "subj", q=8).join(sent, "subj").select("insubj", "conv")
    around = L.contains_join(sent.select("conv", F.col("subj").alias("t")), "conv", "t", names, "insubj", q=4, shortest=1).select("insubj", "conv")
    named = inside.unionByName(around).groupBy("insubj").agg(F.min("conv").alias("conv"))
    ref = inbound.select("id", "insubj").join(named, "insubj").groupBy("id").agg(F.min("conv").alias("ref"))
    rid = X.first_code([F.col("foot")], r"(?i)REQ-\d{8}-[0-9A-F]{8}")
    found = inbound.join(ref, "id", "left").select("id", "ref", rid.alias("rid"), F.col("body").rlike("certificate|halal").alias("keyword"), "body")
    # only mails that nothing else decides are searched for terms of what was sent; they are read several times, so they are written once
    open_mail = F.col("rid").isNull() & F.col("ref").isNull() & ~F.col("keyword")
    j = cut_lineage(found.withColumn("body", F.when(open_mail, F.col("body"))))
    keyword = F.col("keyword")
    terms = V.reference_terms(turns.filter("turn = 0"))
    j = j.join(V.held_terms(j.filter("body is not null").select("id", "body"), terms, "id", "body"), "id", "left")
    status = rules.decide([
        (F.col("rid").isNotNull(), "exact"), (F.col("ref").isNotNull(), "probable"), (keyword | F.col("terms").isNotNull(), "unmatched_candidate"),
    ], "excluded")
    return j.select("id", status.alias("status"), F.coalesce("terms", F.lit("")).alias("terms"), F.coalesce("rid", F.col("ref").cast("string"), F.lit("")).alias("matched"))


@query(
    "jn_14_product_links",
    """
    WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS line, max(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    m AS (SELECT doc, line, name || CASE WHEN line = 2 THEN ' extra' ELSE '' END AS name FROM p WHERE line <= 2),
    s AS (SELECT m.doc, m.line AS mline, p.line, CASE WHEN m.name = p.name THEN 1.0 WHEN contains(m.name, p.name) OR contains(p.name, m.name) THEN 0.86 + 0.14 * least(length(m.name), length(p.name)) / greatest(length(m.name), length(p.name)) ELSE 1 - levenshtein(m.name, p.name) / greatest(length(m.name), length(p.name)) END AS score FROM m JOIN p USING (doc)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc, mline ORDER BY round(score, 6) DESC, line) AS rn FROM s),
    t AS (SELECT m.doc, m.line AS mline, max(CASE WHEN rn = 1 THEN r.line END) AS line, coalesce(max(CASE WHEN rn = 1 THEN round(score, 6) END), 0) AS a, coalesce(max(CASE WHEN rn = 2 THEN round(score, 6) END), 0) AS b FROM m LEFT JOIN r ON r.doc = m.doc AND r.mline = m.line AND rn <= 2 AND round(score, 6) >= 0.7 GROUP BY 1, 2)
    SELECT doc, mline::BIGINT AS master_line, coalesce(line, -1)::BIGINT AS product_line, round(a, 4)::DOUBLE AS similarity, CASE WHEN a >= 0.88 AND (round(a - b, 6) >= 0.08 OR a >= 0.96) THEN 'LINKED' WHEN a >= 0.7 THEN 'CANDIDATE' ELSE 'UNLINKED' END AS link_status FROM t
    """,
)
def product_links(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    products = li.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line")).agg(F.max("p_name").alias("name"))
    master = products.filter("line <= 2").select("doc", F.col("line").alias("mline"), F.concat("name", F.when(F.col("line") == 2, F.lit(" extra")).otherwise(F.lit(""))).alias("mname"))
    top = L.link_products(master, products, "doc", "mline", "mname", "line", "name")
    score, margin = F.coalesce("top_score", F.lit(0.0)), F.round(F.coalesce("margin", F.lit(0.0)), 6)
    status = rules.decide([((score >= 0.88) & ((margin >= 0.08) | (score >= 0.96)), "LINKED"), (score >= 0.7, "CANDIDATE")], "UNLINKED")
    return top.select(
        "doc", F.col("mline").cast("bigint").alias("master_line"), F.coalesce(F.col("line").cast("bigint"), F.lit(-1)).alias("product_line"),
        F.round(score, 4).alias("similarity"), status.alias("link_status"),
    )


@query(
    "jn_15_signature_class",
    """
    WITH s AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda v: CAST(v > 0 AS INTEGER)) AS b FROM embeddings),
    p AS (SELECT t.vec_id, r.label AS cls, 1 - list_sum(list_transform(range(1, 65), lambda i: CAST(t.b[i] <> r.b[i] AS INTEGER))) / 64 AS sim FROM s t JOIN s r ON t.vec_id <> r.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, cls ORDER BY sim DESC) AS rn FROM p),
    c AS (SELECT vec_id, cls, round(0.7 * max(sim) + 0.3 * avg(sim), 6) AS score FROM k WHERE rn <= 3 GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cls) AS rn FROM c),
    t AS (SELECT vec_id, max(CASE WHEN rn = 1 THEN cls END) AS cls, max(CASE WHEN rn = 1 THEN score END) AS a, max(CASE WHEN rn = 2 THEN score END) AS b FROM r WHERE rn <= 2 GROUP BY 1)
    SELECT vec_id, cls AS predicted, a AS score, CASE WHEN a >= 0.82 AND round(a - b, 6) >= 0.07 THEN 'AUTO_IMAGE' WHEN a < 0.7 OR round(a - b, 6) < 0.04 THEN 'MANUAL_REVIEW' ELSE 'REVIEW' END AS decision FROM t
    """,
)
def signature_class(spark, d):
    bits = F.aggregate(F.transform("embedding", lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    sigs = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("cls"), bits.alias("sig"))
    scores = L.class_scores(sigs.select("vec_id", "sig"), sigs, "vec_id", "cls")
    top = rank.top_two(scores.withColumn("score", F.round("score", 6)), ["vec_id"], "score", "cls")
    margin = F.round("margin", 6)
    decision = rules.decide([((F.col("top_score") >= 0.82) & (margin >= 0.07), "AUTO_IMAGE"), ((F.col("top_score") < 0.7) | (margin < 0.04), "MANUAL_REVIEW")], "REVIEW")
    return top.select("vec_id", F.col("cls").alias("predicted"), F.col("top_score").alias("score"), decision.alias("decision"))


def word_vectors(docs):
    """TF-IDF of the words of each distinct text of a language; exact copies are represented by their
    smallest id. idf = ln((1 + n) / (1 + df)) + 1 over the texts of the language."""
    # only ids meet in the aggregate; the texts stay where they were read, as the ids of copies are few
    named = docs.select("lang", F.sha2("text", 256).alias("sha"), "doc_id")
    first = named.groupBy("lang", "sha").agg(F.min("doc_id").alias("first"))
    copies = cut_lineage(named.join(first, ["lang", "sha"]).filter("doc_id <> first").select("doc_id"))
    return vectors.of_texts(docs.join(copies, "doc_id", "left_anti"), "lang", "doc_id", "text")


DUP_SQL = r"""
reps AS (SELECT lang, min(doc_id) AS doc_id, text FROM documents GROUP BY lang, text),
tf AS (SELECT lang, doc_id, word, count(*) AS tf FROM (SELECT lang, doc_id, unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda x: x <> '')) AS word FROM reps) GROUP BY 1, 2, 3),
nn AS (SELECT lang, count(DISTINCT doc_id) AS n FROM tf GROUP BY 1), df AS (SELECT lang, word, count(*) AS df FROM tf GROUP BY 1, 2),
wc AS (SELECT tf.lang, doc_id, tf.word, tf.tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON df.lang = tf.lang AND df.word = tf.word JOIN nn ON nn.lang = tf.lang),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM wc GROUP BY 1),
dots AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS dot FROM wc x JOIN wc y ON x.lang = y.lang AND x.word = y.word AND x.doc_id < y.doc_id GROUP BY 1, 2),
near AS (SELECT a, b, dot / (na.n * nb.n) AS cosine FROM dots JOIN nm na ON na.doc_id = a JOIN nm nb ON nb.doc_id = b WHERE dot / (na.n * nb.n) >= 0.97)
"""


@query("jn_16_near_duplicates", f"WITH {DUP_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM near")
def near_duplicates(spark, d):
    pairs = L.near_pairs(word_vectors(table(spark, d, "documents")))
    return pairs.withColumn("cosine", F.round("cosine", 6))


def duplicate_roots(spark, d):
    """(doc_id, root) of every document that has a near or exact copy. Exact copies are tied to their first one, which stands for
    them in the comparison."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    near = L.near_components(word_vectors(table(spark, d, "documents")))
    first = docs.groupBy("lang", "sha").agg(F.min("doc_id").alias("n"))
    placed = docs.join(first, ["lang", "sha"]).join(near, "n", "left").select("doc_id", F.coalesce("root", "n").alias("root"))
    several = placed.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("root")
    return placed.join(several, "root").select("doc_id", "root")


COMP_SQL = f"""
{DUP_SQL}, first AS (SELECT lang, text, min(doc_id) AS a FROM documents GROUP BY 1, 2),
ed AS (SELECT a, b FROM near UNION SELECT f.a, d.doc_id FROM documents d JOIN first f ON f.lang = d.lang AND f.text = d.text WHERE f.a <> d.doc_id),
sym AS (SELECT a AS n, b AS m FROM ed UNION SELECT b, a FROM ed),
walk AS (SELECT n, n AS r FROM sym UNION SELECT s.m, w.r FROM walk w JOIN sym s ON s.n = w.n),
comp AS (SELECT n, min(r) AS root FROM walk GROUP BY 1)
"""


@query("jn_17_components", f"WITH RECURSIVE {COMP_SQL} SELECT n AS doc_id, root FROM comp")
def components(spark, d):
    return duplicate_roots(spark, d)


@query("jn_18_unconfirmed", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unconfirmed(spark, d):
    confirmed = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(confirmed, "c_custkey", "left_anti")


@query(
    "jn_19_expected_values",
    """
    WITH k AS (SELECT DISTINCT split_part(regexp_extract(url, '//([^/]*)/', 1), '.', 1) AS keyword FROM pages), f AS (SELECT page_id, regexp_extract(url, '//(.*)$', 1) AS name FROM pages)
    SELECT page_id, string_agg(DISTINCT 'V-' || keyword, ',' ORDER BY 'V-' || keyword) AS expected FROM f JOIN k ON contains(name, keyword) WHERE length(keyword) >= 3 GROUP BY 1
    """,
)
def expected_values(spark, d):
    host = F.regexp_extract("url", "//([^/]*)/", 1)
    rules_table = table(spark, d, "pages").select(F.get(F.split(host, r"\."), 0).alias("keyword")).distinct().withColumn("value", F.concat(F.lit("V-"), "keyword"))
    files = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//(.*)$", 1).alias("name"))
    hits = L.contains_join(files, "page_id", "name", rules_table, "keyword").join(rules_table, "keyword")
    return hits.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("expected"))


@query(
    "jn_20_ground_truth",
    r"""
    WITH g AS (SELECT item_id, trim(split_part(text, '.', 1)) AS name FROM benchmark), gd AS (SELECT name, min(item_id) AS item_id FROM g GROUP BY 1),
    q AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS name FROM documents UNION ALL SELECT 1000000 + item_id, CASE WHEN item_id % 2 = 0 THEN trim(split_part(text, '.', 1)) ELSE trim(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) END FROM benchmark),
    e AS (SELECT doc_id, item_id FROM q JOIN gd USING (name)),
    c AS (SELECT doc_id, min(item_id) AS item_id FROM q JOIN gd ON (contains(q.name, gd.name) OR contains(gd.name, q.name)) GROUP BY 1)
    SELECT doc_id, coalesce(e.item_id, c.item_id) AS item_id, CASE WHEN e.item_id IS NOT NULL THEN 'EXACT' ELSE 'CONTAINED' END AS method FROM c LEFT JOIN e USING (doc_id)
    """,
)
def ground_truth(spark, d):
    bench = table(spark, d, "benchmark")
    truth = bench.select("item_id", F.trim(F.get(F.split("text", r"\."), 0)).alias("gname")).groupBy("gname").agg(F.min("item_id").alias("item_id"))
    names = table(spark, d, "documents").select("doc_id", X.squash(F.col("text")).alias("name")).unionByName(
        bench.select((F.col("item_id") + 1000000).alias("doc_id"), F.trim(F.when(F.col("item_id") % 2 == 0, F.get(F.split("text", r"\."), 0)).otherwise(F.concat_ws(" ", F.get(F.split("text", " "), 0), F.get(F.split("text", " "), 1)))).alias("name"))
    )
    exact = names.join(truth, F.col("name") == F.col("gname")).select("doc_id", F.col("item_id").alias("exact_id"))
    inside = L.contains_join(names, "doc_id", "name", truth, "gname", shortest=1).join(truth, "gname").select("doc_id", "item_id")
    around = L.contains_join(truth.select("item_id", F.col("gname").alias("t")), "item_id", "t", names, "name", q=4, shortest=1)
    around = around.join(names, "name").select("doc_id", "item_id")
    contained = inside.unionByName(around).groupBy("doc_id").agg(F.min("item_id").alias("item_id"))
    out = contained.join(exact, "doc_id", "left")
    return out.select("doc_id", F.coalesce("exact_id", "item_id").alias("item_id"), F.when(F.col("exact_id").isNotNull(), F.lit("EXACT")).otherwise(F.lit("CONTAINED")).alias("method"))


@query(
    "jn_21_manifest_enrichment",
    """
    SELECT doc_id, coalesce(quality, -1)::BIGINT AS pages, round(n_chars / greatest(coalesce(quality, 0) + 1, 1), 4) AS chars_per_page, CASE WHEN quality IS NULL THEN 'FALLBACK' ELSE 'MANIFEST' END AS origin FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def manifest_enrichment(spark, d):
    manifest = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("pages_text"))
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(manifest, "doc_id", "left").withColumn("pages", F.col("pages_text").try_cast("bigint"))
    per = F.round(F.col("n_chars") / F.greatest(F.coalesce("pages", F.lit(0)) + 1, F.lit(1)), 4)
    return j.select("doc_id", F.coalesce("pages", F.lit(-1)).alias("pages"), per.alias("chars_per_page"), F.when(F.col("pages").isNull(), F.lit("FALLBACK")).otherwise(F.lit("MANIFEST")).alias("origin"))


@query(
    "jn_22_product_values",
    """
    WITH v AS (SELECT l_orderkey, p_name, min(l_linenumber * 1000000 + l_partkey) AS o FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A' GROUP BY 1, 2)
    SELECT o_orderkey, coalesce((SELECT string_agg(p_name, '|' ORDER BY o) FROM v WHERE l_orderkey = o_orderkey), '') AS product_values FROM orders
    """,
)
def product_values(spark, d):
    from attestry.operators import aggregate

    ready = table(spark, d, "lineitem").filter("l_returnflag = 'A'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "p_name", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord")
    )
    lists = aggregate.ordered_values(ready, ["l_orderkey"], "p_name", "ord")
    orders = table(spark, d, "orders").select("o_orderkey")
    return orders.join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce(F.array_join("values", "|"), F.lit("")).alias("product_values"))
