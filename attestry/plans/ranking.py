"""Ranking, top-k, listings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import filters, lines, rank, rules, sets
from attestry.plans.aggregates import JOBS_SQL, scan_jobs
from attestry.plans.common import LINES_SQL
from attestry.plans.registry import query, table


@query(
    "win_1_stale_failures",
    f"""
    WITH {JOBS_SQL} SELECT id, path, id = latest_id AS is_latest, status = 'ERROR' AND ok_id > id AS is_stale FROM jobs JOIN latest USING (path)
    """,
)
def stale_failures(spark, d):
    flagged = rank.latest_flags(scan_jobs(spark, d), "path", "id", F.col("status") == "DONE", F.col("status") == "ERROR")
    return flagged.select("id", "path", "is_latest", "is_stale")


@query("win_2_keep_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY lower(text)")
def keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("k"))
    return docs.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query(
    "win_3_margin",
    """
    WITH r AS (SELECT l_orderkey, l_suppkey, CAST(round(l_extendedprice) AS BIGINT) AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(round(l_extendedprice) AS BIGINT) DESC, l_suppkey) AS rn FROM (SELECT l_orderkey, l_suppkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1, 2)),
    m AS (SELECT l_orderkey, max(CASE WHEN rn = 1 THEN l_suppkey END) AS l_suppkey, max(CASE WHEN rn = 1 THEN s END) AS top_score, coalesce(max(CASE WHEN rn = 2 THEN s END), 0) AS second_score FROM r WHERE rn <= 2 GROUP BY 1)
    SELECT *, top_score - second_score AS margin, CASE WHEN top_score - second_score >= 20000 THEN 'HIGH' WHEN top_score - second_score >= 5000 THEN 'MEDIUM' ELSE 'LOW' END AS reliability FROM m
    """,
)
def margin(spark, d):
    scores = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.max("l_extendedprice")).cast("bigint").alias("s"))
    top = rank.top_two(scores, ["l_orderkey"], "s", "l_suppkey").withColumn("second_score", F.coalesce("second_score", F.lit(0)))
    level = rules.decide([(F.col("margin") >= 20000, "HIGH"), (F.col("margin") >= 5000, "MEDIUM")], "LOW")
    return top.withColumn("reliability", level)


@query(
    "win_4_diverse_top",
    """
    WITH s AS (SELECT l_suppkey AS id, s_nationkey::BIGINT AS nation, CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE 'G' || CAST(l_suppkey % 40 AS VARCHAR) END AS grp, sum(CAST(l_quantity AS BIGINT)) AS score FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
    a AS (SELECT *, row_number() OVER (PARTITION BY nation, CASE WHEN grp = '' THEN 'row:' || CAST(id AS VARCHAR) ELSE grp END ORDER BY score DESC, id) AS g FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY score DESC, id) AS class_rank FROM a WHERE g = 1)
    SELECT id, nation, score::BIGINT AS score, class_rank, row_number() OVER (ORDER BY score DESC, id) AS overall_rank FROM b WHERE class_rank <= 5
    """,
)
def diverse_top(spark, d):
    sold = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("score"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("nation"))
    group = F.when(F.col("id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("G"), (F.col("id") % 40).cast("string")))
    rows = sold.join(sup, "id").withColumn("grp", group)
    top = rank.diverse_top(rows, "nation", "grp", "score", "id", 5, -F.floor(F.col("score") / 500))
    return top.select("id", "nation", "score", F.col("class_rank").cast("bigint").alias("class_rank"), "overall_rank")


@query(
    "win_5_arg_max",
    """
    SELECT o_custkey, o_orderpriority, arg_max(o_orderkey, (CAST(round(o_totalprice) AS BIGINT), -o_orderkey)) AS o_orderkey, CAST(max(round(o_totalprice)) AS BIGINT) AS score FROM orders GROUP BY 1, 2
    """,
)
def arg_max(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.round("o_totalprice").cast("bigint").alias("score"))
    return rank.best_per_key(rows, ["o_custkey", "o_orderpriority"], [F.col("score"), -F.col("o_orderkey")])


@query(
    "win_6_hard_negatives",
    rf"""
    WITH {LINES_SQL}, c AS (SELECT doc_id, gi, CAST(regexp_matches(line, '[0-9]{{3}}-[0-9]{{4}}|@') AS INTEGER) AS pos, least(12, length(regexp_replace(line, '[^0-9]', '', 'g'))) AS hard FROM lines),
    f AS (SELECT *, min(gi) FILTER (pos = 1) OVER (PARTITION BY doc_id) AS fp FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY hard DESC, abs(gi - fp), gi) AS n, count(*) FILTER (pos = 0) OVER (PARTITION BY doc_id) - 3 AS rem FROM f WHERE fp IS NOT NULL)
    SELECT doc_id, gi::BIGINT AS global_index, pos::BIGINT AS positive FROM r WHERE pos = 1 OR n <= 3 OR ((n - 4) % greatest(1, rem // 8) = 0 AND (n - 4) // greatest(1, rem // 8) < 8)
    """,
)
def hard_negatives(spark, d):
    rows = lines.document_lines(table(spark, d, "documents"), "text", ["doc_id"])
    digits = F.least(F.lit(12), F.length(F.regexp_replace("line", "[^0-9]", "")))
    cand = rows.select("doc_id", "global_index", F.col("line").rlike("[0-9]{3}-[0-9]{4}|@").cast("int").alias("positive"), digits.alias("hard"))
    out = rank.hard_negatives(cand, "doc_id", "positive", "global_index", "hard", 3)
    return out.select("doc_id", F.col("global_index").cast("bigint").alias("global_index"), F.col("positive").cast("bigint").alias("positive"))


@query(
    "win_7_active_order",
    """
    SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_orderdate DESC, o_orderkey DESC) AS position FROM orders WHERE o_orderstatus <> 'P' QUALIFY position <= 5
    """,
)
def active_order(spark, d):
    active = table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_orderdate"), F.desc("o_orderkey")]
    top = rank.top_per_group(active, ["o_custkey"], order, 5, "position")
    return top.select("o_custkey", "o_orderkey", F.col("position").cast("bigint").alias("position"))


@query(
    "win_8_label_context",
    rf"""
    WITH {LINES_SQL}, w AS (SELECT doc_id, gi, line, coalesce(lead(line, 1) OVER o, '') AS n1, coalesce(lead(line, 2) OVER o, '') AS n2, coalesce(lag(line, 1) OVER o, '') AS p1 FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY gi))
    SELECT doc_id, gi::BIGINT AS global_index, md5(trim(regexp_extract(line, 'that (.*)$', 1))) AS same_line, md5(n1 || '|' || n2) AS following, md5(p1) AS previous FROM w WHERE regexp_matches(line, 'that ')
    """,
)
def label_context(spark, d):
    arrays = table(spark, d, "documents").select("doc_id", lines.lines_of(F.col("text")).alias("_l"))
    at = lambda i: F.coalesce(F.get("_l", i)["line"], F.lit(""))
    ctx = F.filter(
        F.transform("_l", lambda r, i: F.struct(i.alias("global_index"), r["line"].alias("line"), at(i + 1).alias("n1"), at(i + 2).alias("n2"), at(i - 1).alias("p1"))),
        lambda r: r["line"].rlike("that "),
    )
    rows = arrays.select("doc_id", F.inline(ctx))
    return rows.select(
        "doc_id", F.col("global_index").cast("bigint").alias("global_index"), F.md5(F.trim(F.regexp_extract("line", "that (.*)$", 1))).alias("same_line"),
        F.md5(F.concat("n1", F.lit("|"), "n2")).alias("following"), F.md5("p1").alias("previous"),
    )


@query("win_9_sorted_listing", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def sorted_listing(spark, d):
    return filters.listing(table(spark, d, "events"), {"event_type": "error"}, [F.desc("ts"), F.desc("event_id")], 200).select("event_id", "user_id")


@query(
    "set_1_record_union",
    """
    SELECT 'doc' AS kind, doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, url FROM pages
    """,
)
def record_union(spark, d):
    docs = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return sets.union_all(docs, pages)


@query(
    "set_2_merge_candidates",
    """
    WITH c AS (SELECT event_id, unnest([strftime(ts, '%Y-%m-%d'), strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d'), strftime(ts, '%Y-%m-%d')]) AS date, unnest([50 + user_id % 40, 60, 58]) AS score FROM events),
    b AS (SELECT event_id, date, max(score) AS score FROM c GROUP BY 1, 2)
    SELECT event_id, string_agg(date || ':' || CAST(score AS VARCHAR), ',' ORDER BY score DESC, date) AS candidates FROM b GROUP BY 1
    """,
)
def merge_candidates(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd")
    nxt = F.date_format(F.date_add(F.to_date("ts"), 1), "yyyy-MM-dd")
    made = F.array(
        F.struct(day.alias("date"), (F.col("user_id") % 40 + 50).cast("int").alias("score")),
        F.struct(nxt.alias("date"), F.lit(60).alias("score")), F.struct(day.alias("date"), F.lit(58).alias("score")),
    )
    merged = table(spark, d, "events").select("event_id", sets.merge_candidates(made).alias("m"))
    text = F.transform("m", lambda c: F.concat(c["date"], F.lit(":"), (-c["rank"]).cast("string")))
    return merged.select("event_id", F.array_join(text, ",").alias("candidates"))


@query(
    "set_3_source_sets",
    """
    WITH s AS (SELECT event_id, list_distinct(['full', CASE WHEN user_id % 2 = 0 THEN 'conditional' ELSE 'file' END, event_type]) AS a FROM events)
    SELECT event_id, list_has_all(a, ['full', 'conditional']) AS both_rules, array_to_string(list_sort(list_intersect(a, ['error', 'file'])), ',') AS blocking FROM s
    """,
)
def source_sets(spark, d):
    a = F.array_distinct(F.array(F.lit("full"), F.when(F.col("user_id") % 2 == 0, F.lit("conditional")).otherwise(F.lit("file")), F.col("event_type")))
    return table(spark, d, "events").select(
        "event_id", sets.has_all(a, ["full", "conditional"]).alias("both_rules"), F.array_join(F.sort_array(sets.common(a, ["error", "file"])), ",").alias("blocking")
    )


@query(
    "set_4_run_diff",
    """
    WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 11 <> 0),
    o AS (SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 13 <> 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'ADDED' WHEN n.c_custkey IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS kind,
      concat_ws(',', CASE WHEN o.c_name IS DISTINCT FROM n.c_name THEN 'c_name' END, CASE WHEN o.seg IS DISTINCT FROM n.seg THEN 'seg' END) AS changed
    FROM o FULL JOIN n ON o.c_custkey = n.c_custkey WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_name IS DISTINCT FROM n.c_name OR o.seg IS DISTINCT FROM n.seg
    """,
)
def run_diff(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("seg"))
    old = c.filter("c_custkey % 13 <> 0")
    new = c.filter("c_custkey % 11 <> 0").select(
        "c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(F.col("c_custkey") % 7 != 0, F.col("seg")).alias("seg"),
    )
    return sets.diff_runs(old, new, "c_custkey", ["c_name", "seg"]).select("c_custkey", "kind", F.array_join("changed", ",").alias("changed"))
