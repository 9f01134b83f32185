"""Demo tables shared by several queries: the wide material master and document lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.reshape import SUB_LEVELS, SUB_START, SUB_WIDTH
from attestry.plans.registry import table

# One block per (order, line number 1..5): part|supplier|flag|ship date. The synthetic data
# repeat line numbers, so the largest block text stands for the line.
WIDE_SQL = """
blocks AS (SELECT l_orderkey AS row_pos, CAST(l_linenumber AS BIGINT) - 1 AS depth,
    max(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|' || l_returnflag || '|' || strftime(l_shipdate, '%Y-%m-%d')) AS b
  FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2),
roots AS (SELECT row_pos, 'Supplier ' || split_part(max(CASE WHEN depth = 0 THEN b END), '|', 2) AS supplier FROM blocks GROUP BY 1),
master AS (SELECT row_pos, depth, CAST(row_pos AS VARCHAR) AS material_no, supplier, 'P' || split_part(b, '|', 1) AS name,
    'Part ' || split_part(b, '|', 1) AS english_name, 'Maker ' || split_part(b, '|', 2) AS maker,
    CASE WHEN split_part(b, '|', 3) = 'N' THEN NULL ELSE 'ORG-' || split_part(b, '|', 3) END AS org,
    'CN-' || CAST(row_pos AS VARCHAR) || '-' || CAST(depth AS VARCHAR) AS cert_no, split_part(b, '|', 4) AS expiry
  FROM blocks JOIN roots USING (row_pos))
"""


def wide_master(spark, d) -> DataFrame:
    """Material master sheet (row_pos, c0..c50), one row per order, built from lineitem.

    The sheet has five levels: lines 6 and 7 of an order are left out."""
    li = table(spark, d, "lineitem").filter("l_linenumber <= 5")
    block = F.concat_ws(
        "|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag",
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    )
    per_level = [
        F.max(F.when(F.col("l_linenumber") == k + 1, block)).alias(f"b{k}") for k in range(5)
    ]
    wide = li.groupBy(F.col("l_orderkey").alias("row_pos")).agg(*per_level)

    def part(k: int, i: int):
        return F.get(F.split(F.col(f"b{k}"), r"\|"), i)

    def fields(k: int) -> dict[str, F.Column]:
        has = F.col(f"b{k}").isNotNull()
        org = F.when(part(k, 2) == "N", F.lit("-")).otherwise(F.concat(F.lit("ORG-"), part(k, 2)))
        return {
            "name": F.concat(F.lit("P"), part(k, 0)),
            "english_name": F.concat(F.lit("Part "), part(k, 0)),
            "maker": F.concat(F.lit("Maker "), part(k, 1)),
            "maker_country": F.lit("nan"),
            "org": org,
            "cert_no": F.when(has, F.concat(F.lit("CN-"), F.col("row_pos").cast("string"), F.lit(f"-{k}"))),
            "expiry": part(k, 3),
        }

    cells = {i: F.lit(None).cast("string") for i in range(SUB_START + SUB_LEVELS * SUB_WIDTH)}
    main = fields(0)
    cells.update(
        {0: F.col("row_pos").cast("string"), 1: F.lit(""), 2: main["name"], 3: main["english_name"], 4: main["maker"],
         5: main["maker_country"], 6: F.concat(F.lit("Supplier "), part(0, 1)), 7: main["org"], 8: main["cert_no"], 9: main["expiry"]}
    )
    for level in range(1, 5):
        base = SUB_START + (level - 1) * SUB_WIDTH
        sub = fields(level)
        for offset, name in enumerate(("name", "english_name", "maker", "maker_country", "org", "cert_no", "expiry")):
            cells[base + offset] = sub[name]
    return wide.select("row_pos", *[c.alias(f"c{i}") for i, c in cells.items()])


LINES_SQL = r"""
raw_lines AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
clean_lines AS (SELECT doc_id, lang, source, line_no, trim(regexp_replace(ln, '\s+', ' ', 'g')) AS line FROM raw_lines),
lines AS (SELECT doc_id, lang, source, CAST(line_no AS BIGINT) AS line_no, line, row_number() OVER w - 1 AS gi,
    coalesce(lag(line) OVER w, '') AS prev, coalesce(lead(line) OVER w, '') AS next
  FROM clean_lines WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
"""

