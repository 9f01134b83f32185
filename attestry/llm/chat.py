"""Chat formatting of logged conversations, snapshots collapsed. DataFrame operations only.

A logger that writes a conversation after every turn leaves many rows that are prefixes of longer conversations.
Each turn gets two 64-bit hashes; their running XOR along the turns is the hash of the prefix up to that turn. A
conversation whose whole hash is the prefix hash of a longer one is dropped by an anti-join, equal conversations
leave the one with the smallest id, and the rest is rendered.

A conversation of any length is spread over tasks: turns are numbered, hashed, ordered and rendered in parts of
``PART_TURNS`` turn numbers, and only the parts' totals of one conversation meet. Texts are shuffled once, for the
rendering; before that only hashes move.

Defined results: a prefix has the same turn numbers, roles and texts. Exactly repeated rows count once. Several
different rows with one turn number belong together, and are rendered in order of role and text. Null roles and texts
count as empty, a null turn number comes first, rows without a conversation id form one conversation. Other columns
are not read; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 64


def _turns(logged: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    number = F.col(turn).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    return logged.select(
        F.col(conv).alias("_conv"), key.alias("_key"), number.alias("_turn"), F.coalesce(F.floor(number / PART_TURNS), F.lit(-(1 << 62))).alias("_part"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """One row per conversation and turn number: the prefix's hashes ``_h1 _h2`` and size, and whether it is the whole."""
    content = [F.col("_turn"), F.col("_role"), F.col("_text")]
    hashed = turns.select(
        "_conv", "_key", "_turn", "_part", F.xxhash64(*content).alias("_h1"), F.xxhash64(F.lit(7), *reversed(content)).alias("_h2")
    ).distinct()
    per_turn = hashed.groupBy("_key", "_part", "_turn").agg(
        F.first("_conv").alias("_conv"), F.bit_xor("_h1").alias("_h1"), F.bit_xor("_h2").alias("_h2"), F.count(F.lit(1)).alias("_n")
    )
    parts = per_turn.groupBy("_key", "_part").agg(*[f(c).alias(f"_t{c}") for f, c in ((F.bit_xor, "_h1"), (F.bit_xor, "_h2"), (F.sum, "_n"))])
    along = W.partitionBy("_key").orderBy("_part")
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    parts = parts.select(
        "_key", "_part", F.lead("_part").over(along).isNull().alias("_last"),
        *[F.coalesce(f(f"_t{c}").over(earlier), zero).alias(f"_p{c}") for f, c in ((F.bit_xor, "_h1"), (F.bit_xor, "_h2"), (F.sum, "_n"))],
    )
    inside = W.partitionBy("_key", "_part").orderBy(F.asc_nulls_first("_turn"))
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    own = per_turn.select(
        "_conv", "_key", "_part", F.row_number().over(inside).alias("_row"), F.count(F.lit(1)).over(W.partitionBy("_key", "_part")).alias("_rows"),
        F.bit_xor("_h1").over(upto).alias("_h1"), F.bit_xor("_h2").over(upto).alias("_h2"), F.sum("_n").over(upto).alias("_n"),
    )
    joined = own.join(parts, ["_key", "_part"])
    return joined.select(
        "_conv", "_key", F.col("_h1").bitwiseXOR(F.col("_p_h1")).alias("_h1"), F.col("_h2").bitwiseXOR(F.col("_p_h2")).alias("_h2"),
        (F.col("_n") + F.col("_p_n")).alias("_n"), (F.col("_last") & (F.col("_row") == F.col("_rows"))).alias("_whole"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """Keys of the conversations that prefix no longer one; of equal ones that with the smallest id."""
    prefixes = prefix_hashes(turns)
    ident = ["_h1", "_h2", "_n"]
    whole = prefixes.filter("_whole").groupBy(*ident).agg(F.min(F.struct("_conv", "_key")).alias("_first"))
    longer = prefixes.filter(~F.col("_whole")).select(*ident).distinct()
    return whole.join(longer, ident, "left_anti").select(F.col("_first._key").alias("_key"))


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def chat_texts(logged: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The maximal conversations as chat text, one row per conversation and part of ``PART_TURNS`` turn numbers."""
    turns = _turns(logged, conv, turn, role, text)
    kept = turns.join(maximal(turns), "_key", "left_semi")
    rows = F.array_sort(F.array_distinct(F.collect_list(F.struct("_turn", "_role", "_text"))))
    # array_sort puts a null turn number first, as a struct's null field is its smallest value.
    parts = kept.groupBy("_key", "_part").agg(F.first("_conv").alias(conv), rows.alias("_rows"))
    return parts.select(
        conv, F.when(F.col("_part") > -(1 << 62), F.col("_part")).alias("part"), F.size("_rows").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("_rows", lambda r: rendered_turn(r["_role"], r["_text"])), "").alias("rendered"),
    )


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, turn, sha256(string_agg(turn || ':' || length(role) || ':' || length(text) || ':' || role || text, '') OVER (
    PARTITION BY conv_id ORDER BY turn, role, text RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h,
    last_value(role || text) OVER (PARTITION BY conv_id, turn ORDER BY role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) = role || text AS whole_turn,
    max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM t),
q AS (SELECT * FROM p WHERE whole_turn),
f AS (SELECT h, min(conv_id) AS conv_id FROM q WHERE turn = last_turn GROUP BY h),
m AS (SELECT conv_id FROM f WHERE h NOT IN (SELECT h FROM q WHERE turn < last_turn))
SELECT conv_id, CAST(turn // 64 AS BIGINT) AS part, count(*) AS n_turns,
  string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
FROM t JOIN m USING (conv_id) GROUP BY 1, 2
"""
