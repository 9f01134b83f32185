"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Every stage takes all that its predecessor kept, and all but the last return the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import importance, jaccard, packing, quality_rules, repeats
from attestry.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A passage of 50 short words has some 155 bytes; shorter windows find it, and its words decide.
PASSAGE_BYTES, PASSAGE_WORDS = 152, 50
# Fewer remembered pieces than by default: a worker has been through four stages before.
KEPT_PIECES = 300_000


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The rows are judged where they lie; nothing is shuffled.

    Null and empty texts have too few words and go; repeated rows are judged alike; a very long text is judged whole."""
    return quality_rules.kept_rows(docs).select(*COLUMNS)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. Null and empty texts have no feature that speaks against them; copies of a row
    have equal weights; a very long text counts every feature once."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.kept_rows(docs, labels).select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id."""
    return jaccard.one_of_each(docs.select(*COLUMNS))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of ``PASSAGE_WORDS`` words or more that start anywhere else; ``n_chars`` is counted anew.

    A null text stays null and an empty one empty; copies of a row lose the same bytes, all of them where the text is long
    enough, since each repeats the other."""
    cleaned = repeats.cleaned(docs, repeats.find(docs, PASSAGE_BYTES), least_words=PASSAGE_WORDS)
    changed = F.col("text").isNotNull()
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 ids. Null and empty texts are their end id alone, repeated rows are packed each,
    a very long text is cut into several pieces."""
    return packing.digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), kept=KEPT_PIECES))


STAGES = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("near duplicates", near_duplicates_stage),
    ("repeated strings", repeats_stage),
    ("packing", packing_stage),
]

# Suffix merging, hashed models and tokenizers have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
