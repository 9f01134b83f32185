"""The queries of this folder and their SQL twins: one per operator, and the corpus pipeline."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import bpe, chat, golay, id_files, importance, jaccard, language, merkle, packing, quality_rules, repeats, runs, syncmers
from attestry.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return enter


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_quality_rules", quality_rules.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.cascade(documents(spark, sf_dir))


@query("op9_chat_format", chat.ORACLE_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_texts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


@query("op8_id_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "id-files")
    id_files.write(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return id_files.digests(id_files.read(spark, folder))


@query("op10_language")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


@query("op3_syncmers")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_probe(documents(spark, sf_dir))


@query("op7_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(documents(spark, sf_dir), jaccard.Similar(words=4, num=85, den=100))


@query("op2_repeats")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.find(documents(spark, sf_dir)))


@query("op1_importance")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tenth_rearranged(doc: int | None, n: int) -> np.ndarray | None:
    """Where the words of one document in ten come from: behind a first part, the same few words over and over."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


@query("op11_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(documents(spark, sf_dir), tenth_rearranged)


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.link(documents(spark, sf_dir))


@query("op13_merkle", merkle.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verified(documents(spark, sf_dir), {"n_chars": tampered})
