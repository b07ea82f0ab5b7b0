"""The registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode
from .common import read_table
from .decontaminate import ORACLE as DECONTAMINATION_SQL
from .decontaminate import decontaminate
from .digest import edited_pairs
from .licenses import scan
from .line_dedup import ORACLE as LINE_DEDUP_SQL
from .line_dedup import line_dedup
from .lm import lm_scores
from .pii import find_pii
from .quality import classify
from .sharding import shard
from .simhash import near_duplicates

VOCABULARY = os.environ.get("LOXIS_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(read_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_pii, op3_quality, op4_decontamination, op5_sharding, op6_license_scan, op7_fingerprint, op8_line_dedup, op9_lm_score, op10_simhash)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": DECONTAMINATION_SQL, "op8_line_dedup": LINE_DEDUP_SQL}
