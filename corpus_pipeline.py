"""The corpus pipeline: five stages over `documents`, each reading what the one before it kept.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. run() applies them to the documents of a folder, with a table in the shared folder between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loxis.llm.bpe import encode
from loxis.llm.common import read_table, staged
from loxis.llm.decontaminate import clean
from loxis.llm.line_dedup import deduped
from loxis.llm.quality import classify
from loxis.llm.queries import VOCABULARY
from loxis.llm.simhash import representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, read_table(spark, sf_dir, "labels"), keep_good=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document stays, if need be with an empty text."""
    return deduped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of least id."""
    return representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of the benchmark go, however long they are."""
    return clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return encode(docs, VOCABULARY, with_ids=True)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", benchmark), ("bpe", tokens)]

#: Attention-weighted scores, XXH64 fingerprints and BPE have no SQL form; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
