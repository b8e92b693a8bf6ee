"""A corpus through quality, exact and near dedup, decontamination and packing.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``. The stages read only documents' text and ids from ``docs``, and
labels and the benchmark from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontamination, exact_dedup, packing, quality, simhash
from colloquy.llm.common import row_ids, table


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a key per row (_row), written so that the key stays the same."""
    return table(row_ids(docs), name)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with _row) whose _row isn't among ``dropped``.

    The keys, which are the smaller side, are hashed per partition, so texts are
    shuffled once and not sorted.
    """
    keys = dropped.select(F.col("_row").alias("_key"))
    return docs.join(keys.hint("shuffle_hash"), docs["_row"] == keys["_key"], "left_anti").drop("_row")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    It is learned from the labelled rows of ``docs``; without any, all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.accepted(docs, quality.train(docs, labels))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of equal texts."""
    rows = _keyed(docs, "exact-rows")
    return _without(rows, table(exact_dedup.later_rows(rows), "exact"))


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each near-duplicate component."""
    rows = _keyed(docs, "near-rows")
    return _without(rows, table(simhash.later_rows(rows), "near"))


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_filter),
    ("SimHash near-dedup", near_filter),
    ("benchmark decontamination", decontamination_filter),
    ("packing", packed),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
