"""From documents to packed sequences: five operators of markbook.llm in a row, each a table of its own."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markbook.llm import exact, mixing, packing, simhash, toxicity
from markbook.llm.common import settled, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: bytes that Spark sends to a Python worker at once. By default it sends 10,000 rows, and whole texts have no bound; a batch is held
#: by the executor, by the worker and by what the worker makes of it, in each of the executor's tasks
BATCH_BYTES = 2 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that sends no more than BATCH_BYTES (and a row) to a Python worker at once; a smaller setting stays."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
            spark.conf.set(BATCH_SETTING, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Labels are those of the folder; rows of ``labels`` for other documents do not count."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact.without_duplicates(docs)


@in_small_batches
def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal texts the document with the smallest doc_id."""
    return simhash.one_of_each(docs)


@in_small_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their weights: documents left out, taken once or several times."""
    return mixing.mixture(docs)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.packed(packing.digested(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", different),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
