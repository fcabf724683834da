"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.llm import chat, crosstok, exact, mixing, packing, quality, secrets, simhash, substrings, toxicity, vectors, warc, whitening
from markbook.llm.common import table
from markbook.plans.registry import Registry

registry = Registry()


@registry.add("op1_warc", warc.WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registry.add("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.digested(table(spark, sf_dir, "documents")))


@registry.add("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@registry.add("op4_chat", chat.CHAT_SQL)
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.formatted_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


@registry.add("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(table(spark, sf_dir, "documents")))


@registry.add("op6_mixing", mixing.MIX_SQL)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@registry.add("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registry.add("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.without_repeats(table(spark, sf_dir, "documents")))


@registry.add("op9_exact", exact.EXACT_SQL)
def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@registry.add("op10_vectors")
def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@registry.add("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("bigint"))


@registry.add("op12_quality", quality.QUALITY_SQL)
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(table(spark, sf_dir, "documents"))
    return found.drop("class_distance", "word_distance")


@registry.add("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.alignments(table(spark, sf_dir, "documents"))


def queries():
    return dict(registry.queries)


def oracle_sql():
    return dict(registry.sql)
