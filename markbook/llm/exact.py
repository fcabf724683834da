"""Exact duplicates by two passes over a Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.llm.common import bits_table, buckets_for, drop_ids, lowered, maybe_in, settled, text_of


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", most_bits: int = 1 << 27) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the largest id of equal texts stays.

    Pass 1 hashes each text once (a settled table of id and digest) and counts, per bit of a Bloom filter, whether two
    rows or more set it. Pass 2 asks that filter for each row: a row with a bit that it alone set has no equal and passes
    straight through; only the rest are grouped by digest. The filter is at most ``most_bits`` / 8 bytes and so may be
    broadcast. The digest groups are aggregates, settled before the join, so a text with a third of all rows is combined
    before the shuffle and its rows are split by adaptive execution in the join.

    Null texts count as empty, so null and empty texts are one group. Rows that repeat an id and its text are one document:
    all bear its decision, and each counts in group_size. Ids that are null are smaller than any other. Very long texts are
    hashed whole. An empty table gives no rows. Other columns are not read.
    """
    hashed = settled(
        docs.select(F.col(id).alias("doc_id"), F.sha2(lowered(text_of(text)), 256).alias("text_sha256")), "exact-hash"
    )
    buckets = buckets_for(hashed.count(), most_bits)
    bits = settled(bits_table(hashed, "text_sha256", buckets, least=2), "exact-bits")
    marked = maybe_in(hashed, F.col("text_sha256"), bits, buckets)
    alone = marked.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"),
        "text_sha256",
    )
    maybe = marked.where("_maybe").select("doc_id", "text_sha256")
    groups = settled(
        maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "exact-groups",
    )
    grouped = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, columns unchanged."""
    found = exact_duplicates(docs)
    return drop_ids(docs, settled(found.where("not kept").select("doc_id"), "exact-dropped"))


EXACT_SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       h as text_sha256
from t window w as (partition by h)"""
