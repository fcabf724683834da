"""What several operators of this package share: tables, settled steps, files of the shared folder, id filters."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.session import settled, work_dir

#: white space of the contracts: space and U+0009 to U+000D, the same set as ``bytes.split()``
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["settled", "work_dir", "table", "text_of", "lowered", "filesystem", "drop_ids", "hash_bits", "bits_table", "joined_back", "worker_memory"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lowered(column: Column) -> Column:
    """A-Z in lower case and nothing else changed. Text of one byte per character takes the faster way."""
    ascii_only = F.octet_length(column) == F.char_length(column)
    return F.when(ascii_only, F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def filesystem(uri: str):
    """pyarrow's file system for a folder of the shared store, and the path in it. Used inside tasks.

    Only for files this package wrote below ``spark.checkpoint.dir``; inputs are read by Spark alone.
    """
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


# --- bit tables: bounded Bloom filters made of DataFrame functions -------------------------------------------
BUCKET = 32_768  # bits in one bitmap of Spark's bitmap functions
PROBES = 2


def buckets_for(rows: int, most_bits: int) -> int:
    """Bitmaps for about 32 bits a row, at most ``most_bits`` in all: the proven bound of the broadcast.

    Beyond the bound the filter answers "maybe" more often, which costs shuffled rows and no result.
    """
    return max(1, min(most_bits, 32 * rows) // BUCKET)


def hash_bits(key: Column, buckets: int) -> list[Column]:
    """(bucket, place, ...) of a key: one bitmap and PROBES places in it, as columns _b, _p0, _p1."""
    first, second = F.xxhash64(key), F.xxhash64(key, F.lit("places"))
    places = [F.shiftrightunsigned(second, 15 * i).bitwiseAND(F.lit(BUCKET - 1)).cast("int") for i in range(PROBES)]
    return [F.pmod(first, F.lit(buckets)).cast("int").alias("_b"), *[p.alias(f"_p{i}") for i, p in enumerate(places)]]


def bits_table(keys: DataFrame, column: str, buckets: int, least: int = 1) -> DataFrame:
    """(_b, _bits): bits that at least ``least`` rows of ``keys`` set. At most ``buckets`` rows of 4 KB."""
    places = keys.select(*hash_bits(F.col(column), buckets)).select(
        "_b", F.explode(F.array(*[F.col(f"_p{i}") for i in range(PROBES)])).alias("_p")
    )
    counted = places.groupBy("_b", "_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row may set a bit by both of its places; the bit then counts for two, which only adds a "maybe"
    return (
        counted.where(F.col("_n") >= least)
        .groupBy("_b")
        .agg(F.bitmap_construct_agg(F.col("_p").cast("bigint")).alias("_bits"))
    )


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place.bitwiseAND(F.lit(7))) == 1


def maybe_in(df: DataFrame, key: Column, bits: DataFrame, buckets: int, name: str = "_maybe") -> DataFrame:
    """Add a boolean column: false only where the key certainly set none of the bits."""
    marked = df.select("*", *hash_bits(key, buckets)).join(F.broadcast(bits), "_b", "left")
    hit = F.lit(True)
    for i in range(PROBES):
        hit = hit & _is_set(F.col("_bits"), F.col(f"_p{i}"))
    return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop(
        "_b", "_bits", *[f"_p{i}" for i in range(PROBES)]
    )


def drop_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id", most_bits: int = 1 << 26) -> DataFrame:
    """``docs`` without the rows whose key is in ``dropped`` (a settled one-column table); columns unchanged.

    A bounded bit table of the dropped keys goes to every task. Rows it does not know pass straight through, only the
    others meet the exact list in a shuffle, so texts that stay are not shuffled. Rows with a null key stay.
    """
    gone = dropped.select(F.col(key).alias("_key")).distinct()
    buckets = buckets_for(dropped.count(), most_bits)
    bits = settled(bits_table(gone, "_key", buckets), "dropped-bits")
    names = docs.columns
    marked = maybe_in(docs.select(F.struct(*names).alias("_row")), F.col("_row")[key], bits, buckets)
    straight = marked.where(~F.col("_maybe")).select("_row.*")
    checked = (
        marked.where("_maybe")
        .select("_row", F.col("_row")[key].alias("_key"))
        .join(gone, "_key", "left_anti")
        .select("_row.*")
    )
    return straight.unionByName(checked)


#: a key is hot if it holds 1 of so many rows; there are at most so many hot keys
HOT_KEYS = 4_096


def joined_back(rows: DataFrame, found: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` joined with ``found`` (a settled table, one row per key; ``copies``: how many rows have it) on ``key``.

    Keys that hold 1 of HOT_KEYS of all rows are at most HOT_KEYS, so they may be broadcast; a key with a third of all rows
    is never shuffled. The other rows are shuffled, and no key of theirs has more than that share.
    """
    total = found.agg(F.sum(copies)).head()[0] or 0
    hot = F.col(copies) * HOT_KEYS >= total
    of_hot = F.broadcast(found.where(hot))
    near = rows.join(of_hot, key)
    cold = rows.join(F.broadcast(found.where(hot).select(key)), key, "left_anti").join(found.where(~hot), key)
    return near.unionByName(cold)


def worker_memory(owner: str) -> dict:
    """A dictionary that outlives a task in this Python worker: functions that travel to it arrive anew with every task.

    Spark's workers serve one operator after another. A worker remembers for one ``owner`` at a time: what others left goes, so
    that a tokenizer and its words are not kept through steps that do not need them.
    """
    kept = sys.modules.setdefault("markbook_worker_memory", types.ModuleType("markbook_worker_memory")).__dict__
    for other in [k for k in kept if k.startswith("owner ") and k != f"owner {owner}"]:
        del kept[other]
    return kept.setdefault(f"owner {owner}", {})
