"""Tables kept in shards: a change rewrites the shards it touches, and a manifest says which version of each shard counts.

A folder holds one or more such tables. ``<name>/v=<batch>/shard=<n>`` are the rows of a shard as a batch left them;
``manifest/batch=<n>`` names the version of every shard after that batch and exists only once all of it is written. Readers
follow the newest manifest, so they never see half a batch; doing a batch again overwrites what it wrote and starts from the
manifest before it. Versions that the last two manifests do not name are deleted, so the folder does not grow with the
number of batches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
KEPT = 2

Versions = dict[str, dict[int, int]]


def shard_of(keys: Sequence[str], shards: int = SHARDS) -> Column:
    """The shard of a row by its key; keys are compared as they are written."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(shards)).cast("int")


def _files(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().toString() for f in found or []]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _number(path: str, label: str) -> int:
    return int(re.search(rf"/{label}=(\d+)", path)[1])


def committed(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose manifest is whole, in order."""
    return sorted(_number(f, "batch") for f in _files(spark, f"{folder}/manifest/batch=*/_SUCCESS"))


def versions(spark: SparkSession, folder: str, below: int | None = None) -> Versions:
    """{table: {shard: version}} as the newest batch (before ``below``) left it. At most SHARDS entries a table."""
    batches = [b for b in committed(spark, folder) if below is None or b < below]
    found: Versions = {}
    if batches:
        named = spark.read.schema("name string, shard int, version long").parquet(f"{folder}/manifest/batch={batches[-1]}")
        for r in named.collect():
            found.setdefault(r.name, {})[r.shard] = r.version
    return found


def write_shards(rows: DataFrame, folder: str, name: str, batch: int) -> list[int]:
    """Write rows, which have a ``shard`` column, as this batch's version; the shards that it has."""
    path = f"{folder}/{name}/v={batch}"
    # one shard is split over tasks only where it is large
    rows.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
    return sorted(_number(f, "shard") for f in _files(rows.sparkSession, f"{path}/shard=*"))


def read_shards(spark: SparkSession, folder: str, name: str, of: Versions, schema: str, shards: Sequence[int] | None = None) -> DataFrame:
    """Rows of the named shards, or of all, without the shard column."""
    wanted = {s: v for s, v in of.get(name, {}).items() if shards is None or s in shards}
    paths = [f"{folder}/{name}/v={v}/shard={s}" for s, v in sorted(wanted.items())]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def commit(spark: SparkSession, folder: str, batch: int, of: Versions) -> None:
    """Make ``of`` the state after ``batch``, then drop versions that only older manifests name."""
    rows = [(name, shard, version) for name, shards in of.items() for shard, version in shards.items()]
    named = spark.createDataFrame(rows, "name string, shard int, version long").coalesce(1)
    named.write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")
    _drop_old(spark, folder)


def _drop_old(spark: SparkSession, folder: str) -> None:
    batches = committed(spark, folder)
    kept = batches[-KEPT:]
    if len(batches) == len(kept):
        return
    needed: dict[str, set[tuple[int, int]]] = {}
    for batch in kept:
        for name, shards in versions(spark, folder, batch + 1).items():
            needed.setdefault(name, set()).update((v, s) for s, v in shards.items())
    for name, pairs in needed.items():
        for path in _files(spark, f"{folder}/{name}/v=*"):
            version = _number(path, "v")
            if version > kept[-1]:
                continue
            shards = _files(spark, f"{path}/shard=*")
            unused = [s for s in shards if (version, _number(s, "shard")) not in pairs]
            for gone in [path] if len(unused) == len(shards) else unused:
                _delete(spark, gone)
    for batch in batches[:-KEPT]:
        _delete(spark, f"{folder}/manifest/batch={batch}")


def upsert_shards(
    updates: DataFrame, folder: str, key: Sequence[str], order: Sequence[str] = (), shards: int = SHARDS, batch: int | None = None
) -> int:
    """Write updates over the stored table by key; of several updates of a key the last by ``order`` counts. Returns the batch.

    Only the shards of updated keys are read and rewritten; the files of the others stay as they are. Repeating a batch
    number does that batch again.
    """
    from markbook.operators.tables import upsert

    spark = updates.sparkSession
    if batch is None:
        batch = max(committed(spark, folder), default=-1) + 1
    before = versions(spark, folder, batch)
    schema = ", ".join(f"`{n}` {t}" for n, t in updates.dtypes)
    placed = updates.withColumn("shard", shard_of(key, shards))
    touched = [r[0] for r in placed.select("shard").distinct().collect()]
    stored = read_shards(spark, folder, "rows", before, schema, touched)
    merged = upsert(stored, updates, key, order).withColumn("shard", shard_of(key, shards))
    written = write_shards(merged, folder, "rows", batch)
    commit(spark, folder, batch, {"rows": before.get("rows", {}) | dict.fromkeys(written, batch)})
    return batch


def read_upserted(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The stored table as the newest batch left it."""
    return read_shards(spark, folder, "rows", versions(spark, folder), schema)
