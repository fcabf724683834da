"""Incremental jobs: score answers as they arrive, keep statistics of the questions that changed.

Both run as micro-batches and may be stopped anywhere. What a batch writes counts only when its manifest is there, which is
written last; after a restart the stream repeats the batch, which overwrites its own rows. So a job neither loses nor
repeats results, and a reader never sees half a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markbook.operators.analytics import question_summary
from markbook.operators.tables import latest
from markbook.sources import shards


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive, at most so many in a batch: a backlog is worked off in batches of a bounded size."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_scores(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Score every arriving answer once. ``score`` turns a batch of answers into results, for example ``plans.grading.grade``.

    Results of batch n are ``out``/batch=n; ``out``/done/batch=n, one row, is written after them. A batch of few files is few
    tasks, so its rows are dealt over all cores before they are scored.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        score(batch.repartition(parts)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finish_scores(spark, out, number)

    return _start(stream, handle, checkpoint)


def finish_scores(spark: SparkSession, out: str, number: int) -> None:
    spark.range(1).select(F.lit(number).alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{out}/done/batch={number}")


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """Results of all batches that are done."""
    done = [f.rsplit("/", 2)[1] for f in shards._files(spark, f"{out}/done/batch=*/_SUCCESS")]
    return spark.read.parquet(*[f"{out}/{batch}" for batch in done])


def stream_stats(stream: DataFrame, out: str, checkpoint: str, order: list[str], count: int = shards.SHARDS) -> StreamingQuery:
    """Keep per-question statistics of a stream of results that may be scored again.

    A later result of an answer (by ``order``) replaces the earlier one, so statistics cannot simply be added up. The latest
    result of every answer is kept in ``count`` shards by question; a batch rewrites the shards it touches and the statistics of
    their questions. What a batch costs depends on these shards, not on how many batches there were (see `sources.shards`).
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = shards.versions(spark, out, below=number)
        placed = batch.withColumn("shard", shards.shard_of(["question_id"], count))
        touched = [r[0] for r in placed.select("shard").distinct().collect()]
        if not touched:
            return
        schema = ", ".join(f"`{c}` {t}" for c, t in batch.dtypes)
        stored = shards.read_shards(spark, out, "latest", before, schema, touched)
        # an answer has one question, so the latest per (question, answer) is the latest per answer
        current = latest(stored.unionByName(batch), ["question_id", "answer_id"], order).select(*batch.columns)
        written = shards.write_shards(current.withColumn("shard", shards.shard_of(["question_id"], count)), out, "latest", number)
        new = shards.read_shards(spark, out, "latest", {"latest": dict.fromkeys(written, number)}, schema)
        stats = question_summary(new).withColumn("shard", shards.shard_of(["question_id"], count))
        with_stats = shards.write_shards(stats, out, "stats", number)
        finish_stats(spark, out, number, {
            "latest": before.get("latest", {}) | dict.fromkeys(written, number),
            "stats": before.get("stats", {}) | dict.fromkeys(with_stats, number),
        })

    return _start(stream, handle, checkpoint)


def finish_stats(spark: SparkSession, out: str, number: int, state: shards.Versions) -> None:
    shards.commit(spark, out, number, state)


def read_stats(spark: SparkSession, out: str) -> DataFrame:
    """The newest statistics of every question."""
    state = shards.versions(spark, out)
    paths = [f"{out}/stats/v={v}/shard={s}" for s, v in state["stats"].items()]
    return spark.read.parquet(*paths)
