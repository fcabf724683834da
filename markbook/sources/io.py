"""Scans and sinks. Every scan has an explicit schema; a missing path reads as an empty table."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markbook.functions import fixed
from markbook.functions.text import strip_space
from markbook.schemas import CONFIGS, LABELS, SEED_ITEMS

BOM = "\ufeff"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) is there, asked of the file system that owns it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, broken lines stop the job."""
    if not exists(spark, path):
        return _empty(spark, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return read_jsonl(spark, path, LABELS)


def write_splits(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One folder per split."""
    df.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def append_new(df: DataFrame, path: str, key: str, fmt: str = "parquet") -> None:
    """Append the rows whose key is not written yet; running it again adds nothing."""
    spark = df.sparkSession
    if exists(spark, path):
        written = spark.read.schema(df.schema).format(fmt).load(path).select(key)
        df = df.join(written, key, "left_anti")
    df.write.mode("append").format(fmt).save(path)


def read_configs(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(configs keyed by file stem, broken files) from one JSON object per file."""
    schema = f"{CONFIGS}, _corrupt_record string"
    if not exists(spark, pattern):
        empty = _empty(spark, schema)
        return empty.drop("_corrupt_record"), empty.select(F.lit("").alias("file"))
    # whole files as text: the parser's record of a failure can then be read on its own
    files = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    parsed = files.select("file", F.from_json("value", schema).alias("c")).select(
        "file", F.regexp_replace("file", "\\.json$", "").alias("_stem"), "c.*"
    )
    broken = F.col("_corrupt_record").isNotNull()
    good = parsed.where(~broken).withColumn("question_id", F.col("_stem")).drop("_stem", "_corrupt_record", "file")
    return good, parsed.where(broken).select("file")


def warn_broken(broken: DataFrame, shown: int = 5) -> None:
    """Warn about broken files: how many, and the names of a few."""
    names = [r["file"] for r in broken.limit(shown).collect()]
    if names:
        warnings.warn(f"{broken.count()} broken config files skipped, among them {', '.join(names)}", stacklevel=2)


def read_tsv(spark: SparkSession, path: str, min_cols: int, max_cols: int | None = None) -> DataFrame:
    """Tab-separated rows as columns c0.. of text; rows with fewer than ``min_cols`` columns are dropped.

    A byte-order mark before the first value is removed. Quoted values may hold tabs and line breaks.
    """
    n = max(max_cols or min_cols, min_cols)
    schema = ", ".join(f"c{i} string" for i in range(n))
    if not exists(spark, path):
        return _empty(spark, schema)
    raw = (
        spark.read.schema(f"{schema}, _raw string")
        .option("sep", "\t")
        .option("columnNameOfCorruptRecord", "_raw")
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path)
    )
    # the parser keeps the text of rows with another number of columns; an empty value reads as null.
    # tabs inside quotes part no columns
    bare = F.regexp_replace("_raw", '(?s)"(?:[^"]|"")*"', "")
    enough = F.col("_raw").isNull() | (F.size(F.split(bare, "\t")) >= min_cols)
    values = [F.coalesce(f"c{i}", F.lit("")).alias(f"c{i}") if i < min_cols else F.col(f"c{i}") for i in range(n)]
    return raw.where(enough).select(*values).withColumn("c0", F.regexp_replace("c0", "^" + BOM, ""))


def read_csv_items(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CSV with a header line, columns found by name; adds ``file`` (name without folder)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    wanted = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for path in wanted:
        if not exists(spark, path):
            continue
        raw = (
            spark.read.option("header", True)
            .option("multiLine", True)
            .option("escape", '"')
            .option("inferSchema", False)
            .csv(path)
        )
        raw = raw.withColumn("file", F.col("_metadata.file_name"))
        present = set(raw.columns)
        parts.append(
            raw.select(*[F.col(f"`{c}`") if c in present else F.lit(None).cast("string").alias(c) for c in columns], "file")
        )
    if not parts:
        return _empty(spark, f"{schema}, file string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


EXPORT_COLUMNS = ("answer_id", "student_id", "class_name", "total_score", "max_score", "rating")


def export_results(df: DataFrame, path: str, fmt: str = "csv", columns: Sequence[str] = EXPORT_COLUMNS) -> None:
    """Write results: CSV with the fixed columns and nulls as empty, or JSON with all columns."""
    if fmt == "csv":
        df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option(
            "emptyValue", ""
        ).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def parse_phases(lines: DataFrame, column: str = "value") -> DataFrame:
    """(phase, ms) from log lines, colour codes removed; other lines are dropped."""
    plain = F.regexp_replace(F.col(column), fixed.ANSI_COLOUR, "")
    return lines.select(
        F.regexp_extract(plain, fixed.PHASE_ENTRY, 1).alias("phase"),
        F.regexp_extract(plain, fixed.PHASE_ENTRY, 2).try_cast("double").alias("ms"),
    ).where(F.col("phase") != "")


def parse_phase_log(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return _empty(spark, "phase string, ms double")
    return parse_phases(spark.read.text(path))


# fixed values: source files, their subject codes and names
SEED_SUBJECTS = {
    "1_History_ShortAns": ("HIST", "历史"),
    "8_Political_ShortAns": ("POL", "政治"),
    "3_Geography_ShortAns": ("GEO", "地理"),
    "6_Chinese_ShortAns": ("CHN", "语文"),
}


def with_place(raw: DataFrame, order: int = 0) -> DataFrame:
    """Add where a row was read: ``_order`` (of its source), ``_file``, ``_block`` and ``_row``.

    Call it directly on a scan. Rows of one block are read in one task, in order.
    """
    return raw.select(
        "*",
        F.lit(order).alias("_order"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )


def number_rows(df: DataFrame, out: str = "position", sub: Sequence[str] = ()) -> DataFrame:
    """Number rows 0.. in reading order; ``sub`` orders rows that came from one read row.

    A block's rows are numbered in one task on top of the count of all earlier blocks, and only those
    counts (one per block) are added up in one place.
    """
    block = ["_order", "_file", "_block"]
    counts = df.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(*block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*block).orderBy("_row", *sub)
    return (
        df.withColumn("_i", F.row_number().over(inside) - 1)
        .join(bases, block)
        .withColumn(out, F.col("_base") + F.col("_i"))
        .drop(*block, "_row", "_i", "_base")
    )


def read_seed_items(spark: SparkSession, folder: str, subjects: Sequence[str] = tuple(SEED_SUBJECTS)) -> DataFrame:
    """Source items with nested steps, their subject code and name, and a ``position`` in reading order."""
    out = None
    for order, name in enumerate(subjects):
        code, title = SEED_SUBJECTS[name]
        path = f"{folder}/{name}.jsonl"
        if not exists(spark, path):
            continue
        raw = with_place(spark.read.schema(SEED_ITEMS).option("mode", "FAILFAST").json(path), order)
        part = raw.withColumn("subject_code", F.lit(code)).withColumn("subject_name", F.lit(title))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return _empty(spark, f"{SEED_ITEMS}, subject_code string, subject_name string, position bigint")
    return number_rows(out)


SPAN_ANSWER = "struct<text:string,answer_start:int>"
NESTED_CORPUS = (
    "data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,"
    f"answers:array<{SPAN_ANSWER}>>>>>>>"
)
FLAT_CORPUS = (
    "context_id string, context_text string, title string, "
    "qas array<struct<query_id:string,query_text:string,answers:array<string>>>"
)


def _span_rows(rows: DataFrame) -> DataFrame:
    start = F.coalesce(F.col("given"), F.instr("context", F.col("answer")) - 1)
    return (
        rows.withColumn("answer_start", start)
        .where((F.coalesce("answer", F.lit("")) != "") & (F.col("answer_start") >= 0))
        .select(
            F.col("qid").alias("id"),
            F.col("qid").alias("question_id"),
            F.lit("cmrc").alias("origin"),
            "context",
            "query",
            "answer",
            F.col("answer_start").cast("int").alias("answer_start"),
            F.lit(False).alias("is_impossible"),
            F.lit("exact").alias("hit_type"),
        )
    )


def span_corpus_nested(raw: DataFrame) -> DataFrame:
    """Span rows from data -> paragraphs -> qas; a missing start counts as not located."""
    qa = (
        raw.select(F.explode("data").alias("a"))
        .select(F.explode("a.paragraphs").alias("p"))
        .select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    )
    first = F.get(F.col("q.answers"), F.lit(0))
    return _span_rows(
        qa.select(
            F.col("q.id").alias("qid"),
            "context",
            F.col("q.question").alias("query"),
            first["text"].alias("answer"),
            F.coalesce(first["answer_start"], F.lit(-1)).alias("given"),
        )
    )


def span_corpus_flat(raw: DataFrame) -> DataFrame:
    """Span rows from context_text -> qas with plain answers; the start is searched."""
    qa = raw.select(F.col("context_text").alias("context"), F.explode("qas").alias("q"))
    return _span_rows(
        qa.select(
            F.col("q.query_id").alias("qid"),
            "context",
            F.col("q.query_text").alias("query"),
            F.get(F.col("q.answers"), F.lit(0)).alias("answer"),
            F.lit(None).cast("int").alias("given"),
        )
    )


def read_span_corpus(spark: SparkSession, path: str, nested: bool) -> DataFrame:
    """Reading-comprehension corpus: one JSON document, nested or flat layout."""
    schema = NESTED_CORPUS if nested else FLAT_CORPUS
    if not exists(spark, path):
        raw = _empty(spark, schema)
    else:
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return span_corpus_nested(raw) if nested else span_corpus_flat(raw)


def trimmed(column: str) -> Column:
    return strip_space(F.coalesce(F.col(column), F.lit("")))
