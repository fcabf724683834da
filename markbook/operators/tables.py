"""Table maintenance: upserts, cascades, default ids, lookups and the joins that feed scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.scores import half_even
from markbook.functions.text import answer_text, strip_space
from markbook.operators.ranking import hash_rank, running_totals


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by ``order``. An aggregate, so a key with very many versions is no hot spot."""
    values = [c for c in rows.columns if c not in key]
    newest = F.max_by(F.struct(*values), F.struct(*order))
    return rows.groupBy(*key).agg(newest.alias("_v")).select(*key, "_v.*")


def upsert(base: DataFrame, updates: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Base with updates written over it by key; among several updates of a key the last by ``order``."""
    newest = latest(updates, key, order) if order else updates
    kept = base.join(updates.select(*key), list(key), "left_anti")
    return kept.unionByName(newest.select(*base.columns))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed."""
    return df.join(done.select(key), key, "left_anti")


def save_config(questions: DataFrame, configs: DataFrame, status: str) -> DataFrame:
    """Questions after saving rubrics: those with a saved one take the status."""
    saved = configs.select("question_id").distinct().withColumn("_new", F.lit(status))
    return (
        questions.join(saved, "question_id", "left")
        .withColumn("config_status", F.coalesce("_new", "config_status"))
        .drop("_new")
        .select(*questions.columns)
    )


def cascade(tables: Mapping[str, DataFrame], deleted: DataFrame, key: str = "question_id") -> dict[str, DataFrame]:
    """Every table without the rows of deleted keys."""
    gone = deleted.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def delete_project(
    projects: DataFrame, questions: DataFrame, tables: Mapping[str, DataFrame], deleted: DataFrame
) -> dict[str, DataFrame]:
    """Delete projects, their questions and everything that hangs on those questions."""
    doomed = questions.join(deleted.select("project_id").distinct(), "project_id", "left_semi").select("question_id")
    kept = cascade({"questions": questions, **tables}, doomed)
    return {"projects": projects.join(deleted.select("project_id"), "project_id", "left_anti"), **kept}


def default_ids(
    df: DataFrame, out: str, order: str, prefix: Column, width: int = 3, group: Sequence[str] = (), start: int = 0,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Fill a missing ``out`` with prefix + zero-padded place (1..n by the unique number ``order`` per group)."""
    placed = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], group, cuts)
    number = (F.col("_one_upto") + F.lit(start)).cast("string")
    padded = F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0"))
    made = F.concat(prefix, padded)
    current = F.col(out) if out in df.columns else F.lit(None).cast("string")
    return placed.withColumn(out, F.coalesce(current, made)).drop("_one", "_one_upto", "_one_all")


def list_rows(df: DataFrame, **equal) -> DataFrame:
    """Rows matching the given column values; a value of None means no filter on that column."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def latest_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.col("created_at").desc(), "project_id")


def clean_submissions(df: DataFrame) -> DataFrame:
    """Blank answers dropped, text trimmed, empty student and class ids to null."""
    return (
        df.withColumn("answer_text", strip_space(F.col("answer_text")))
        .where(F.col("answer_text") != "")
        .withColumn("student_id", F.nullif(F.col("student_id"), F.lit("")))
        .withColumn("class_name", F.nullif(F.col("class_name"), F.lit("")))
    )


def scoring_input(
    answers: DataFrame, questions: DataFrame, ocr: DataFrame | None = None
) -> DataFrame:
    """Answers with their effective text, the question's stem and, for recognised answers, its OCR confidence."""
    stems = questions.select("question_id", F.col("content").alias("stem_text"))
    out = answers.withColumn("text", answer_text(F.col("ocr_text"), F.col("answer_text"))).join(
        stems, "question_id", "left"
    )
    if ocr is None:
        return out.withColumn("ocr_confidence", F.lit(None).cast("double"))
    conf = ocr.select("question_id", F.col("confidence").alias("_conf"))
    return (
        out.join(conf, "question_id", "left")
        .withColumn("ocr_confidence", F.when(F.col("source") == "ocr", F.col("_conf")))
        .drop("_conf")
    )


def with_student(results: DataFrame, answers: DataFrame) -> DataFrame:
    return results.join(answers.select("answer_id", "student_id", "class_name"), "answer_id", "left")


def with_stem(df: DataFrame, items: DataFrame, id_col: str = "id") -> DataFrame:
    """Add the stem of the item named by the id's part before '#'. ``items``: id, question."""
    stems = items.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("question", F.lit("")) != "")).select(
        F.col("id").alias("_item"), strip_space(F.col("question")).alias("stem")
    )
    keyed = df.withColumn("_item", F.get(F.split(F.col(id_col), "#"), F.lit(0)))
    return keyed.join(stems, "_item", "left").drop("_item")


def question_stems(df: DataFrame, items: DataFrame, id_col: str = "id") -> DataFrame:
    """(question_id, stem): all distinct stems behind a question's full rows, sorted, joined by newline.

    Distinct first, so only a question's different stems meet.
    """
    full = with_stem(df.where(F.col("origin") == "full"), items, id_col).where(F.col("stem").isNotNull())
    return full.select("question_id", "stem").distinct().groupBy("question_id").agg(
        F.array_join(F.sort_array(F.collect_list("stem")), "\n").alias("stem")
    )


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def scored_pairs(df: DataFrame, s1: Column, s2: Column, score: Column, source: str, question: Column) -> DataFrame:
    """Sentence pairs with an outside score: trimmed, at least four characters, score clamped and rounded."""
    from markbook.functions.scores import clamp

    return df.select(
        strip_space(F.coalesce(s1, F.lit(""))).alias("sentence1"),
        strip_space(F.coalesce(s2, F.lit(""))).alias("sentence2"),
        half_even(clamp(score, 0.0, 1.0), 3).alias("score"),
        F.lit(source).alias("source"),
        question.alias("question_id"),
    ).where((F.length("sentence1") >= 4) & (F.length("sentence2") >= 4) & F.col("score").isNotNull())


def seeded_cap(df: DataFrame, keys: Sequence[str], limit: int, seed: int = 42) -> DataFrame:
    """``limit`` rows in seeded order of ``keys``."""
    return hash_rank(df, keys, seed, upto=limit).where(F.col("rank") <= limit).drop("rank", "total")
