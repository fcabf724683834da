"""Result analytics: distributions, hit rates, question views, read order, timings, usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.scores import bucket_label, half_even, is_hit, rating, ratio, ratio_bucket
from markbook.functions.text import strip_space
from markbook.operators.ranking import order_statistics


def answer_totals(details: DataFrame, maxima: DataFrame | None = None, key: str = "answer_id") -> DataFrame:
    """(key, total_score, max_score, rating) from scored points.

    The maximum comes from ``maxima`` (key, max_score) or is the sum of ``weight``.
    """
    sums = [F.sum("point_score").alias("total_score")]
    if maxima is None:
        totals = details.groupBy(key).agg(*sums, F.sum("weight").alias("max_score"))
    else:
        totals = details.groupBy(key).agg(*sums).join(maxima.select(key, "max_score"), key)
    return totals.withColumn("rating", rating(F.col("total_score"), F.col("max_score")))


def _fixed_rows(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(values)), f"place int, {name} string")


def score_buckets(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Five buckets of score share, empty ones included."""
    share = ratio(F.col("total_score"), F.col("max_score"))
    counted = results.groupBy(*by, ratio_bucket(share).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    if not by:
        frame = _fixed_rows(results, fixed.BUCKET_LABELS, "label")
    else:
        places = F.explode(F.array(*[F.lit(i) for i in range(len(fixed.BUCKET_LABELS))])).alias("place")
        frame = counted.select(*by).distinct().select(*by, places).withColumn("label", bucket_label(F.col("place")))
    joined = frame.join(counted, [*by, "place"], "left")
    return joined.select(*by, F.col("place").alias("bucket"), "label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def rating_counts(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return results.groupBy(*by, "rating").agg(F.count(F.lit(1)).alias("n"))


def point_hits(details: DataFrame) -> DataFrame:
    """(question_id, point_id, hit, total); a status other than miss is a hit."""
    return details.groupBy("question_id", F.coalesce("point_id", F.lit(0)).alias("point_id")).agg(
        F.count_if(is_hit(F.col("hit_status"))).alias("hit"), F.count(F.lit(1)).alias("total")
    )


def admin_stats(questions: DataFrame, answers: DataFrame, results: DataFrame) -> DataFrame:
    """Dashboard figures as (section, name, value): questions by status, answers, score averages, ratings, buckets.

    Each row adds to the figures it belongs to, and all figures are one grouping: every table is read once.
    """

    def figure(section: str, name: Column | str, n: int = 1, x: Column | None = None) -> Column:
        label = F.lit(name) if isinstance(name, str) else name
        value = F.lit(None) if x is None else x
        return F.struct(
            F.lit(section).alias("section"), label.cast("string").alias("name"),
            F.lit(n).cast("bigint").alias("n"), value.cast("double").alias("x"),
        )

    bucket = bucket_label(ratio_bucket(ratio(F.col("total_score"), F.col("max_score"))))
    averages = [("average", F.col("total_score")), ("max_score_average", F.col("max_score"))]
    of_result = [figure("scores", "total"), *[figure("scores", k, 0, x) for k, x in averages], figure("rating", F.col("rating"))]
    placed = F.array_compact(F.array(*of_result, F.when(bucket.isNotNull(), figure("distribution", bucket))))
    of_question = F.array(figure("questions", "total"), figure("questions", F.col("config_status")))
    always = [("questions", "total"), ("answers", "total"), ("scores", "total"), *[("scores", k) for k, _ in averages]]
    always += [("distribution", label) for label in fixed.BUCKET_LABELS]
    empty = results.sparkSession.createDataFrame([(*k, 0, None) for k in always], "section string, name string, n bigint, x double")
    every = (
        questions.select(F.inline(of_question))
        .unionByName(answers.select(F.inline(F.array(figure("answers", "total")))))
        .unionByName(results.select(F.inline(placed)))
        .unionByName(empty)
    )
    is_average = (F.col("section") == "scores") & F.col("name").isin([k for k, _ in averages])
    value = F.when(is_average, F.coalesce("_avg", F.lit(0.0))).otherwise(F.col("_n").cast("double"))
    sums = every.groupBy("section", "name").agg(F.sum("n").alias("_n"), F.avg("x").alias("_avg"))
    return sums.select("section", "name", value.alias("value"))


def question_summary(results: DataFrame, class_name: str | None = None) -> DataFrame:
    """Per question: count, average, highest, lowest score, pass rate in percent and rating counts."""
    chosen = results if class_name is None else results.where(F.col("class_name") == class_name)
    return chosen.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total_score").alias("avg_score"),
        F.max("total_score").alias("max_total"),
        F.min("total_score").alias("min_total"),
        (F.avg((F.col("rating") != "fail").cast("double")) * 100.0).alias("pass_rate"),
        *[F.count_if(F.col("rating") == r).alias(r) for r in fixed.RATINGS],
    )


def with_hit_rate(hits: DataFrame) -> DataFrame:
    return hits.withColumn("hit_rate", F.col("hit") / F.col("total"))


def assemble_ocr(lines: DataFrame, low: float = fixed.LOW_OCR_SCORE, band: float | None = None) -> DataFrame:
    """One text per question in read order: mean y of the box, then x of its first corner.

    Blank lines are dropped; ``band`` rounds y to rows of that height. Adds mean score, line count and a
    flag that is set when a line is below ``low`` or no line is left. The text of one page is one value, so
    its lines meet; only (y, x, text) travel.
    """
    box = F.col("box")
    mean_y = F.coalesce(
        F.try_divide(F.aggregate(box, F.lit(0.0), lambda acc, p: acc + p[1]), F.size(box)), F.lit(0.0)
    )
    y = F.floor(mean_y / F.lit(band)) if band else mean_y
    x = F.coalesce(F.get(F.get(box, F.lit(0)), F.lit(0)), F.lit(0.0))
    text = strip_space(F.col("text"))
    used = text != ""
    line = F.when(used, F.struct(y.alias("y"), x.alias("x"), text.alias("text")))
    grouped = lines.groupBy("question_id").agg(
        F.sort_array(F.collect_list(line)).alias("lines"),
        F.coalesce(F.avg(F.when(used, F.col("score"))), F.lit(0.0)).alias("confidence"),
        F.max(F.when(used, (F.col("score") < low).cast("int"))).alias("_low"),
    )
    return grouped.select(
        "question_id",
        F.array_join(F.transform("lines", lambda s: s["text"]), "\n").alias("answer_text"),
        "confidence",
        F.size("lines").alias("n_lines"),
        (F.coalesce("_low", F.lit(1)) == 1).alias("low_confidence"),
    )


def phase_timings(phases: DataFrame) -> DataFrame:
    """(phase, mean, min, max, n) of (phase, ms)."""
    ms = F.col("ms")
    return phases.groupBy("phase").agg(
        F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count(F.lit(1)).alias("n")
    )


def latency_summary(
    df: DataFrame,
    value: str = "latency",
    quantiles: Sequence[float] = (0.5, 0.95, 0.99),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """(q, value): rank-based quantiles, no interpolation; q = 1 is the maximum."""
    return order_statistics(df, value, [*quantiles, 1.0], cuts)


def throughput(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row: calls, wall seconds between first start and last end, calls per second."""

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    wall = (micros(F.max(end)) - micros(F.min(start))) / 1e6
    return df.agg(F.count(F.lit(1)).alias("calls"), wall.alias("wall")).withColumn(
        "per_second", F.try_divide("calls", "wall")
    )


def usage_totals(calls: DataFrame) -> DataFrame:
    """One row of model-call totals. ``calls``: ok, prompt_tokens, completion_tokens."""

    def tokens(c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).cast("bigint")

    return calls.agg(
        F.count_if("ok").alias("calls"),
        F.count_if(~F.col("ok")).alias("failures"),
        tokens("prompt_tokens").alias("prompt_tokens"),
        tokens("completion_tokens").alias("completion_tokens"),
    ).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
