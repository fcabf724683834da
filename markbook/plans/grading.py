"""Whole jobs composed of operators: grading, the label job chain, the dataset build."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.operators import builders, labels
from markbook.operators.align import align_spans
from markbook.operators.overlap import strip_stems
from markbook.operators.rubrics import confirmed_only, point_rows
from markbook.operators.scoring import Matcher, score_answers
from markbook.operators.tables import scoring_input
from markbook.settings import ScoringSettings


def grade(
    answers: DataFrame,
    configs: DataFrame,
    questions: DataFrame,
    matcher: Matcher | None = None,
    settings: ScoringSettings | None = None,
    ocr: DataFrame | None = None,
    min_match: int = fixed.MIN_STEM_MATCH,
    only_confirmed: bool = False,
    keep_digits: bool = False,
) -> DataFrame:
    """Score answers end to end: effective text, stem passages blanked, points, total, rating.

    Returns the results table (answer_id, question_id, student_id, class_name, scores, point_details,
    ocr_confidence).
    """
    ready = scoring_input(answers, questions, ocr)
    stems = questions.where(F.coalesce("content", F.lit("")) != "").select(
        "question_id", F.col("question_id").alias("stem_id"), F.col("content").alias("stem_text")
    )
    stripped = strip_stems(
        ready.drop("stem_text"), stems, min_match, "answer_id", "stem_id", "text", "stem_text", ["question_id"],
        keep_digits=keep_digits,
    )
    scored = score_answers(stripped, confirmed_only(configs, only_confirmed), matcher, settings, "stripped_text")
    return scored.select(
        "answer_id",
        "question_id",
        "student_id",
        "class_name",
        "total_score",
        "max_score",
        "rating",
        "point_details",
        "ocr_confidence",
    )


def clean_labels(
    points: DataFrame,
    min_confidence: float = 0.55,
    max_span_ratio: float = 0.5,
    max_invalid: float = 0.34,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept points with ``align``, one-row report, filter counts) from label points.

    ``points``: sample_id, origin, question_id, student_answer, point_id, hit, hit_type, extracted_span,
    confidence, partial_credit.
    """
    aligned = align_spans(points, "student_answer", "extracted_span").withColumn("strategy", F.col("align.strategy"))
    filtered = labels.point_filter(
        aligned,
        F.length("extracted_span"),
        F.length("student_answer"),
        F.col("align").isNotNull(),
        min_confidence,
        max_span_ratio,
    )
    kept, _ = labels.drop_bad_samples(filtered, max_invalid)
    return (
        kept.drop("strategy"),
        labels.quality_report(filtered, "strategy", max_invalid),
        labels.filter_counts(filtered),
    )


def build_dataset(
    points: DataFrame,
    configs: DataFrame,
    external: Sequence[DataFrame] = (),
    ratios: Mapping[str, float] = builders.SPLIT_RATIOS,
    seed: int = 42,
    negative_ratio: float = 0.22,
    settle: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> dict[str, DataFrame]:
    """Splits, span tuples, sentence pairs and their statistics from kept label points.

    The tuples are read several times; on large data give a ``settle`` that writes them down once, such as
    ``session.settled``.
    """
    rubric = point_rows(configs)
    split = builders.question_split(points, ratios, seed)
    tuples = settle(builders.span_tuples(points, rubric, split))
    spans = builders.downsample_negatives(tuples, negative_ratio, seed)
    pairs = builders.label_pairs(points, rubric, split)
    for part in external:
        pairs = builders.union_pairs(pairs, part)
    return {
        "split": split,
        "spans": spans,
        "pairs": pairs,
        "span_stats": builders.dataset_stats(spans, ["split", "origin", "hit_type"]),
        "pair_stats": builders.pair_balance(pairs, ["split", "source"]),
    }
