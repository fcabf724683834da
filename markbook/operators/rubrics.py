"""Rubrics (scoring configs): normalisation, weights, thresholds and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.scores import half_even, safe_num
from markbook.functions.text import let, strip_space
from markbook.schemas import POINT
from markbook.settings import ScoringSettings


def rubric_rows(points: DataFrame, key: str = "question_id") -> DataFrame:
    """One row per question: points in order and the total of their weights. Rubrics are short lists."""
    point = F.struct(
        F.col("point_id").cast("bigint").alias("point_id"),
        F.col("point_text").alias("point_text"),
        F.col("weight").cast("double").alias("weight"),
        F.col("aliases").alias("aliases"),
    ).cast(POINT)
    return points.groupBy(key).agg(
        F.sum(F.col("weight").cast("double")).alias("total_score"),
        F.sort_array(F.collect_list(point)).alias("points"),
    )


def point_rows(configs: DataFrame) -> DataFrame:
    """One row per (question, point)."""
    return configs.select("question_id", F.inline("points"))


def _rescaled(points: Column, total: Column) -> Column:
    """Scale weights to the total; what rounding leaves over goes to the last point."""

    def weight_sum(ps: Column) -> Column:
        return F.aggregate(ps, F.lit(0.0), lambda acc, p: acc + p["weight"])

    def scale(s: Column) -> Column:
        scaled = F.transform(points, lambda p: p.withField("weight", half_even(p["weight"] * total / s, 2)))

        def settle(ps: Column) -> Column:
            drift = half_even(total - weight_sum(ps), 2)
            last = F.size(ps) - 1
            fixed_last = F.transform(
                ps,
                lambda p, i: F.when(i == last, p.withField("weight", half_even(p["weight"] + drift, 2))).otherwise(p),
            )
            return F.when(F.abs(drift) >= 0.01, fixed_last).otherwise(ps)

        return F.when((s <= 0) | (F.abs(s - total) < 0.011), points).otherwise(let(scaled, settle))

    return let(weight_sum(points), scale)


def normalize_rubric(raw: DataFrame, totals: str = "total_score") -> DataFrame:
    """Clean parsed rubrics: blank points dropped, aliases trimmed and distinct, weight at least .5,
    ids 1..n in order, weights rescaled to the total. Questions left without points are dropped.

    ``points`` of the input is an array of struct(point_id, point_text, weight, aliases), weight as text.
    """
    ordered = F.array_sort(
        F.transform(
            "points",
            lambda p, i: F.struct(
                F.coalesce(p["point_id"].cast("bigint"), F.lit(0)).alias("point_id"), i.alias("i"), p.alias("p")
            ),
        )
    )
    cleaned = F.transform(
        ordered,
        lambda o: F.struct(
            strip_space(F.coalesce(o["p"]["point_text"], F.lit(""))).alias("text"),
            F.greatest(F.coalesce(safe_num(o["p"]["weight"]), F.lit(1.0)), F.lit(0.5)).alias("weight"),
            F.array_distinct(
                F.filter(
                    F.transform(F.coalesce(o["p"]["aliases"], F.array().cast("array<string>")), strip_space),
                    lambda a: a != "",
                )
            ).alias("aliases"),
        ),
    )
    numbered = F.transform(
        F.filter(cleaned, lambda p: p["text"] != ""),
        lambda p, i: F.struct(
            (i + 1).cast("bigint").alias("point_id"),
            p["text"].alias("point_text"),
            p["weight"].alias("weight"),
            p["aliases"].alias("aliases"),
        ).cast(POINT),
    )
    return (
        raw.withColumn("points", numbered)
        .where(F.size("points") > 0)
        .withColumn("points", _rescaled(F.col("points"), F.col(totals).cast("double")))
    )


def rescale_weights(points: DataFrame, totals: DataFrame, key: str = "question_id") -> DataFrame:
    """Table form of the rescale: (key, point_id, weight) with (key, total_score).

    Sums are pre-aggregated, so a question with very many points does not meet in one task.
    """
    sums = points.groupBy(key).agg(F.sum("weight").alias("_s"), F.max("point_id").alias("_last"))
    total = F.col("total_score").cast("double")
    off = (F.col("_s") > 0) & (F.abs(F.col("_s") - total) >= 0.011)
    # no factor where the weights already fit
    base = sums.join(totals, key).select(
        key, "_last", total.alias("_t"), F.when(off, total / F.col("_s")).alias("_factor")
    )
    scaled = points.join(base, key).withColumn(
        "_w", F.when(F.col("_factor").isNull(), F.col("weight")).otherwise(half_even(F.col("weight") * F.col("_factor"), 2))
    )
    sums_after = scaled.groupBy(key, "_last", "_t", "_factor").agg(F.sum("_w").alias("_sum"))
    drift = sums_after.select(
        F.col(key).alias("_k"),
        F.col("_last").alias("_p"),
        F.when(F.col("_factor").isNotNull(), half_even(F.col("_t") - F.col("_sum"), 2)).alias("_drift"),
    ).where(F.abs("_drift") >= 0.01)
    at_last = (F.col(key) == F.col("_k")) & (F.col("point_id") == F.col("_p"))
    settled = F.coalesce(half_even(F.col("_w") + F.col("_drift"), 2), F.col("_w"))
    return (
        scaled.join(drift, at_last, "left")
        .withColumn("weight", settled)
        .drop("_last", "_t", "_factor", "_w", "_k", "_p", "_drift")
    )


def effective_thresholds(configs: DataFrame, settings: ScoringSettings) -> DataFrame:
    """Add similarity_high / similarity_low: the question's own thresholds, else the settings.

    A field missing inside a present struct takes the fixed default, not the setting.
    """
    own, default = F.col("thresholds"), ScoringSettings()
    return configs.withColumns(
        {
            name: F.when(own.isNull(), F.lit(getattr(settings, name))).otherwise(
                F.coalesce(own[name], F.lit(getattr(default, name)))
            )
            for name in ("similarity_high", "similarity_low")
        }
    )


def confirmed_only(configs: DataFrame, required: bool = True) -> DataFrame:
    """Keep only rubrics a teacher confirmed, when that is required."""
    return configs.where(F.coalesce(F.col("meta.confirmed_by_teacher"), F.lit(False))) if required else configs


Rule = tuple[str, Column]


def config_rules() -> list[Rule]:
    """(name, condition that breaks the contract) for scoring configs."""
    points = F.col("points")

    def any_point(test) -> Column:
        return F.exists(points, lambda p: F.coalesce(test(p), F.lit(True)))

    def bad_threshold(name: str) -> Column:
        t = F.col("thresholds")[name]
        return t.isNotNull() & ~t.between(0, 1)

    return [
        ("question_id", F.coalesce(F.col("question_id") == "", F.lit(True))),
        ("total_score", F.coalesce(F.col("total_score") <= 0, F.lit(True))),
        ("points", F.coalesce(F.size(points) < 1, F.lit(True))),
        ("point_id", any_point(lambda p: p["point_id"] < 1)),
        ("point_id_repeated", F.coalesce(F.size(F.array_distinct(points["point_id"])) < F.size(points), F.lit(False))),
        ("point_text", any_point(lambda p: p["point_text"] == "")),
        ("weight", any_point(lambda p: p["weight"] <= 0)),
        ("alias_empty", F.exists(points, lambda p: F.coalesce(F.array_contains(p["aliases"], ""), F.lit(False)))),
        (
            "alias_repeated",
            F.exists(
                points,
                lambda p: F.coalesce(F.size(F.array_distinct(p["aliases"])) < F.size(p["aliases"]), F.lit(False)),
            ),
        ),
        ("similarity_high", bad_threshold("similarity_high")),
        ("similarity_low", bad_threshold("similarity_low")),
    ]


def label_rules() -> list[Rule]:
    """(name, condition that breaks the contract) for label records."""
    labels = F.col("labels")
    points = labels["point_labels"]

    def any_point(test) -> Column:
        return F.exists(points, lambda p: F.coalesce(test(p), F.lit(True)))

    def out_of_unit(p: Column) -> Column:
        return p.isNotNull() & ~p.between(0, 1)

    return [
        ("question_id", labels["question_id"].isNull()),
        ("student_answer", labels["student_answer"].isNull()),
        ("point_labels", F.coalesce(F.size(points) < 1, F.lit(True))),
        ("point_id", any_point(lambda p: p["point_id"] < 1)),
        ("hit", any_point(lambda p: p["hit"].isNull())),
        ("hit_type", any_point(lambda p: ~p["hit_type"].isin("exact", "semantic", "miss"))),
        ("confidence", any_point(lambda p: out_of_unit(p["confidence"]))),
        ("partial_credit", any_point(lambda p: out_of_unit(p["partial_credit"]))),
    ]


def violations(rules: list[Rule]) -> Column:
    """Names of the broken rules, in rule order."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def validate(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, set-aside rows with a ``violations`` array)."""
    checked = df.withColumn("violations", violations(rules))
    return checked.where(F.size("violations") == 0).drop("violations"), checked.where(F.size("violations") > 0)
