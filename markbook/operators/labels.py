"""Point labels: normalising raw output, voting, quality filters, inspection and patches.

Labels are handled as one row per (sample, point); everything aggregates partially before a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.scores import clamp, half_even, pearson, safe_num
from markbook.functions.text import strip_space
from markbook.operators.align import align_spans
from markbook.operators.ranking import hash_rank


def label_points(labels: DataFrame) -> DataFrame:
    """Label records to one row per point, with its place in the record."""
    return labels.select(
        "sample_id",
        "origin",
        "expert_total",
        F.col("labels.question_id").alias("question_id"),
        F.col("labels.student_answer").alias("student_answer"),
        F.posexplode("labels.point_labels").alias("pos", "p"),
    ).select("sample_id", "origin", "expert_total", "question_id", "student_answer", "pos", "p.*")


def normalize_labels(raw: DataFrame, samples: DataFrame, points: DataFrame) -> DataFrame:
    """Raw model output to one clean label per (sample, rubric point).

    ``raw``: sample_id, pos, point_id, hit, hit_type, extracted_span, confidence, partial_credit,
    rationale (numbers may be text). ``samples``: sample_id, question_id and anything to carry.
    ``points``: question_id, point_id. Unknown ids, bad hit types and repeats are dropped; a point the
    model left out is a miss with confidence .5.
    """
    expected = samples.join(points.select("question_id", "point_id"), "question_id")
    usable = raw.withColumn("point_id", F.col("point_id").cast("string").try_cast("bigint")).where(
        F.col("point_id").isNotNull() & F.col("hit_type").isin(*fixed.HIT_TYPES)
    )
    span = strip_space(F.coalesce(F.col("extracted_span"), F.lit("")))
    said_hit = F.coalesce(F.col("hit").cast("boolean"), F.col("hit_type") != "miss")
    hit = (F.col("hit_type") != "miss") & said_hit & (span != "")
    hit_type = F.when(hit, F.col("hit_type")).otherwise("miss")
    credit = F.when(hit_type == "exact", F.lit(1.0)).when(
        hit_type == "semantic", clamp(F.coalesce(safe_num(F.col("partial_credit")), F.lit(1.0)), 0.5, 1.0)
    )
    cleaned = usable.select(
        "sample_id",
        "point_id",
        "pos",
        F.struct(
            hit.alias("hit"),
            hit_type.alias("hit_type"),
            F.when(hit, span).otherwise("").alias("extracted_span"),
            half_even(clamp(F.coalesce(safe_num(F.col("confidence")), F.lit(1.0)), 0.0, 1.0), 3).alias("confidence"),
            credit.alias("partial_credit"),
            F.nullif(
                F.substring(strip_space(F.coalesce(F.col("rationale"), F.lit(""))), 1, 80), F.lit("")
            ).alias("rationale"),
        ).alias("label"),
    )
    first = cleaned.groupBy("sample_id", "point_id").agg(F.min_by("label", "pos").alias("label"))
    missing = F.struct(
        F.lit(False).alias("hit"),
        F.lit("miss").alias("hit_type"),
        F.lit("").alias("extracted_span"),
        F.lit(0.5).alias("confidence"),
        F.lit(None).cast("double").alias("partial_credit"),
        F.lit(None).cast("string").alias("rationale"),
    )
    joined = expected.join(first, ["sample_id", "point_id"], "left")
    kept = [c for c in expected.columns if c not in ("sample_id", "point_id")]
    return joined.withColumn("label", F.coalesce("label", missing)).select("sample_id", "point_id", *kept, "label.*")


def count_votes(votes: DataFrame, *more: Column) -> DataFrame:
    """Votes per (sample, point, hit, hit_type) with the first round and the surest vote of each, and ``more`` aggregates.

    ``votes``: sample_id, point_id, round, hit, hit_type, extracted_span, confidence, partial_credit.
    """
    surest = F.max_by(
        F.struct("extracted_span", "partial_credit"), F.struct(F.col("confidence"), -F.col("round"))
    )
    return votes.groupBy("sample_id", "point_id", "hit", "hit_type").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min("round").alias("first_round"),
        F.sum("confidence").alias("confidence_sum"),
        surest.alias("surest"),
        *more,
    )


def majority_vote(votes: DataFrame, rounds: int | None = None) -> DataFrame:
    """One label per (sample, point) that the first round (0) judged.

    The most frequent (hit, hit_type) wins when it holds more than half of all rounds of the sample, else
    the first round's does. Adds ``agreement`` (share of the most frequent) and ``flipped``.
    """
    counted = count_votes(votes, F.collect_set("round").alias("rounds_seen"))
    group = F.struct("hit", "hit_type", "surest")
    per_point = counted.groupBy("sample_id", "point_id").agg(
        F.max_by(group, F.struct(F.col("votes"), -F.col("first_round"))).alias("top"),
        F.max("votes").alias("top_votes"),
        F.min_by(group, "first_round").alias("base"),
        F.min("first_round").alias("first_round"),
        (F.sum("confidence_sum") / F.sum("votes")).alias("mean_confidence"),
        F.array_distinct(F.flatten(F.collect_list("rounds_seen"))).alias("rounds_seen"),
    )
    if rounds is None:
        # a point has few rounds and a sample few points, so this needs no second look at the votes
        of_sample = F.flatten(F.collect_list("rounds_seen").over(W.partitionBy("sample_id")))
        per_point = per_point.withColumn("rounds", F.size(F.array_distinct(of_sample)).cast("bigint"))
    else:
        per_point = per_point.withColumn("rounds", F.lit(rounds).cast("bigint"))
    per_point = per_point.where(F.col("first_round") == 0)
    decided = F.col("top_votes") * 2 > F.col("rounds")
    chosen = per_point.withColumn("c", F.when(decided, F.col("top")).otherwise(F.col("base")))
    changed = (F.col("c.hit") != F.col("base.hit")) | (F.col("c.hit_type") != F.col("base.hit_type"))
    credit = F.when(F.col("c.hit_type") == "exact", F.lit(1.0)).when(
        F.col("c.hit_type") == "semantic", F.coalesce(F.col("c.surest.partial_credit"), F.lit(1.0))
    )
    return chosen.select(
        "sample_id",
        "point_id",
        F.col("c.hit").alias("hit"),
        F.col("c.hit_type").alias("hit_type"),
        F.col("c.surest.extracted_span").alias("extracted_span"),
        half_even(F.col("mean_confidence"), 3).alias("confidence"),
        credit.alias("partial_credit"),
        (F.col("top_votes") / F.col("rounds")).alias("agreement"),
        changed.alias("flipped"),
    )


def vote_report(voted: DataFrame) -> DataFrame:
    """One row: samples checked, points flipped, mean over samples of the mean point agreement."""
    per_sample = voted.groupBy("sample_id").agg(
        F.avg("agreement").alias("agreement"), F.count_if("flipped").alias("flips")
    )
    return per_sample.agg(
        F.count(F.lit(1)).alias("checked_samples"),
        F.coalesce(F.sum("flips"), F.lit(0)).alias("point_flips"),
        half_even(F.coalesce(F.avg("agreement"), F.lit(1.0)), 4).alias("mean_point_agreement"),
    )


def merge_voted(raw: DataFrame, voted: DataFrame, key: str = "sample_id") -> DataFrame:
    """Voted records plus the raw ones that were not voted on."""
    rest = raw.join(voted.select(key), key, "left_anti")
    return voted.unionByName(rest, allowMissingColumns=True)


def high_value(points: DataFrame, low_confidence: float = 0.75, n: int | None = 400) -> DataFrame:
    """Samples with a semantic hit or an unsure point, least sure first; (sample_id, min_confidence)."""
    per_sample = points.groupBy("sample_id").agg(
        F.min("confidence").alias("min_confidence"),
        F.max((F.col("hit_type") == "semantic").cast("int")).alias("_semantic"),
    )
    wanted = per_sample.where((F.col("_semantic") == 1) | (F.col("min_confidence") < low_confidence)).drop("_semantic")
    return wanted if n is None else wanted.orderBy("min_confidence", "sample_id").limit(n)


def point_filter(
    points: DataFrame,
    span_length: Column,
    answer_length: Column,
    aligned: Column,
    min_confidence: float = 0.55,
    max_span_ratio: float = 0.5,
) -> DataFrame:
    """Add ``reason``: null for points that pass, else the first filter they fail."""
    reason = (
        F.when(F.col("confidence") < min_confidence, "low_confidence")
        .when(~F.col("hit"), F.lit(None).cast("string"))
        .when(F.coalesce(span_length, F.lit(0)) == 0, "empty_span")
        .when(span_length > max_span_ratio * F.greatest(answer_length, F.lit(1)), "overlong_span")
        .when(~aligned, "align_fail")
    )
    return points.withColumn("reason", reason)


def drop_bad_samples(
    filtered: DataFrame, max_invalid: float = 0.34, key: str = "sample_id"
) -> tuple[DataFrame, DataFrame]:
    """(kept points of kept samples, dropped samples with their reason)."""
    status = filtered.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_points"), F.count_if(F.col("reason").isNotNull()).alias("invalid_points")
    )
    verdict = status.withColumn(
        "dropped",
        F.when(F.col("invalid_points") / F.col("total_points") > max_invalid, "sample_dropped_invalid_ratio").when(
            F.col("invalid_points") == F.col("total_points"), "sample_dropped_empty"
        ),
    )
    dropped = verdict.where(F.col("dropped").isNotNull())
    kept = filtered.where(F.col("reason").isNull()).join(dropped.select(key), key, "left_anti").drop("reason")
    return kept, dropped


def quality_report(filtered: DataFrame, strategy: str | None = None, max_invalid: float = 0.34) -> DataFrame:
    """One row of point and sample counts after ``point_filter``.

    Hit-type counts are taken before samples are dropped; ``kept_*`` ones after.
    """
    ok = F.col("reason").isNull()
    per_sample = filtered.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ok).alias("bad"),
        *[F.count_if(F.col("reason") == r).alias(r) for r in ("low_confidence", "empty_span", "overlong_span", "align_fail")],
        F.count_if(F.col("hit") & ((F.col("reason") != "low_confidence") | ok)).alias("hit_points"),
        F.count_if(F.col("hit") & ok).alias("aligned"),
        F.count_if(~F.col("hit") & ok).alias("miss_points"),
        *[F.count_if(ok & (F.col("hit_type") == t)).alias(t) for t in ("exact", "semantic")],
        *[
            F.count_if(ok & F.col("hit") & (F.col(strategy) == s)).alias(f"strategy_{s}")
            for s in (("exact", "fuzzy", "lcs") if strategy else ())
        ],
    )
    over = F.col("bad") / F.col("n") > max_invalid
    empty = ~over & (F.col("bad") == F.col("n"))
    kept = ~over & ~empty

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    def rate(top: Column, bottom: Column) -> Column:
        return half_even(top / F.greatest(bottom, F.lit(1)), 4)

    sums = per_sample.agg(
        F.count(F.lit(1)).alias("input_records"),
        F.count_if(kept).alias("kept_samples"),
        F.count_if(over).alias("sample_dropped_invalid_ratio"),
        F.count_if(empty).alias("sample_dropped_empty"),
        F.count_if(kept & (F.col("aligned") > 0)).alias("samples_with_hits"),
        *[total(c).alias(c) for c in per_sample.columns if c not in ("sample_id", "n", "bad")],
        F.coalesce(F.sum(F.when(kept, F.col("exact"))), F.lit(0)).cast("bigint").alias("kept_exact"),
        F.coalesce(F.sum(F.when(kept, F.col("semantic"))), F.lit(0)).cast("bigint").alias("kept_semantic"),
    )
    # every hit point that is left has been aligned, so a kept sample with hits is fully aligned
    return sums.withColumns(
        {
            "point_success_rate": rate(F.col("aligned"), F.col("hit_points")),
            "samples_fully_aligned": F.col("samples_with_hits"),
            "sample_success_rate": rate(F.col("samples_with_hits"), F.col("samples_with_hits")),
            "semantic_share": rate(F.col("semantic"), F.col("exact") + F.col("semantic")),
        }
    )


def filter_counts(filtered: DataFrame) -> DataFrame:
    """(reason, points): how many points each filter set aside."""
    return filtered.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("points"))


def inspection_sample(
    points: DataFrame, ratio: float = 0.05, seed: int = 42, carry: Sequence[str] = ("origin",)
) -> DataFrame:
    """Samples for human checking: max(1, round(n * ratio)) of each origin x composition stratum."""
    per_sample = points.groupBy("sample_id", *carry).agg(
        F.max((F.col("hit_type") == "semantic").cast("int")).alias("_semantic"),
        F.max(F.col("hit").cast("int")).alias("_hit"),
    )
    stratum = F.when(F.col("_semantic") == 1, "semantic").when(F.col("_hit") == 1, "hit").otherwise("all_miss")
    placed = per_sample.withColumn("stratum", stratum).drop("_semantic", "_hit")
    ranked = hash_rank(placed, ["sample_id"], seed, [*carry, "stratum"])
    quota = F.greatest(F.lit(1), half_even(F.col("total") * F.lit(ratio), 0).cast("bigint"))
    return ranked.where(F.col("rank") <= quota).drop("rank", "total")


def label_inventory(stages: dict[str, DataFrame]) -> DataFrame:
    """Per stage: points, hits, exact, semantic, semantic share of hits."""
    parts = [df.select("hit", "hit_type").withColumn("stage", F.lit(name)) for name, df in stages.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    counted = union.groupBy("stage").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("hit").alias("hits"),
        F.count_if(F.col("hit_type") == "exact").alias("exact"),
        F.count_if(F.col("hit_type") == "semantic").alias("semantic"),
    )
    return counted.withColumn("semantic_share", F.try_divide("semantic", "hits"))


def predicted_totals(points: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, predicted): weights of hit points times their credit (no credit given counts as full)."""
    credit = F.coalesce(F.nullif(F.col("partial_credit"), F.lit(0.0)), F.lit(1.0))
    gained = F.when(F.col("hit"), F.coalesce(F.col("weight"), F.lit(0.0)) * credit).otherwise(F.lit(0.0))
    return (
        points.join(weights.select("question_id", "point_id", "weight"), ["question_id", "point_id"], "left")
        .groupBy("sample_id")
        .agg(F.sum(gained).alias("predicted"))
    )


def expert_agreement(predicted: DataFrame, expert: DataFrame, min_pairs: int = 5) -> DataFrame:
    """One row comparing (sample_id, predicted) with (sample_id, expert_total): n, pearson, mae, within_20pct."""
    pairs = predicted.join(expert.where(F.col("expert_total").isNotNull()), "sample_id")
    off = F.abs(F.col("predicted") - F.col("expert_total"))
    near = F.avg((off <= 0.2 * F.greatest(F.col("expert_total"), F.lit(1.0))).cast("double"))
    stats = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        half_even(pearson(F.col("predicted"), F.col("expert_total")), 4).alias("pearson"),
        half_even(F.avg(off), 3).alias("mae"),
        half_even(near, 4).alias("within_20pct"),
    )
    few = F.col("n") < min_pairs
    return stats.select(
        "n",
        *[F.when(~few, F.col(c)).alias(c) for c in ("pearson", "mae", "within_20pct")],
        F.when(few, "insufficient pairs").alias("note"),
    )


def unify_conflicts(
    points: DataFrame,
    questions: Sequence[str] | None = None,
    group: Sequence[str] = ("question_id", "student_answer", "point_text"),
    order: Sequence[str] = ("sample_id",),
    values: Sequence[str] = ("hit_type", "extracted_span", "confidence", "partial_credit", "align"),
) -> DataFrame:
    """Copy the first positive (hit and aligned) of each group to its other members; adds ``unified``.

    ``questions`` limits it to the listed ones. The first positive is found by an aggregate, so a group
    of any size is spread over tasks; long texts are compared by their SHA-256.
    """
    positive = F.col("hit") & F.col("align").isNotNull()
    wanted = F.lit(True) if questions is None else F.col("question_id").isin(list(questions))
    keyed = points.withColumn("_g", F.sha2(F.to_json(F.struct(*group)), 256))
    first = (
        keyed.where(positive & wanted)
        .groupBy("_g")
        .agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_first"))
    )
    joined = keyed.join(first, "_g", "left").withColumn(
        "unified", F.coalesce(~positive & wanted & F.col("_first").isNotNull(), F.lit(False))
    )
    copied = {v: F.when(F.col("unified"), F.col(f"_first.{v}")).otherwise(F.col(v)) for v in values}
    return (
        joined.withColumns({**copied, "hit": F.col("hit") | F.col("unified")}).drop("_g", "_first")
    )


def patch_labels(points: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn labels into hits by human decision.

    ``patches``: patch_no, question_id, point_text, locate, span. A patch applies to the point of every
    answer that contains ``locate``, unless it is already hit and aligned; the span is aligned anew. The
    first patch that aligns wins. Returns (points with ``patched``, change log, patches located nowhere).
    """
    located = points.join(patches, ["question_id", "point_text"]).where(
        F.instr("student_answer", F.col("locate")) > 0
    )
    open_points = located.where(~(F.col("hit") & F.col("align").isNotNull()))
    tried = align_spans(
        open_points.select("sample_id", "point_id", "patch_no", "span", "student_answer"),
        "student_answer",
        "span",
        "new_align",
    ).where(F.col("new_align").isNotNull())
    decided = tried.groupBy("sample_id", "point_id").agg(
        F.min_by(F.struct("patch_no", "span", "new_align"), "patch_no").alias("_p")
    )
    joined = points.join(decided, ["sample_id", "point_id"], "left").withColumn("patched", F.col("_p").isNotNull())

    def replaced(column: str, value: Column) -> Column:
        return F.when(F.col("patched"), value).otherwise(F.col(column))

    updated = joined.withColumns(
        {
            "hit": F.col("hit") | F.col("patched"),
            "hit_type": replaced("hit_type", F.lit("semantic")),
            "extracted_span": replaced("extracted_span", F.col("_p.span")),
            "confidence": replaced("confidence", F.lit(1.0)),
            "partial_credit": replaced("partial_credit", F.lit(1.0)),
            "align": replaced("align", F.col("_p.new_align")),
        }
    ).drop("_p")
    log = joined.where("patched").select(
        F.lit("arbitration").alias("kind"),
        "sample_id",
        "question_id",
        "point_id",
        "point_text",
        F.lit("->hit").alias("action"),
        F.lit(False).alias("old_hit"),
        F.lit(True).alias("new_hit"),
        F.col("_p.span").alias("span"),
        F.col("_p.new_align.strategy").alias("align"),
    )
    unmatched = patches.join(
        points.select("question_id", "student_answer").join(patches, "question_id").where(
            F.instr("student_answer", F.col("locate")) > 0
        ).select("patch_no"),
        "patch_no",
        "left_anti",
    )
    return updated, log, unmatched

