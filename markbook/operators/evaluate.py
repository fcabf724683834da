"""Evaluation: span metrics, thresholds, correlation, AUC, confusion, disagreement, parity."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.scores import half_even, pearson
from markbook.functions.text import char_f1, exact_match
from markbook.operators.ranking import hash_rank, running_totals


def decode_spans(
    logits: DataFrame,
    carry: Sequence[str],
    start: str = "start_logits",
    end: str = "end_logits",
    low: str = "ctx_low",
    high: str = "ctx_high",
    max_tokens: int = fixed.MAX_SPAN_TOKENS,
    null_index: int = 0,
) -> DataFrame:
    """Best span per row of start/end logits: span_start, span_end, span and null log-probability, probability.

    Arrow batches; a row without context tokens (low < 0) gets (0, 0) and probability 0.
    """
    types = dict(logits.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + (
        ", span_start int, span_end int, span_logprob double, null_logprob double, has_answer_prob double"
    )

    def best_span(s: np.ndarray, e: np.ndarray, lo: int, hi: int) -> tuple[int, int]:
        # row i of the windows holds the ends a span from i may reach; the first maximum wins
        padded = np.concatenate([e[lo : hi + 1], np.full(max_tokens - 1, -np.inf)])
        reach = np.lib.stride_tricks.sliding_window_view(padded, max_tokens)
        i, width = divmod(int(np.argmax(s[lo : hi + 1, None] + reach)), max_tokens)
        return lo + i, lo + i + width

    def log_normaliser(x: np.ndarray) -> float:
        return float(x.max() + np.log(np.exp(x - x.max()).sum()))

    def decode(batches):
        for batch in batches:
            rows = []
            for s, e, lo, hi in zip(batch[start], batch[end], batch[low], batch[high]):
                if lo < 0:
                    rows.append((0, 0, -1e9, -1e9, 0.0))
                    continue
                s, e = np.asarray(s, np.float64), np.asarray(e, np.float64)
                norm = log_normaliser(s) + log_normaliser(e)
                i, j = best_span(s, e, int(lo), int(hi))
                span, null = s[i] + e[j] - norm, s[null_index] + e[null_index] - norm
                rows.append((i, j, span, null, round(1.0 / (1.0 + np.exp(null - span)), 6)))
            found = pd.DataFrame(
                rows, columns=["span_start", "span_end", "span_logprob", "null_logprob", "has_answer_prob"]
            )
            yield pd.concat([batch[list(carry)].reset_index(drop=True), found], axis=1)

    return logits.select(*carry, start, end, low, high).mapInPandas(decode, schema)


def span_text(pred: DataFrame, context: str = "context", offsets: str = "offsets", out: str = "pred_text") -> DataFrame:
    """Predicted text from token positions and an array of struct(start, end half-open) character offsets."""
    at = F.get(F.col(offsets), F.col("span_start"))["start"]
    after = F.get(F.col(offsets), F.col("span_end"))["end"]
    none = (F.col("span_start") == 0) & (F.col("span_end") == 0)
    return pred.withColumn(out, F.when(none, "").otherwise(F.substring(F.col(context), at + 1, after - at)))


def span_metrics(pred: DataFrame, threshold: float) -> DataFrame:
    """One row: exact match and F1 over positives (all, exact, semantic), point accuracy, semantic hit rate.

    ``pred``: pred_text, score_diff, answer, is_impossible, hit_type. A prediction whose text is empty is a
    miss whatever its score.
    """
    text = F.when(F.col("score_diff") > threshold, F.col("pred_text")).otherwise("")
    judged = pred.select(
        text.alias("_p"),
        F.when(F.col("is_impossible"), "").otherwise(F.col("answer")).alias("_g"),
        (~F.col("is_impossible")).alias("pos"),
        "hit_type",
    ).select(
        "pos",
        "hit_type",
        (F.col("_p") != "").alias("hit"),
        exact_match(F.col("_p"), F.col("_g")).alias("em"),
        char_f1(F.col("_p"), F.col("_g")).alias("f1"),
    )
    exact = F.col("pos") & (F.col("hit_type") == "exact")
    semantic = F.col("pos") & (F.col("hit_type") == "semantic")

    def mean(cond: Column, value: Column) -> Column:
        return half_even(F.avg(F.when(cond, value.cast("double"))), 4)

    return judged.agg(
        mean(F.col("pos"), F.col("em")).alias("em"),
        mean(F.col("pos"), F.col("f1")).alias("token_f1"),
        mean(F.lit(True), F.col("pos") == F.col("hit")).alias("point_accuracy"),
        mean(semantic, F.col("hit")).alias("equivalence_hit_rate"),
        mean(exact, F.col("em")).alias("em_exact"),
        mean(exact, F.col("f1")).alias("f1_exact"),
        mean(semantic, F.col("em")).alias("em_semantic"),
        mean(semantic, F.col("f1")).alias("f1_semantic"),
        F.count_if(exact).alias("n_exact"),
        F.count_if(semantic).alias("n_semantic"),
        F.count_if("pos").alias("positives"),
        F.count(F.lit(1)).alias("eval_n"),
    )


def tune_threshold(
    pred: DataFrame, diff: str = "score_diff", gold: str = "gold", cuts: Sequence[float] | None = None
) -> DataFrame:
    """One row (threshold, accuracy): the observed diff that maximises accuracy of diff > threshold.

    The smallest one wins a tie. Exact over all distinct diffs, by running totals.
    """
    counted = pred.groupBy(diff).agg(F.count_if(F.col(gold)).alias("p"), F.count_if(~F.col(gold)).alias("n"))
    runs = running_totals(counted, diff, ["p", "n"], cuts=cuts)
    right = F.col("n_upto") + F.col("p_all") - F.col("p_upto")
    return runs.select(F.col(diff).alias("t"), (right / (F.col("p_all") + F.col("n_all"))).alias("a")).agg(
        F.min_by("t", F.struct(-F.col("a"), F.col("t"))).alias("threshold"), F.max("a").alias("accuracy")
    )


def auc(
    df: DataFrame, score: str, gold: str, cut: float, cuts: Sequence[float] | None = None
) -> DataFrame:
    """One row: AUC with half ties from running totals, means, recall and false-positive rate at ``cut``."""
    known = df.where(F.col(score).isNotNull() & F.col(gold).isNotNull())
    counted = known.groupBy(score).agg(F.count_if(F.col(gold)).alias("p"), F.count_if(~F.col(gold)).alias("n"))
    runs = running_totals(counted, score, ["p", "n"], cuts=cuts)
    # twice the wins: a positive beats all lower negatives and half of the equal ones
    wins = F.col("p") * (2 * (F.col("n_upto") - F.col("n")) + F.col("n"))
    s = F.col(score).cast("double")
    above = F.col(score) >= cut
    return runs.agg(
        F.sum("p").alias("n_pos"),
        F.sum("n").alias("n_neg"),
        half_even(F.try_divide(F.sum(wins), 2.0 * F.sum("p") * F.sum("n")), 4).alias("auc"),
        half_even(F.sum(s * F.col("p")) / F.greatest(F.sum("p"), F.lit(1)), 4).alias("mean_pos"),
        half_even(F.sum(s * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)), 4).alias("mean_neg"),
        half_even(F.sum(F.when(above, F.col("p")).otherwise(0)) / F.greatest(F.sum("p"), F.lit(1)), 4).alias("recall"),
        half_even(F.sum(F.when(above, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1)), 4).alias("fpr"),
    )


def pearson_of(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation (0 for fewer than two rows or no variance) and row count, per group if asked."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(x), F.col(y)).alias("pearson"))


def in_split(df: DataFrame, spans: DataFrame, split: str = "test", key: str = "question_id") -> DataFrame:
    """Rows of questions that occur in the given split."""
    return df.join(spans.where(F.col("split") == split).select(key), key, "left_semi")


def score_correlation(points: DataFrame, threshold: float) -> DataFrame:
    """One row: correlation of predicted totals with expert totals and with label totals.

    ``points``: sample_id, weight, score_diff, hit (label), expert_total; one row per (sample, point).
    """
    zero = F.lit(0.0)
    totals = points.groupBy("sample_id").agg(
        F.sum(F.when(F.col("score_diff") > threshold, F.col("weight")).otherwise(zero)).alias("predicted"),
        F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(zero)).alias("labelled"),
        F.max("expert_total").alias("expert"),
    )
    return totals.agg(
        F.count("expert").alias("n_samples"),
        half_even(pearson(F.col("predicted"), F.col("expert")), 4).alias("pearson_vs_expert"),
        half_even(pearson(F.col("predicted"), F.col("labelled")), 4).alias("pearson_vs_label"),
    )


def assemble_gold(spans: DataFrame, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """(gold points per answer, totals per answer) from full-answer span tuples.

    One row per (question, context, query), the first one by ``order``. Points with contradictory gold are
    dropped and counted; the others are renumbered 1..n in order. Contexts are keyed by SHA-256.
    """
    full = spans.where(F.col("origin") == "full").withColumn("context_key", F.sha2("context", 256))
    answer = ["question_id", "context_key"]
    per_point = full.groupBy(*answer, "query").agg(
        F.min_by(F.struct("is_impossible", "point_weight", "query_aliases"), order).alias("f"),
        F.min(order).alias("first"),
        (F.min(F.col("is_impossible").cast("int")) != F.max(F.col("is_impossible").cast("int"))).alias("conflict"),
    )
    # one entry per rubric point of one answer
    entry = F.struct(
        F.col("first"),
        "query",
        F.col("f.point_weight").alias("weight"),
        F.col("f.is_impossible").alias("is_impossible"),
        F.col("f.query_aliases").alias("aliases"),
    )
    grouped = per_point.groupBy(*answer).agg(
        F.count_if("conflict").alias("conflicts"),
        F.sort_array(F.collect_list(F.when(~F.col("conflict"), entry))).alias("kept"),
    )
    grouped = grouped.where(F.size("kept") > 0)
    points = grouped.select(*answer, F.posexplode("kept").alias("pos", "k")).select(
        *answer,
        (F.col("pos") + 1).cast("bigint").alias("point_id"),
        F.col("k.query").alias("query"),
        F.col("k.aliases").alias("aliases"),
        F.col("k.weight").alias("weight"),
        F.col("k.is_impossible").alias("is_impossible"),
    )

    def total(only_hits: bool) -> Column:
        return F.aggregate(
            "kept",
            F.lit(0.0),
            lambda acc, k: acc + F.when(k["is_impossible"] & F.lit(only_hits), 0.0).otherwise(k["weight"]),
        )

    totals = grouped.select(
        *answer,
        F.size("kept").alias("points"),
        "conflicts",
        total(True).alias("expert_total"),
        half_even(total(False), 4).alias("max_total"),
    )
    return points, totals


def align_gold(pred: DataFrame, gold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predicted points next to gold points of the same answer and place; ``point_id`` is the place."""
    g = gold.select(*keys, "point_id", "query", F.col("weight").alias("gold_weight"), "is_impossible")
    return pred.join(g, [*keys, "point_id"])


def confusion(aligned: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, point accuracy and credit rate. Needs hit_status, point_score, is_impossible."""
    hit, gold = F.col("hit_status") != "miss", ~F.col("is_impossible")
    counts = aligned.agg(
        F.count_if(hit & gold).alias("tp"),
        F.count_if(hit & ~gold).alias("fp"),
        F.count_if(~hit & gold).alias("fn"),
        F.count_if(~hit & ~gold).alias("tn"),
        F.count_if(gold & (F.col("point_score") > 0)).alias("credited"),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns(
        {
            "point_accuracy": (F.col("tp") + F.col("tn")) / F.greatest(n, F.lit(1)),
            "credit_rate": F.col("credited") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)),
        }
    )


def score_error(totals: DataFrame, pred: str = "total_score", gold: str = "expert_total") -> DataFrame:
    """One row: answers, mean absolute error and correlation of totals."""
    return totals.agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.avg(F.abs(F.col(pred) - F.col(gold))).alias("mae"),
        pearson(F.col(pred), F.col(gold)).alias("pearson"),
    )


def zero_band(totals: DataFrame, pred: str = "total_score", gold: str = "expert_total") -> DataFrame:
    """Answers worth nothing by gold that were given a score."""
    return totals.where((F.col(gold) == 0) & (F.col(pred) > 0))


def top_n(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows with the highest ``by``."""
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def disagreements(aligned: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Points hit by the system and not by gold, with the confidence the sheet is sorted by."""
    sure = F.coalesce("confidence", "similarity", F.lit(0.0))
    return aligned.where((F.col("hit_status") != "miss") & F.col("is_impossible")).select(
        *carry,
        F.col("query").alias("point_text"),
        "source",
        "hit_status",
        half_even(sure, 4).alias("conf"),
        F.col("point_score").alias("weight"),
        F.substring(F.coalesce("extracted_span", F.lit("")), 1, 40).alias("span"),
    )


def systematic_sample(
    df: DataFrame, by: str, n: int, keys: Sequence[str], seed: int = 42, cuts: Sequence[float] | None = None
) -> DataFrame:
    """``n`` rows evenly spread over the order of ``by``: places floor(i * total / n); rows of one value in seeded order of ``keys``.

    Counts per value, added up, tell in which values the places lie: at most ``n``. Only rows of these values are ranked.
    """
    counted = df.groupBy(by).agg(F.count(F.lit(1)).alias("_c"))
    runs = running_totals(counted, by, ["_c"], cuts=cuts)
    before, total = F.col("_c_upto") - F.col("_c"), F.col("_c_all")
    # the i with before <= floor(i * total / n) < upto, if places are fewer than rows
    some = F.sequence(F.ceil(before * F.lit(n) / total), F.ceil(F.col("_c_upto") * F.lit(n) / total) - 1)
    places = F.transform(some, lambda i: F.floor(i * total / F.lit(n)) - before + 1)
    has_some = F.ceil(before * F.lit(n) / total) < F.ceil(F.col("_c_upto") * F.lit(n) / total)
    taken = F.when(total <= n, F.sequence(F.lit(1).cast("bigint"), F.col("_c"))).when(has_some, places)
    wanted = F.broadcast(runs.select(F.struct(by).alias("_v"), taken.alias("_taken")).where(F.col("_taken").isNotNull()))
    rows = df.withColumn("_v", F.struct(by)).join(wanted, "_v")
    ranked = hash_rank(rows, keys, seed, [by], rank="_rank", total="_of")
    return ranked.where(F.array_contains("_taken", F.col("_rank"))).select(*df.columns)


def stride_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` distinct key combinations, every step-th in seeded order."""
    ranked = hash_rank(df.select(*keys).distinct(), keys, seed)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(n)))
    place = F.col("rank") - 1
    return ranked.where((place % step == 0) & (F.floor(place / step) < n)).select(*keys)


def parity(
    a: DataFrame, b: DataFrame, keys: Sequence[str], numbers: Sequence[str], exact: Sequence[str] = (), tol: float = 1e-3
) -> DataFrame:
    """One row: cases, passed, missing on either side; numbers within ``tol``, the rest equal."""
    left = a.select(*keys, F.struct(*numbers, *exact).alias("_a"))
    right = b.select(*keys, F.struct(*numbers, *exact).alias("_b"))
    joined = left.join(right, list(keys), "full")
    close = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for c in numbers:
        close = close & (F.abs(F.col(f"_a.{c}") - F.col(f"_b.{c}")) <= tol)
    for c in exact:
        close = close & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    return joined.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(close).alias("passed"),
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
    )


def metric_drops(
    reports: DataFrame, base: str, other: str, metrics: Sequence[str], gate: float = 0.01
) -> DataFrame:
    """(metric, drop, passed): base minus other per metric. ``reports`` is (variant, metric, value)."""
    wide = (
        reports.where(F.col("metric").isin(*metrics)).groupBy("metric").pivot("variant", [base, other]).agg(F.first("value"))
    )
    drop = half_even(F.col(base) - F.col(other), 4)
    return wide.select("metric", drop.alias("drop"), (drop < gate).alias("passed"))


def sweep(pred: DataFrame, score: str, gold: str, grid: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, point_accuracy) for score >= threshold at every grid value.

    Rows are counted once per grid band; the rest is running totals over the grid.
    """
    grid = sorted(set(float(g) for g in grid))
    bounds = F.array(*[F.lit(g) for g in grid])
    # band = number of grid values the score reaches
    band = F.size(F.filter(bounds, lambda g: F.col(score).cast("double") >= g))
    counted = pred.groupBy(band.alias("band")).agg(
        F.count_if(F.col(gold)).alias("p"), F.count_if(~F.col(gold)).alias("n")
    )
    whole = counted.agg(F.sum("p").alias("p_all"), F.sum("n").alias("n_all"))
    # a band reaches the first `band` thresholds
    reached = counted.select(F.explode(F.slice(bounds, 1, F.col("band"))).alias("threshold"), "p", "n")
    per = reached.groupBy("threshold").agg(F.sum("p").alias("tp"), F.sum("n").alias("fp"))
    listed = whole.select(F.explode(bounds).alias("threshold"), "p_all", "n_all")
    out = listed.join(per, "threshold", "left").select(
        "threshold",
        F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("fp", F.lit(0)).alias("fp"),
        "p_all",
        "n_all",
    )
    fn, tn = F.col("p_all") - F.col("tp"), F.col("n_all") - F.col("fp")
    return out.select(
        "threshold",
        "tp",
        "fp",
        fn.alias("fn"),
        tn.alias("tn"),
        half_even((F.col("tp") + tn) / (F.col("p_all") + F.col("n_all")), 6).alias("point_accuracy"),
    )


def position_metrics(pred: DataFrame) -> DataFrame:
    """One row: exact span rate over positives, null accuracy over negatives, span + .2 * null.

    ``pred``: pred_start, pred_end, gold_start, gold_end; gold_start 0 means no answer.
    """
    exact = (F.col("pred_start") == F.col("gold_start")) & (F.col("pred_end") == F.col("gold_end"))
    null = F.col("gold_start") == 0

    def rate(group: Column) -> Column:
        return F.count_if(exact & group) / F.greatest(F.count_if(group), F.lit(1))

    return pred.agg(rate(~null).alias("span_exact"), rate(null).alias("null_acc")).withColumn(
        "key", F.col("span_exact") + 0.2 * F.col("null_acc")
    )


def rmse(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rmse): root of the mean squared difference; pairs with a null are left out."""
    gap = F.col(a) - F.col(b)
    return df.groupBy(*keys).agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


def _midranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the mean rank of the rows of each distinct value."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    runs = running_totals(counts, value, ["_c"])
    return runs.select(value, (F.col("_c_upto") - (F.col("_c") - 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of mean ranks. Ranks come from counts per distinct value, so ties cost one row each."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    joint = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    ranked = joint.join(_midranks(pairs, a, "_x"), a).join(_midranks(pairs, b, "_y"), b)
    n, x, y = F.col("_n"), F.col("_x"), F.col("_y")
    means = ranked.agg((F.sum(n * x) / F.sum(n)).alias("mx"), (F.sum(n * y) / F.sum(n)).alias("my")).select(F.struct("mx", "my").alias("m"))
    centred = ranked.withColumn("_m", means.scalar()).select("_n", (x - F.col("_m.mx")).alias("_x"), (y - F.col("_m.my")).alias("_y"))
    spread = F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))
    return centred.agg(F.when(spread > 0, F.sum(n * x * y) / spread).alias("spearman"))


def weighted_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Cohen's kappa of two integer grades, disagreement weighted by its square.

    Expected disagreement follows from sums and sums of squares, so the grades are never paired up.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    observed = F.sum((x - y) * (x - y)) / F.count(F.lit(1))
    expected = F.avg(x * x) + F.avg(y * y) - 2 * F.avg("x") * F.avg("y")
    return pairs.agg(F.when(expected > 0, 1 - observed / expected).alias("kappa"))
