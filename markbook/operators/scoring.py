"""Rubric scoring: option rules, span evidence with credit masking, similarity fallback, totals.

A rubric is joined once as an array, and all points of an answer are scored by one fold over that array
inside the row: point n has to see the text without what points 1..n-1 were credited for. The answer
text is never exploded and never shuffled again.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.scores import rating
from markbook.functions.text import let, trim_span
from markbook.operators.matchers import ArrowMatcher, LexicalMatcher, TableMatcher
from markbook.operators.rubrics import effective_thresholds
from markbook.schemas import POINT_DETAIL
from markbook.settings import ScoringSettings

Matcher = LexicalMatcher | TableMatcher | ArrowMatcher

_SEPARATORS = "".join("\\" + c if ord(c) < 128 else c for c in fixed.OPTION_DELIMITERS)
# a letter after a choosing verb, before an option noun, or standing alone (a digit may follow)
OPTION_USE = (
    f"(?<=[{fixed.OPTION_VERBS_BEFORE}])[A-E]"
    f"|[A-E](?=[{fixed.OPTION_NOUNS_AFTER}])"
    f"|(?<![^\\s{_SEPARATORS}])[A-E](?![^\\s{_SEPARATORS}0-9])"
)


def option_letters(point_text: Column, aliases: Column) -> Column:
    """Expected option letters of a choice point, in order of appearance; empty for other points."""
    texts = F.concat(F.array(point_text), F.coalesce(aliases, F.array().cast("array<string>")))
    hints = "|".join(fixed.OPTION_HINTS)
    hinted = F.filter(texts, lambda t: t.rlike(hints))
    letters = F.flatten(F.transform(hinted, lambda t: F.regexp_extract_all(t, F.lit("[A-E]"), F.lit(0))))
    return F.array_distinct(letters)


def option_hit(answer: Column, letters: Column, require_all: bool = False) -> Column:
    """First expected letter the answer uses as an option, else null."""
    used = F.regexp_extract_all(answer, F.lit("(?U)" + OPTION_USE), F.lit(0))
    chosen = let(used, lambda u: F.get(F.filter(letters, lambda x: F.array_contains(u, x)), F.lit(0)))
    if require_all:
        chosen = F.when(F.size(F.array_except(letters, used)) == 0, chosen)
    return chosen


def with_letters(points: Column) -> Column:
    """Points with ``letters`` and the full candidate list, ready for the fold."""
    return F.transform(
        points,
        lambda p: F.struct(
            p["point_id"].alias("point_id"),
            p["point_text"].alias("point_text"),
            p["weight"].alias("weight"),
            F.concat(F.array(p["point_text"]), F.coalesce(p["aliases"], F.array().cast("array<string>"))).alias(
                "candidates"
            ),
            option_letters(p["point_text"], p["aliases"]).alias("letters"),
        ),
    )


def _detail(point: Column, status: Column, alias, span, conf, sim, score: Column, source: str) -> Column:
    return F.struct(
        point["point_id"].alias("point_id"),
        status.alias("hit_status"),
        alias.alias("matched_alias"),
        span.alias("extracted_span"),
        conf.alias("confidence"),
        sim.alias("similarity"),
        score.alias("point_score"),
        F.lit(source).alias("source"),
    ).cast(POINT_DETAIL)


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def best_span(candidates: Column, masked: Column, matcher, threshold: float) -> Column:
    """struct(neg_prob, pos, candidate, start, end) of the best usable evidence, else null."""
    size = F.length(masked)
    listed = F.transform(
        candidates, lambda c, i: F.struct(c.alias("c"), i.alias("i"), matcher.evidence(c, masked).alias("e"))
    )
    usable = F.filter(
        listed,
        lambda x: (x["e"]["has_answer_prob"] >= threshold)
        & (x["e"]["start"] <= x["e"]["end"])
        & (x["e"]["end"] < size)
        & (x["e"]["end"] - x["e"]["start"] + 1 <= fixed.MAX_SPAN_CHARS),
    )
    # smallest struct = highest probability, earliest candidate on a tie
    return F.array_min(
        F.transform(
            usable,
            lambda x: F.struct(
                (-x["e"]["has_answer_prob"]).alias("neg_prob"),
                x["i"].alias("pos"),
                x["c"].alias("candidate"),
                x["e"]["start"].alias("start"),
                x["e"]["end"].alias("end"),
            ),
        )
    )


def score_points(text: Column, points: Column, matcher, threshold: float, finish) -> Column:
    """Option rules and span evidence in point order with credit masking, then ``finish``.

    ``finish`` gets struct(masked, details) with one entry per point, null for points without a hit. It is part
    of the fold: the state is computed once and not looked at from outside.
    """
    state = f"struct<masked:string,details:array<{POINT_DETAIL}>>"

    def step(acc: Column, point: Column) -> Column:
        masked = acc["masked"]
        missed = F.struct(
            masked.alias("masked"), F.concat(acc["details"], F.array(F.lit(None).cast(POINT_DETAIL))).alias("details")
        ).cast(state)

        def with_option(letter: Column) -> Column:
            detail = _detail(
                point, F.lit("hit_exact"), point["point_text"], letter, F.lit(1.0), _none("double"),
                point["weight"], "option",
            )
            credited = F.struct(
                masked.alias("masked"), F.concat(acc["details"], F.array(detail)).alias("details")
            ).cast(state)
            return F.when(letter.isNotNull(), credited).otherwise(missed)

        def with_span(best: Column) -> Column:
            raw = F.substring(masked, best["start"] + 1, best["end"] - best["start"] + 1)

            def credit(span: Column) -> Column:
                at = F.instr(masked, span)
                detail = _detail(
                    point, F.lit("hit_exact"), best["candidate"], span, -best["neg_prob"], _none("double"),
                    point["weight"], "mrc",
                )
                blanked = F.overlay(masked, F.repeat(F.lit(" "), F.length(span)), at, F.length(span))
                return F.struct(
                    F.when((span != "") & (at > 0), blanked).otherwise(masked).alias("masked"),
                    F.concat(acc["details"], F.array(detail)).alias("details"),
                ).cast(state)

            return F.when(best.isNotNull(), let(trim_span(raw), credit)).otherwise(missed)

        return F.when(F.size(point["letters"]) > 0, let(option_hit(masked, point["letters"]), with_option)).otherwise(
            let(best_span(point["candidates"], masked, matcher, threshold), with_span)
        )

    start = F.struct(text.alias("masked"), F.array().cast(f"array<{POINT_DETAIL}>").alias("details")).cast(state)
    return F.aggregate(points, start, step, finish)


def from_similarity(point: Column, cosine: Column, high: Column, low: Column, partial: float) -> Column:
    """Detail of a point judged by similarity alone."""
    status = F.when(cosine >= high, "hit_semantic").when(cosine >= low, "partial").otherwise("miss")
    score = (
        F.when(cosine >= high, point["weight"])
        .when(cosine >= low, point["weight"] * F.lit(partial))
        .otherwise(F.lit(0.0))
    )
    return _detail(point, status, _none(), _none(), _none("double"), cosine, score, "similarity")


def score_fallback(points: Column, scored: Column, matcher, high: Column, low: Column, partial: float) -> Column:
    """All details in point order; points without one yet are judged on the fully masked text."""

    def fill(point: Column, position: Column) -> Column:
        known = F.get(scored["details"], position)
        similar = from_similarity(point, matcher.similarity(point["point_text"], scored["masked"]), high, low, partial)
        return F.when(known.isNotNull(), known).otherwise(similar)

    return F.transform(points, fill)


def _model_details(matcher: ArrowMatcher, settings: ScoringSettings):
    """The batch function behind an ArrowMatcher: one model call per rubric position and batch."""
    # plain values only: workers need not have this package installed
    extract, similarity = matcher.extract, matcher.similarity
    threshold, partial = settings.mrc_confidence_threshold, settings.partial_credit
    option_use, max_chars = re.compile(OPTION_USE), fixed.MAX_SPAN_CHARS
    edges = fixed.whitespace() + fixed.SPAN_EDGE_PUNCT

    def detail(point, status, alias, span, conf, sim, score, source) -> dict:
        return {
            "point_id": int(point["point_id"]), "hit_status": status, "matched_alias": alias, "extracted_span": span,
            "confidence": conf, "similarity": sim, "point_score": float(score), "source": source,
        }

    def judge(batch: pd.DataFrame) -> list[list[dict]]:
        texts = list(batch["_text"])
        rubric = [list(p) for p in batch["_points"]]
        details: list[dict[int, dict]] = [{} for _ in texts]
        for position in range(max((len(p) for p in rubric), default=0)):
            asked: list[tuple[int, str]] = []
            for row, points in enumerate(rubric):
                if position >= len(points):
                    continue
                point = points[position]
                if len(point["letters"]):
                    used = set(option_use.findall(texts[row]))
                    letter = next((x for x in point["letters"] if x in used), None)
                    if letter:
                        details[row][position] = detail(point, "hit_exact", point["point_text"], letter, 1.0, None, point["weight"], "option")
                else:
                    asked += [(row, c) for c in point["candidates"]]
            if not asked:
                continue
            found = extract([c for _, c in asked], [texts[r] for r, _ in asked])
            best: dict[int, tuple] = {}
            for (row, candidate), (prob, start, end) in zip(asked, found):
                fits = start <= end < len(texts[row]) and end - start + 1 <= max_chars
                if prob >= threshold and fits and (row not in best or prob > best[row][0]):
                    best[row] = (prob, candidate, texts[row][start : end + 1])
            for row, (prob, candidate, raw) in best.items():
                span = raw.strip(edges) or raw
                point = rubric[row][position]
                details[row][position] = detail(point, "hit_exact", candidate, span, prob, None, point["weight"], "mrc")
                texts[row] = texts[row].replace(span, " " * len(span), 1)
        rest = [(r, i) for r, ps in enumerate(rubric) for i in range(len(ps)) if i not in details[r]]
        cosines = similarity([rubric[r][i]["point_text"] for r, i in rest], [texts[r] for r, _ in rest])
        for (row, i), cosine in zip(rest, cosines):
            point, high, low = rubric[row][i], batch["_high"].iloc[row], batch["_low"].iloc[row]
            status = "hit_semantic" if cosine >= high else "partial" if cosine >= low else "miss"
            share = {"hit_semantic": 1.0, "partial": partial, "miss": 0.0}[status]
            details[row][i] = detail(point, status, None, None, None, float(cosine), point["weight"] * share, "similarity")
        return [[d[i] for i in range(len(rubric[r]))] for r, d in enumerate(details)]

    return judge


def _with_model(df: DataFrame, matcher: ArrowMatcher, settings: ScoringSettings) -> DataFrame:
    judge = _model_details(matcher, settings)
    carried = [c for c in df.columns if c not in ("_text", "_points", "_high", "_low")]
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carried) + f", point_details array<{POINT_DETAIL}>"

    def run(batches):
        for batch in batches:
            out = batch[carried].copy()
            out["point_details"] = judge(batch)
            yield out

    return df.mapInPandas(run, schema)


def score_answers(
    answers: DataFrame,
    configs: DataFrame,
    matcher: Matcher | None = None,
    settings: ScoringSettings | None = None,
    text: str = "answer_text",
) -> DataFrame:
    """Answers with point_details, total_score, max_score and rating.

    ``text`` is the text to score (stem-stripped beforehand if wanted, see ``plans.grading``). Answers
    of questions without a rubric are left out. The rubric side of the join is one row per question;
    whether it is broadcast is left to its measured size.
    """
    matcher = matcher or LexicalMatcher()
    settings = (settings or ScoringSettings()).check()
    rubric = effective_thresholds(configs, settings).select(
        "question_id",
        F.col("total_score").alias("max_score"),
        with_letters(F.col("points")).alias("_points"),
        F.col("similarity_high").alias("_high"),
        F.col("similarity_low").alias("_low"),
    )
    ready = answers if isinstance(matcher, ArrowMatcher) else matcher.prepare(answers)
    joined = ready.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).join(rubric, "question_id")
    if isinstance(matcher, ArrowMatcher):
        scored = _with_model(joined, matcher, settings)
    else:
        points = F.col("_points")

        def finish(scored: Column) -> Column:
            return score_fallback(
                points, scored, matcher, F.col("_high"), F.col("_low"), settings.partial_credit
            )

        details = score_points(F.col("_text"), points, matcher, settings.mrc_confidence_threshold, finish)
        scored = joined.withColumn("point_details", details).drop(
            "_points", "_text", "_high", "_low", "_spans", "_cosines"
        )
    total = F.aggregate("point_details", F.lit(0.0), lambda acc, d: acc + d["point_score"])
    return scored.withColumn("total_score", total).withColumn(
        "rating", rating(F.col("total_score"), F.col("max_score"))
    )


def detail_rows(scored: DataFrame, *carry: str) -> DataFrame:
    """One row per scored point."""
    return scored.select(*(carry or ("answer_id", "question_id")), F.inline("point_details"))


def pick_span(predictions: DataFrame, threshold: float, max_chars: int = fixed.MAX_SPAN_CHARS) -> DataFrame:
    """Best usable prediction per (answer, point), unmasked table form.

    Input: answer_id, point_id, pos, candidate, has_answer_prob, start, end (closed), answer_len.
    """
    fits = (
        (F.col("has_answer_prob") >= threshold)
        & (F.col("start") <= F.col("end"))
        & (F.col("end") < F.col("answer_len"))
        & (F.col("end") - F.col("start") + 1 <= max_chars)
    )
    best = F.max_by(
        F.struct("candidate", "has_answer_prob", "start", "end"), F.struct("has_answer_prob", -F.col("pos"))
    )
    return predictions.where(fits).groupBy("answer_id", "point_id").agg(best.alias("b")).select(
        "answer_id", "point_id", "b.*"
    )


def sentence_max(
    answers: DataFrame, cosine_of, point_texts: str = "point_text", text: str = "answer_text"
) -> DataFrame:
    """Highest sentence similarity per row, 0 without sentences; an alternative to whole-text similarity.

    ``cosine_of(point, sentence)`` is a column function.
    """
    from markbook.functions.text import sentences

    parts = sentences(F.col(text), fixed.SENTENCE_BREAK_COARSE, 1)
    best = F.array_max(F.transform(parts, lambda s: cosine_of(F.col(point_texts), s)))
    return answers.withColumn("cos_sent_max", F.coalesce(best, F.lit(0.0)))
