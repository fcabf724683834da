"""Where span and similarity evidence comes from.

A matcher answers two questions for an answer: where does a candidate wording occur, and how close is a
point to the answer. Three forms: built-in lexical search, a table computed beforehand, and a user's own
model called on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions.text import let

EVIDENCE = "struct<has_answer_prob:double,start:int,end:int>"


@dataclass(frozen=True)
class LexicalMatcher:
    """First exact occurrence of the candidate; a fixed cosine unless ``cosine_of`` gives one."""

    found_prob: float = 0.97
    missing_prob: float = 0.1
    cosine: float = 0.0
    cosine_of: Callable[[Column, Column], Column] | None = None

    def prepare(self, answers: DataFrame) -> DataFrame:
        return answers

    def evidence(self, candidate: Column, masked: Column) -> Column:
        def judge(at: Column) -> Column:
            return F.struct(
                F.when(at > 0, F.lit(self.found_prob)).otherwise(F.lit(self.missing_prob)).alias("has_answer_prob"),
                F.greatest(at - 1, F.lit(0)).alias("start"),
                F.when(at > 0, at + F.length(candidate) - 2).otherwise(F.lit(0)).alias("end"),
            )

        return let(F.instr(masked, candidate), judge)

    def similarity(self, point_text: Column, masked: Column) -> Column:
        return self.cosine_of(point_text, masked) if self.cosine_of else F.lit(self.cosine)


@dataclass(frozen=True)
class TableMatcher:
    """Evidence computed beforehand on the unmasked answer.

    ``spans`` is (answer_id, candidate, has_answer_prob, start, end closed), ``cosines`` is
    (answer_id, point_text, cosine). A key that is missing raises an error in the job, unless
    ``missing_is_error`` is off: then it counts as no evidence (``count_missing`` reports how many).
    """

    spans: DataFrame
    cosines: DataFrame
    missing_is_error: bool = True

    def prepare(self, answers: DataFrame) -> DataFrame:
        # one entry per rubric candidate of one answer
        span_value = F.struct("has_answer_prob", F.col("start").cast("int"), F.col("end").cast("int")).cast(EVIDENCE)
        span_map = self.spans.groupBy("answer_id").agg(
            F.map_from_entries(F.collect_list(F.struct("candidate", span_value))).alias("_spans")
        )
        cosine_map = self.cosines.groupBy("answer_id").agg(
            F.map_from_entries(F.collect_list(F.struct("point_text", "cosine"))).alias("_cosines")
        )
        return answers.join(span_map, "answer_id", "left").join(cosine_map, "answer_id", "left")

    def _value(self, table: Column, key: Column, kind: str) -> Column:
        found = F.try_element_at(table, key)
        if not self.missing_is_error:
            return found
        return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"no {kind} for: "), key))).otherwise(found)

    def evidence(self, candidate: Column, masked: Column) -> Column:
        return self._value(F.col("_spans"), candidate, "span")

    def similarity(self, point_text: Column, masked: Column) -> Column:
        return self._value(F.col("_cosines"), point_text, "similarity")


@dataclass(frozen=True)
class ArrowMatcher:
    """A user's model. ``extract`` gets equally long lists of candidates and texts and returns a list of
    (prob, start, end closed); ``similarity`` gets lists of points and texts and returns cosines.

    All candidates of one rubric position of a whole Arrow batch go to the model in one call.
    """

    extract: Callable[[list[str], list[str]], list[tuple[float, int, int]]]
    similarity: Callable[[list[str], list[str]], list[float]]


def candidate_rows(answers: DataFrame, points: DataFrame) -> DataFrame:
    """(answer_id, question_id, point_id, weight, pos, candidate): the wordings to look for.

    ``pos`` 0 is the point text, then the aliases in order.
    """
    listed = points.select(
        "question_id",
        "point_id",
        "weight",
        F.posexplode(F.concat(F.array("point_text"), F.coalesce("aliases", F.array().cast("array<string>")))).alias(
            "pos", "candidate"
        ),
    )
    return answers.join(listed, "question_id")


def lookup_predictions(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates with their precomputed evidence; ``found`` is false where the table has no entry."""
    marked = spans.withColumn("_found", F.lit(True))
    return candidates.join(marked, ["answer_id", "candidate"], "left").withColumn(
        "found", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def count_missing(candidates: DataFrame, spans: DataFrame) -> DataFrame:
    """One row: candidates looked up and candidates without an entry."""
    return lookup_predictions(candidates, spans).agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(~F.col("found")).alias("missing")
    )
