"""Find a quoted span in an answer: exact, then folded, then matching blocks.

The first two tiers are built-in expressions. Only rows they leave open reach Python: the Arrow
function gets nulls for all others.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.text import kept_positions, let, norm_align, strip_space

ALIGN_TYPE = "struct<start:int,end:int,matched_text:string,strategy:string>"


def _align(start: Column, end: Column, answer: Column, strategy: str) -> Column:
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        F.substring(answer, start + 1, end - start).alias("matched_text"),
        F.lit(strategy).alias("strategy"),
    ).cast(ALIGN_TYPE)


def align_native(answer: Column, span: Column) -> Column:
    """Exact match, else match after folding, else null."""

    def place(s: Column) -> Column:
        exact_at = F.instr(answer, s) - 1

        def fold(both: Column) -> Column:
            at = F.instr(both["a"], both["s"]) - 1

            def project(places: Column) -> Column:
                last = F.get(places, at + F.length(both["s"]) - 1)
                return _align(F.get(places, at), last + 1, answer, "fuzzy")

            found = let(kept_positions(answer, fixed.align_drop()), project)
            return F.when((both["s"] != "") & (at >= 0), found)

        fuzzy = let(F.struct(norm_align(answer).alias("a"), norm_align(s).alias("s")), fold)
        return (
            F.when(s == "", F.lit(None).cast(ALIGN_TYPE))
            .when(exact_at >= 0, _align(exact_at, exact_at + F.length(s), answer, "exact"))
            .otherwise(fuzzy)
        )

    return let(strip_space(F.coalesce(span, F.lit(""))), place)


def _block_function(min_coverage: float):
    # all it needs is inside: workers need not have this package installed
    def matching_block(answer: str, span: str) -> tuple[int, int] | None:
        blocks = difflib.SequenceMatcher(None, answer, span, autojunk=False).get_matching_blocks()
        if sum(b.size for b in blocks) < max(2.0, min_coverage * len(span)):
            return None
        longest = max(blocks, key=lambda b: b.size)
        return (longest.a, longest.size) if longest.size >= 2 else None

    @F.pandas_udf("struct<at:int,size:int>")
    def block(answer: pd.Series, span: pd.Series) -> pd.DataFrame:
        rows = [(matching_block(a, s) if a and s else None) or (None, None) for a, s in zip(answer, span)]
        return pd.DataFrame(rows, columns=["at", "size"], dtype="Int32")

    # kept out of join conditions, where a Python function cannot run
    return block.asNondeterministic()


def align_spans(
    df: DataFrame,
    answer: str = "answer_text",
    span: str = "extracted_span",
    out: str = "align",
    min_coverage: float = 0.6,
) -> DataFrame:
    """Add ``out`` = struct(start, end half-open, matched_text, strategy), null when nothing fits."""
    text = F.col(answer)
    native = df.withColumn("_native", align_native(text, F.col(span)))
    still_open = F.col("_native").isNull() & (strip_space(F.coalesce(F.col(span), F.lit(""))) != "")
    block = _block_function(min_coverage)
    # one pass: only texts of rows that nothing else could place go to Python, the others are null there
    asked = F.when(still_open, norm_align(text)), F.when(still_open, norm_align(strip_space(F.col(span))))
    tried = native.withColumn("_block", block(*asked))
    by_block = let(
        kept_positions(text, fixed.align_drop()),
        lambda places: _align(
            F.get(places, F.col("_block.at")),
            F.get(places, F.col("_block.at") + F.col("_block.size") - 1) + 1,
            text,
            "lcs",
        ),
    )
    placed = F.coalesce("_native", F.when(F.col("_block.at").isNotNull(), by_block))
    return tried.withColumn(out, placed).drop("_native", "_block")


def align_report(df: DataFrame, hit: str = "hit", align: str = "align") -> DataFrame:
    """One row: hit points, aligned ones, and how many by each strategy."""
    hits = F.col(hit)

    def by(strategy: str) -> Column:
        return F.count_if(hits & (F.col(f"{align}.strategy") == strategy)).alias(strategy)

    return df.agg(
        F.count_if(hits).alias("hit_points"),
        F.count_if(hits & F.col(align).isNotNull()).alias("aligned"),
        by("exact"),
        by("fuzzy"),
        by("lcs"),
    )
