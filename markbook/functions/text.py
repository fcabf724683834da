"""Text expressions. All are built-in column expressions; offsets count Unicode code points."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook.functions import fixed


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_metric(col: Column) -> Column:
    """Drop whitespace and punctuation (used by exact match and F1)."""
    return F.translate(col, fixed.metric_drop(), "")


def norm_stem(col: Column, keep_digits: bool = False) -> Column:
    """Drop whitespace, punctuation, digits and note marks; lower-case ASCII letters."""
    return F.translate(col, string.ascii_uppercase + fixed.stem_drop(keep_digits), string.ascii_lowercase)


def norm_align(col: Column) -> Column:
    """Drop whitespace and punctuation, fold width and case, one character to one."""
    source, target = fixed.fold_table()
    return F.translate(col, source + fixed.align_drop(), target)


def kept_positions(col: Column, drop: str) -> Column:
    """0-based positions of the characters that normalisation keeps, in order."""
    marked = F.transform(F.split(col, ""), lambda c, i: F.when(F.instr(F.lit(drop), c) == 0, i))
    return F.filter(marked, lambda i: i.isNotNull())


def norm_with_map(col: Column) -> Column:
    """struct(text, idx): normalised text and, per kept character, its place in the original."""
    return F.struct(norm_align(col).alias("text"), kept_positions(col, fixed.align_drop()).alias("idx"))


def strip_space(col: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only blanks."""
    return F.btrim(col, F.lit(fixed.whitespace()))


def sentences(col: Column, pattern: str = fixed.SENTENCE_BREAK_FINE, min_len: int = 6) -> Column:
    """Trimmed sentences of at least ``min_len`` characters, in order."""
    parts = F.transform(F.split(col, pattern), strip_space)
    return F.filter(parts, lambda s: F.length(s) >= min_len)


def dedup_key(col: Column) -> Column:
    """Text without any whitespace."""
    return F.translate(col, fixed.whitespace(), "")


def trim_span(col: Column) -> Column:
    """Trim whitespace and punctuation at both ends; keep the original when nothing is left."""
    trimmed = F.btrim(col, F.lit(fixed.whitespace() + fixed.SPAN_EDGE_PUNCT))
    return F.when(trimmed == "", col).otherwise(trimmed)


def answer_text(ocr_text: Column, typed_text: Column) -> Column:
    """Recognised text first, then typed text, then the empty string."""
    return F.coalesce(ocr_text, typed_text, F.lit(""))


def split_aliases(col: Column) -> Column:
    """Comma-separated aliases (either comma), trimmed, empties dropped."""
    return F.filter(F.transform(F.split(col, "[，,]"), strip_space), lambda a: a != "")


def mask_ranges(text: Column, ranges: Column) -> Column:
    """Blank closed character ranges (``start``, ``end``), keeping the length."""
    last = F.length(text) - 1

    def blank(acc: Column, r: Column) -> Column:
        lo = F.least(r["start"].cast("int"), last)
        hi = F.greatest(F.least(r["end"].cast("int"), last), lo)
        return F.overlay(acc, F.repeat(F.lit(" "), hi - lo + 1), lo + 1, hi - lo + 1)

    return F.when(text == "", text).otherwise(F.aggregate(ranges, text, blank))


def exact_match(pred: Column, gold: Column) -> Column:
    """1 when both normalise to the same non-empty text, else 0."""
    p, g = norm_metric(pred), norm_metric(gold)
    return ((p == g) & (p != "")).cast("int")


def _numbered_chars(text: Column) -> Column:
    """The characters of a text, each with its number among equal ones: sorted once, runs of equal ones cut by a pattern."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*"), F.lit(0))

    def numbered(run: Column) -> Column:
        char = F.substring(run, 1, 1)
        return F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.concat(char, i.cast("string")))

    return F.flatten(F.transform(runs, numbered))


#: a text of at most so many different characters has each of them counted in the other text
COUNTED_CHARS = 64


def _common_chars(p: Column, g: Column, chars: Column) -> Column:
    """Size of the common character multiset. ``chars``: the different characters of ``g``; of many, both texts are sorted instead."""

    def times(text: Column, char: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, char, F.lit("")))

    counted = F.aggregate(chars, F.lit(0), lambda acc, c: acc + F.least(times(p, c), times(g, c)))
    return F.when(F.size(chars) <= COUNTED_CHARS, counted).otherwise(F.size(F.array_intersect(_numbered_chars(p), _numbered_chars(g))))


def char_f1(pred: Column, gold: Column) -> Column:
    """F1 over character multisets of the normalised texts; 0 when either is empty."""
    texts = F.struct(norm_metric(pred).alias("p"), norm_metric(gold).alias("g"))

    def score(t: Column) -> Column:
        overlap = let(F.array_distinct(F.split(t["g"], "")), lambda chars: _common_chars(t["p"], t["g"], chars))
        # 2PR/(P+R) with P = overlap/|p| and R = overlap/|g| is 2*overlap/(|p|+|g|)
        f1 = 2.0 * overlap / (F.length(t["p"]) + F.length(t["g"]))
        return F.when((t["p"] == "") | (t["g"] == ""), F.lit(0.0)).otherwise(f1)

    return let(texts, score)


def occurrences(text: Column, span: Column) -> Column:
    """0-based starts of the non-overlapping occurrences of ``span``, left to right."""
    quoted = F.concat(F.lit("\\Q"), F.replace(span, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    lengths = F.transform(F.split(text, quoted, -1), lambda part: F.length(part))
    width = F.length(span)

    def step(acc: Column, n: Column) -> Column:
        return F.struct(
            (acc["pos"] + n + width).alias("pos"),
            F.concat(acc["starts"], F.array(acc["pos"] + n)).alias("starts"),
        )

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts"))

    def fold(sizes: Column) -> Column:
        before = F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0)))
        return F.aggregate(before, start, step, lambda acc: acc["starts"])

    return F.when(span == "", F.array().cast("array<int>")).otherwise(let(lengths, fold))


def highlight_segments(text: Column, details: Column) -> Column:
    """Split a text into marked and unmarked segments.

    ``details`` is an array of struct(point_id, hit_status, extracted_span). Every occurrence of a
    span is marked; marks are taken by start, and one that overlaps an earlier mark is skipped.
    """
    named = F.filter(details, lambda d: d["extracted_span"].isNotNull() & (d["extracted_span"] != ""))
    marks = F.flatten(
        F.transform(
            named,
            lambda d, seq: F.transform(
                occurrences(text, d["extracted_span"]),
                lambda s: F.struct(
                    s.alias("start"),
                    seq.alias("seq"),
                    (s + F.length(d["extracted_span"])).alias("end"),
                    d["hit_status"].alias("hit_status"),
                    d["point_id"].cast("bigint").alias("point_id"),
                ),
            ),
        )
    )
    seg_type = "array<struct<text:string,hit_status:string,point_id:bigint>>"

    def segment(start: Column, end: Column, status: Column, point: Column) -> Column:
        piece = F.struct(
            F.substring(text, start + 1, end - start).alias("text"),
            status.cast("string").alias("hit_status"),
            point.cast("bigint").alias("point_id"),
        )
        return F.when(end > start, F.array(piece)).otherwise(F.array()).cast(seg_type)

    def place(acc: Column, m: Column) -> Column:
        kept = F.struct(
            m["end"].alias("cursor"),
            F.concat(
                acc["segs"],
                segment(acc["cursor"], m["start"], F.lit(None), F.lit(None)),
                segment(m["start"], m["end"], m["hit_status"], m["point_id"]),
            ).alias("segs"),
        )
        return F.when(m["start"] < acc["cursor"], acc).otherwise(kept)

    start = F.struct(F.lit(0).alias("cursor"), F.array().cast(seg_type).alias("segs"))
    return F.aggregate(
        F.array_sort(marks),
        start,
        place,
        lambda acc: F.concat(acc["segs"], segment(acc["cursor"], F.length(text), F.lit(None), F.lit(None))),
    )


def kgrams(text: Column, k: int, piece: int = 128) -> Column:
    """All substrings of ``k`` characters, in order. Taken from short pieces, because finding a place in a text costs its distance."""

    def of_piece(start: Column) -> Column:
        def taken(part: Column) -> Column:
            last = F.length(part) - k
            return F.transform(F.sequence(F.lit(0), last), lambda o: F.substring(part, o + 1, F.lit(k)))

        return let(F.substring(text, start + 1, F.lit(piece + k - 1)), taken)

    starts = F.sequence(F.lit(0), F.length(text) - k, F.lit(piece))
    none = F.array().cast("array<string>")
    return F.when(F.length(text) >= k, F.flatten(F.transform(starts, of_piece))).otherwise(none)


def shared_grams(text: Column, wanted: Column, k: int, block: int = 4096) -> Column:
    """Which of the ``wanted`` k-grams occur in the text: a hash look-up per character, block by block."""

    def of_block(start: Column) -> Column:
        return let(F.substring(text, start + 1, F.lit(block + k - 1)), lambda part: F.array_intersect(kgrams(part, k), wanted))

    starts = F.sequence(F.lit(0), F.length(text) - k, F.lit(block))
    none = F.array().cast("array<string>")
    worth = (F.length(text) >= k) & (F.size(wanted) > 0)
    return F.when(worth, F.array_distinct(F.flatten(F.transform(starts, of_block)))).otherwise(none)


def longest_common(text: Column, ref: Column, k: int, shared: Column | None = None) -> Column:
    """Longest common substring of at least ``k`` characters, '' when there is none.

    A window over ``ref`` grows at its end while ``text`` has it and moves its start on otherwise, so ``text`` is searched
    at most twice per character of ``ref``. Among equally long ones the earliest in ``text`` is returned. With ``shared``, the k-grams
    of ``ref`` that the text has (`shared_grams`), the text is searched only where the window's last k-gram is one of them.
    """
    n = F.length(ref)
    state = "struct<start:int,size:int,found:int,at:int,hit:string>"

    def step(acc: Column, _: Column) -> Column:
        window = F.substring(ref, acc["start"] + 1, acc["size"])

        def look(at: Column) -> Column:
            better = (acc["size"] > acc["found"]) | ((acc["size"] == acc["found"]) & (at < acc["at"]))
            grown = F.struct(
                acc["start"],
                acc["size"] + 1,
                F.greatest(acc["found"], acc["size"]),
                F.when(better, at).otherwise(acc["at"]),
                F.when(better, window).otherwise(acc["hit"]),
            ).cast(state)
            moved = F.struct(
                acc["start"] + 1, F.greatest(acc["size"] - 1, F.lit(k)), acc["found"], acc["at"], acc["hit"]
            ).cast(state)
            return F.when(at > 0, grown).otherwise(moved)

        place = F.instr(text, window)
        if shared is not None:
            newest = F.substring(ref, acc["start"] + acc["size"] - k + 1, F.lit(k))
            place = F.when(F.array_contains(shared, newest), place).otherwise(0)
        return F.when(acc["start"] + acc["size"] > n, acc).otherwise(let(place, look))

    first = F.struct(F.lit(0), F.lit(k), F.lit(0), F.lit(0), F.lit("")).cast(state)
    found = F.aggregate(F.sequence(F.lit(1), 2 * n), first, step, lambda acc: acc["hit"])
    return F.when((F.length(text) >= k) & (n >= k), found).otherwise(F.lit(""))
