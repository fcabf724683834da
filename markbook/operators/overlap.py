"""Shared substrings between text columns: longest common substring, stem stripping, leak scans.

Large sides are cut into k-grams and met with an equality join, so no text pair is compared that does
not share a k-gram. Texts are split into short pieces (overlapping by k-1) before the k-grams are
taken: one long text spreads over tasks and no k-gram is lost.

The large side is first reduced with sampled grams: any common substring of length >= k contains a
w-gram that starts at a multiple of s when k >= w + s - 1. Only texts with such a gram go on. That step
loses nothing. References that are small are broadcast, and then only the k-grams around a sampled gram that was found go on,
from the scan that found it; a text that has one such gram is neither read nor cut again.

Which pairs share something is answered by `matching_runs`: a shared passage gives two rows, its first and
its last gram, however long it is. Where only the longest match of each left position counts, no pairs are made at all
(`longest_matches`): a gram's continuations on the right side are a list in its one dictionary row, or, where a gram
has many, the closest two in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from markbook.functions import fixed
from markbook.functions.text import dedup_key, kept_positions, kgrams, let, longest_common, norm_stem, shared_grams

PIECE = 256
#: a piece is cut into slices of so many gram starts
SLICE = 32
#: a reference side of at most so many bytes, by the planner's statistics, is broadcast as grams
BROADCAST_BYTES = 131_072
#: characters after a gram that are compared at once; one less than a power of two
SPAN = 127
#: a gram with more different continuations than this is heavy: they do not fit its dictionary row
LISTED = 16
#: parts into which the left positions of heavy grams are cut
SALTS = 64


def grams(
    df: DataFrame, ids: Sequence[str], text: str, size: int, step: int = 1, place: str = "i", after: int = 0
) -> DataFrame:
    """(ids, place, gram): every ``size``-gram that starts at a multiple of ``step``, 0-based.

    With ``after`` also ``before``, the character before it ('' at the beginning), and ``tail``, up to ``after`` characters after it.
    """
    short = _stride(SLICE, step)
    stride = _stride(PIECE, short)
    n = F.length(text)
    first_starts = F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)), F.lit(stride))
    lead = (lambda b: F.least(b, F.lit(1))) if after else (lambda b: F.lit(0))

    def cut(b: Column) -> Column:
        return F.substring(F.col(text), b + 1 - lead(b), lead(b) + (stride + size - 1 + after))

    # a text shorter than a gram is one short piece; a condition on the text itself would normalise it once more
    pieces = df.select(*ids, F.explode(F.transform(first_starts, lambda b: F.struct(b.alias("base"), cut(b).alias("piece")))).alias("_p"))
    base, piece = F.col("_p.base"), F.col("_p.piece")
    room = F.length(piece) - lead(base) - size
    slices = F.sequence(F.lit(0), F.least(room, F.lit(stride - 1)), F.lit(short))
    # finding a place takes as long as what lies before it, so grams are cut from slices; numbers are exploded, which Spark compiles
    found = pieces.where(room >= 0).select(*ids, base.alias("_base"), piece.alias("_piece"), F.explode(slices).alias("_s"))
    base, skip = F.col("_base") + F.col("_s"), lead(F.col("_base") + F.col("_s"))
    part = F.substring(F.col("_piece"), F.col("_s") + 1 + lead(F.col("_base")) - skip, skip + (short + size - 1 + after))
    found = found.select(*ids, base.alias("_base"), part.alias("_slice"))
    base, part, skip, o = F.col("_base"), F.col("_slice"), lead(F.col("_base")), F.col("_o")
    offsets = F.sequence(F.lit(0), F.least(F.length(part) - skip - size, F.lit(short - 1)), F.lit(step))
    fields = [(base + o).alias(place), F.substring(part, o + 1 + skip, F.lit(size)).alias("gram")]
    if after:
        fields.append(F.when(o + skip > 0, F.substring(part, o + skip, F.lit(1))).otherwise("").alias("before"))
        fields.append(F.substring(part, o + 1 + skip + size, F.lit(after)).alias("tail"))
    return found.select(*ids, "_base", "_slice", F.explode(offsets).alias("_o")).select(*ids, *fields)


def _stride(length: int, step: int) -> int:
    """The multiple of ``step`` that reaches ``length``."""
    return step * max(1, -(-length // step))


def _small(refs: DataFrame) -> bool:
    """Whether grams of the references are broadcast; by the size that the optimizer knows, which starts no job."""
    return int(refs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= BROADCAST_BYTES


def _joined_side(grams_of_refs: DataFrame, refs: DataFrame) -> DataFrame:
    """The reference side of a gram join: broadcast if the references are small, otherwise both sides are shuffled.

    The optimizer sizes exploded grams by the text they came from and would broadcast far too much. So the size it knows of
    the references decides; that starts no job.
    """
    return F.broadcast(grams_of_refs) if _small(refs) else grams_of_refs.hint("merge")


def _row_shares(text: Column, refs: Column, width: int, step: int) -> Column:
    """Whether a sampled gram of ``text`` occurs in one of ``refs``; looks at short pieces in turn."""
    stride = step * max(1, -(-PIECE // step))
    starts = F.sequence(F.lit(0), F.length(text) - width, F.lit(stride))

    def in_piece(piece: Column) -> Column:
        offsets = F.sequence(F.lit(0), F.least(F.length(piece) - width, F.lit(stride - 1)), F.lit(step))

        def found(o: Column) -> Column:
            return let(
                F.substring(piece, o + 1, F.lit(width)), lambda g: F.exists(refs, lambda r: F.contains(r, g))
            )

        return F.exists(offsets, found)

    return F.exists(starts, lambda b: let(F.substring(text, b + 1, F.lit(stride + width - 1)), in_piece))


def sharing_rows(
    left: DataFrame, right: DataFrame, k: int, left_id: str, text: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Left rows that may share >= k characters with a right row; never misses one.

    With ``keys`` a row has only the few references of its key, and is tested against them in place.
    """
    width = (k + 1) // 2
    step = k - width + 1
    if keys:
        refs = right.where(F.length(text) >= k).groupBy(*keys).agg(F.collect_set(text).alias("_refs"))
        # short texts go first: a condition after the join may be evaluated in any order
        long_enough = left.where(F.length(text) >= k)
        shares = F.when(F.length(text) >= k, _row_shares(F.col(text), F.col("_refs"), width, step))
        return long_enough.join(refs, list(keys)).where(shares).select(*left.columns)
    left_grams = grams(left, [left_id], text, width, step)
    right_grams = _joined_side(grams(right, [], text, width).select("gram").distinct(), right)
    ids = left_grams.join(right_grams, "gram", "left_semi").select(left_id).distinct()
    return left.join(ids, left_id, "left_semi")


def sharing_grams(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    text: str = "norm",
    keys: Sequence[str] = (),
    after: int = 1,
    parts: int | None = None,
) -> DataFrame:
    """(left_id, keys, i, gram, before, tail) as `grams` gives them, of all left k-grams that may be in a right text; never misses one.

    A k-gram holds one sampled gram, so it begins less than a step before that. With small references each sampled gram that is
    found gives these few k-grams, cut from the piece it stands in. For more than one use, the pieces are shuffled by their text into
    ``parts`` (a number, so that adaptive execution does not join them: a piece gives many rows).
    """
    if keys or not _small(right):
        return grams(sharing_rows(left, right, k, left_id, text, keys), [left_id, *keys], text, k, after=after)
    width = (k + 1) // 2
    step = k - width + 1
    short = _stride(SLICE, step)
    stride = _stride(PIECE, short)
    first_starts = F.sequence(F.lit(0), F.greatest(F.length(text) - width, F.lit(0)), F.lit(stride))

    def lead(b: Column) -> Column:
        return F.least(b, F.lit(step))

    def cut(b: Column) -> Column:
        return F.substring(F.col(text), b + 1 - lead(b), lead(b) + (stride - step + k + after))

    pieces = left.select(left_id, F.explode(F.transform(first_starts, lambda b: F.struct(b.alias("base"), cut(b).alias("piece")))).alias("_p"))
    base, piece = F.col("_p.base"), F.col("_p.piece")
    room = F.length(piece) - lead(base) - width
    slices = F.sequence(F.lit(0), F.least(room, F.lit(stride - 1)), F.lit(short))
    found = pieces.where(room >= 0).select(left_id, base.alias("_base"), piece.alias("_piece"), F.explode(slices).alias("_s"))
    part = F.substring(F.col("_piece"), F.col("_s") + 1 + lead(F.col("_base")), F.lit(short - step + width))
    found = found.select(left_id, "_base", "_piece", "_s", part.alias("_slice"))
    offsets = F.sequence(F.lit(0), F.length("_slice") - width, F.lit(step))
    found = found.select(left_id, "_base", "_piece", "_s", "_slice", F.explode(offsets).alias("_o"))
    sampled = F.substring(F.col("_slice"), F.col("_o") + 1, F.lit(width)).alias("_sampled")
    known = grams(right, [], text, width).select(F.col("gram").alias("_sampled")).distinct()
    hits = found.select(left_id, "_base", "_piece", (F.col("_s") + F.col("_o")).alias("_s"), sampled).join(F.broadcast(known), "_sampled", "left_semi")
    back = F.explode(F.sequence(F.lit(0), F.least(F.col("_base") + F.col("_s"), F.lit(step - 1)))).alias("_d")
    hits = hits.select(left_id, "_base", "_piece", "_s")
    if parts:
        hits = hits.repartition(parts, left_id)
    hits = hits.select(left_id, "_base", "_piece", "_s", back)
    place = F.col("_base") + F.col("_s") - F.col("_d")
    at = F.col("_s") + lead(F.col("_base")) - F.col("_d")
    whole = hits.where(F.length("_piece") - at >= k)
    before = F.when(at > 0, F.substring(F.col("_piece"), at, F.lit(1))).otherwise("")
    of_piece = {"gram": F.substring(F.col("_piece"), at + 1, F.lit(k)), "tail": F.substring(F.col("_piece"), at + 1 + k, F.lit(after))}
    return whole.select(left_id, place.alias("i"), of_piece["gram"].alias("gram"), before.alias("before"), of_piece["tail"].alias("tail"))


def matching_runs(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    right_id: str,
    text: str = "norm",
    keys: Sequence[str] = (),
) -> DataFrame:
    """(left_id, right_id, i, j, run_end): the passages of at least k characters that a left and a right text share.

    A passage begins at i on the left and j on the right, can be prolonged neither way, and ends before ``run_end``. Two grams meet in the
    join only if a passage begins or ends with them, so it gives one row or two; on its diagonal a beginning is followed by its end.
    """
    lg = sharing_grams(left, right, k, left_id, text, keys)
    rg = grams(right, [right_id, *keys], text, k, place="j", after=1)
    rg = rg.withColumnsRenamed({"before": "_before", "tail": "_tail"})
    begins, ends = _edges(F.col("tail"))
    met = lg.join(_joined_side(rg, right), [*keys, "gram"]).where(begins | ends)
    met = met.select(left_id, right_id, "i", "j", begins.alias("_begins"), ends.alias("_ends"))
    line = W.partitionBy(left_id, right_id, F.col("i") - F.col("j")).orderBy("i")
    last = F.when(F.col("_ends"), F.col("i")).otherwise(F.lead("i").over(line))
    return met.withColumn("_last", last).where("_begins").select(left_id, right_id, "i", "j", (F.col("_last") + k).alias("run_end"))


def _edges(following: Column) -> tuple[Column, Column]:
    """Whether a passage begins, and whether it ends, with a gram that a left and a right text share."""
    begins = (F.col("before") == "") | (F.col("before") != F.col("_before"))
    return begins, (following == "") | (following != F.col("_tail"))


def _shared_prefix(a: Column, b: Column) -> Column:
    """How many of at most SPAN characters two texts begin with in common."""
    steps = [1 << p for p in range(SPAN.bit_length() - 1, -1, -1)]

    def longer(n: Column, s: Column) -> Column:
        same = (F.length(a) >= n + s) & (F.length(b) >= n + s) & (F.substring(a, n + 1, s) == F.substring(b, n + 1, s))
        return F.when(same, n + s).otherwise(n)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), longer)


def longest_matches(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    text: str = "norm",
    keys: Sequence[str] = (),
    shared: DataFrame | None = None,
) -> DataFrame:
    """(left_id, i, run_end): per left position the longest match of at least k characters with any right text.

    No pairs are made. The right side becomes a dictionary with a row per gram: how many different continuations it has and, up
    to LISTED, which. A left position meets that one row and compares its own continuation with the list. For a heavy gram,
    left positions and continuations are sorted together: the longest match of a text among sorted ones is with the one just
    before or just after it. So rows grow with left positions plus right grams, not with their product; left
    positions of a heavy gram are cut into SALTS parts, each of which gets the continuations.

    A match that goes on beyond SPAN characters after the gram lies in a passage of k + SPAN characters. The position has these
    characters, so it meets the right texts that have them too, equal right texts as one, and only beginnings and ends of
    passages make pairs, as in `matching_runs`. So left texts are cut once; not at all, if ``shared`` has their `sharing_grams`.
    """
    lg = shared or sharing_grams(left, right, k, left_id, text, keys, after=SPAN + 1)
    lg = lg.withColumns({"tail": F.substring("tail", 1, SPAN), "next": F.substring("tail", SPAN + 1, 1)})
    texts = right.where(F.length(text) >= k).select(*keys, text).distinct()
    of_gram = [*keys, "gram"]
    tails = grams(texts, list(keys), text, k, after=SPAN).groupBy(*of_gram, "tail").agg(F.lit(1).alias("_one"))
    counted = tails.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*of_gram)))
    listed = F.when(F.max("_n") <= LISTED, F.collect_list(F.when(F.col("_n") <= LISTED, F.col("tail")))).alias("_tails")
    dictionary = counted.groupBy(*of_gram).agg(listed)
    best = F.array_max(F.transform("_tails", lambda t: _shared_prefix(F.col("tail"), t)))
    salt = F.pmod(F.xxhash64(left_id, "i"), F.lit(SALTS)).cast("int").alias("_salt")
    hits = lg.join(_joined_side(dictionary, right), of_gram)
    hits = hits.select(*of_gram, salt, "tail", "before", "next", left_id, "i", best.alias("_listed"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    given = counted.where(F.col("_n") > LISTED).select(*of_gram, parts, "tail", F.col("tail").alias("_given"))
    both = hits.unionByName(given, allowMissingColumns=True)
    group = W.partitionBy(*of_gram, "_salt").rowsBetween(W.unboundedPreceding, 0)
    # of equal continuations the right one comes first
    below = F.last("_given", ignorenulls=True).over(group.orderBy("tail", F.col("_given").isNull()))
    above = F.last("_given", ignorenulls=True).over(group.orderBy(F.desc("tail"), F.col("_given").isNull()))
    near = both.withColumns({"_below": below, "_above": above}).where(F.col("_given").isNull())
    closest = F.greatest(*[_shared_prefix(F.col("tail"), F.coalesce(F.col(c), F.lit(""))) for c in ("_below", "_above")])
    found = near.select(*keys, left_id, "i", "gram", "tail", "before", "next", F.coalesce("_listed", closest).alias("_more"))

    wide = k + SPAN
    long_texts = texts.where(F.length(text) >= wide).withColumn("_text", F.xxhash64(*keys, text))
    rg = grams(long_texts, ["_text", *keys], text, wide, place="j", after=1)
    rg = rg.withColumnsRenamed({"before": "_before", "tail": "_tail", "gram": "_passage", **{c: f"_of_{c}" for c in keys}})
    begins, ends = _edges(F.col("next"))
    # positions with shorter matches meet nothing, so their key is any that spreads them
    key = F.when(F.col("_more") == SPAN, F.concat("gram", "tail")).otherwise(F.xxhash64(left_id, "i").cast("string"))
    found = found.select(*keys, left_id, "i", "before", "next", "_more", key.alias("_key"))
    same = F.col("_key") == F.col("_passage")
    for c in keys:
        same &= F.col(c) == F.col(f"_of_{c}")
    edge = found.join(_joined_side(rg, right), same & (F.col("_more") == SPAN) & (begins | ends), "left")
    met = F.col("_text").isNotNull()
    edge = edge.select(left_id, "i", "_more", "_text", "j", (met & begins).alias("_begins"), (met & ends).alias("_ends"))
    # all positions of a text in one part: bounded by the text
    edge = edge.repartition(left_id)
    line = W.partitionBy(left_id, "_text", F.col("i") - F.col("j")).orderBy("i")
    last = F.when(F.col("_ends"), F.col("i")).otherwise(F.lead("i").over(line))
    runs = edge.withColumn("_last", last).withColumn("_last", F.when(F.col("_begins"), F.col("_last")).otherwise(F.col("i")))
    inside = F.explode(F.sequence(F.col("i"), F.col("_last"))).alias("i")
    return runs.select(left_id, inside, (F.col("_last") + k + F.col("_more")).alias("run_end")).groupBy(left_id, "i").agg(F.max("run_end").alias("run_end"))


def lcs_pairs(
    left: DataFrame,
    right: DataFrame,
    k: int,
    left_id: str,
    right_id: str,
    left_text: str = "text",
    right_text: str = "text",
    keys: Sequence[str] = (),
    normalize: Callable[[Column], Column] = norm_stem,
) -> DataFrame:
    """(left_id, right_id, lcs_len): text pairs sharing a normalised substring of >= k characters."""
    ln = left.select(left_id, *keys, normalize(F.col(left_text)).alias("norm"))
    rn = right.select(right_id, *keys, normalize(F.col(right_text)).alias("norm"))
    runs = matching_runs(ln, rn, k, left_id, right_id, keys=keys)
    return runs.groupBy(left_id, right_id).agg(F.max(F.col("run_end") - F.col("i")).alias("lcs_len"))


def strip_ranges(
    answers: DataFrame,
    stems: DataFrame,
    min_match: int = fixed.MIN_STEM_MATCH,
    answer_id: str = "answer_id",
    stem_id: str = "stem_id",
    answer_text: str = "answer_text",
    stem_text: str = "stem_text",
    keys: Sequence[str] = (),
    keep_digits: bool = False,
) -> DataFrame:
    """(answer_id, ranges): normalised half-open ranges taken by the greedy left-to-right pass.

    At each position the longest match with any stem is taken and the scan goes on after it, so a match
    that begins inside a taken one does not count.
    """

    def norm(c: str) -> Column:
        return norm_stem(F.col(c), keep_digits)

    ln = answers.select(answer_id, *keys, norm(answer_text).alias("norm"))
    rn = stems.select(stem_id, *keys, norm(stem_text).alias("norm"))
    longest = longest_matches(ln, rn, min_match, answer_id, keys=keys).withColumnRenamed("run_end", "end")
    # one text's own positions: bounded by the text
    ordered = longest.groupBy(answer_id).agg(F.sort_array(F.collect_list(F.struct("i", "end"))).alias("m"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def take(acc: Column, m: Column) -> Column:
        taken = F.struct(
            m["end"].alias("pos"),
            F.concat(acc["ranges"], F.array(F.struct(m["i"].alias("start"), m["end"].alias("end")))).alias(
                "ranges"
            ),
        )
        return F.when(m["i"] >= acc["pos"], taken).otherwise(acc)

    start = F.struct(F.lit(0).alias("pos"), none.alias("ranges"))
    return ordered.select(answer_id, F.aggregate("m", start, take, lambda a: a["ranges"]).alias("ranges"))


def blank_ranges(text: Column, ranges: Column, keep_digits: bool = False) -> Column:
    """Blank the kept characters of normalised ranges; ignorable characters and the length stay."""
    drop = fixed.stem_drop(keep_digits)
    kept_class = "[^" + "".join("\\" + c if ord(c) < 128 and not c.isalnum() else c for c in drop) + "]"
    places = kept_positions(text, drop)

    def blank(acc: Column, r: Column) -> Column:
        first = F.get(acc["places"], r["start"])
        last = F.get(acc["places"], r["end"] - 1)
        piece = F.substring(text, first + 1, last - first + 1)
        return F.struct(
            acc["places"].alias("places"),
            (last + 1).alias("pos"),
            F.concat(
                acc["out"],
                F.substring(text, acc["pos"] + 1, first - acc["pos"]),
                F.regexp_replace(piece, kept_class, " "),
            ).alias("out"),
        )

    start = F.struct(places.alias("places"), F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(
        ranges,
        start,
        blank,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))),
    )


def strip_stems(
    answers: DataFrame,
    stems: DataFrame,
    min_match: int = fixed.MIN_STEM_MATCH,
    answer_id: str = "answer_id",
    stem_id: str = "stem_id",
    answer_text: str = "answer_text",
    stem_text: str = "stem_text",
    keys: Sequence[str] = (),
    out: str = "stripped_text",
    keep_digits: bool = False,
) -> DataFrame:
    """Add ``out``: the answer with every long passage copied from a stem blanked.

    ``keys`` (for example question_id) restricts the comparison to stems of the same question.
    """
    ranges = strip_ranges(
        answers, stems, min_match, answer_id, stem_id, answer_text, stem_text, keys, keep_digits
    )
    text = F.col(answer_text)
    stripped = F.when(F.col("ranges").isNull(), text).otherwise(blank_ranges(text, F.col("ranges"), keep_digits))
    return answers.join(ranges, answer_id, "left").withColumn(out, stripped).drop("ranges")


def strip_training_rows(
    spans: DataFrame, stems: DataFrame, min_match: int = fixed.MIN_STEM_MATCH, key: str | None = "question_id"
) -> DataFrame:
    """Strip the context of full-answer rows; rows whose gold span would vanish stay unchanged.

    ``stems`` is (``key``, stem_id, stem_text); without a key every stem counts. Adds ``strip_status``: changed, guarded or same.
    """
    full = spans.where(F.col("origin") == "full")
    keys = [key] if key else []
    ranges = strip_ranges(full, stems, min_match, "id", "stem_id", "context", "stem_text", keys)
    after = F.when((F.col("origin") == "full") & F.col("ranges").isNotNull(), blank_ranges(F.col("context"), F.col("ranges")))
    gold_end = F.col("answer_end") - F.col("answer_start") + 1
    gold = F.substring(F.col("_after"), F.col("answer_start") + 1, gold_end)
    erased = (
        (F.col("answer_start") >= 0)
        & (F.col("answer_end") > F.col("answer_start"))
        & (F.btrim(gold, F.lit(fixed.whitespace())) == "")
    )
    same = F.col("_after").isNull() | (F.col("_after") == F.col("context"))
    status = F.when(same, "same").when(erased, "guarded").otherwise("changed")
    return (
        spans.join(ranges, "id", "left")
        .withColumn("_after", after)
        .withColumn("strip_status", status)
        .withColumn("context", F.when(F.col("strip_status") == "changed", F.col("_after")).otherwise(F.col("context")))
        .drop("ranges", "_after")
    )


def in_stem(hit: Column, stem: Column, k: int = fixed.MIN_STEM_MATCH) -> Column:
    """Whether a hit comes from the stem, allowing one or two of its edge characters to differ."""
    inside = F.instr(stem, hit) > 0
    for cut in (1, 2):
        head = F.substring(hit, F.lit(1), F.length(hit) - cut)
        tail = F.substring(hit, F.lit(cut + 1), F.length(hit))
        long_enough = F.length(hit) > k + cut
        inside = inside | (long_enough & ((F.instr(stem, head) > 0) | (F.instr(stem, tail) > 0)))
    return F.coalesce(inside & (stem != ""), F.lit(False))


def reference_grams(refs: Column, k: int = fixed.MIN_STEM_MATCH) -> Column:
    """The normalised k-grams of each reference. Made once per question, before references meet answers."""
    return F.transform(refs, lambda r: F.array_distinct(kgrams(norm_stem(F.coalesce(r, F.lit(""))), k)))


def first_shared(text: Column, refs: Column, grams_of_refs: Column, k: int, usable=lambda hit: F.lit(True)) -> Column:
    """struct(ref, hit) of the first reference sharing >= k normalised characters, else null.

    The text's k-grams are looked up once among those of all references. Without one in common nothing else is done; a
    reference without one is passed over, and in the others only places with one are searched for.
    """

    def search(norm_text: Column) -> Column:
        def compared(shared: Column) -> Column:
            def with_hit(r: Column) -> Column:
                hit = let(norm_stem(r["ref"]), lambda norm_ref: longest_common(norm_text, norm_ref, k, shared))
                met = F.arrays_overlap(r["grams"], shared)
                return F.struct(r["ref"].alias("ref"), F.when(met, hit).otherwise("").alias("hit"))

            pairs = F.zip_with(refs, grams_of_refs, lambda ref, g: F.struct(ref.alias("ref"), g.alias("grams")))
            found = F.filter(F.transform(pairs, with_hit), lambda s: (s["hit"] != "") & usable(s["hit"]))
            return F.when(F.size(shared) > 0, F.get(found, F.lit(0)))

        return let(shared_grams(norm_text, F.flatten(grams_of_refs), k), compared)

    return let(norm_stem(text), search)


def _grams_of(refs: str, grams: str | None, k: int) -> Column:
    return F.col(grams) if grams else reference_grams(F.col(refs), k)


def classify_fp(
    points: DataFrame, span: str = "extracted_span", refs: str = "refs", k: int = fixed.MIN_STEM_MATCH, grams: str | None = None
) -> DataFrame:
    """Why a wrongly credited point was credited: copied from a reference, or said in other words.

    ``grams`` names a column of `reference_grams`, for references that many rows have.
    """
    shared = first_shared(F.coalesce(F.col(span), F.lit("")), F.col(refs), _grams_of(refs, grams, k), k)
    return (
        points.withColumn("_s", shared)
        .withColumn("category", F.when(F.col("_s").isNotNull(), "verbatim-leak").otherwise("semantic-discussion"))
        .withColumn("hit", F.coalesce(F.col("_s.hit"), F.lit("")))
        .drop("_s")
    )


def leak_scan(
    spans: DataFrame,
    context: str = "context",
    refs: str = "refs",
    stem: str = "stem",
    k: int = fixed.MIN_STEM_MATCH,
    grams: str | None = None,
) -> DataFrame:
    """Rows whose context repeats >= k characters of one of their references, not explained by the stem.

    Give it the unanswerable full-answer rows. References are short, so the search stays in the row and no text is
    shuffled. ``grams`` names a column of `reference_grams`, for references that many rows have.
    """
    stem_norm = norm_stem(F.coalesce(F.col(stem), F.lit("")))
    shared = first_shared(
        F.col(context), F.col(refs), _grams_of(refs, grams, k), k, lambda hit: ~in_stem(hit, F.col("_stem"), k)
    )
    # a generator, so that no filter makes the search run twice
    hits = F.inline(F.filter(F.array(shared), lambda s: s.isNotNull()))
    return spans.withColumn("_stem", stem_norm).select(*spans.columns, hits)


def whole_candidates(shared: DataFrame, right: DataFrame, k: int, left_id: str, text: str = "norm") -> DataFrame:
    """(left_id, _whole): the right texts of at least k characters that a left text may hold whole; never misses one.

    ``shared`` has the `sharing_grams` of the left texts.
    Each right text is looked for by its rarest gram alone, so grams that many texts share bring no pairs.
    """
    texts = right.where(F.length(text) >= k).select(F.col(text).alias("_whole")).distinct()
    taken = grams(texts, ["_whole"], "_whole", k, place="j").groupBy("_whole", "gram").agg(F.min("j").alias("j"))
    counted = taken.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min_by(F.struct("gram", "j"), F.struct("_n", "gram")).alias("_r")
    keyed = taken.join(counted, "gram").groupBy("_whole").agg(rarest).select("_whole", "_r.gram")
    return shared.select(left_id, "gram").join(_joined_side(keyed, right), "gram").select(left_id, "_whole").distinct()


def containing(left: DataFrame, right: DataFrame, k: int, left_id: str, text: str = "norm") -> DataFrame:
    """(left_id) of left texts that hold a whole right text of at least k characters."""
    pairs = whole_candidates(sharing_grams(left, right, k, left_id, text), right, k, left_id, text)
    held = left.join(pairs, left_id).where(F.contains(F.col(text), F.col("_whole")))
    return held.select(left_id).distinct()


def overlap_report(
    own: DataFrame, external: DataFrame, own_id: str, external_id: str, text: str, k: int
) -> DataFrame:
    """Per external text: equal to an own text, contained in or containing one, or sharing >= k characters."""
    mine = own.select(own_id, dedup_key(F.col(text)).alias("norm"))
    theirs = external.select(external_id, dedup_key(F.col(text)).alias("norm"))
    equal = mine.select("norm").distinct().withColumn("_exact", F.lit(True))
    # an external text inside an own one matches from its beginning to its end
    from_start = F.max(F.when(F.col("i") == 0, F.col("run_end"))).alias("_from_start")
    # joins by id follow in one of the two uses only; a condition that they add there would make the shuffle another one
    known = theirs.where(F.col(external_id).isNotNull())
    parts = int(external.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = sharing_grams(known, mine, k, external_id, after=SPAN + 1, parts=parts)
    longest = longest_matches(theirs, mine, k, external_id, shared=shared)
    sized = longest.groupBy(external_id).agg(F.max(F.col("run_end") - F.col("i")).alias("_lcs"), from_start)
    met = sized.join(whole_candidates(shared, mine, k, external_id), external_id, "left")
    contained = (F.col("_from_start") == F.length("norm")) | F.contains(F.col("norm"), F.col("_whole"))
    kinds = (
        theirs.join(met, external_id, "left")
        .join(equal, "norm", "left")
        .where(F.col("_exact") | F.col("_lcs").isNotNull())
        .groupBy(external_id)
        .agg(F.max("_exact").alias("_exact"), F.max("_lcs").alias("_lcs"), F.max(contained).alias("_contained"))
    )
    exact = F.col("_exact").isNotNull()
    kind = F.when(exact, "exact").when(F.col("_contained"), "containment").otherwise("shared").alias("overlap")
    return kinds.select(external_id, kind, F.when(~exact, F.col("_lcs")).alias("lcs_len"))
