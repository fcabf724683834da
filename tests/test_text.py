"""Expressions against plain Python on random short strings."""

import random
from collections import Counter

from pyspark.sql import functions as F

from markbook.functions import fixed, scores, text


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_normalisers_match_character_rules(spark):
    rng = random.Random(1)
    alphabet = "abXY 19，。①⑴０％Ａ～é　\n$^ß𠀀"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 20))) for _ in range(200)]
    df = _rows(spark, [(t,) for t in texts], "t string").select(
        "t",
        text.norm_metric(F.col("t")).alias("metric"),
        text.norm_stem(F.col("t")).alias("stem"),
        text.norm_stem(F.col("t"), True).alias("digits"),
        text.norm_with_map(F.col("t")).alias("align"),
        text.dedup_key(F.col("t")).alias("key"),
    )
    metric, stem, align = set(fixed.metric_drop()), set(fixed.stem_drop()), set(fixed.align_drop())
    fold = dict(zip(*fixed.fold_table()))
    for r in df.collect():
        t = r["t"]
        assert r["metric"] == "".join(c for c in t if c not in metric)
        assert r["stem"] == "".join(c.lower() if c.isascii() else c for c in t if c not in stem)
        assert ("1" in r["digits"]) == ("1" in t)
        kept = [i for i, c in enumerate(t) if c not in align]
        assert list(r["align"]["idx"]) == kept
        assert r["align"]["text"] == "".join(fold.get(t[i], t[i]) for i in kept)
        assert r["key"] == "".join(t.split())


def test_fold_is_width_and_case(spark):
    got = _rows(spark, [("ＡＢ５０％ Opec",)], "t string").select(text.norm_align(F.col("t"))).first()[0]
    assert got == "ab50opec"


def test_char_f1_and_exact_match_against_counting(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("甲乙a，b ", k=rng.randint(0, 8))), "".join(rng.choices("甲乙a，b ", k=rng.randint(0, 8)))) for _ in range(200)]
    df = _rows(spark, pairs, "p string, g string")
    drop = set(fixed.metric_drop())
    for r in df.select("*", text.char_f1(F.col("p"), F.col("g")).alias("f1"), text.exact_match(F.col("p"), F.col("g")).alias("em")).collect():
        p, g = ("".join(c for c in r[k] if c not in drop) for k in ("p", "g"))
        common = sum((Counter(p) & Counter(g)).values())
        want = 2 * common / (len(p) + len(g)) if p and g else 0.0
        assert abs(r["f1"] - want) < 1e-12
        assert r["em"] == int(bool(p) and p == g)


def test_trim_span(spark):
    cases = [("发生在1898年，", "发生在1898年"), ("。又称百日维新。", "又称百日维新"), ("  （戊戌变法）  ", "戊戌变法"), ("，。", "，。")]
    df = _rows(spark, cases, "s string, want string")
    assert df.where(text.trim_span(F.col("s")) != F.col("want")).count() == 0


def test_mask_ranges_clips_and_keeps_length(spark):
    df = _rows(spark, [("ABXYZ", [(0, 1)]), ("ABXYZ", [(3, 9)]), ("", [(0, 1)])], "t string, r array<struct<start:int,end:int>>")
    got = [r[0] for r in df.select(text.mask_ranges(F.col("t"), F.col("r"))).collect()]
    assert got == ["  XYZ", "ABX  ", ""]


def test_aliases_sentences_effective_text(spark):
    df = _rows(spark, [("a， b,,c ", "短。这是一个句子，另一个长句子！", None, "typed")], "a string, s string, o string, t string")
    r = df.select(
        text.split_aliases(F.col("a")), text.sentences(F.col("s")), text.answer_text(F.col("o"), F.col("t"))
    ).first()
    assert list(r[0]) == ["a", "b", "c"]
    assert list(r[1]) == ["这是一个句子", "另一个长句子"]
    assert r[2] == "typed"


def _segments(t, details):
    marks = []
    for d in details:
        span = d[2]
        at = t.find(span) if span else -1
        while at >= 0:
            marks.append((at, len(marks), at + len(span), d[1], d[0]))
            at = t.find(span, at + len(span))
    out, cursor = [], 0
    for start, _, end, status, point in sorted(marks):
        if start < cursor:
            continue
        if start > cursor:
            out.append((t[cursor:start], None, None))
        out.append((t[start:end], status, point))
        cursor = end
    if cursor < len(t):
        out.append((t[cursor:], None, None))
    return out


def test_highlight_segments_against_scan(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(150):
        t = "".join(rng.choices("ab.\\E", k=rng.randint(0, 14)))
        details = [(i, "hit_exact", "".join(rng.choices("ab.\\E", k=rng.randint(0, 3)))) for i in range(rng.randint(0, 3))]
        cases.append((t, details))
    df = _rows(spark, cases, "t string, d array<struct<point_id:bigint,hit_status:string,extracted_span:string>>")
    for r in df.select("t", "d", text.highlight_segments(F.col("t"), F.col("d")).alias("s")).collect():
        assert [tuple(s) for s in r["s"]] == _segments(r["t"], [tuple(d) for d in r["d"]])


def test_longest_common_against_all_substrings(spark):
    rng = random.Random(4)
    cases = [("".join(rng.choices("ab", k=rng.randint(0, 14))), "".join(rng.choices("ab", k=rng.randint(0, 10)))) for _ in range(300)]
    df = _rows(spark, cases, "t string, r string").select("t", "r", text.longest_common(F.col("t"), F.col("r"), 3).alias("hit"))
    for r in df.collect():
        t, ref = r["t"], r["r"]
        found = [t[i:j] for i in range(len(t)) for j in range(i + 3, len(t) + 1) if t[i:j] in ref]
        longest = max(map(len, found), default=0)
        want = next((f for f in found if len(f) == longest), "")
        assert r["hit"] == want


def test_numbers_ratings_buckets(spark):
    df = _rows(spark, [(9.0, 10.0), (7.5, 10.0), (6.0, 10.0), (5.9, 10.0), (1.0, 0.0), (10.0, 10.0), (2.0, 5.0)], "s double, m double")
    got = [tuple(r) for r in df.select(scores.rating(F.col("s"), F.col("m")), scores.ratio_bucket(scores.ratio(F.col("s"), F.col("m")))).collect()]
    assert got == [("excellent", 4), ("good", 3), ("pass", 3), ("fail", 2), ("fail", 0), ("excellent", 4), ("fail", 2)]
    bad = _rows(spark, [("1.5",), ("x",), (None,)], "v string").select(scores.safe_num(F.col("v"))).collect()
    assert [r[0] for r in bad] == [1.5, None, None]
    r = _rows(spark, [(0.125, 1.7, -2.0)], "a double, b double, c double").select(
        scores.half_even(F.col("a"), 2), scores.clamp(F.col("b"), 0.0, 1.0), scores.clamp(F.col("c"), 0.0, 1.0)
    ).first()
    assert tuple(r) == (0.12, 1.0, 0.0)


def test_cosine_and_guarded_pearson(spark):
    df = _rows(spark, [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(scores.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    data = _rows(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert abs(data.agg(scores.pearson(F.col("x"), F.col("y"))).first()[0] - 1) < 1e-12
    assert data.agg(scores.pearson(F.lit(1.0), F.col("y"))).first()[0] == 0.0
    assert data.limit(1).agg(scores.pearson(F.col("x"), F.col("y"))).first()[0] == 0.0


def test_long_texts_with_many_characters_stay_cheap(spark):
    import time

    wide = "".join(chr(0x4E00 + i * 7 % 3000) for i in range(80_000))
    noise = "".join(chr(0x4E00 + i * i % 997) for i in range(20_000))
    copied = "".join(chr(0x5E00 + i) for i in range(400))
    rows = [(wide, wide[::-1], noise[:9000] + copied + noise[9000:], copied)]
    df = spark.createDataFrame(rows, "a string, b string, t string, r string")
    out = df.select(text.char_f1(F.col("a"), F.col("b")).alias("f1"), text.longest_common(F.col("t"), F.col("r"), 8).alias("hit"))
    out.first()
    start = time.perf_counter()
    assert tuple(out.first()) == (1.0, copied)
    assert time.perf_counter() - start < 10


def test_a_leak_in_a_long_text_is_found_fast(spark):
    import time

    from markbook.operators import overlap

    noise = "".join(chr(0x4E00 + i * i % 997) for i in range(20_000))
    copied = "".join(chr(0x5E00 + i) for i in range(400))
    rows = [(noise[:9000] + copied + noise[9000:], ["nothing of it", copied + "more", noise[:5]])]
    one = spark.createDataFrame(rows, "t string, refs array<string>").cache()
    shared = overlap.first_shared(F.col("t"), F.col("refs"), overlap.reference_grams(F.col("refs")), 8)
    one.select(shared.alias("s")).first()
    for n in (1, 41):  # the difference is forty texts, without what a job costs
        many = one.crossJoin(spark.range(0, n, 1, 1)).select(F.length(shared["hit"]).alias("n"))
        start = time.perf_counter()
        assert many.agg(F.min("n")).first()[0] == 400
        spent = time.perf_counter() - start
        first = spent if n == 1 else first
    assert (spent - first) / 40 < 0.1


def test_longest_common_with_shared_grams(spark):
    rng = random.Random(14)
    cases = [("".join(rng.choices("abc", k=rng.randint(0, 40))), "".join(rng.choices("abc", k=rng.randint(0, 25)))) for _ in range(300)]
    t, r = F.col("t"), F.col("r")
    shared = text.shared_grams(t, text.kgrams(r, 3, piece=4), 3, block=7)
    df = _rows(spark, cases, "t string, r string")
    got = df.select(t, r, text.longest_common(t, r, 3).alias("want"), text.longest_common(t, r, 3, shared).alias("hit"), shared.alias("s")).collect()
    for row in got:
        assert row.hit == row.want
        assert set(row.s) == {row.t[i : i + 3] for i in range(len(row.t) - 2)} & {row.r[i : i + 3] for i in range(len(row.r) - 2)}


def test_longest_common_like_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 20)))) for _ in range(150)]
    got = spark.createDataFrame(rows, "t string, r string").select("t", "r", text.longest_common(F.col("t"), F.col("r"), 3).alias("hit")).collect()
    for t, r, hit in got:
        found = {r[i:j] for i in range(len(r)) for j in range(i + 3, len(r) + 1) if r[i:j] in t}
        assert hit == min(found, key=lambda x: (-len(x), t.find(x)), default="")


def test_common_chars_by_counting_and_by_sorting(spark, monkeypatch):
    rng = random.Random(9)
    wide = "".join(chr(0x4E00 + i) for i in range(90)) + "𠀀ab"
    rows = [("".join(rng.choices(a, k=400)), "".join(rng.choices(b, k=300))) for a in (wide, wide[-40:]) for b in (wide, wide[-40:]) for _ in range(20)]

    def scored(pairs):
        found = [r[0] for r in _rows(spark, pairs, "p string, g string").select(text.char_f1(F.col("p"), F.col("g"))).collect()]
        for (p, g), f1 in zip(pairs, found, strict=True):
            assert abs(f1 - 2 * sum((Counter(p) & Counter(g)).values()) / (len(p) + len(g))) < 1e-12

    scored(rows)
    # no text is sorted for a gold text of few different characters
    monkeypatch.setattr(text, "_numbered_chars", lambda t: F.array(F.raise_error(F.concat(F.lit("sorted: "), t)).cast("string")))
    scored([r for r in rows if len(set(r[1])) <= 40])
