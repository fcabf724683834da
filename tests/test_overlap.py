"""Shared substrings, stem stripping and alignment against brute force."""

import difflib
import random
import re

from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.operators import align, overlap

POEM = "阅读下面这首宋词，完成下列各题。 鹊桥仙 陆游 华灯纵博，雕鞍驰射，谁记当年豪举①？镜湖元自属闲人，又何必君恩赐与③。"


def _lcs(a, b):
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)


def test_lcs_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    left = [(i, "".join(rng.choices("abc", k=rng.randint(0, 16)))) for i in range(60)]
    right = [(i, "".join(rng.choices("abc", k=rng.randint(0, 12)))) for i in range(40)]
    got = overlap.lcs_pairs(
        spark.createDataFrame(left, "l int, text string"), spark.createDataFrame(right, "r int, text string"), 4, "l", "r"
    )
    want = {(i, j, _lcs(a, b)) for i, a in left for j, b in right if _lcs(a, b) >= 4}
    assert {tuple(r) for r in got.collect()} == want


def test_shuffled_gram_join_gives_the_same(spark, monkeypatch):
    rng = random.Random(15)
    left = spark.createDataFrame([(i, "".join(rng.choices("abc", k=14))) for i in range(30)], "l int, text string")
    right = spark.createDataFrame([(i, "".join(rng.choices("abc", k=12))) for i in range(30)], "r int, text string")
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 1 << 62)
    small = {tuple(r) for r in overlap.lcs_pairs(left, right, 4, "l", "r").collect()}
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 0)
    large = overlap.lcs_pairs(left, right, 4, "l", "r")
    assert "SortMergeJoin" in large._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in large.collect()} == small


def _longest(left, right, k):
    return {
        (i, p): p + n
        for i, a in left
        for p in range(len(a))
        if (n := max((n for n in range(k, len(a) - p + 1) if any(a[p : p + n] in b for _, b in right)), default=0))
    }


def test_longest_matches_equal_brute_force(spark, monkeypatch):
    rng = random.Random(25)
    monkeypatch.setattr(overlap, "SPAN", 3)  # continuations are cut, so long matches go the second way
    left = [(i, "".join(rng.choices("ab", k=rng.randint(0, 30)))) for i in range(80)]
    right = [(i, "".join(rng.choices("ab", k=rng.randint(0, 20)))) for i in range(40)]
    dfs = spark.createDataFrame(left, "l int, norm string"), spark.createDataFrame(right, "r int, norm string")
    want = _longest(left, right, 3)
    for listed in (1, 16):
        monkeypatch.setattr(overlap, "LISTED", listed)
        got = overlap.longest_matches(*dfs, 3, "l").collect()
        assert {(r.l, r.i): r.run_end for r in got} == want and len(got) == len(want)


def test_a_gram_in_every_text_gives_rows_in_proportion(spark, monkeypatch):
    """Each of n documents and n references has the same twelve characters: no step makes n * n rows."""
    monkeypatch.setattr(overlap, "SALTS", 4)
    n, rng = 200, random.Random(26)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    left = [(i, word() + "COMMONPHRASE" + word()) for i in range(n)]
    right = [(i, word() + "COMMONPHRASE" + word()) for i in range(n)]
    dfs = spark.createDataFrame(left, "l int, norm string"), spark.createDataFrame(right, "r int, norm string")
    got = overlap.longest_matches(*dfs, 10, "l")
    assert {(r.l, r.i): r.run_end for r in got.collect()} == _longest(left, right, 10)
    rows = [int(r) for r in re.findall(r"number of output rows: ([\d,]+)", _metrics(got)) for r in [r.replace(",", "")]]
    assert rows and max(rows) <= 30 * n  # 26 short and 21 long grams a text; SALTS copies of the continuations of some of them


def _metrics(df):
    """Row counts of every node of the plan that just ran."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(f"number of output rows: {metric.get().value()}")
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return "\n".join(found)


def test_no_job_while_planning(spark):
    left = spark.createDataFrame([(1, "abcdefgh")], "l int, text string")
    right = spark.createDataFrame([(1, "xbcdefgx")], "r int, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    overlap.lcs_pairs(left, right, 4, "l", "r").explain()
    spark.sparkContext.setJobGroup("other", "other")
    assert not tracker.getJobIdsForGroup("planning")


def test_lcs_pairs_over_long_texts_cut_into_pieces(spark):
    rng = random.Random(6)
    shared = "".join(rng.choices("xyz", k=700))
    long_text = "".join(rng.choices("ab", k=1000)) + shared + "".join(rng.choices("ab", k=800))
    got = overlap.lcs_pairs(
        spark.createDataFrame([(1, long_text)], "l int, text string"),
        spark.createDataFrame([(1, "q" + shared + "q")], "r int, text string"),
        24,
        "l",
        "r",
    ).first()
    assert got["lcs_len"] == 700


def _strip(answer, stems, k, drop):
    kept = [i for i, c in enumerate(answer) if c not in drop]
    norm = "".join(answer[i].lower() for i in kept)
    stems = ["".join(c.lower() for c in s if c not in drop) for s in stems]
    out, i = list(answer), 0
    while i < len(norm):
        best = max((n for n in range(k, len(norm) - i + 1) if any(norm[i : i + n] in s for s in stems)), default=0)
        for p in kept[i : i + best]:
            out[p] = " "
        i += best or 1
    return "".join(out)


def test_strip_stems_equals_greedy_scan(spark):
    rng = random.Random(7)
    answers = [(i, i % 5, "".join(rng.choices("ab,", k=rng.randint(0, 24)))) for i in range(150)]
    stems = [(i, i % 5, "".join(rng.choices("ab ", k=rng.randint(0, 14)))) for i in range(15)]
    got = overlap.strip_stems(
        spark.createDataFrame(answers, "answer_id int, q int, answer_text string"),
        spark.createDataFrame(stems, "stem_id int, q int, stem_text string"),
        3,
        keys=["q"],
    )
    drop = set(fixed.stem_drop())
    want = {i: _strip(t, [s for _, sq, s in stems if sq == q], 3, drop) for i, q, t in answers}
    assert {r["answer_id"]: r["stripped_text"] for r in got.collect()} == want


def test_strip_long_answers_piece_by_piece(spark):
    rng = random.Random(16)
    stem = "".join(rng.choices("mnop", k=300))
    answers = []
    for i in range(12):
        base = "".join(rng.choices("ab", k=rng.randint(200, 900)))
        at = rng.randint(0, len(base))
        answers.append((i, 1, base[:at] + stem[i * 20 : i * 20 + 9 + i] + base[at:]))
    got = overlap.strip_stems(
        spark.createDataFrame(answers, "answer_id int, q int, answer_text string"),
        spark.createDataFrame([(1, 1, stem)], "stem_id int, q int, stem_text string"),
        8,
        keys=["q"],
    )
    drop = set(fixed.stem_drop())
    assert {r["answer_id"]: r["stripped_text"] for r in got.collect()} == {i: _strip(t, [stem], 8, drop) for i, _, t in answers}


def _stripped(spark, answer, stems, **more):
    a = spark.createDataFrame([(1, answer)], "answer_id int, answer_text string")
    s = spark.createDataFrame(list(enumerate(stems)), "stem_id int, stem_text string")
    return overlap.strip_stems(a, s, **more).first()["stripped_text"]


def test_strip_stems_on_real_wording(spark):
    answer = "“镜湖元自属闲人，又何必君恩赐与！”这表达了作者的归隐之意。"
    out = _stripped(spark, answer, [POEM])
    assert "镜湖元自属闲人" not in out and "归隐之意" in out and len(out) == len(answer)
    short = "环境污染问题不容忽视，应当推广绿色包装。"
    stem = "随着电子商务的快速发展，由快递业带来的环境污染问题也日益显现。"
    assert _stripped(spark, short, [stem]) == short
    assert _stripped(spark, "任何答案", ["短"]) == "任何答案"
    assert _stripped(spark, "", [POEM]) == ""
    folded = _stripped(spark, "AD1911 revolution OF china 起义", ["A.D. 1911 Revolution of China"])
    assert "revolution" not in folded and "起义" in folded


def test_digits_may_be_kept(spark):
    stem, answer = "abcdef12xyz", "abcdef34xyz"
    assert _stripped(spark, answer, [stem]) != answer
    assert _stripped(spark, answer, [stem], keep_digits=True) == answer


def test_strip_training_rows_guards_gold(spark):
    spans = spark.createDataFrame(
        [
            ("i#full#p1", 1, "full", "abcdefghij rest of it", 0, 5),
            ("i#full#p2", 1, "full", "abcdefghij rest of it", 12, 15),
            ("i#s1#p1", 1, "fragment", "abcdefghij rest of it", 12, 15),
        ],
        "id string, question_id int, origin string, context string, answer_start int, answer_end int",
    )
    stems = spark.createDataFrame([(1, 1, "xx abcdefghij yy")], "question_id int, stem_id int, stem_text string")
    got = {r["id"]: (r["strip_status"], r["context"]) for r in overlap.strip_training_rows(spans, stems).collect()}
    assert got["i#full#p1"] == ("guarded", "abcdefghij rest of it")
    assert got["i#full#p2"] == ("changed", " " * 10 + " rest of it")
    assert got["i#s1#p1"][0] == "same"


def test_leaks_and_attribution(spark):
    rows = spark.createDataFrame(
        [
            ("leak", "他写道：推动了思想解放的潮流向前", ["甲", "推动了思想解放的潮流"], ""),
            ("stem", "他写道：推动了思想解放的潮流向前", ["推动了思想解放的潮流啊"], "材料：推动了思想解放的潮流"),
            ("none", "完全不同的回答内容在这里", ["推动了思想解放的潮流"], ""),
        ],
        "id string, context string, refs array<string>, stem string",
    )
    got = [(r["id"], r["hit"]) for r in overlap.leak_scan(rows).collect()]
    assert got == [("leak", "推动了思想解放的潮流")]
    fps = overlap.classify_fp(rows.withColumnRenamed("context", "extracted_span")).select("id", "category").collect()
    assert {r["id"]: r["category"] for r in fps} == {"leak": "verbatim-leak", "stem": "verbatim-leak", "none": "semantic-discussion"}


def test_in_stem_allows_two_edge_characters(spark):
    df = spark.createDataFrame(
        [("abcdefghij", "abcdefghijkl"), ("abcdefghijXX", "zabcdefghijz"), ("XXabcdefghi", "abcdefghi"), ("XXXabcdefghi", "abcdefghi"), ("abcdefgh", "")],
        "hit string, stem string",
    )
    assert [r[0] for r in df.select(overlap.in_stem(F.col("hit"), F.col("stem"))).collect()] == [True, True, True, False, False]


def test_align_tiers(spark):
    cases = [
        ("学生认为戊戌变法促进了思想启蒙", "戊戌变法", (4, 8, "exact")),
        ("甲说A，乙再说A", "A", (2, 3, "exact")),
        ("任何答案", "   ", None),
        ("完全不同的内容", "ABC", None),
        ("他答：促进了思想启蒙，有利于社会进步。", "促进了思想启蒙 有利于社会进步", (3, 18, "fuzzy")),
        ("增长率为５０％以上", "50%", (4, 6, "fuzzy")),
        ("采用OPEC机制增产", "opec", (2, 6, "fuzzy")),
        ("一二三四五六七八九", "六七八九十一二三", None),
        ("经济重心南移", "政治制度变革", None),
        ("维新派主张设制度局", "设制度局", (5, 9, "exact")),
    ]
    df = spark.createDataFrame([(i, a, s) for i, (a, s, _) in enumerate(cases)], "i int, answer_text string, extracted_span string")
    got = {r["i"]: r["align"] for r in align.align_spans(df).collect()}
    for i, (answer, _, want) in enumerate(cases):
        a = got[i]
        assert (a and (a["start"], a["end"], a["strategy"])) == want
        assert a is None or a["matched_text"] == answer[a["start"] : a["end"]]


def test_align_blocks_equal_difflib(spark):
    rng = random.Random(8)
    cases = []
    for i in range(150):
        a = "".join(rng.choices("abcd", k=rng.randint(4, 20)))
        s = "".join(c for c in a[2:12] if rng.random() < 0.8) + rng.choice(["", "d", "ca"])
        cases.append((i, a, s))
    df = spark.createDataFrame(cases, "i int, answer_text string, extracted_span string")
    for r in align.align_spans(df).collect():
        a, s = r["answer_text"], r["extracted_span"]
        if not s or s in a:
            continue
        blocks = difflib.SequenceMatcher(None, a, s, autojunk=False).get_matching_blocks()
        longest = max(blocks, key=lambda b: b.size)
        ok = sum(b.size for b in blocks) >= max(2.0, 0.6 * len(s)) and longest.size >= 2
        assert (r["align"] is not None) == ok
        if ok:
            assert (r["align"]["start"], r["align"]["end"], r["align"]["strategy"]) == (longest.a, longest.a + longest.size, "lcs")


def test_align_report_counts(spark):
    df = spark.createDataFrame(
        [("abcd", "bc", True), ("abcd", "B.C", True), ("abcd", "zz", True), ("abcd", "", False)],
        "answer_text string, extracted_span string, hit boolean",
    )
    r = align.align_report(align.align_spans(df)).first()
    assert (r["hit_points"], r["aligned"], r["exact"], r["fuzzy"], r["lcs"]) == (3, 2, 1, 1, 0)


def test_overlap_report_kinds(spark):
    own = spark.createDataFrame([(1, "the same text here"), (2, "a longer text holding inner words inside")], "o int, t string")
    ext = spark.createDataFrame([(1, "the  same text here"), (2, "holding inner words"), (3, "words of their own"), (4, "xx holding inner yy zz")], "e int, t string")
    got = {r["e"]: r["overlap"] for r in overlap.overlap_report(own, ext, "o", "e", "t", 8).collect()}
    assert got == {1: "exact", 2: "containment", 4: "shared"}


def test_grams_are_those_of_the_text(spark):
    """Texts around the ends of slices and pieces, in one to four bytes a character."""
    rng = random.Random(5)
    lengths = (1, 7, 8, 9, 31, 32, 33, 39, 40, 64, 255, 256, 257, 263, 264, 265, 520)
    texts = [None, "", *["".join(rng.choice("ab\u4eac\u00e9\U0001d11e") for _ in range(n)) for n in lengths]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, norm string")
    for size, step, after in ((4, 5, 0), (8, 1, 127), (68, 68, 0), (8, 3, 5)):
        want = []
        for i, t in enumerate(texts):
            for o in range(0, len(t or "") - size + 1, step):
                want.append((i, o, t[o : o + size], *((t[o - 1 : o] if o else "", t[o + size : o + size + after]) if after else ())))
        assert sorted(map(tuple, overlap.grams(df, ["id"], "norm", size, step, after=after).collect())) == want


def test_grams_are_cut_from_slices(spark):
    """Grams come from numbers, so Spark compiles them, and a text is normalised once, not in a filter before a shuffle too."""
    df = spark.range(3).select("id", F.lit("x" * 600).alias("text")).repartition(2, "id").select("id", F.translate("text", "x", "yz").alias("norm"))
    plan = overlap.grams(df, ["id"], "norm", 8)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" not in plan and plan.count("explode(sequence(") == 2
    assert all("translate" not in line for line in plan.split("RepartitionByExpression")[1].splitlines())


def test_stripping_does_not_normalise_twice(spark):
    """The scan of the answers passes texts on as they are, for training rows too."""
    rows = [(i, "full", "the quick brown fox jumps %d" % i, 0, 5) for i in range(4)]
    spans = spark.createDataFrame(rows, "id int, origin string, context string, answer_start int, answer_end int").repartition(2, "id")
    stems = spark.createDataFrame([(1, "quick brown fox")], "stem_id int, stem_text string")
    plan = overlap.strip_training_rows(spans, stems, 8, None)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "translate(context" in line]
    assert "RepartitionByExpression" in plan and not filters


def test_sharing_grams_misses_none(spark, monkeypatch):
    """Left k-grams that a right text has are all there, once, with the characters around them; in small pieces, with ends everywhere."""
    rng = random.Random(31)
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 1 << 100)
    left = [(i, "".join(rng.choices("abc\u4eac\U0001d11e", (4, 4, 1, 1, 1), k=rng.randint(0, 120)))) for i in range(60)]
    right = [(i, left[i][1][i : i + 25]) for i in range(0, 60, 4)]
    dfs = spark.createDataFrame([*left, (60, None)], "l int, norm string"), spark.createDataFrame([*right, (1, None)], "r int, norm string")
    for piece, of_slice in ((20, 8), (256, 32)):
        monkeypatch.setattr(overlap, "PIECE", piece)
        monkeypatch.setattr(overlap, "SLICE", of_slice)
        for k, after, parts in ((6, 1, None), (7, 9, 3)):
            got = overlap.sharing_grams(*dfs, k, "l", after=after, parts=parts).select("l", "i", "gram", "before", "tail").collect()
            texts = dict(left)
            for r in got:
                t = texts[r.l]
                assert (r.gram, r.before, r.tail) == (t[r.i : r.i + k], t[max(r.i - 1, 0) : r.i], t[r.i + k : r.i + k + after]) and len(r.gram) == k
            want = {(i, p) for i, t in left for p in range(len(t) - k + 1) if any(t[p : p + k] in s for _, s in right)}
            assert want and want <= {(r.l, r.i) for r in got} and len({(r.l, r.i) for r in got}) == len(got)


def test_longest_matches_of_small_and_large_references_and_of_keys(spark, monkeypatch):
    """The same positions if the references are broadcast or shuffled, and per key."""
    rng = random.Random(32)
    monkeypatch.setattr(overlap, "SPAN", 3)
    left = [(i, i % 2, "".join(rng.choices("ab", k=rng.randint(0, 30)))) for i in range(40)]
    right = [(i, i % 2, "".join(rng.choices("ab", k=rng.randint(0, 20)))) for i in range(20)]
    dfs = spark.createDataFrame(left, "l int, q int, norm string"), spark.createDataFrame(right, "r int, q int, norm string")
    by_key = {}
    for q in (0, 1):
        by_key |= _longest([(i, t) for i, p, t in left if p == q], [(i, t) for i, p, t in right if p == q], 3)
    got = overlap.longest_matches(*dfs, 3, "l", keys=["q"]).collect()
    assert {(r.l, r.i): r.run_end for r in got} == by_key and len(got) == len(by_key)
    want = _longest([(i, t) for i, _, t in left], [(i, t) for i, _, t in right], 3)
    for size, listed in ((0, 16), (1 << 100, 1), (1 << 100, 16)):
        monkeypatch.setattr(overlap, "BROADCAST_BYTES", size)
        monkeypatch.setattr(overlap, "LISTED", listed)
        got = overlap.longest_matches(*dfs, 3, "l").collect()
        assert {(r.l, r.i): r.run_end for r in got} == want and len(got) == len(want)


def _passes(df):
    """How often the plan that ran made the rows of a range; shuffles that are used again count once."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Range (")


def test_training_rows_are_cut_once(spark, monkeypatch):
    """One pass over the texts finds the matches, one strips them."""
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 1 << 100)
    text = F.concat(F.lit("the quick brown fox jumps "), F.col("id").cast("string")).alias("context")
    spans = spark.range(50).select("id", F.lit("full").alias("origin"), text, F.lit(0).alias("answer_start"), F.lit(5).alias("answer_end"))
    stems = spark.createDataFrame([(1, "quick brown fox")], "stem_id int, stem_text string")
    out = overlap.strip_training_rows(spans, stems, 8, None)
    assert _passes(out) == 2
    assert {r["context"][:19] for r in out.collect()} == {"the                "}


def test_overlap_report_reads_texts_twice(spark, monkeypatch):
    """One pass finds what is shared, for both uses, one compares whole texts."""
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", 1 << 100)
    text = F.concat(F.lit("holding inner words "), F.col("id").cast("string")).alias("t")
    own = spark.createDataFrame([(1, "holding inner words 7"), (2, "a longer text holding inner words inside"), (3, "inner words 3")], "o int, t string")
    out = overlap.overlap_report(own, spark.range(50).select(F.col("id").alias("e"), text), "o", "e", "t", 8)
    assert _passes(out) == 2
    got = {r["e"]: r["overlap"] for r in out.collect()}
    holds = {3, *range(30, 40)}
    assert got == {e: "exact" if e == 7 else "containment" if e in holds else "shared" for e in range(50)}
