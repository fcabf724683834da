"""Labels, builders and evaluation on small cases and against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from markbook import schemas
from markbook.operators import builders, evaluate, labels, ranking
from markbook.plans import views
from markbook.plans.grading import build_dataset, clean_labels
from markbook.session import settled

VOTES = "sample_id string, point_id int, round int, hit boolean, hit_type string, extracted_span string, confidence double, partial_credit double"
POINTS = "sample_id string, origin string, question_id string, student_answer string, point_id bigint, hit boolean, hit_type string, extracted_span string, confidence double, partial_credit double"


def test_majority_and_tie(spark):
    rows = [
        ("a", 1, 0, True, "exact", "甲", 0.9, 1.0), ("a", 1, 1, False, "miss", "", 0.8, None), ("a", 1, 2, True, "exact", "甲乙", 0.95, 1.0),
        ("b", 1, 0, True, "semantic", "甲", 0.9, 0.5), ("b", 1, 1, False, "miss", "", 0.7, None),
        ("c", 1, 0, True, "semantic", "x", 0.2, 0.5), ("c", 1, 1, False, "miss", "", 0.7, None), ("c", 1, 2, False, "miss", "", 0.6, None),
        ("c", 2, 1, True, "exact", "y", 0.5, None),
    ]
    got = {(r["sample_id"], r["point_id"]): r for r in labels.majority_vote(spark.createDataFrame(rows, VOTES)).collect()}
    a, b, c = got["a", 1], got["b", 1], got["c", 1]
    assert (a["hit_type"], a["extracted_span"], a["flipped"]) == ("exact", "甲乙", False)
    assert a["agreement"] == pytest.approx(2 / 3) and a["confidence"] == pytest.approx(0.883)
    assert (b["hit_type"], b["partial_credit"], b["flipped"]) == ("semantic", 0.5, False)
    assert (c["hit"], c["hit_type"], c["flipped"]) == (False, "miss", True)
    # a point the first round did not judge is not in the result
    assert ("c", 2) not in got


def test_votes_are_dealt_once(spark, small):
    # all votes of a sample are in one part from the start; their number follows the size of the files
    voted = labels.majority_vote(views.votes(spark, small))
    plan = voted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(l_orderkey" in plan
    rows = views.table(spark, small, "lineitem")
    assert views.dealt(rows, "l_orderkey", 2048).rdd.getNumPartitions() >= 2 * views.dealt(rows, "l_orderkey", 4096).rdd.getNumPartitions() - 1 > 20


def _hash_exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_vote_report_needs_no_second_shuffle(spark, small):
    assert _hash_exchanges(labels.vote_report(labels.majority_vote(views.votes(spark, small), 3))) == 1


def test_votes_are_counted_in_parts_that_follow_their_files(spark, small, monkeypatch):
    monkeypatch.setattr(views, "LINE_BYTES", 2048, raising=False)
    counted = labels.count_votes(views.votes(spark, small))
    assert _hash_exchanges(counted) == 1 and counted.rdd.getNumPartitions() > 50


def test_normalise_labels(spark):
    raw = spark.createDataFrame(
        [
            ("s", 0, "1", True, "semantic", " 组织举人 ", "1.7", "0.2", "r" * 100),
            ("s", 1, "1", True, "exact", "later", "0.9", None, None),
            ("s", 2, "99", True, "exact", "x", "0.9", None, None),
            ("s", 3, "2", True, "weird", "x", "0.9", None, None),
            ("s", 4, "3", True, "exact", "  ", "bad", None, None),
            ("s", 5, "x", True, "exact", "x", "0.9", None, None),
        ],
        "sample_id string, pos int, point_id string, hit boolean, hit_type string, extracted_span string, confidence string, partial_credit string, rationale string",
    )
    samples = spark.createDataFrame([("s", "q")], "sample_id string, question_id string")
    points = spark.createDataFrame([("q", i) for i in (1, 2, 3)], "question_id string, point_id bigint")
    got = {r["point_id"]: r for r in labels.normalize_labels(raw, samples, points).collect()}
    one = got[1]
    assert (one["hit_type"], one["extracted_span"], one["confidence"], one["partial_credit"], len(one["rationale"])) == ("semantic", "组织举人", 1.0, 0.5, 80)
    assert (got[2]["hit_type"], got[2]["confidence"]) == ("miss", 0.5)
    assert (got[3]["hit"], got[3]["hit_type"], got[3]["confidence"], got[3]["partial_credit"]) == (False, "miss", 1.0, None)


def _label_rows():
    text = "康有为组织举人联名上书皇帝，后来又宣传设议会让百姓参与政治。"
    return [
        ("t#full", "full", "q", text, 1, True, "semantic", "组织举人联名上书皇帝", 0.9, 1.0),
        ("t#full", "full", "q", text, 2, True, "exact", "设议会", 0.95, 1.0),
        ("t#full", "full", "q", text, 3, False, "miss", "", 0.9, None),
        ("u#s0", "fragment", "q2", "短答案", 1, True, "exact", "短答案", 0.9, None),
        ("u#s0", "fragment", "q2", "短答案", 2, False, "miss", "", 0.1, None),
    ]


def test_quality_chain_and_build(spark):
    kept, report, filters = clean_labels(spark.createDataFrame(_label_rows(), POINTS))
    assert {r["reason"]: r["points"] for r in filters.collect()} == {"overlong_span": 1, "low_confidence": 1}
    r = report.first()
    assert (r["input_records"], r["kept_samples"], r["sample_dropped_invalid_ratio"], r["hit_points"], r["aligned"]) == (2, 1, 1, 3, 2)
    assert (r["strategy_exact"], r["point_success_rate"]) == (2, 0.6667)
    configs = spark.createDataFrame(
        [("q", 8.0, "历史", [(1, "公车上书", 3.0, ["上书请愿"]), (2, "兴民权设议院", 3.0, ["君主立宪"]), (3, "创办时务报", 2.0, [])], None, None)],
        schemas.CONFIGS,
    )
    built = build_dataset(kept, configs, ratios={"train": 1.0, "val": 0.0}, negative_ratio=0.5, settle=settled)
    spans = {x["id"]: x for x in built["spans"].collect()}
    assert sorted(spans) == ["t#full#p1", "t#full#p2", "t#full#p3"]
    for x in spans.values():
        assert x["split"] == "train"
        assert x["answer"] == (x["context"][x["answer_start"] : x["answer_end"]] if not x["is_impossible"] else "")
    pairs = {(x["source"], x["sentence2"]): x["score"] for x in built["pairs"].collect()}
    assert pairs[("label-exact", "设议会")] == 1.0 and pairs[("label-semantic", "组织举人联名上书皇帝")] == 1.0
    assert pairs[("label-alias", "上书请愿")] == 1.0 and pairs[("label-alias", "君主立宪")] == 1.0
    # both sentences hold a hit, so the first one serves as distractor
    assert [s for (k, s) in pairs if k == "label-miss"] == ["康有为组织举人联名上书皇帝"]
    stats = {(x["dim"], x["value"]): x["rows"] for x in built["span_stats"].collect()}
    assert stats["all", None] == 3 and stats["hit_type", "miss"] == 1


def test_split_is_disjoint_and_repeatable(spark):
    ids = spark.createDataFrame([(f"Q{i:03d}",) for i in range(50)], "question_id string")
    a = {r["question_id"]: r["split"] for r in builders.question_split(ids).collect()}
    b = {r["question_id"]: r["split"] for r in builders.question_split(ids.unionAll(ids)).collect()}
    assert a == b and Counter(a.values()) == {"train": 40, "val": 5, "test": 5}


def test_split_shares_are_decimal(spark):
    # as doubles, 0.7 * 90 is 62.99999999999999
    rows = builders.question_split(spark.range(90).withColumnRenamed("id", "question_id"), {"train": 0.7, "val": 0.2}, 7)
    assert Counter(r["split"] for r in rows.collect()) == {"train": 63, "val": 18, "test": 9}


def _round_robin(rows, ratio):
    pos, neg = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    k = int(len(pos) * ratio / (1 - ratio))
    if not pos or not neg or k >= len(neg):
        return Counter(r[1] for r in neg), None
    left, taken = Counter(r[1] for r in neg), Counter()
    while sum(taken.values()) < k:
        open_questions = [q for q in left if left[q]]
        if sum(taken.values()) + len(open_questions) > k:
            return taken, k
        for q in open_questions:
            left[q] -= 1
            taken[q] += 1
    return taken, k


def test_downsample_against_round_robin(spark):
    rng = random.Random(9)
    for case in range(6):
        weights = [1, 1, 2, 5, 30]
        rows = [(f"r{i}", rng.choices("abcde", weights)[0], rng.random() < 0.7) for i in range(rng.choice([5, 60, 200]))]
        out = builders.downsample_negatives(spark.createDataFrame(rows, "id string, question_id string, is_impossible boolean"), 0.3).collect()
        got = Counter(r["question_id"] for r in out if r["is_impossible"])
        full_rounds, k = _round_robin(rows, 0.3)
        assert sum(1 for r in out if not r["is_impossible"]) == sum(1 for r in rows if not r[2])
        if k is None:
            assert got == full_rounds
        else:
            assert sum(got.values()) == k
            assert all(0 <= got[q] - full_rounds[q] <= 1 for q in "abcde")


def test_downsample_ratio(spark):
    rows = [(f"p{i}", f"Q{i}", False) for i in range(800)] + [(f"n{i}", f"Q{i}", True) for i in range(2000)]
    out = builders.downsample_negatives(spark.createDataFrame(rows, "id string, question_id string, is_impossible boolean"))
    n, neg = out.count(), out.where("is_impossible").count()
    assert n - neg == 800 and abs(neg / n - 0.22) < 0.01


def test_fragments_top_up(spark):
    rows = [(f"z{i}", "fragment", 0.0) for i in range(50)] + [(f"h{i}", "fragment", 1.0) for i in range(10)] + [("f", "full", None)]
    df = spark.createDataFrame(rows, "sample_id string, origin string, expert_step_label double")
    got = [r["sample_id"] for r in builders.sample_fragments(df, 40, 0.25).collect()]
    assert len(got) == len(set(got)) == 40 and sum(g.startswith("h") for g in got) == 10
    assert builders.sample_fragments(df, 100, 0.25).count() == 60


def _item(source, qid, **more):
    base = dict(source=source, subject="历史", stage="高中", qid=qid, type="choice", question="戊戌变法的领导阶级是？", material="", choices=None,
                answer_letter=None, answer_text="", explanation="", difficulty=None, split="train", note="")
    return tuple({**base, **more}.values())


def test_item_pairs_and_negatives(spark):
    choices = {"A": "地主阶级", "B": "资产阶级维新派", "C": "农", "D": "农民阶级"}
    rows = [
        _item("m3ke", "1", choices=choices, answer_letter="B", split="dev"),
        _item("m3ke", "2", choices=choices, split="test"),
        _item("internlm-history", "3", type="open", question="北京人遗址这表明北京人", answer_text="人类的活动"),
        _item("internlm-history", "4", type="open", question="商鞅变法的内容说明", answer_text="社会变革"),
        _item("internlm-history", "5", type="open", question="社会变革的主要内容有哪些", answer_text="社会变革"),
        _item("reciter", "6", type="fill", question="默写下一句", answer_text="不过数仞而下"),
        _item("reciter", "7", type="fill", question="默写不过数仞而下", answer_text="不过数仞而下"),
        _item("ncr", "8", choices=choices, answer_letter="A", material="周鼎传全文材料在此处共十余字"),
        _item("ncr", "9", question="短", choices=choices, answer_letter="A"),
    ]
    items = spark.createDataFrame(rows, schemas.ITEMS)
    by = defaultdict(list)
    for r in builders.item_pairs(items).collect():
        by[r["question_id"]].append(r)
    m = by["EXT-m3ke-1"]
    assert Counter(r["score"] for r in m) == {1.0: 1, 0.0: 2} and {r["split"] for r in m} == {"val"}
    assert "EXT-m3ke-2" not in by and "EXT-reciter-7" not in by and "EXT-ncr-9" not in by
    assert {(r["sentence2"], r["score"]) for r in by["EXT-internlm-history-3"]} == {("人类的活动", 1.0), ("社会变革", 0.0)}
    assert by["EXT-reciter-6"][0]["source"] == "extra-reciter-pos"
    negs = {r["id"]: r for r in builders.item_negatives(items).collect()}
    assert set(negs) == {"extra-internlm-history-3", "extra-internlm-history-4", "extra-ncr-8"} - (
        set() if len("北京人遗址这表明北京人") >= 10 else {"extra-internlm-history-3"}) - ({"extra-internlm-history-4"} if len("商鞅变法的内容说明") < 10 else set())
    assert negs["extra-ncr-8"]["context"].startswith("周鼎传")


def test_hard_negatives_never_own_and_distinct(spark):
    rng = random.Random(10)
    rows = [(i, rng.choice("gh"), rng.choice("abcdef")) for i in range(200)] + [(900, "lone", "z")]
    df = spark.createDataFrame(rows, "k int, g string, label string")
    got = defaultdict(list)
    for r in builders.hard_negatives(df, "label", "k", 3, group=["g"]).collect():
        got[r["k"]].append(r["negative"])
    own = {k: lab for k, _, lab in rows}
    assert set(got) == set(range(200))
    assert all(own[k] not in v and len(v) == len(set(v)) == 3 for k, v in got.items())


def test_prompts_and_outputs(spark):
    df = spark.createDataFrame([("q1", "答{x}", [(1, "甲", 1.0, ["乙", "丙"]), (2, "丁", 1.0, [])])], f"question_id string, a string, points array<{schemas.POINT}>")
    template = "{q}: {points}\n{a} {unknown} {q}"
    values = {"q": F.col("question_id"), "points": builders.points_block(F.col("points")), "a": F.col("a")}
    assert builders.render_prompts(df, template, values).first()["prompt"] == "q1: 1. 甲（别名：乙、丙）\n2. 丁\n答{x} {unknown} q1"
    raws = [(1, '```json\n{"k": 1}\n```'), (2, 'text {"k": 2, "s": "a}b"} tail } x'), (3, '{"k": 3'), (4, "none"), (5, None), (6, '{"k": 6} {"k": 7}')]
    good, bad = builders.parse_outputs(spark.createDataFrame(raws, "i int, raw_text string"), "k bigint, s string")
    assert {r["i"]: r["parsed"]["k"] for r in good.collect()} == {1: 1, 2: 2, 6: 6}
    assert sorted(r["i"] for r in bad.collect()) == [3, 4, 5]


def test_grid_and_option_queries(spark):
    qs = spark.createDataFrame([("SAS-HIST-001",), ("SAS-GEO-001",)], "question_id string")
    done = spark.createDataFrame([("SAS-GEO-001#syn-good-v0",)], "sample_id string")
    got = [r["sample_id"] for r in builders.synth_grid(qs, done).collect()]
    assert len(got) == 8 + 3 and "SAS-HIST-001#syn-poor-v1" in got
    rows = spark.createDataFrame([("选 B得3分", False), ("选B得3分", True), ("表达之情", False), ("C正确", False)], "query string, is_impossible boolean")
    assert builders.drop_option_positives(rows).count() == 2


def test_ranks_and_running_totals_in_hot_groups(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    by = defaultdict(list)
    for r in ranking.hash_rank(df, ["k"], 3, ["g"]).collect():
        by[r["g"]].append((r["rank"], r["total"]))
    assert all(sorted(x[0] for x in v) == list(range(1, len(v) + 1)) and {x[1] for x in v} == {len(v)} for v in by.values())
    ranked = sorted((r["rank"], r["v"]) for r in ranking.value_rank(df, "v", ["k"], 3).collect())
    assert [x[0] for x in ranked] == list(range(1, 3001)) and [x[1] for x in ranked] == sorted(r[2] for r in rows)
    values = sorted(r[2] for r in rows)
    got = {r["q"]: r["value"] for r in ranking.order_statistics(df, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {q: values[min(len(values) - 1, int(q * len(values)))] for q in (0.0, 0.5, 0.95, 1.0)}


def test_threshold_and_auc_against_loops(spark):
    rng = random.Random(12)
    for _ in range(3):
        rows = [(rng.randint(-5, 5) / 2, rng.random() < 0.5) for _ in range(60)]
        df = spark.createDataFrame(rows, "score_diff double, gold boolean")
        best = max(sorted({d for d, _ in rows}), key=lambda t: (sum((d > t) == g for d, g in rows), -t))
        r = evaluate.tune_threshold(df).first()
        assert r["threshold"] == best and r["accuracy"] == pytest.approx(sum((d > best) == g for d, g in rows) / 60)
        pos, neg = [d for d, g in rows if g], [d for d, g in rows if not g]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert evaluate.auc(df, "score_diff", "gold", 0.0).first()["auc"] == pytest.approx(want, abs=1e-4)


def test_decode_against_loops(spark):
    rng = random.Random(13)
    rows = [(i, [rng.random() for _ in range(12)], [rng.random() for _ in range(12)], 2, 10) for i in range(40)] + [(99, [0.1], [0.1], -1, -1)]
    df = spark.createDataFrame(rows, "i int, start_logits array<double>, end_logits array<double>, ctx_low int, ctx_high int")
    got = {r["i"]: r for r in evaluate.decode_spans(df, ["i"], max_tokens=4).collect()}
    for i, s, e, lo, hi in rows[:-1]:
        best = max(((s[a] + e[b], -a, -b) for a in range(lo, hi + 1) for b in range(a, min(a + 4, hi + 1))))
        assert (got[i]["span_start"], got[i]["span_end"]) == (-best[1], -best[2])
    assert (got[99]["span_start"], got[99]["has_answer_prob"]) == (0, 0.0)


def test_span_metrics(spark):
    rows = [("甲乙", 1.0, "甲乙", False, "exact"), ("甲", 1.0, "甲乙", False, "semantic"), ("丙", -1.0, "丙", False, "semantic"), ("x", 1.0, "", True, "miss"), ("", 2.0, "", True, "miss")]
    r = evaluate.span_metrics(spark.createDataFrame(rows, "pred_text string, score_diff double, answer string, is_impossible boolean, hit_type string"), 0.0).first()
    assert (r["em"], r["token_f1"], r["point_accuracy"], r["equivalence_hit_rate"]) == (0.3333, 0.5556, 0.6, 0.5)
    assert (r["em_exact"], r["f1_semantic"], r["n_exact"], r["n_semantic"], r["positives"]) == (1.0, 0.3333, 1, 2, 3)


def test_gold_assembly_drops_contradictions(spark):
    rows = [
        ("1", "full", "q", "ctx", "甲", 2.0, ["a"], False), ("2", "full", "q", "ctx", "乙", 1.0, [], True), ("3", "full", "q", "ctx", "乙", 1.0, [], False),
        ("4", "full", "q", "ctx", "丙", 1.5, [], True), ("5", "fragment", "q", "ctx", "丁", 1.0, [], True), ("6", "full", "q", "ctx", "甲", 9.0, [], False),
    ]
    df = spark.createDataFrame(rows, "id string, origin string, question_id string, context string, query string, point_weight double, query_aliases array<string>, is_impossible boolean")
    points, totals = evaluate.assemble_gold(df)
    assert [(r["point_id"], r["query"], r["weight"]) for r in points.orderBy("point_id").collect()] == [(1, "甲", 2.0), (2, "丙", 1.5)]
    r = totals.first()
    assert (r["conflicts"], r["expert_total"], r["max_total"]) == (1, 2.0, 3.5)


def test_patches_and_conflicts(spark):
    rows = [("s1", "q", 1, "甲", "前 abc 后 xyz", False, None), ("s2", "q", 1, "甲", "别的", False, None), ("s3", "q", 1, "甲", "前 abc 后 xyz", True, (0, 1, "前", "exact"))]
    points = spark.createDataFrame(
        [r[:5] + (r[5], "miss" if not r[5] else "exact", "", 0.5, None, r[6]) for r in rows],
        f"sample_id string, question_id string, point_id bigint, point_text string, student_answer string, hit boolean, hit_type string, extracted_span string, confidence double, partial_credit double, align {schemas.ALIGN}",
    )
    patches = spark.createDataFrame([(1, "q", "甲", "abc", "nowhere at all"), (2, "q", "甲", "abc", "xyz"), (3, "q", "甲", "missing", "xyz")], "patch_no int, question_id string, point_text string, locate string, span string")
    updated, log, unmatched = labels.patch_labels(points, patches)
    got = {r["sample_id"]: r for r in updated.collect()}
    assert (got["s1"]["hit_type"], got["s1"]["extracted_span"], got["s1"]["align"]["start"]) == ("semantic", "xyz", 8)
    assert not got["s2"]["hit"] and got["s3"]["hit_type"] == "exact"
    assert [(r["sample_id"], r["align"]) for r in log.collect()] == [("s1", "exact")]
    assert [r["patch_no"] for r in unmatched.collect()] == [3]
    unified = {r["sample_id"]: r for r in labels.unify_conflicts(points, ["q"]).collect()}
    assert unified["s1"]["unified"] and unified["s1"]["align"]["end"] == 1 and not unified["s2"]["hit"] and not unified["s3"]["unified"]


def test_systematic_sample_places(spark):
    rows = [(i, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, r double")
    assert evaluate.systematic_sample(df, "r", 8, ["k"]).count() == 8
    assert evaluate.systematic_sample(df, "r", 80, ["k"]).count() == 50
    assert evaluate.stride_sample(df, ["k"], 8).count() == 8


def test_ranges_in_two_steps(spark):
    rng = random.Random(14)
    cuts = sorted({rng.random() for _ in range(300)})
    values = [(rng.random(),) for _ in range(500)] + [(c,) for c in cuts[:5]] + [(-1.0,), (2.0,)]
    df = spark.createDataFrame(values, "v double").select("v", ranking.range_of(F.col("v"), cuts).alias("r"))
    assert all(r["r"] == sum(c < r["v"] for c in cuts) for r in df.collect())


def test_value_orders_run_nothing_while_they_are_planned(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.xxhash64("id").cast("double").alias("v"), (F.col("id") % 2 == 0).alias("g"))
    spark.sparkContext.setJobGroup("planning", "planning")
    planned = [
        evaluate.auc(df, "v", "g", 0.0), evaluate.tune_threshold(df, "v", "g"), evaluate.systematic_sample(df, "v", 9, ["k"]),
        ranking.order_statistics(df, "v", [0.5, 0.99]), ranking.value_rank(df, "v", ["k"], 1),
    ]
    spark.sparkContext.setJobGroup("running", "running")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    values = sorted(r.v for r in df.collect())
    assert {r.q: r.value for r in planned[3].collect()} == {0.5: values[10_000], 0.99: values[19_800]}
    want = [values[i * 20_000 // 9] for i in range(9)]
    assert sorted(r.v for r in planned[2].collect()) == want


def test_many_ranges(spark):
    df = spark.range(60_000).select(F.xxhash64("id").cast("double").alias("v"))
    cuts = ranking.split_points(df, "v", 6000)
    found = df.withColumn("c", cuts).select(ranking.range_of(F.col("v"), F.col("c")).alias("r")).groupBy("r").count().collect()
    assert len(found) > 5500 and max(r["count"] for r in found) < 60


def test_systematic_sample_exchanges(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = evaluate.systematic_sample(df, "v", 9, ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"(?m)^[\s:+*()\d-]*Exchange ", plan)) <= 10  # nodes of their own, not those used again


def test_rank_only_as_far_as_wanted(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    whole = {r["k"] for r in ranking.hash_rank(df, ["k"], 1).where("rank <= 7").collect()}
    part = ranking.hash_rank(df, ["k"], 1, upto=7)
    assert part.count() < 100 and {r["k"] for r in part.where("rank <= 7").collect()} == whole


def test_rows_without_a_group_are_ranked_too(spark):
    rows = [(i, None if i % 3 == 0 else "g", None if i % 4 == 0 else float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, g string, v double")
    ranked = ranking.hash_rank(df, ["k"], 1, ["g"]).collect()
    assert sorted(r["rank"] for r in ranked if r["g"] is None) == list(range(1, 21))
    by_value = sorted((r["rank"], r["v"] is None) for r in ranking.value_rank(df, "v", ["k"], 1).collect())
    assert [r for r, _ in by_value] == list(range(1, 61)) and all(n for _, n in by_value[:15])
    spans = [(f"n{i}", None if i % 2 else "q", True) for i in range(20)] + [(f"p{i}", "q", False) for i in range(9)]
    out = builders.downsample_negatives(spark.createDataFrame(spans, "id string, question_id string, is_impossible boolean"), 0.5)
    assert Counter(r["question_id"] for r in out.where("is_impossible").collect()) in ({None: 5, "q": 4}, {None: 4, "q": 5})
