"""Rubric scoring with the three matchers."""

import pytest
from pyspark.sql import functions as F

from markbook import schemas
from markbook.operators import matchers, rubrics, scoring
from markbook.operators.matchers import ArrowMatcher, LexicalMatcher, TableMatcher
from markbook.plans.grading import grade
from markbook.settings import ScoringSettings


def _config(spark, points, thresholds=None, total=None, confirmed=None):
    total = total or sum(p[2] for p in points)
    meta = None if confirmed is None else ("m", "t", confirmed)
    return spark.createDataFrame([("q", total, None, points, thresholds, meta)], schemas.CONFIGS)


def _answers(spark, *texts):
    return spark.createDataFrame([(f"a{i}", "q", t) for i, t in enumerate(texts)], "answer_id string, question_id string, answer_text string")


def _details(df):
    return df.orderBy("answer_id").first()["point_details"]


@pytest.fixture(params=["lexical", "arrow"])
def matcher(request):
    # defined here so that workers get the function itself, not a reference to this module
    def extract(candidates, texts):
        return [(0.97, t.find(c), t.find(c) + len(c) - 1) if c in t else (0.1, 0, 0) for c, t in zip(candidates, texts)]

    if request.param == "lexical":
        return LexicalMatcher(cosine=0.9)
    return ArrowMatcher(extract, lambda p, t: [0.9] * len(p))


def test_alias_hit(spark, matcher):
    cfg = _config(spark, [(1, "水的蒸发", 2.0, ["变成水汽"])])
    r = scoring.score_answers(_answers(spark, "这场改革就是变成水汽"), cfg, matcher).first()
    d = r["point_details"][0]
    assert (d["hit_status"], d["matched_alias"], d["extracted_span"], d["source"]) == ("hit_exact", "变成水汽", "变成水汽", "mrc")
    assert (r["total_score"], r["rating"]) == (2.0, "excellent")


def test_points_that_share_an_id_keep_their_own_details(spark, matcher):
    cfg = _config(spark, [(1, "第一句", 2.0, []), (1, "第二句", 2.0, [])], (0.95, 0.92))
    r = scoring.score_answers(_answers(spark, "只有第一句"), cfg, matcher).first()
    assert [d["hit_status"] for d in r["point_details"]] == ["hit_exact", "miss"] and r["total_score"] == 2.0
    good, aside = rubrics.validate(cfg, rubrics.config_rules())
    assert good.count() == 0 and list(aside.first()["violations"]) == ["point_id_repeated"]


def test_credited_span_is_blanked_for_later_points(spark):
    def extract(candidates, texts):
        return [(0.97, t.find("AB"), t.find("AB") + 1) if "AB" in c and "AB" in t else (0.1, 0, 0) for c, t in zip(candidates, texts)]

    # the similarity encodes what it was shown: 1 when the blanked text arrives
    def similar(points, texts):
        return [0.99 if t == "  XYZ" else 0.0 for t in texts]

    cfg = _config(spark, [(1, "AB目标", 1.0, []), (2, "PQ目标", 1.0, [])])
    d = _details(scoring.score_answers(_answers(spark, "ABXYZ"), cfg, ArrowMatcher(extract, similar)))
    assert (d[0]["extracted_span"], d[1]["hit_status"]) == ("AB", "hit_semantic")


def test_one_passage_is_credited_once(spark, matcher):
    cfg = _config(spark, [(1, "变法", 1.0, []), (2, "变法", 1.0, [])], (0.95, 0.92))
    d = _details(scoring.score_answers(_answers(spark, "变法一次"), cfg, matcher))
    assert [x["hit_status"] for x in d] == ["hit_exact", "miss"]
    d = _details(scoring.score_answers(_answers(spark, "变法又变法"), cfg, matcher))
    assert [x["hit_status"] for x in d] == ["hit_exact", "hit_exact"]


def test_fallback_bands(spark, matcher):
    for (high, low), want in {(0.85, 0.75): ("hit_semantic", 2.0), (0.95, 0.9): ("partial", 0.5), (0.95, 0.91): ("miss", 0.0)}.items():
        cfg = _config(spark, [(1, "促进了思想启蒙", 2.0, [])], (high, low))
        d = _details(scoring.score_answers(_answers(spark, "推动了当时的思想解放潮流"), cfg, matcher))[0]
        assert (d["hit_status"], d["point_score"], d["source"], d["similarity"]) == (*want, "similarity", 0.9)


def test_option_points(spark, matcher):
    cfg = _config(spark, [(1, "选B得3分", 3.0, ["B项正确"]), (2, "选A得1分", 1.0, []), (3, "表达了乐观自勉之情", 2.0, [])], (0.85, 0.75))
    r = scoring.score_answers(_answers(spark, "1）B\n（2）诗人虽有感叹，却依旧自勉乐观"), cfg, matcher).first()
    d = r["point_details"]
    assert (d[0]["source"], d[0]["extracted_span"], d[0]["confidence"], d[0]["matched_alias"]) == ("option", "B", 1.0, "选B得3分")
    assert (d[1]["source"], d[1]["hit_status"]) == ("similarity", "hit_semantic")
    assert r["total_score"] == 6.0


def test_option_miss_skips_span_matching(spark, matcher):
    # the wording itself occurs, but an option point is never searched as a span
    cfg = _config(spark, [(1, "选A项", 1.0, [])], (0.95, 0.91))
    d = _details(scoring.score_answers(_answers(spark, "我写了选择A项以外"), cfg, matcher))[0]
    assert d["source"] in ("option", "similarity")
    d = _details(scoring.score_answers(_answers(spark, "A不对，应选B"), _config(spark, [(1, "选A得1分", 1.0, []), (2, "选B得2分", 2.0, [])]), matcher))
    assert [x["source"] for x in d] == ["similarity", "option"]


def test_option_letters_and_use(spark):
    pts = [("选B得3分", [], ["B"]), ("选择B、E", ["B项正确", "E项正确"], ["B", "E"]), ("断句正确项为B", [], ["B"]), ("表达诗人不甘沉沦的乐观之情", [], [])]
    df = spark.createDataFrame([p[:2] for p in pts], "t string, a array<string>")
    assert [r[0] for r in df.select(scoring.option_letters(F.col("t"), F.col("a"))).collect()] == [p[2] for p in pts]
    uses = [
        ("1）B", ["B"], "B"), ("（1）B", ["B"], "B"), ("B", ["B"], "B"), ("我选B.", ["B"], "B"), ("10.B11.A12.A", ["B"], "B"),
        ("A不对，应选B", ["A", "B"], "B"), ("A,B,D", ["A", "B", "D"], "A"), ("大力发展素质教育", ["B"], None), ("ABC", ["B"], None), ("XB项", ["B"], "B"),
    ]
    df = spark.createDataFrame([u[:2] for u in uses], "t string, l array<string>")
    assert [r[0] for r in df.select(scoring.option_hit(F.col("t"), F.col("l"))).collect()] == [u[2] for u in uses]
    both = df.limit(1).select(scoring.option_hit(F.lit("选A"), F.array(F.lit("A"), F.lit("B")), True)).first()[0]
    assert both is None


def test_table_matcher_and_missing_keys(spark):
    cfg = _config(spark, [(1, "甲", 1.0, ["乙"]), (2, "丙", 2.0, [])], (0.9, 0.5))
    spans = spark.createDataFrame(
        [("a0", "甲", 0.85, 0, 1), ("a0", "乙", 0.9, 2, 3), ("a0", "丙", 0.95, 5, 99)], schemas.SPAN_PREDICTIONS
    )
    cosines = spark.createDataFrame([("a0", "甲", 0.1), ("a0", "丙", 0.6)], schemas.SIMILARITIES)
    d = _details(scoring.score_answers(_answers(spark, "一二三四五六"), cfg, TableMatcher(spans, cosines)))
    assert (d[0]["matched_alias"], d[0]["extracted_span"]) == ("乙", "三四")
    assert (d[1]["hit_status"], d[1]["point_score"]) == ("partial", 0.5)
    gap = TableMatcher(spans.where("candidate <> '丙'"), cosines)
    with pytest.raises(Exception, match="no span for"):
        scoring.score_answers(_answers(spark, "一二三四五六"), cfg, gap).collect()
    cands = matchers.candidate_rows(_answers(spark, "x").select("answer_id", "question_id"), rubrics.point_rows(cfg))
    assert tuple(matchers.count_missing(cands, spans.where("candidate <> '丙'")).first()) == (3, 1)


def test_long_spans_are_not_usable(spark, matcher):
    cfg = _config(spark, [(1, "x" * 65, 1.0, ["x" * 64])], (0.99, 0.98))
    d = _details(scoring.score_answers(_answers(spark, "x" * 70), cfg, matcher))[0]
    assert d["matched_alias"] == "x" * 64


def test_settings_and_thresholds(spark):
    for bad in (dict(similarity_low=0.96), dict(similarity_high=1.1), dict(partial_credit=2), dict(mrc_confidence_threshold=-1)):
        with pytest.raises(ValueError):
            ScoringSettings(**bad).check()
    cfg = _config(spark, [(1, "a", 1.0, [])], (None, 0.7))
    r = rubrics.effective_thresholds(cfg, ScoringSettings(0.8, 0.6)).first()
    assert (r["similarity_high"], r["similarity_low"]) == (0.95, 0.7)
    assert rubrics.confirmed_only(_config(spark, [(1, "a", 1.0, [])], confirmed=False)).count() == 0
    assert rubrics.confirmed_only(_config(spark, [(1, "a", 1.0, [])], confirmed=True)).count() == 1


def test_grade_strips_the_stem_first(spark):
    stem = "镜湖元自属闲人又何必君恩赐与"
    answers = spark.createDataFrame(
        [("a0", "q", "s", "c", f"{stem}。归隐", "text", None), ("a1", "q", None, None, "x", "ocr", "又何必君恩")], schemas.ANSWERS
    )
    questions = spark.createDataFrame([("q", None, stem, "语文", 3.0, None, "confirmed")], schemas.QUESTIONS)
    ocr = spark.createDataFrame([("q", 0.7)], "question_id string, confidence double")
    cfg = _config(spark, [(1, "君恩", 1.0, []), (2, "归隐", 2.0, [])])
    rows = {r["answer_id"]: r for r in grade(answers, cfg, questions, ocr=ocr).collect()}
    assert [d["hit_status"] for d in rows["a0"]["point_details"]] == ["miss", "hit_exact"]
    assert rows["a0"]["ocr_confidence"] is None and rows["a0"]["total_score"] == 2.0
    # five copied characters are too few to be blanked
    assert rows["a1"]["total_score"] == 1.0 and rows["a1"]["ocr_confidence"] == 0.7


def test_rubric_normalisation(spark):
    raw = spark.createDataFrame(
        [("q", 6.0, [("2", " 乙 ", "x", ["b ", "b", ""]), ("1", "甲", "0.1", None), ("3", "  ", "9", [])])],
        "question_id string, total_score double, points array<struct<point_id:string,point_text:string,weight:string,aliases:array<string>>>",
    )
    r = rubrics.normalize_rubric(raw).first()["points"]
    assert [(p["point_id"], p["point_text"], p["weight"], list(p["aliases"])) for p in r] == [(1, "甲", 2.0, []), (2, "乙", 4.0, ["b"])]


def test_contract_violations(spark):
    good = _config(spark, [(1, "a", 1.0, ["x"])])
    bad = _config(spark, [(0, "", -1.0, ["x", "x", ""])], (1.5, 0.2), total=-1.0)
    ok, aside = rubrics.validate(good.unionByName(bad), rubrics.config_rules())
    assert ok.count() == 1
    assert list(aside.first()["violations"]) == ["total_score", "point_id", "point_text", "weight", "alias_empty", "alias_repeated", "similarity_high"]
