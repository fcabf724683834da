"""Analytics, table maintenance and the incremental jobs."""

import pytest
from pyspark.sql import functions as F

from markbook import schemas
from markbook.functions import fixed
from markbook.operators import analytics, evaluate, tables
from markbook.sources import shards
from markbook.streaming import jobs

RESULTS = "answer_id string, question_id string, class_name string, total_score double, max_score double, rating string"


def test_dashboard_figures(spark):
    questions = spark.createDataFrame([("Q1", "confirmed"), ("Q2", "none")], "question_id string, config_status string")
    results = spark.createDataFrame([("A1", "Q1", None, 5.0, 5.0, "excellent"), ("A2", "Q1", "一班", 2.0, 5.0, "pass")], RESULTS)
    got = {(r["section"], r["name"]): r["value"] for r in analytics.admin_stats(questions, results, results).collect()}
    assert got["questions", "total"] == 2 and got["questions", "confirmed"] == 1 and got["scores", "average"] == 3.5
    assert got["distribution", "80-100%"] == 1 and got["distribution", "40-60%"] == 1 and got["distribution", "0-20%"] == 0
    # scored again: the later result replaces the earlier one
    again = spark.createDataFrame([("A1", "Q1", None, 4.0, 5.0, "excellent")], RESULTS)
    mean = tables.upsert(results, again, ["answer_id"]).agg(F.avg("total_score")).first()[0]
    assert mean == 3.0
    empty = {(r["section"], r["name"]): r["value"] for r in analytics.admin_stats(questions.limit(0), results.limit(0), results.limit(0)).collect()}
    assert empty["scores", "average"] == 0.0 and len([k for k in empty if k[0] == "distribution"]) == len(fixed.BUCKET_LABELS)


def test_point_hits_and_question_view(spark):
    details = spark.createDataFrame([("Q1", 1, "hit_exact"), ("Q1", 1, "miss"), ("Q1", 2, "partial"), ("Q1", None, "miss")], "question_id string, point_id bigint, hit_status string")
    got = {r["point_id"]: (r["hit"], r["total"]) for r in analytics.point_hits(details).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 0: (0, 1)}
    results = spark.createDataFrame([("a", "Q1", "x", 4.0, 5.0, "good"), ("b", "Q1", "y", 1.0, 5.0, "fail")], RESULTS)
    r = analytics.question_summary(results).first()
    assert (r["n"], r["avg_score"], r["pass_rate"], r["good"], r["fail"]) == (2, 2.5, 50.0, 1, 1)
    assert analytics.question_summary(results, "x").first()["n"] == 1


def test_ocr_reading_order(spark):
    def box(y, x):
        return [[x, y], [x + 40, y], [x + 40, y + 12], [x, y + 12]]

    rows = [("q", " 第三 ", box(90.0, 10.0), 0.95), ("q", "第二", box(10.0, 60.0), 0.7), ("q", "第一", box(10.0, 5.0), 0.9), ("q", "  ", box(1.0, 1.0), 0.1), ("e", " ", None, 0.9)]
    got = {r["question_id"]: r for r in analytics.assemble_ocr(spark.createDataFrame(rows, schemas.OCR_LINES)).collect()}
    assert got["q"]["answer_text"] == "第一\n第二\n第三" and got["q"]["low_confidence"] and abs(got["q"]["confidence"] - 0.85) < 1e-9
    assert (got["e"]["answer_text"], got["e"]["confidence"], got["e"]["low_confidence"]) == ("", 0.0, True)
    jitter = spark.createDataFrame([("q", "右", box(10.0, 60.0), 0.9), ("q", "左", box(11.0, 5.0), 0.9)], schemas.OCR_LINES)
    assert analytics.assemble_ocr(jitter).first()["answer_text"] == "右\n左"
    assert analytics.assemble_ocr(jitter, band=20.0).first()["answer_text"] == "左\n右"


def test_usage_and_latency(spark):
    calls = spark.createDataFrame([(True, 10, 5), (True, 1, 1), (False, None, None)], "ok boolean, prompt_tokens bigint, completion_tokens bigint")
    assert tuple(analytics.usage_totals(calls).first()) == (2, 1, 11, 6, 17)
    times = spark.createDataFrame([(float(i),) for i in range(1, 11)], "latency double")
    assert {r["q"]: r["value"] for r in analytics.latency_summary(times).collect()} == {0.5: 6.0, 0.95: 10.0, 0.99: 10.0, 1.0: 10.0}


def test_cascade_and_projects(spark):
    projects = spark.createDataFrame([("P1",), ("P2",)], "project_id string")
    questions = spark.createDataFrame([("Q1", "P1"), ("Q2", "P2")], "question_id string, project_id string")
    answers = spark.createDataFrame([("A1", "Q1"), ("A2", "Q2")], "answer_id string, question_id string")
    kept = tables.delete_project(projects, questions, {"answers": answers}, projects.where("project_id = 'P1'"))
    assert [kept[k].first()[0] for k in ("projects", "questions", "answers")] == ["P2", "Q2", "Q2"]
    dated = spark.createDataFrame([("P1", "2026-01-01"), ("P2", "2026-02-01")], "project_id string, created_at string")
    assert [r[0] for r in tables.latest_projects(dated).collect()] == ["P2", "P1"]


def test_default_ids_keep_given_ones(spark):
    df = spark.createDataFrame([(1, None), (2, "mine"), (3, None)], "n int, qid string")
    got = {r["n"]: r["qid"] for r in tables.default_ids(df, "qid", "n", F.lit("Q"), start=4).collect()}
    assert got == {1: "Q005", 2: "mine", 3: "Q007"}


def test_stems_by_item_prefix(spark):
    items = spark.createDataFrame([("i1", " 题干一 "), ("i2", "题干二"), ("i3", None)], "id string, question string")
    rows = spark.createDataFrame([("i1#full#p1", "q", "full"), ("i2#full", "q", "full"), ("i1#full#p2", "q", "full"), ("i3#s0", "q", "fragment")], "id string, question_id string, origin string")
    assert tables.question_stems(rows, items).first()["stem"] == "题干一\n题干二"
    assert tables.with_stem(rows, items).where("stem is null").count() == 1


def test_submissions(spark):
    df = spark.createDataFrame([("s", "", " 答 "), ("", "c", "x"), ("t", "c", " 　")], "student_id string, class_name string, answer_text string")
    assert [tuple(r) for r in tables.clean_submissions(df).collect()] == [("s", None, "答"), (None, "c", "x")]


def test_parity_and_drops(spark):
    a = spark.createDataFrame([("x", 1.0, 3), ("y", 1.0, 3), ("z", 1.0, 3)], "k string, p double, s int")
    b = spark.createDataFrame([("x", 1.0005, 3), ("y", 1.1, 3), ("w", 1.0, 3)], "k string, p double, s int")
    assert tuple(evaluate.parity(a, b, ["k"], ["p"], ["s"]).first()) == (4, 1, 1, 1)
    reports = spark.createDataFrame([("fp32", "em", 0.5), ("int8", "em", 0.495), ("fp32", "f1", 0.8), ("int8", "f1", 0.7)], "variant string, metric string, value double")
    got = {r["metric"]: (r["drop"], r["passed"]) for r in evaluate.metric_drops(reports, "fp32", "int8", ["em", "f1"]).collect()}
    assert got == {"em": (0.005, True), "f1": (0.1, False)}


def _put(spark, folder, rows, name):
    spark.createDataFrame(rows, "answer_id string, question_id string, total_score double, max_score double, rating string, seq int").coalesce(1).write.parquet(f"{folder}/{name}")


def test_stream_scores_each_answer_once_across_restarts(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "answer_id string, answer_text string"

    def arrive(name, *ids):
        spark.createDataFrame([(i, "x") for i in ids], schema).coalesce(1).write.mode("append").parquet(f"{src}/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        jobs.stream_scores(stream, lambda b: b.withColumn("total_score", F.lit(1.0)), out, check).awaitTermination()
        return sorted(r["answer_id"] for r in jobs.read_scores(spark, out).collect())

    arrive("one", "a", "b")
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    arrive("two", "c")
    assert run() == ["a", "b", "c"]


def test_stream_scores_a_batch_of_one_file_on_all_cores(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(1000).withColumnRenamed("id", "answer_id").coalesce(1).write.parquet(src)
    jobs.stream_scores(
        jobs.arriving(spark, src, "answer_id bigint", 1), lambda b: b.withColumn("part", F.spark_partition_id()), out, check
    ).awaitTermination()
    scored = jobs.read_scores(spark, out)
    assert scored.select("answer_id").distinct().count() == scored.count() == 1000
    assert scored.select("part").distinct().count() >= spark.sparkContext.defaultParallelism


def test_stream_stats_follow_the_latest_result(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "answer_id string, question_id string, total_score double, max_score double, rating string, seq int"

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        jobs.stream_stats(stream, out, check, ["seq"]).awaitTermination()
        return {r["question_id"]: (r["n"], r["avg_score"], r["fail"]) for r in jobs.read_stats(spark, out).collect()}

    _put(spark, src, [("a", "q1", 1.0, 5.0, "fail", 1), ("b", "q1", 5.0, 5.0, "excellent", 2), ("c", "q2", 3.0, 5.0, "pass", 3)], "one")
    assert run() == {"q1": (2, 3.0, 1), "q2": (1, 3.0, 0)}
    _put(spark, src, [("a", "q1", 5.0, 5.0, "excellent", 9), ("b", "q1", 0.0, 5.0, "fail", 1)], "two")
    # a is replaced, the late older result of b is not taken
    assert run() == {"q1": (2, 5.0, 0), "q2": (1, 3.0, 0)}


class _Stopped(RuntimeError):
    pass


def _stop_once(monkeypatch, name):
    """Let the job fail once just before ``jobs.<name>`` says that a batch is done."""
    real, calls = getattr(jobs, name), []

    def finish(*args):
        calls.append(args)
        if len(calls) == 2:
            raise _Stopped
        real(*args)

    monkeypatch.setattr(jobs, name, finish)


def test_stream_scores_stopped_between_write_and_commit(spark, tmp_path, monkeypatch):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "answer_id string, answer_text string"
    for i in range(4):
        spark.createDataFrame([(f"a{i}", "x"), (f"b{i}", "y")], schema).coalesce(1).write.mode("append").parquet(src)
    _stop_once(monkeypatch, "finish_scores")
    scored = []

    def score(batch):
        scored.append(sorted(r.answer_id for r in batch.collect()))
        return batch.withColumn("total_score", F.lit(1.0))

    with pytest.raises(Exception):  # noqa: B017  the stream wraps what stopped it
        jobs.stream_scores(jobs.arriving(spark, src, schema, 1), score, out, check).awaitTermination()
    # the second batch is written, but does not count yet
    assert jobs.read_scores(spark, out).count() == 2 and (tmp_path / "out" / "batch=1").exists()
    jobs.stream_scores(jobs.arriving(spark, src, schema, 1), score, out, check).awaitTermination()
    got = sorted(r.answer_id for r in jobs.read_scores(spark, out).collect())
    assert got == sorted(f"{c}{i}" for c in "ab" for i in range(4))
    assert len(scored) == 5 and scored[1] == scored[2]  # only the stopped batch was done twice


def test_stream_stats_stopped_between_write_and_commit(spark, tmp_path, monkeypatch):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "answer_id string, question_id string, total_score double, max_score double, rating string, seq int"
    for i in range(3):
        rows = [("a", "q1", 1.0 + i, 5.0, "pass", i), (f"n{i}", "q2", 2.0, 5.0, "fail", i)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    _stop_once(monkeypatch, "finish_stats")
    run = lambda: jobs.stream_stats(jobs.arriving(spark, src, schema, 1), out, check, ["seq"]).awaitTermination()
    with pytest.raises(Exception):  # noqa: B017
        run()
    half = {r["question_id"]: r["n"] for r in jobs.read_stats(spark, out).collect()}
    assert half == {"q1": 1, "q2": 1}
    run()
    assert {r["question_id"]: (r["n"], r["avg_score"]) for r in jobs.read_stats(spark, out).collect()} == {"q1": (1, 3.0), "q2": (3, 2.0)}


def test_stream_stats_do_not_grow_with_batches(spark, tmp_path):
    out, check = (str(tmp_path / n) for n in ("out", "check"))
    schema = "answer_id string, question_id string, total_score double, max_score double, rating string, seq int"
    sizes = []
    for i in range(8):
        rows = [(f"a{k}", f"q{k % 3}", float(i), 9.0, "pass", i) for k in range(30)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_stats(jobs.arriving(spark, str(tmp_path / "in"), schema), out, check, ["seq"]).awaitTermination()
        sizes.append(sum(f.is_file() and f.suffix == ".parquet" for f in (tmp_path / "out").rglob("*")))
    # every batch rescores the same answers: the same state, and what it took to write it is gone
    assert sizes[2] == sizes[-1]
    got = {r["question_id"]: (r["n"], r["avg_score"]) for r in jobs.read_stats(spark, out).collect()}
    assert got == {f"q{k}": (10, 7.0) for k in range(3)}


def test_upsert_rewrites_touched_shards_only(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k string, v int, at int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert shards.upsert_shards(frame([(f"k{i}", i, 0) for i in range(200)]), folder, ["k"], shards=16) == 0
    shards.upsert_shards(frame([("k1", 10, 1), ("k2", 20, 1)]), folder, ["k"], shards=16)
    before = {f.name for f in (tmp_path / "t" / "rows").rglob("*.parquet")}
    assert shards.upsert_shards(frame([("k7", -7, 3), ("k7", -8, 2), ("new", 1, 1), (None, 5, 1)]), folder, ["k"], ["at"], shards=16) == 2
    want = {f"k{i}": i for i in range(200)} | {"k1": 10, "k2": 20, "k7": -7, "new": 1, None: 5}
    got = shards.read_upserted(spark, folder, schema).collect()
    assert {r.k: r.v for r in got} == want and len(got) == len(want)
    kept = [f for f in (tmp_path / "t" / "rows").rglob("*.parquet") if f.name in before]
    assert {f.parent.name for f in kept} == {f"shard={i}" for i in range(16)} and len(kept) >= 13  # first and second version
    # doing the last batch again changes nothing
    shards.upsert_shards(frame([("k7", -7, 3), ("new", 1, 1), (None, 5, 1)]), folder, ["k"], ["at"], shards=16, batch=2)
    assert {r.k: r.v for r in shards.read_upserted(spark, folder, schema).collect()} == want
