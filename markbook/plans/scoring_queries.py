"""Rubric scoring over documents, predictions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.scores import cosine
from markbook.operators import analytics, matchers, scoring, tables
from markbook.operators.matchers import LexicalMatcher, TableMatcher
from markbook.plans import grading, views
from markbook.plans.registry import ANSWERS, POINTS, RATING, Registry, quoted
from markbook.session import work_dir
from markbook.streaming import jobs

registry = Registry()
add = registry.add

_EDGES = quoted(fixed.whitespace() + fixed.SPAN_EDGE_PUNCT)


def _trimmed(x: str) -> str:
    return f"case when trim({x}, {_EDGES}) = '' then {x} else trim({x}, {_EDGES}) end"


def _fold_sql(texts: str) -> str:
    """CTEs scoring four points in order, each on the text blanked by the earlier ones."""
    out = [
        f"""{POINTS},
        wide as (select question_id, list(struct_pack(t := point_text, a := aliases) order by point_id) as ps
                 from points group by 1),
        s0 as (select answer_id, question_id, class_name, answer_text as t0, ps from {texts} join wide using (question_id))"""
    ]
    for p in range(1, 5):
        t = f"t{p - 1}"
        fits = f"strpos({t}, c) > 0 and length(c) between 1 and 64"
        out.append(f"c{p} as (select *, [c for c in list_prepend(ps[{p}].t, ps[{p}].a) if {fits}][1] as m{p} from s{p - 1})")
        out.append(f"d{p} as (select *, {_trimmed(f'm{p}')} as x{p} from c{p})")
        out.append(
            f"""s{p} as (select *, case when m{p} is null then {t} else
            substr({t}, 1, strpos({t}, x{p}) - 1) || repeat(' ', length(x{p})) ||
            substr({t}, strpos({t}, x{p}) + length(x{p})) end as t{p} from d{p})"""
        )
    rows = " union all ".join(
        f"""select answer_id, question_id, class_name, {p}::bigint as point_id,
        case when m{p} is null then 'miss' else 'hit_exact' end as hit_status, m{p} as matched_alias,
        case when m{p} is not null then x{p} end as extracted_span,
        case when m{p} is not null then 0.97::double end as confidence,
        case when m{p} is null then 0.0::double end as similarity,
        case when m{p} is null then 0 else {p} end::double as point_score,
        case when m{p} is null then 'similarity' else 'mrc' end as source from s4"""
        for p in range(1, 5)
    )
    out.append(f"scored as ({rows})")
    return ",\n".join(out)


_SCORED = f"{ANSWERS}, {_fold_sql('answers')}"
_TOTALS = """totals as (select answer_id, question_id, class_name, sum(point_score)::double as total_score,
    10.0::double as max_score from scored group by 1, 2, 3)"""


def _scored(spark, folder):
    return scoring.score_answers(views.answers(spark, folder), views.configs(spark, folder))


@add(
    "score_points",
    f"""with {_SCORED} select answer_id, question_id, point_id, hit_status, matched_alias, extracted_span, confidence,
    similarity, point_score, source from scored""",
)
def score_points(spark, folder):
    return scoring.detail_rows(_scored(spark, folder))


@add("score_totals", f"with {_SCORED}, {_TOTALS} select *, {RATING} as rating from totals")
def score_totals(spark, folder):
    return _scored(spark, folder).select(
        "answer_id", "question_id", "class_name", "total_score", "max_score", "rating"
    )


@add(
    "point_hits_scored",
    f"""with {_SCORED} select question_id, point_id, count(*) filter (hit_status <> 'miss') as hit, count(*) as total,
    count(*) filter (hit_status <> 'miss') / count(*) as hit_rate from scored group by 1, 2""",
)
def point_hits_scored(spark, folder):
    return analytics.with_hit_rate(analytics.point_hits(scoring.detail_rows(_scored(spark, folder))))


@add(
    "question_outcomes",
    f"""with {_SCORED}, {_TOTALS}, r as (select *, {RATING} as rating from totals)
    select question_id, count(*) as n, avg(total_score) as avg_score, max(total_score) as max_total,
    min(total_score) as min_total, avg(case when rating <> 'fail' then 1.0::double else 0 end) * 100.0 as pass_rate,
    count(*) filter (rating = 'excellent') as excellent, count(*) filter (rating = 'good') as good,
    count(*) filter (rating = 'pass') as pass, count(*) filter (rating = 'fail') as fail from r group by 1""",
)
def question_outcomes(spark, folder):
    return analytics.question_summary(_scored(spark, folder))


def _candidates(spark, folder):
    answers = views.answers(spark, folder).select("answer_id", "question_id")
    return matchers.candidate_rows(answers, views.points(spark, folder))


_CANDIDATES = f"""{ANSWERS}, {POINTS},
    listed as (select question_id, point_id, weight, unnest(range(len(aliases) + 1)) as pos,
               unnest(list_prepend(point_text, aliases)) as candidate from points),
    candidates as (select answer_id, question_id, point_id, weight, pos::int as pos, candidate
                   from answers join listed using (question_id))"""


@add("candidates", f"with {_CANDIDATES} select * from candidates")
def candidates(spark, folder):
    return _candidates(spark, folder)


def _predictions(cands):
    """Made-up evidence per (answer, candidate), by arithmetic on ids."""
    a, p, k = F.col("answer_id"), F.col("point_id"), F.col("pos")
    start = a % 50
    return cands.select(
        "answer_id",
        "point_id",
        "pos",
        "candidate",
        ((a * 7 + k * 13 + p * 5) % 101 / 100.0).alias("has_answer_prob"),
        start.cast("int").alias("start"),
        (start + (a + k) % 80).cast("int").alias("end"),
    )


@add(
    "pick_span",
    f"""with {_CANDIDATES}, d as (select answer_id, point_id, pos, candidate,
      (answer_id * 7 + pos * 13 + point_id * 5) % 101 / 100.0::double as has_answer_prob,
      (answer_id % 50)::int as start, (answer_id % 50 + (answer_id + pos) % 80)::int as "end" from candidates),
    ok as (select d.*, row_number() over (partition by d.answer_id, point_id order by has_answer_prob desc, pos) as r
      from d join answers a on a.answer_id = d.answer_id
      where has_answer_prob >= 0.8 and start <= "end" and "end" < length(answer_text) and "end" - start + 1 <= 64)
    select answer_id, point_id, candidate, has_answer_prob, start, "end" from ok where r = 1""",
)
def pick_span(spark, folder):
    lengths = views.answers(spark, folder).select("answer_id", F.length("answer_text").alias("answer_len"))
    made = _predictions(_candidates(spark, folder)).join(lengths, "answer_id")
    return scoring.pick_span(made, 0.8)


@add(
    "prediction_gaps",
    f"""with {_CANDIDATES}, d as (select distinct answer_id, candidate from candidates where (answer_id + pos) % 9 <> 0)
    select count(*) as candidates, count(*) filter (d.answer_id is null) as missing
    from candidates c left join d on d.answer_id = c.answer_id and d.candidate = c.candidate""",
)
def prediction_gaps(spark, folder):
    cands = _candidates(spark, folder)
    known = cands.where((F.col("answer_id") + F.col("pos")) % 9 != 0).select("answer_id", "candidate").distinct()
    return matchers.count_missing(cands, known)


@add("table_scoring")
def table_scoring(spark, folder):
    """Scoring from precomputed evidence; the same fold as the lexical one, checked on small cases."""
    cands = _candidates(spark, folder)
    made = _predictions(cands)
    # one entry per wording, whichever point it came from
    spans = made.groupBy("answer_id", "candidate").agg(
        F.min_by(F.struct("has_answer_prob", "start", "end"), F.struct("point_id", "pos")).alias("e")
    ).select("answer_id", "candidate", "e.*")
    cosines = (
        cands.where("pos = 0")
        .select("answer_id", F.col("candidate").alias("point_text"), (F.col("answer_id") % 11 / 10.0).alias("cosine"))
        .distinct()
    )
    matcher = TableMatcher(spans, cosines)
    out = scoring.score_answers(views.answers(spark, folder), views.configs(spark, folder), matcher)
    return scoring.detail_rows(out)


_VECTORS = """chosen as (select label as point_label, min(vec_id) as point_vec from embeddings group by 1),
    pts as (select point_label, point_vec, embedding as pe from chosen join embeddings on vec_id = point_vec),
    rest as (select * from embeddings where vec_id not in (select point_vec from chosen)),
    sims as (select vec_id, point_label, label = point_label as gold,
      list_inner_product(embedding::double[], pe::double[]) / (sqrt(list_inner_product(embedding::double[], embedding::double[]))
        * sqrt(list_inner_product(pe::double[], pe::double[])) + 1e-9) as c
      from rest join pts on label % 5 = point_label % 5)"""


def _similar(spark, folder):
    point, rest = views.vectors(spark, folder)
    left = rest.withColumn("question_id", F.col("label") % 5)
    right = point.withColumn("question_id", F.col("point_label") % 5)
    return left.join(right, "question_id").select(
        "vec_id",
        "point_label",
        (F.col("label") == F.col("point_label")).alias("gold"),
        cosine(F.col("embedding"), F.col("point_embedding")).alias("c"),
    )


@add("cosine_fallback", f"with {_VECTORS} select vec_id, point_label, gold, round(c, 6) as cosine from sims")
def cosine_fallback(spark, folder):
    return _similar(spark, folder).select("vec_id", "point_label", "gold", F.col("c").alias("cosine"))


@add(
    "score_fallback",
    f"""with {_VECTORS} select vec_id, point_label, case when round(c, 6) >= 0.5 then 'hit_semantic'
    when round(c, 6) >= 0.2 then 'partial' else 'miss' end as hit_status,
    case when round(c, 6) >= 0.5 then 2.0 when round(c, 6) >= 0.2 then 0.5 else 0.0 end::double as point_score from sims""",
)
def score_fallback(spark, folder):
    point = F.struct(F.col("point_label").cast("bigint").alias("point_id"), F.lit(2.0).alias("weight"))
    judged = scoring.from_similarity(point, F.col("c"), F.lit(0.5), F.lit(0.2), 0.25)
    return _similar(spark, folder).select("vec_id", "point_label", judged.alias("d")).select(
        "vec_id", "point_label", "d.hit_status", "d.point_score"
    )


@add(
    "sentence_max",
    f"""with {ANSWERS}, {POINTS}, s as (select answer_id, question_id, point_id, point_text,
      unnest(regexp_split_to_array(answer_text, '[。！？；\n]+')) as raw
      from answers join points using (question_id)),
    parts as (select *, trim(raw, {quoted(fixed.whitespace())}) as part from s),
    j as (select answer_id, point_id, max(case when part <> '' then case when strpos(part, point_text) > 0 then
      length(point_text) / length(part) else 0 end end)::double as best from parts group by 1, 2)
    select answer_id, point_id, round(coalesce(best, 0), 6) as cos_sent_max from j""",
)
def sentence_max(spark, folder):
    """Sentence-wise evidence with a stand-in similarity: share of the sentence the point text fills."""
    first = views.points(spark, folder).select("question_id", "point_id", "point_text")
    rows = views.answers(spark, folder).select("answer_id", "question_id", "answer_text").join(first, "question_id")

    def share(point, sentence):
        return F.when(F.instr(sentence, point) > 0, F.length(point) / F.length(sentence)).otherwise(F.lit(0.0))

    out = scoring.sentence_max(rows, share)
    return out.select("answer_id", "point_id", F.round("cos_sent_max", 6).alias("cos_sent_max"))


def _grading_inputs(spark, folder):
    docs = views.answers(spark, folder)
    none = F.lit(None).cast("string")
    answers = docs.select(
        "answer_id", "question_id", none.alias("student_id"), "class_name", "answer_text",
        F.lit("text").alias("source"), none.alias("ocr_text"),
    )
    bench = views.table(spark, folder, "benchmark")
    questions = bench.select(F.col("item_id").alias("question_id"), F.col("text").alias("content"))
    return answers, questions


def _graded(spark, folder, answers):
    _, questions = _grading_inputs(spark, folder)
    return grading.grade(answers, views.configs(spark, folder), questions, LexicalMatcher(), min_match=24)


# the greedy pass over stem matches of the own question, as SQL: see text_queries
def _graded_sql() -> str:
    from markbook.plans.text_queries import STRIPPED_OWN

    blanked = """blanked as (select a.answer_id, a.question_id, a.class_name,
      coalesce(s.stripped_text, a.answer_text) as answer_text from answers a left join stripped s using (answer_id))"""
    return f"""{STRIPPED_OWN}, {blanked}, {_fold_sql('blanked')}, {_TOTALS}
    select answer_id, question_id, class_name, total_score, max_score, {RATING} as rating from totals"""


@add("grade_answers", _graded_sql())
def grade_answers(spark, folder):
    answers, _ = _grading_inputs(spark, folder)
    return _graded(spark, folder, answers).select(
        "answer_id", "question_id", "class_name", "total_score", "max_score", "rating"
    )


@add("stream_scores", f"with {_SCORED}, {_TOTALS} select answer_id, total_score, {RATING} as rating from totals")
def stream_scores(spark, folder):
    """Documents arriving as six files, two in a batch, each scored once."""
    base = work_dir(spark, "scores")
    documents = views.documents(spark, folder)
    documents.repartition(6, "doc_id").write.parquet(f"{base}/in")
    stream = jobs.arriving(spark, f"{base}/in", "doc_id bigint, text string, lang string, source string, n_chars bigint", 2)
    configs = views.configs(spark, folder)

    def score(batch):
        answers = batch.select(
            F.col("doc_id").alias("answer_id"), views.question_id(spark, folder).alias("question_id"), F.col("text").alias("answer_text")
        )
        return scoring.score_answers(answers, configs).select("answer_id", "total_score", "rating")

    jobs.stream_scores(stream, score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return jobs.read_scores(spark, f"{base}/out")


@add(
    "stream_stats",
    f"""with latest as (select user_id as answer_id, user_id % 20 as question_id, value as total_score, 50.0 as max_score from (
      select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1),
    r as (select *, {RATING} as rating from latest)
    select question_id, count(*) as n, round(avg(total_score), 6) as avg_score, max(total_score) as max_total,
    min(total_score) as min_total, round(avg(case when rating <> 'fail' then 1.0::double else 0 end) * 100.0, 6) as pass_rate,
    count(*) filter (rating = 'excellent') as excellent, count(*) filter (rating = 'good') as good,
    count(*) filter (rating = 'pass') as pass, count(*) filter (rating = 'fail') as fail from r group by 1""",
)
def stream_stats(spark, folder):
    """Events in five files by time, a batch each, as results scored again and again; statistics follow the latest of each answer."""
    base = work_dir(spark, "stats")
    # event times are read as the given files store them, without a time zone
    schema = views.EVENTS.replace("ts timestamp", "ts timestamp_ntz")
    events = spark.read.schema(schema).parquet(f"{folder}/events.parquet")
    events.repartitionByRange(5, "ts").write.parquet(f"{base}/in")
    stream = jobs.arriving(spark, f"{base}/in", schema, 1)
    query = jobs.stream_stats(views.submissions(stream), f"{base}/out", f"{base}/checkpoint", ["ts", "event_id"])
    query.awaitTermination()
    out = jobs.read_stats(spark, f"{base}/out")
    return out.withColumns({"avg_score": F.round("avg_score", 6), "pass_rate": F.round("pass_rate", 6)})


@add(
    "question_stems",
    """select conv_id % 30 as question_id, string_agg(distinct trim(text, chr(10) || ' '), chr(10) order by trim(text, chr(10) || ' ')) as stem
    from conversations where turn = 0 group by 1""",
)
def question_stems(spark, folder):
    """Stems found through the part of the row id before '#', several per question."""
    conv = views.table(spark, folder, "conversations")
    items = conv.where("turn = 0").select(F.col("conv_id").cast("string").alias("id"), F.col("text").alias("question"))
    rows = conv.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("#p"), F.col("turn").cast("string")).alias("id"),
        (F.col("conv_id") % 30).alias("question_id"),
        F.lit("full").alias("origin"),
    )
    return tables.question_stems(rows, items)
