"""Result analytics and table maintenance over the given tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.functions.scores import rating
from markbook.operators import analytics, tables
from markbook.plans import views
from markbook.plans.registry import DETAILS, QUESTION, RATING, RESULTS, Registry
from markbook.session import work_dir
from markbook.sources import shards
from markbook.sources.io import parse_phases

registry = Registry()
add = registry.add

_SHARE = "case when max_score > 0 then total_score / max_score else 0 end"
_BUCKET = f"least(floor(({_SHARE}) * 100.0)::int, 99) // 20"
_LABELS = "['" + "', '".join(fixed.BUCKET_LABELS) + "']"


@add("rating_dist", f"with {RESULTS} select rating, count(*) as n from results group by 1")
def rating_dist(spark, folder):
    return analytics.rating_counts(views.results(spark, folder))


@add(
    "score_buckets",
    f"""with {RESULTS}, n as (select {_BUCKET} as bucket, count(*) as n from results group by 1)
    select b::int as bucket, {_LABELS}[b + 1] as label, coalesce(n, 0) as n
    from unnest([0, 1, 2, 3, 4]) t(b) left join n on n.bucket = b""",
)
def score_buckets(spark, folder):
    return analytics.score_buckets(views.results(spark, folder))


@add(
    "question_buckets",
    f"""with {RESULTS}, n as (select question_id, {_BUCKET} as bucket, count(*) as n from results group by 1, 2),
    q as (select distinct question_id from results)
    select q.question_id, b::int as bucket, {_LABELS}[b + 1] as label, coalesce(n, 0) as n
    from q cross join unnest([0, 1, 2, 3, 4]) t(b) left join n on n.bucket = b and n.question_id = q.question_id""",
)
def question_buckets(spark, folder):
    return analytics.score_buckets(views.results(spark, folder), ["question_id"])


@add(
    "point_hit_rate",
    f"""with {DETAILS} select question_id, point_id, count(*) filter (hit_status <> 'miss') as hit,
    count(*) as total, count(*) filter (hit_status <> 'miss') / count(*) as hit_rate from details group by 1, 2""",
)
def point_hit_rate(spark, folder):
    return analytics.with_hit_rate(analytics.point_hits(views.details(spark, folder)))


_SUMMARY = """select question_id, count(*) as n, avg(total_score) as avg_score, max(total_score) as max_total,
    min(total_score) as min_total, avg(case when rating <> 'fail' then 1.0::double else 0 end) * 100.0 as pass_rate,
    count(*) filter (rating = 'excellent') as excellent, count(*) filter (rating = 'good') as good,
    count(*) filter (rating = 'pass') as pass, count(*) filter (rating = 'fail') as fail
    from results {where} group by 1"""


@add("question_summary", f"with {RESULTS} {_SUMMARY.format(where='')}")
def question_summary(spark, folder):
    return analytics.question_summary(views.results(spark, folder))


@add("class_filter", f"""with {RESULTS} {_SUMMARY.format(where="where class_name = '1-URGENT'")}""")
def class_filter(spark, folder):
    return analytics.question_summary(views.results(spark, folder), "1-URGENT")


@add(
    "answer_totals",
    f"""with {DETAILS}, sums as (select answer_id, sum(point_score)::double as total_score,
    sum(weight)::double as max_score from details group by 1) select *, {RATING} as rating from sums""",
)
def answer_totals(spark, folder):
    return analytics.answer_totals(views.details(spark, folder))


_STATUS = "['none', 'pending_review', 'confirmed'][question_id % 3 + 1]"


def _questions(spark, folder):
    status = F.array(F.lit("none"), F.lit("pending_review"), F.lit("confirmed"))
    q = views.table(spark, folder, "orders").select((F.col("o_custkey") % 50).alias("question_id")).distinct()
    return q.withColumn("config_status", F.get(status, (F.col("question_id") % 3).cast("int")))


_QUESTIONS = f"""questions as (select question_id, {_STATUS} as config_status
    from (select distinct o_custkey % 50 as question_id from orders))"""


@add(
    "admin_stats",
    f"""with {RESULTS}, {_QUESTIONS}, b as (select {_BUCKET} as bucket, count(*) as n from results group by 1)
    select 'questions' as section, 'total' as name, count(*)::double as value from questions
    union all select 'questions', config_status, count(*) from questions group by 2
    union all select 'answers', 'total', count(*) from orders
    union all select 'scores', 'total', count(*) from results
    union all select 'scores', 'average', coalesce(avg(total_score), 0) from results
    union all select 'scores', 'max_score_average', coalesce(avg(max_score), 0) from results
    union all select 'rating', rating, count(*) from results group by 2
    union all select 'distribution', {_LABELS}[p + 1], coalesce(n, 0)
      from unnest([0, 1, 2, 3, 4]) t(p) left join b on b.bucket = p""",
)
def admin_stats(spark, folder):
    return analytics.admin_stats(
        _questions(spark, folder), views.table(spark, folder, "orders"), views.results(spark, folder)
    )


@add(
    "ocr_assemble",
    """select l_orderkey as question_id,
    string_agg(l_linenumber::varchar, chr(10) order by l_quantity, l_extendedprice, l_linenumber) as answer_text,
    round(avg(1 - 2 * l_tax), 6) as confidence, count(*)::int as n_lines, bool_or(1 - 2 * l_tax < 0.8) as low_confidence
    from lineitem group by 1""",
)
def ocr_assemble(spark, folder):
    out = analytics.assemble_ocr(views.ocr_lines(spark, folder))
    return out.withColumn("confidence", F.round("confidence", 6))


@add(
    "phase_timings",
    """select event_type as phase, round(avg(value), 6) as mean_ms, min(value) as min_ms, max(value) as max_ms,
    count(*) as n from events group by 1""",
)
def phase_timings(spark, folder):
    out = analytics.phase_timings(parse_phases(views.log_lines(spark, folder)))
    return out.withColumn("mean_ms", F.round("mean_ms", 6))


@add(
    "latency_ranks",
    """with s as (select value, row_number() over (order by value) - 1 as i, count(*) over () as n from events)
    select q::double as q, value from s, unnest([0.5, 0.95, 0.99, 1.0]::double[]) t(q)
    where i = least(n - 1, floor(q * n)::bigint)""",
)
def latency_ranks(spark, folder):
    return analytics.latency_summary(views.table(spark, folder, "events"), "value")


@add(
    "throughput",
    """select count(*) as calls, round(epoch(max(ts)) - epoch(min(ts)), 3) as wall,
    round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) as per_second from events""",
)
def throughput(spark, folder):
    out = analytics.throughput(views.table(spark, folder, "events"), "ts", "ts")
    return out.withColumns({"wall": F.round("wall", 3), "per_second": F.round("per_second", 6)})


@add(
    "usage_totals",
    """select count(*) filter (event_type <> 'error') as calls, count(*) filter (event_type = 'error') as failures,
    sum(case when event_type <> 'error' then user_id else 0 end)::bigint as prompt_tokens,
    sum(case when event_type <> 'error' then event_id else 0 end)::bigint as completion_tokens,
    sum(case when event_type <> 'error' then user_id + event_id else 0 end)::bigint as total_tokens from events""",
)
def usage_totals(spark, folder):
    calls = views.table(spark, folder, "events").select(
        (F.col("event_type") != "error").alias("ok"),
        F.col("user_id").alias("prompt_tokens"),
        F.col("event_id").alias("completion_tokens"),
    )
    return analytics.usage_totals(calls)


# --- table maintenance ----------------------------------------------------------------------------
_LATEST = """latest as (select user_id as answer_id, value as total_score, event_id from (
    select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1)"""


@add(
    "upsert_latest",
    f"""with {_LATEST} select answer_id, total_score, event_id from latest
    union all select c_custkey, c_acctbal, -1 from customer
    where c_custkey not in (select answer_id from latest)""",
)
def upsert_latest(spark, folder):
    base = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("answer_id"), F.col("c_acctbal").alias("total_score"), F.lit(-1).cast("bigint").alias("event_id")
    )
    updates = views.table(spark, folder, "events").select(
        F.col("user_id").alias("answer_id"), F.col("value").alias("total_score"), "event_id", "ts"
    )
    return tables.upsert(base, updates, ["answer_id"], ["ts", "event_id"])


@add(
    "upsert_stored",
    """with late as (select user_id as answer_id, value as total_score, event_id, event_id % 2 as part,
      row_number() over (partition by user_id, event_id % 2 order by ts desc, event_id desc) as r from events),
    odd as (select answer_id, total_score, event_id from late where r = 1 and part = 1),
    even as (select answer_id, total_score, event_id from late where r = 1 and part = 0 and answer_id not in (select answer_id from odd))
    select * from odd union all select * from even union all select c_custkey, c_acctbal, -1 from customer
    where c_custkey not in (select answer_id from odd union all select answer_id from even)""",
)
def upsert_stored(spark, folder):
    """Customers are stored in shards; two upserts of events follow, the second over the first."""
    path = os.path.join(work_dir(spark, "upserts"), "table")
    base = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("answer_id"), F.col("c_acctbal").alias("total_score"), F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(None).cast("timestamp").alias("ts"),
    )
    events = views.table(spark, folder, "events").select(
        F.col("user_id").alias("answer_id"), F.col("value").alias("total_score"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    )
    shards.upsert_shards(base, path, ["answer_id"])
    for part in (0, 1):
        shards.upsert_shards(events.where(F.col("event_id") % 2 == part), path, ["answer_id"], ["ts", "event_id"])
    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
    return shards.read_upserted(spark, path, schema).drop("ts")


@add(
    "cascade_delete",
    f"""with {RESULTS}, {_QUESTIONS}, gone as (select question_id from questions where question_id % 7 = 3)
    select 'questions' as name, count(*) as n from questions where question_id not in (from gone)
    union all select 'results', count(*) from results where question_id not in (from gone)
    union all select 'answers', count(*) from orders where o_custkey % 50 not in (from gone)""",
)
def cascade_delete(spark, folder):
    questions = _questions(spark, folder)
    gone = questions.where("question_id % 7 = 3").select("question_id")
    orders = views.table(spark, folder, "orders").withColumn("question_id", F.col("o_custkey") % 50)
    kept = tables.cascade(
        {"questions": questions, "results": views.results(spark, folder), "answers": orders}, gone
    )
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@add(
    "project_delete",
    """with p as (select n_nationkey as project_id from nation), gone as (select project_id from p where project_id % 5 = 0),
    q as (select c_custkey as question_id, c_nationkey as project_id from customer),
    doomed as (select question_id from q where project_id in (from gone))
    select 'projects' as name, count(*) as n from p where project_id not in (from gone)
    union all select 'questions', count(*) from q where question_id not in (from doomed)
    union all select 'answers', count(*) from orders where o_custkey not in (from doomed)""",
)
def project_delete(spark, folder):
    projects = views.table(spark, folder, "nation").select(F.col("n_nationkey").alias("project_id"))
    questions = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("question_id"), F.col("c_nationkey").alias("project_id")
    )
    answers = views.table(spark, folder, "orders").select(F.col("o_custkey").alias("question_id"))
    kept = tables.delete_project(projects, questions, {"answers": answers}, projects.where("project_id % 5 = 0"))
    out = None
    for name, df in kept.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@add(
    "resume_anti",
    "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
)
def resume_anti(spark, folder):
    done = views.table(spark, folder, "labels")
    return tables.not_done(views.table(spark, folder, "documents").select("doc_id", "lang"), done, "doc_id")


@add(
    "config_status",
    f"""with {_QUESTIONS} select question_id, case when question_id in (select item_id from benchmark)
    then 'confirmed' else config_status end as config_status from questions""",
)
def config_status(spark, folder):
    saved = views.table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"))
    return tables.save_config(_questions(spark, folder), saved, "confirmed")


@add(
    "default_ids",
    """select o_orderkey, (o_custkey % 50) || '-A' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as answer_id
    from (select *, row_number() over (partition by o_custkey % 50 order by o_orderkey) as n from orders)""",
)
def default_ids(spark, folder):
    orders = views.table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("question_id"))
    prefix = F.concat(F.col("question_id").cast("string"), F.lit("-A"))
    out = tables.default_ids(orders, "answer_id", "o_orderkey", prefix, group=["question_id"])
    return out.select("o_orderkey", "answer_id")


@add(
    "clean_submissions",
    """select conv_id, turn, nullif(case when role = 'user' then '' else role end, '') as student_id,
    trim(text, ' ' || chr(10) || chr(9) || chr(13)) as answer_text
    from conversations where trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> ''""",
)
def clean_submissions(spark, folder):
    rows = views.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("student_id"),
        F.lit("").alias("class_name"),
        F.col("text").alias("answer_text"),
    )
    return tables.clean_submissions(rows).drop("class_name")


@add(
    "list_rows",
    f"with {RESULTS} select * from results where question_id = 7 and class_name = '2-HIGH'",
)
def list_rows(spark, folder):
    return tables.list_rows(views.results(spark, folder), question_id=7, class_name="2-HIGH", rating=None)


@add(
    "latest_projects",
    "select page_id, url from pages order by length(html) desc, page_id",
)
def latest_projects(spark, folder):
    pages = views.table(spark, folder, "pages").select(
        F.col("page_id").alias("project_id"), "url", F.length("html").alias("created_at")
    )
    return tables.latest_projects(pages).select(F.col("project_id").alias("page_id"), "url")


@add(
    "scoring_input",
    f"""select d.doc_id as answer_id, d.{QUESTION} as question_id,
    coalesce(case when d.source = 'src0' then p.url end, d.text, '') as text, b.text as stem_text,
    case when d.source = 'src0' then (d.{QUESTION}) / 40.0::double end as ocr_confidence
    from documents d left join benchmark b on b.item_id = d.{QUESTION} left join pages p on p.page_id = d.doc_id""",
)
def scoring_input(spark, folder):
    docs = views.table(spark, folder, "documents")
    pages = views.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
    first = F.col("source") == "src0"
    answers = docs.join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("answer_id"),
        views.question_id(spark, folder).alias("question_id"),
        F.when(first, F.col("url")).alias("ocr_text"),
        F.col("text").alias("answer_text"),
        F.when(first, "ocr").otherwise("text").alias("source"),
    )
    bench = views.table(spark, folder, "benchmark")
    questions = bench.select(F.col("item_id").alias("question_id"), F.col("text").alias("content"))
    ocr = docs.select(views.question_id(spark, folder).alias("question_id")).distinct().withColumn(
        "confidence", F.col("question_id") / 40.0
    )
    out = tables.scoring_input(answers, questions, ocr)
    return out.select("answer_id", "question_id", "text", "stem_text", "ocr_confidence")


@add(
    "with_student",
    """select o_orderkey as answer_id, o_totalprice as total_score, c_name as student_id, c_mktsegment as class_name
    from orders left join customer on c_custkey = o_orderkey""",
)
def with_student(spark, folder):
    results = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("answer_id"), F.col("o_totalprice").alias("total_score")
    )
    answers = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("answer_id"), F.col("c_name").alias("student_id"), F.col("c_mktsegment").alias("class_name")
    )
    return tables.with_student(results, answers)


@add(
    "submission_ratings",
    f"""with {_LATEST} select answer_id, total_score, {RATING.replace("max_score", "50.0")} as rating from latest""",
)
def submission_ratings(spark, folder):
    events = views.submissions(views.table(spark, folder, "events"))
    out = tables.latest(events, ["answer_id"], ["ts", "event_id"])
    return out.select("answer_id", "total_score", rating(F.col("total_score"), F.lit(50.0)).alias("rating"))
