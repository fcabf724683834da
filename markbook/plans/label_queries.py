"""Label work over votes and labels made from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook.operators import labels, rubrics
from markbook.plans import views
from markbook.plans.registry import LABELS, LINES, POINTS, QUESTION, VOTES, Registry
from markbook.schemas import LABELS as LABEL_SCHEMA

registry = Registry()
add = registry.add

_CREDIT = "case when hit_type = 'exact' then 1.0 when hit_type = 'semantic' then 0.5 end::double"

_VOTED = f"""{VOTES},
    k as (select sample_id, point_id, hit, hit_type, count(*) as n, min(round) as first from votes group by 1, 2, 3, 4),
    w as (select *, row_number() over (partition by sample_id, point_id order by n desc, first) as place from k),
    t as (select sample_id, point_id, max(n) as top, arg_min(hit_type, place) as top_type, arg_min(hit_type, first) as base_type from w group by 1, 2),
    c as (select *, case when top * 2 > 3 then top_type else base_type end as hit_type from t),
    s as (select c.sample_id, c.point_id, extracted_span, row_number() over (partition by c.sample_id, c.point_id order by confidence desc, round) as r
      from c join votes v on v.sample_id = c.sample_id and v.point_id = c.point_id and v.hit_type = c.hit_type),
    m as (select sample_id, point_id, round(sum(confidence) / count(*), 3) as confidence from votes group by 1, 2),
    voted as (select c.sample_id, c.point_id, c.hit_type <> 'miss' as hit, c.hit_type, s.extracted_span, m.confidence,
      {_CREDIT} as partial_credit, top / 3 as agreement, c.hit_type <> base_type as flipped
      from c join s on s.sample_id = c.sample_id and s.point_id = c.point_id and r = 1
      join m on m.sample_id = c.sample_id and m.point_id = c.point_id)"""


@add(
    "majority_vote",
    f"""with {_VOTED} select sample_id, point_id, hit, hit_type, extracted_span, confidence, partial_credit,
    agreement, flipped from voted""",
)
def majority_vote(spark, folder):
    return labels.majority_vote(views.votes(spark, folder))


@add(
    "vote_report",
    f"""with {_VOTED}, p as (select sample_id, avg(agreement) as a, count(*) filter (flipped) as f from voted group by 1)
    select count(*) as checked_samples, sum(f)::bigint as point_flips, round(avg(a), 4) as mean_point_agreement from p""",
)
def vote_report(spark, folder):
    return labels.vote_report(labels.majority_vote(views.votes(spark, folder), 3))


@add(
    "vote_counts",
    f"""with {VOTES} select sample_id, point_id, hit, hit_type, count(*) as votes, min(round)::int as first_round,
    round(sum(confidence), 6) as confidence_sum, arg_max(extracted_span, (confidence, -round)) as surest_span from votes group by 1, 2, 3, 4""",
)
def vote_counts(spark, folder):
    out = labels.count_votes(views.votes(spark, folder))
    sums = out.withColumn("confidence_sum", F.round("confidence_sum", 6))
    return sums.withColumn("surest_span", F.col("surest.extracted_span")).drop("surest")


@add(
    "merge_voted",
    f"""with {LABELS} select sample_id, point_id, case when sample_id % 3 = 0 then 'voted' else 'raw' end as stage from labels0""",
)
def merge_voted(spark, folder):
    every = views.labels(spark, folder).select("sample_id", "point_id")
    voted = every.where("sample_id % 3 = 0").withColumn("stage", F.lit("voted"))
    return labels.merge_voted(every, voted).withColumn("stage", F.coalesce("stage", F.lit("raw")))


_REASON = """case when confidence < 0.55 then 'low_confidence' when not hit then null when span_length = 0 then 'empty_span'
    when span_length > 0.5 * greatest(answer_length, 1) then 'overlong_span' when span_length % 11 = 0 then 'align_fail' end"""
_FILTERED = f"""{LABELS}, filtered as (select *, {_REASON} as reason from labels0),
    per as (select sample_id, count(*) as n, count(reason) as bad from filtered group by 1),
    verdict as (select *, bad / n > 0.34 as over, bad / n <= 0.34 and bad = n as empty from per)"""


def _filtered(spark, folder):
    return labels.point_filter(
        views.labels(spark, folder), F.col("span_length"), F.col("answer_length"), F.col("span_length") % 11 != 0
    )


@add(
    "quality_filter",
    f"with {_FILTERED} select reason, count(*) as points from filtered where reason is not null group by 1",
)
def quality_filter(spark, folder):
    return labels.filter_counts(_filtered(spark, folder))


@add(
    "kept_points",
    f"""with {_FILTERED} select f.sample_id, f.point_id, f.hit_type from filtered f join verdict v using (sample_id)
    where reason is null and not over and not empty""",
)
def kept_points(spark, folder):
    kept, _ = labels.drop_bad_samples(_filtered(spark, folder))
    return kept.select("sample_id", "point_id", "hit_type")


@add(
    "dropped_samples",
    f"""with {_FILTERED} select sample_id, n as total_points, bad as invalid_points,
    case when over then 'sample_dropped_invalid_ratio' else 'sample_dropped_empty' end as dropped from verdict where over or empty""",
)
def dropped_samples(spark, folder):
    return labels.drop_bad_samples(_filtered(spark, folder))[1]


@add(
    "quality_report",
    f"""with {_FILTERED}, f as (select * from filtered join verdict using (sample_id)),
    s as (select sample_id, bool_or(hit and reason is null) as hits from f where not over and not empty group by 1)
    select (select count(*) from verdict) as input_records, (select count(*) from verdict where not over and not empty) as kept_samples,
    (select count(*) from verdict where over) as sample_dropped_invalid_ratio, (select count(*) from verdict where empty) as sample_dropped_empty,
    (select count(*) from s where hits) as samples_with_hits, (select count(*) from s where hits) as samples_fully_aligned,
    count(*) filter (reason = 'low_confidence') as low_confidence, count(*) filter (reason = 'empty_span') as empty_span,
    count(*) filter (reason = 'overlong_span') as overlong_span, count(*) filter (reason = 'align_fail') as align_fail,
    count(*) filter (hit and reason is distinct from 'low_confidence') as hit_points, count(*) filter (hit and reason is null) as aligned,
    count(*) filter (not hit and reason is null) as miss_points,
    count(*) filter (reason is null and hit_type = 'exact') as exact, count(*) filter (reason is null and hit_type = 'semantic') as semantic,
    count(*) filter (reason is null and hit_type = 'exact' and not over and not empty) as kept_exact,
    count(*) filter (reason is null and hit_type = 'semantic' and not over and not empty) as kept_semantic,
    round(count(*) filter (hit and reason is null) / greatest(count(*) filter (hit and reason is distinct from 'low_confidence'), 1), 4) as point_success_rate,
    case when (select count(*) from s where hits) > 0 then 1.0 else 0.0 end::double as sample_success_rate,
    round(count(*) filter (reason is null and hit_type = 'semantic') / greatest(count(*) filter (reason is null and hit), 1), 4) as semantic_share
    from f""",
)
def quality_report(spark, folder):
    return labels.quality_report(_filtered(spark, folder))


@add(
    "high_value_top",
    f"""with {LABELS} select sample_id, min(confidence) as min_confidence from labels0 group by 1
    having bool_or(hit_type = 'semantic') or min(confidence) < 0.75 order by 2, 1 limit 400""",
)
def high_value_top(spark, folder):
    return labels.high_value(views.labels(spark, folder))


@add(
    "inspection_sample",
    f"""with {LABELS}, s as (select sample_id, origin, case when bool_or(hit_type = 'semantic') then 'semantic' when bool_or(hit) then 'hit' else 'all_miss' end as stratum
      from labels0 group by 1, 2),
    r as (select *, row_number() over (partition by origin, stratum order by md5('42#' || sample_id), sample_id) as r,
      count(*) over (partition by origin, stratum) as n from s)
    select sample_id, origin, stratum from r where r <= greatest(1, round_even(n * 0.05, 0))""",
)
def inspection_sample(spark, folder):
    return labels.inspection_sample(views.labels(spark, folder))


@add(
    "label_inventory",
    f"""with {VOTES}, s as (select case when round = 0 then 'raw' else 'voted' end as stage, hit, hit_type from votes)
    select stage, count(*) as points, count(*) filter (hit) as hits, count(*) filter (hit_type = 'exact') as exact,
    count(*) filter (hit_type = 'semantic') as semantic, count(*) filter (hit_type = 'semantic') / count(*) filter (hit) as semantic_share
    from s group by 1""",
)
def label_inventory(spark, folder):
    votes = views.votes(spark, folder)
    return labels.label_inventory({"raw": votes.where("round = 0"), "voted": votes.where("round > 0")})


_POINT_DATA = """pt as (select sample_id, point_id, sample_id // 4 as answer, point_id as point_text, hit, hit_type, extracted_span, confidence,
    case when hit and span_length % 3 = 0 then span_length end as align from labels0)"""


@add(
    "conflict_unify",
    f"""with {LABELS}, {_POINT_DATA},
    f as (select answer, point_text, min(sample_id) as first from pt where hit and align is not null and answer % 5 <> 0 group by 1, 2),
    j as (select pt.*, f.first is not null and not (pt.hit and pt.align is not null) as unified, o.hit_type as t, o.extracted_span as x, o.confidence as c, o.align as al
      from pt left join f on f.answer = pt.answer and f.point_text = pt.point_text
      left join pt o on o.sample_id = f.first and o.point_id = f.point_text)
    select sample_id, point_id, unified, hit or unified as hit, case when unified then t else hit_type end as hit_type,
    case when unified then x else extracted_span end as extracted_span, case when unified then c else confidence end as confidence,
    case when unified then al else align end as align from j""",
)
def conflict_unify(spark, folder):
    """Four neighbouring orders play one answer labelled four times."""
    rows = views.labels(spark, folder).select(
        "sample_id", "point_id", F.floor(F.col("sample_id") / 4).alias("question_id"), F.col("point_id").alias("point_text"),
        "hit", "hit_type", "extracted_span", "confidence",
        F.when(F.col("hit") & (F.col("span_length") % 3 == 0), F.col("span_length")).alias("align"),
    )
    # questions divisible by five take no part: their labels count as not aligned for the search
    part = rows.where("question_id % 5 <> 0")
    rest = rows.where("question_id % 5 = 0").withColumn("unified", F.lit(False))
    out = labels.unify_conflicts(
        part, None, ["question_id", "point_text"], ["sample_id"], ["hit_type", "extracted_span", "confidence", "align"]
    )
    return out.unionByName(rest).drop("question_id", "point_text")


@add(
    "patch_labels",
    f"""with {POINTS}, base as (select doc_id as sample_id, {QUESTION} as question_id, p.point_id, p.point_text, d.text, doc_id % 2 = 0 as hit
      from documents d join points p on p.question_id = d.{QUESTION}),
    pa as (select question_id as patch_no, question_id, point_text, aliases[1] as loc, aliases[2] as span from points where point_id = 2),
    l as (select b.sample_id, b.point_id, pa.span, b.question_id, b.point_text, b.text from base b join pa using (question_id, point_text)
      where strpos(b.text, loc) > 0 and not hit and strpos(b.text, span) > 0)
    select sample_id, question_id, point_id, point_text, 'exact' as align, span from l""",
)
def patch_labels(spark, folder):
    """Change log of patches: one per question, located by one rubric word and quoting another."""
    points = views.points(spark, folder)
    base = views.answers(spark, folder).join(points, "question_id").select(
        F.col("answer_id").alias("sample_id"), "question_id", "point_id", "point_text", F.col("answer_text").alias("student_answer"),
        (F.col("answer_id") % 2 == 0).alias("hit"),
        F.when(F.col("answer_id") % 2 == 0, F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("matched_text"), F.lit("exact").alias("strategy"))).alias("align"),
        F.lit("miss").alias("hit_type"), F.lit("").alias("extracted_span"), F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("partial_credit"),
    )
    patches = points.where("point_id = 2").select(
        F.col("question_id").alias("patch_no"), "question_id", "point_text", F.get("aliases", F.lit(0)).alias("locate"), F.get("aliases", F.lit(1)).alias("span")
    )
    _, log, _ = labels.patch_labels(base, patches)
    return log.where("align = 'exact'").select("sample_id", "question_id", "point_id", "point_text", "align", "span")


_RAW = f"""{LABELS}, raw as (select sample_id, point_id, point_id as pos, case when span_length % 7 = 0 then 'odd' else hit_type end as hit_type,
      hit, extracted_span, confidence * 1.5 - 0.2 as confidence, partial_credit from labels0 where span_length % 5 <> 0),
    want as (select sample_id, p as point_id from (select distinct sample_id from labels0), unnest([1, 2, 3, 4]) t(p))"""


@add(
    "fill_missing_points",
    f"""with {_RAW} select w.sample_id, w.point_id::bigint as point_id, coalesce(hit and extracted_span <> '', false) as hit,
    case when hit then r.hit_type else 'miss' end as hit_type, case when hit then extracted_span else '' end as extracted_span,
    round(case when r.sample_id is null then 0.5 else least(greatest(confidence, 0), 1) end, 3) as confidence,
    case when hit and r.hit_type = 'exact' then 1.0 when hit then least(greatest(partial_credit, 0.5), 1) end::double as partial_credit
    from want w left join raw r on r.sample_id = w.sample_id and r.point_id = w.point_id and r.hit_type <> 'odd'""",
)
def fill_missing_points(spark, folder):
    """Raw output with bad types, ids beyond the rubric and gaps, against a rubric of four points."""
    rows = views.labels(spark, folder)
    raw = rows.where("span_length % 5 <> 0").select(
        "sample_id",
        F.col("point_id").alias("pos"),
        F.col("point_id").cast("string").alias("point_id"),
        F.when(F.col("span_length") % 7 == 0, "odd").otherwise(F.col("hit_type")).alias("hit_type"),
        "hit",
        "extracted_span",
        (F.col("confidence") * 1.5 - 0.2).alias("confidence"),
        "partial_credit",
        F.lit(None).cast("string").alias("rationale"),
    )
    samples = rows.select("sample_id").distinct().withColumn("question_id", F.lit("Q"))
    points = samples.select("question_id").distinct().select(
        "question_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3, 4)])).alias("point_id")
    )
    return labels.normalize_labels(raw, samples, points).drop("question_id", "rationale")


@add(
    "weight_rescale",
    f"""with {LINES}, p as (select l_orderkey as question_id, l_linenumber as point_id, qty as weight from lines),
    s as (select question_id, sum(weight) as s, max(point_id) as last, 100.0::double as t from p group by 1),
    x as (select p.*, s, last, t, s <= 0 or abs(s - t) < 0.011 as keep, case when s <= 0 or abs(s - t) < 0.011 then weight else round_even(weight * (t / s), 2) end as w
      from p join s using (question_id)),
    d as (select question_id, round_even(first(t) - sum(w), 2) as drift from x group by 1)
    select question_id, point_id, round(case when not keep and point_id = last and abs(drift) >= 0.01 then w + drift else w end, 2) as weight
    from x join d using (question_id)""",
)
def weight_rescale(spark, folder):
    points = views.lines(spark, folder).select(
        F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("point_id"), F.col("qty").alias("weight")
    )
    totals = points.select("question_id").distinct().withColumn("total_score", F.lit(100.0))
    return rubrics.rescale_weights(points, totals).withColumn("weight", F.round("weight", 2))


@add(
    "normalize_rubric",
    """with w as (select item_id, list_filter(string_split(text, ' '), lambda x: x <> '') as w from benchmark),
    p as (select item_id, i, case when i % 4 = 0 then '  ' else w[i] end as t, w[i + 1] as a from w, unnest([1, 2, 3, 4, 5]) t(i)),
    k as (select *, row_number() over (partition by item_id order by i) as n, count(*) over (partition by item_id) as c from p where trim(t) <> ''),
    x as (select *, greatest(case when i = 5 then 1.0 else i * 0.4 end, 0.5) as wt from k),
    z as (select *, sum(wt) over (partition by item_id) as s from x),
    v as (select *, round(wt * 12.0 / s, 2) as w2 from z),
    d as (select *, round(12.0 - sum(w2) over (partition by item_id), 2) as drift from v)
    select item_id as question_id, n::bigint as point_id, t as point_text, a as alias,
    round(case when n = c and abs(drift) >= 0.01 then w2 + drift else w2 end, 2)::double as weight from d""",
)
def normalize_rubric(spark, folder):
    """Parsed rubrics with a blank point, repeated aliases and a weight that is no number."""
    words = F.filter(F.split("text", " "), lambda x: x != "")

    def entry(i):
        alias = F.get(F.col("w"), i)
        return F.struct(
            i.cast("string").alias("point_id"),
            F.when(i % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), F.get(F.col("w"), i - 1))).alias("point_text"),
            F.when(i == 5, "heavy").otherwise((i * 0.4).cast("string")).alias("weight"),
            F.array(alias, F.concat(F.lit(" "), alias), F.lit(" ")).alias("aliases"),
        )

    raw = views.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("question_id"), words.alias("w"), F.lit(12.0).alias("total_score")
    )
    raw = raw.withColumn("points", F.transform(F.sequence(F.lit(1), F.lit(5)), entry)).drop("w")
    out = rubrics.point_rows(rubrics.normalize_rubric(raw))
    return out.select(
        "question_id", "point_id", "point_text", F.array_join("aliases", "|").alias("alias"), F.round("weight", 2).alias("weight")
    )


@add(
    "contract_violations",
    f"""with {LABELS}, s as (select sample_id, bool_or(confidence * 1.2 > 1) as c, bool_or(hit_type = 'miss' and point_id = 3) as t,
      bool_or(coalesce(partial_credit, 0) + confidence > 1.2) as p from labels0 group by 1)
    select sample_id, concat_ws(',', case when t then 'hit_type' end, case when c then 'confidence' end) as violations from s where c or t""",
)
def contract_violations(spark, folder):
    """Label records with confidences above one and an unknown hit type; rules named in rule order."""
    point = F.struct(
        F.col("point_id").cast("bigint").alias("point_id"),
        "hit",
        F.when((F.col("hit_type") == "miss") & (F.col("point_id") == 3), "maybe").otherwise(F.col("hit_type")).alias("hit_type"),
        "extracted_span",
        (F.col("confidence") * 1.2).alias("confidence"),
        "partial_credit",
    )
    records = views.labels(spark, folder).groupBy("sample_id").agg(F.sort_array(F.collect_list(point)).alias("point_labels"))
    wrapped = records.select(
        "sample_id", F.struct(F.lit("Q").alias("question_id"), F.lit("x").alias("student_answer"), "point_labels").alias("labels")
    )
    _, bad = rubrics.validate(wrapped, rubrics.label_rules())
    return bad.select("sample_id", F.array_join("violations", ",").alias("violations"))


@add(
    "effective_thresholds",
    """select item_id as question_id, case item_id % 3 when 0 then 0.95 when 1 then 0.8 else 0.95 end::double as similarity_high,
    case item_id % 3 when 0 then 0.9 when 1 then 0.6 else 0.7 end::double as similarity_low from benchmark""",
)
def effective_thresholds(spark, folder):
    """Thresholds of the settings, of the question, and a question that gives only one of them."""
    from markbook.settings import ScoringSettings

    n = F.col("item_id") % 3
    own = F.when(n == 1, F.struct(F.lit(0.8).alias("similarity_high"), F.lit(0.6).alias("similarity_low"))).when(
        n == 2, F.struct(F.lit(None).cast("double").alias("similarity_high"), F.lit(0.7).alias("similarity_low"))
    )
    rows = views.table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), own.alias("thresholds"))
    return rubrics.effective_thresholds(rows, ScoringSettings().check()).drop("thresholds")


@add(
    "expert_agreement",
    f"""with {LABELS}, p as (select sample_id, sum(case when hit then span_length * coalesce(partial_credit, 1) else 0 end) as predicted from labels0 group by 1),
    j as (select predicted, o_totalprice / 1000 as e from p join orders on o_orderkey = sample_id),
    m as (select count(*) as n, avg(abs(predicted - e)) as mae, avg((abs(predicted - e) <= 0.2 * greatest(e, 1))::int::double) as w, corr(predicted, e) as c from j)
    select n, round(c, 4) as pearson, round(mae, 3) as mae, round(w, 4) as within_20pct, null::varchar as note from m""",
)
def expert_agreement(spark, folder):
    rows = views.labels(spark, folder).withColumn("question_id", F.col("sample_id"))
    weights = rows.select("question_id", "point_id", F.col("span_length").cast("double").alias("weight"))
    expert = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("sample_id"), (F.col("o_totalprice") / 1000).alias("expert_total")
    )
    return labels.expert_agreement(labels.predicted_totals(rows, weights), expert)


@add(
    "label_records",
    f"""with {LABELS} select sample_id, origin, point_id::bigint as point_id, hit_type, confidence,
    (row_number() over (partition by sample_id order by point_id) - 1)::int as pos from labels0""",
)
def label_records(spark, folder):
    """Labels packed into records of the label schema and taken apart again."""
    wanted = LABEL_SCHEMA[LABEL_SCHEMA.index("labels struct") + 7 :]
    entry = F.struct(
        F.col("point_id").cast("bigint").alias("point_id"), "hit", "hit_type", "extracted_span", "confidence", "partial_credit",
        F.lit(None).cast("string").alias("rationale"), F.lit(None).cast("struct<start:int,end:int,matched_text:string,strategy:string>").alias("align"),
    )
    packed = views.labels(spark, folder).groupBy("sample_id", "origin").agg(F.sort_array(F.collect_list(entry)).alias("p"))
    meta = F.lit(None).cast("struct<model:string,temperature:double,self_consistency_votes:int,labeled_at:string>")
    records = packed.select(
        "sample_id", "origin", F.lit(None).cast("double").alias("expert_total"),
        F.struct(F.lit("Q").alias("question_id"), F.lit("x").alias("student_answer"), F.col("p").alias("point_labels"), meta.alias("labeling_meta")).cast(wanted).alias("labels"),
    )
    return labels.label_points(records).select("sample_id", "origin", "point_id", "hit_type", "confidence", "pos")


