"""Training-set builders over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook.functions import fixed
from markbook.operators import builders, ranking, tables
from markbook.plans import grading, views
from markbook.plans.registry import ANSWERS, LABELS, LINES, POINTS, QUESTION, Registry, quoted
from markbook.session import settled

registry = Registry()
add = registry.add


def _md5(seed: int, *keys: str) -> str:
    return f"md5('{seed}#' || {' || chr(35) || '.join(keys)})"


_SPLIT = f"""q as (select distinct {QUESTION} as question_id from documents),
    r as (select question_id, row_number() over (order by {_md5(42, 'question_id')}, question_id) as r, count(*) over () as n from q),
    split as (select question_id, case when r <= floor(n * 0.8) then 'train' when r <= floor(n * 0.8) + floor(n * 0.1) then 'val' else 'test' end as split from r)"""


@add("question_split", f"with {_SPLIT} select * from split")
def question_split(spark, folder):
    return builders.question_split(views.answers(spark, folder))


@add(
    "customer_split",
    f"""with r as (select c_custkey, row_number() over (order by {_md5(7, 'c_custkey')}, c_custkey) as r, count(*) over () as n from customer)
    select c_custkey, case when r <= floor(n * 0.7) then 'train' when r <= floor(n * 0.7) + floor(n * 0.2) then 'val' else 'test' end as split from r""",
)
def customer_split(spark, folder):
    customers = views.table(spark, folder, "customer")
    return builders.question_split(customers, {"train": 0.7, "val": 0.2}, 7, "c_custkey")


def _tuples(spark, folder):
    rows = views.labels(spark, folder)
    return rows.select(
        F.concat_ws("-", "sample_id", "point_id").alias("id"),
        (F.col("sample_id") % 50).alias("question_id"),
        (~F.col("hit") | (F.col("span_length") % 2 == 0)).alias("is_impossible"),
        "origin",
        "hit_type",
    )


_TUPLES = f"""{LABELS}, tuples as (select sample_id || '-' || point_id as id, sample_id % 50 as question_id,
      not hit or span_length % 2 = 0 as is_impossible, origin, hit_type from labels0)"""
_DOWN = f"""{_TUPLES}, k as (select floor(count(*) filter (not is_impossible) * 0.22 / (1 - 0.22)) as k from tuples),
    rounds as (select *, row_number() over (partition by question_id order by {_md5(42, 'id')}, id) as r from tuples where is_impossible),
    going as (select *, row_number() over (order by r, {_md5(42, 'question_id')}, question_id) as place from rounds),
    kept as (select id, question_id, is_impossible, origin, hit_type from tuples where not is_impossible
      union all select id, question_id, is_impossible, origin, hit_type from going where place <= (select k from k))"""


@add("negative_downsample", f"with {_DOWN} select id, question_id, is_impossible from kept")
def negative_downsample(spark, folder):
    out = builders.downsample_negatives(_tuples(spark, folder))
    return out.select("id", "question_id", "is_impossible")


@add(
    "dataset_stats",
    f"""with {_TUPLES}, s as (
    select 'all' as dim, null as value, count(*) as "rows", count(*) filter (is_impossible) as impossible from tuples
    union all select 'origin', origin, count(*), count(*) filter (is_impossible) from tuples group by 2
    union all select 'hit_type', hit_type, count(*), count(*) filter (is_impossible) from tuples group by 2)
    select *, round_even(impossible / "rows", 4) as impossible_ratio from s""",
)
def dataset_stats(spark, folder):
    return builders.dataset_stats(_tuples(spark, folder), ["origin", "hit_type"])


@add(
    "fragment_sample",
    f"""with f as (select conv_id || '#s' || turn as sample_id, length(text) % 3 = 0 as zero from conversations),
    r as (select *, row_number() over (partition by zero order by {_md5(42, 'sample_id')}, sample_id) as r from f),
    c as (select least(count(*) filter (zero), 75) as m, count(*) filter (not zero) as s from f),
    q as (select m, least(s, 300 - m) as h from c),
    p as (select *, r <= case when zero then m else h end as first from r, q),
    rest as (select *, row_number() over (order by {_md5(42, 'sample_id')}, sample_id) as place from p where not first)
    select sample_id from p where first union all select sample_id from rest where place <= 300 - m - h""",
)
def fragment_sample(spark, folder):
    return builders.sample_fragments(views.step_samples(spark, folder), 300).select("sample_id")


_ALIGNED = f"""{ANSWERS}, {POINTS}, {_SPLIT},
    lab as (select answer_id as sample_id, question_id, answer_text as student_answer, subject as origin, point_id, point_text, weight, aliases,
      case when strpos(answer_text, point_text) > 0 then 'exact' when strpos(answer_text, aliases[1]) > 0 then 'semantic' else 'miss' end as hit_type,
      case when strpos(answer_text, point_text) > 0 then point_text when strpos(answer_text, aliases[1]) > 0 then aliases[1] else '' end as span
      from answers join points using (question_id)),
    al as (select *, hit_type <> 'miss' as hit, case when hit_type <> 'miss' then strpos(student_answer, span) - 1 end as s,
      case when hit_type <> 'miss' then strpos(student_answer, span) - 1 + length(span) end as e from lab)"""


def _label_points(spark, folder):
    """Documents labelled by rubric words: exact for the point text, semantic for its first alias."""
    points = views.points(spark, folder)
    text, word, alias = F.col("answer_text"), F.col("point_text"), F.get(F.col("aliases"), F.lit(0))
    kind = F.when(F.instr(text, word) > 0, "exact").when(F.instr(text, alias) > 0, "semantic").otherwise("miss")
    span = F.when(kind == "exact", word).when(kind == "semantic", alias).otherwise("")
    at = F.instr(text, span) - 1
    where = F.when(kind != "miss", F.struct(at.alias("start"), (at + F.length(span)).alias("end")))
    return views.answers(spark, folder).join(points, "question_id").select(
        F.col("answer_id").alias("sample_id"),
        F.col("subject").alias("origin"),
        "question_id",
        text.alias("student_answer"),
        "point_id",
        (kind != "miss").alias("hit"),
        kind.alias("hit_type"),
        span.alias("extracted_span"),
        F.when(kind == "semantic", F.lit(0.5)).alias("partial_credit"),
        where.alias("align"),
    )


@add(
    "span_tuples",
    f"""with {_ALIGNED} select sample_id || '#p' || point_id as id, question_id, origin, point_text as query, weight as point_weight,
    case when hit then substr(student_answer, s::int + 1, (e - s)::int) else '' end as answer, coalesce(s, -1)::int as answer_start,
    coalesce(e, -1)::int as answer_end, not hit as is_impossible, hit_type, split, student_answer as context,
    array_to_string(aliases, '|') as query_aliases from al join split using (question_id)""",
)
def span_tuples(spark, folder):
    points = _label_points(spark, folder)
    split = builders.question_split(points)
    return builders.span_tuples(points, views.points(spark, folder), split).withColumn("query_aliases", F.array_join("query_aliases", "|"))


@add(
    "build_dataset",
    f"""with {_ALIGNED}, tuples as (select sample_id || '#p' || point_id as id, question_id, split, hit_type, origin, not hit as is_impossible
      from al join split using (question_id)),
    k as (select floor(count(*) filter (not is_impossible) * 0.22 / (1 - 0.22)) as k from tuples),
    rounds as (select *, row_number() over (partition by question_id order by {_md5(42, 'id')}, id) as r from tuples where is_impossible),
    going as (select *, row_number() over (order by r, {_md5(42, 'question_id')}, question_id) as place from rounds)
    select id, question_id, split, hit_type, origin, is_impossible from tuples where not is_impossible
    union all select id, question_id, split, hit_type, origin, is_impossible from going where place <= (select k from k)""",
)
def build_dataset(spark, folder):
    """The whole build over labelled documents; shown are its span tuples, split by question and with negatives cut to their share."""
    points = _label_points(spark, folder)
    built = grading.build_dataset(points, views.configs(spark, folder), settle=lambda df: settled(df, "build"))
    return built["spans"].select("id", "question_id", "split", "hit_type", "origin", "is_impossible")


@add(
    "label_pairs",
    f"""with {_ALIGNED}, sent as (select doc_id as sample_id, text as t, list_filter(list_transform(
        regexp_split_to_array(text, '[。！？；\n，、]+'), lambda x: trim(x, {quoted(fixed.whitespace())})), lambda x: length(x) >= 6) as parts from documents),
    one as (select sample_id, t, parts, unnest(parts) as p, generate_subscripts(parts, 1) as i from sent),
    free as (select o.sample_id, arg_min(p, i) as p from one o where not exists (select 1 from al where al.sample_id = o.sample_id and al.s is not null
      and not (strpos(o.t, o.p) - 1 + length(o.p) <= al.s or strpos(o.t, o.p) - 1 >= al.e)) group by 1),
    other as (select s.sample_id, coalesce(f.p, s.parts[1], substr(t, 1, 60)) as other from sent s left join free f using (sample_id)),
    pr as (select question_id, origin, point_text as sentence1, span as sentence2, 1.0::double as score, 'label-exact' as source from al where hit_type = 'exact'
      union all select question_id, origin, point_text, span, 0.5, 'label-semantic' from al where hit_type = 'semantic'
      union all select question_id, origin, point_text, other, 0.0, 'label-miss' from al join other using (sample_id) where hit_type = 'miss' and other <> ''
      union all select question_id, origin, point_text, aliases[1], 1.0, 'label-alias' from al)
    select pr.*, split from pr join split using (question_id)""",
)
def label_pairs(spark, folder):
    points = _label_points(spark, folder)
    return builders.label_pairs(points, views.points(spark, folder), builders.question_split(points))


@add(
    "pair_union",
    f"""with {_ALIGNED}, a as (select split, hit_type <> 'miss' as p from al join split using (question_id) union all select 'train', true from part)
    select split, count(*) as "rows", count(*) filter (p) as pos, count(*) filter (not p) as neg, round_even(count(*) filter (p) / greatest(count(*) filter (not p), 1), 3) as pos_neg_ratio
    from a group by 1""",
)
def pair_union(spark, folder):
    points = _label_points(spark, folder)
    own = points.join(builders.question_split(points), "question_id").select("split", F.col("hit").cast("double").alias("score"))
    external = views.table(spark, folder, "part").select(F.lit("test").alias("split"), F.lit(1.0).alias("score"))
    return builders.pair_balance(builders.union_pairs(own, external))


@add(
    "non_overlapping",
    """with p as (select l_orderkey as k, l_quantity::int as s, l_quantity::int + 5 as e from lineitem),
    r as (select l_orderkey as k, l_partkey % 50 as s, l_partkey % 50 + 3 as e from lineitem where l_linestatus = 'O')
    select k, s as start, e as "end" from p where not exists (select 1 from r where r.k = p.k and p.s < r.e and p.e > r.s)""",
)
def non_overlapping(spark, folder):
    lines = views.table(spark, folder, "lineitem")
    start = F.col("l_quantity").cast("int")
    parts = lines.select(F.col("l_orderkey").alias("k"), start.alias("start"), (start + 5).alias("end"))
    at = F.col("l_partkey") % 50
    ranges = lines.where("l_linestatus = 'O'").select(
        F.col("l_orderkey").alias("k"), at.alias("range_start"), (at + 3).alias("range_end")
    )
    return builders.non_overlapping(parts, ranges, "k")


@add(
    "item_pairs",
    """with b as (select 'EXT-part-' || p_partkey as question_id, 'extra' as origin, p_name as sentence1, ['A', 'B', 'C'][p_partkey % 3 + 1] as answer,
      case p_partkey % 10 when 8 then 'val' when 9 then 'test' else 'train' end as split, unnest(['A', 'B', 'C']) as letter,
      unnest([p_brand, p_type, p_size::varchar]) as sentence2 from part where length(p_name) >= 4)
    select question_id, origin, sentence1, sentence2, (letter = answer)::int::double as score,
    case when letter = answer then 'extra-part-pos' else 'extra-part-neg' end as source, split from b where length(sentence2) >= 2""",
)
def item_pairs(spark, folder):
    return builders.item_pairs(views.items(spark, folder))


@add(
    "item_negatives",
    """select 'extra-part-' || p_partkey as id, 'EXT-part-' || p_partkey as question_id, 'extra-part' as origin,
    p_type || ' ' || p_brand as context, p_name as query, true as is_impossible,
    case p_partkey % 10 when 8 then 'val' when 9 then 'test' else 'train' end as split
    from part where length(p_type || ' ' || p_brand) >= 10 and length(p_name) >= 4""",
)
def item_negatives(spark, folder):
    items = views.items(spark, folder).withColumn(
        "material", F.concat_ws(" ", "material", F.element_at("choices", F.lit("A")))
    )
    return builders.item_negatives(items).select("id", "question_id", "origin", "context", "query", "is_impossible", "split")


@add(
    "topic_pairs",
    f"""with b as (select p_partkey, p_name as q, p_brand as lab, 'EXT-internlm-history-' || p_partkey as id from part where length(p_name) >= 4),
    n as (select lab, row_number() over (order by {_md5(42, 'lab')}, lab) as no, count(*) over () as m from (select distinct lab from b)),
    j as (select b.*, no, m, ('0x' || substr({_md5(42, 'id')}, 1, 8))::bigint as h from b join n using (lab)),
    x as (select j.*, (j.no + (h + t) % (j.m - 1)) % j.m + 1 as other from j, unnest([0, 1]) u(t))
    select id as question_id, q as sentence1, lab as sentence2, 1.0::double as score from b
    union all select x.id, x.q, n.lab, 0.0 from x join n on n.no = x.other""",
)
def topic_pairs(spark, folder):
    """Parts labelled with their brand, as topic-labelled questions with hard negatives."""
    items = views.items(spark, folder).withColumns(
        {
            "source": F.lit(builders.LABEL_SOURCE),
            "type": F.lit("open"),
            "answer_text": F.element_at("choices", F.lit("A")),
        }
    )
    return builders.item_pairs(items).select("question_id", "sentence1", "sentence2", "score")


@add(
    "hard_negatives",
    f"""with n as (select p_type, p_brand, row_number() over (partition by p_type order by {_md5(5, 'p_brand')}, p_brand) as no,
      count(*) over (partition by p_type) as m from (select distinct p_type, p_brand from part)),
    j as (select p_partkey, p_type, no, m, ('0x' || substr({_md5(5, 'p_partkey')}, 1, 8))::bigint as h from part join n using (p_type, p_brand)),
    x as (select j.*, (j.no + (h + t) % (j.m - 1)) % j.m + 1 as other from j, unnest([0, 1, 2]) u(t) where t < j.m - 1)
    select p_partkey, x.p_type, n.p_brand as negative from x join n on n.p_type = x.p_type and n.no = x.other""",
)
def hard_negatives(spark, folder):
    parts = views.table(spark, folder, "part")
    return builders.hard_negatives(parts, "p_brand", "p_partkey", 3, 5, ["p_type"])


@add(
    "full_answers",
    f"""select conv_id, string_agg(trim(text, {quoted(fixed.whitespace())}), chr(10) order by turn) as full_answer
    from conversations where trim(text, {quoted(fixed.whitespace())}) <> '' group by 1""",
)
def full_answers(spark, folder):
    items = views.step_items(spark, folder)
    return items.select("conv_id", builders.full_answer(F.col("steps")).alias("full_answer"))


_POOL = f"""c as (select conv_id, turn, trim(text, {quoted(fixed.whitespace())}) as t from conversations),
    k as (select conv_id, translate(text, {quoted(fixed.whitespace())}, '') as key from conversations where turn = 0),
    f as (select key, min(conv_id) as first from k group by 1),
    n as (select key, 'SAS-CONV-' || lpad(r::varchar, greatest(3, length(r::varchar))::int, '0') as question_id
      from (select key, row_number() over (order by first) as r from f))"""


def _seed_items(spark, folder):
    firsts = views.table(spark, folder, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("question"))
    return views.step_items(spark, folder).join(firsts, "conv_id").select(
        F.col("conv_id").cast("string").alias("id"),
        F.lit("CONV").alias("subject_code"),
        "question",
        F.col("question").alias("reference"),
        F.lit(10.0).alias("total"),
        F.size("steps").cast("string").alias("manual_label"),
        "steps",
        F.col("conv_id").alias("position"),
    )


@add(
    "seed_samples",
    f"""with {_POOL}, j as (select k.conv_id, question_id from k join n using (key))
    select conv_id || '#full' as sample_id, question_id, 'full' as origin, count(*)::double as expert_total, null::double as expert_step_label
      from j join c using (conv_id) group by 1, 2
    union all select conv_id || '#s' || turn, question_id, 'fragment', null, (length(v.text) % 3)::double
      from j join conversations v using (conv_id) where trim(v.text, {quoted(fixed.whitespace())}) <> ''""",
)
def seed_samples(spark, folder):
    _, samples = builders.seed_pool(_seed_items(spark, folder))
    return samples.drop("student_answer")


@add(
    "seed_questions",
    f"""with {_POOL} select question_id, count(*) as items from k join n using (key) group by 1""",
)
def seed_questions(spark, folder):
    questions, _ = builders.seed_pool(_seed_items(spark, folder))
    return questions.select("question_id", F.col("n_items").alias("items"))


@add(
    "question_items",
    f"""with {_POOL} select question_id, conv_id::varchar as item_id, conv_id as position from k join n using (key)""",
)
def question_items(spark, folder):
    return builders.question_items(_seed_items(spark, folder))


@add(
    "label_jobs",
    f"""with {_POOL}, j as (select k.conv_id, question_id from k join n using (key))
    select 'full' as origin, count(*) as n from j union all select 'fragment', least(120, (select count(*) from conversations)) as n
    union all select 'synthetic', count(*) from part""",
)
def label_jobs(spark, folder):
    _, samples = builders.seed_pool(_seed_items(spark, folder))
    synthetic = views.table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("sample_id"), F.col("p_name").alias("student_answer")
    )
    jobs = builders.label_jobs(samples, synthetic, total=120)
    return jobs.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))


@add(
    "job_grid",
    """with j as (select item_id || '#syn-' || tier || '-v' || v as sample_id, item_id as question_id, tier, v::int as variant
      from benchmark, unnest(['excellent', 'good', 'fair', 'poor']) t(tier), unnest([0, 1]) u(v) where v = 0 or item_id % 4 = 1)
    select * from j where not (question_id % 3 = 0 and tier = 'good' and variant = 0)""",
)
def job_grid(spark, folder):
    questions = views.table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"))
    done = questions.where("question_id % 3 = 0").select(
        F.concat(F.col("question_id").cast("string"), F.lit("#syn-good-v0")).alias("sample_id")
    )
    return builders.synth_grid(questions, done, extra=F.col("question_id") % 4 == 1)


@add(
    "render_prompts",
    f"""with {ANSWERS}, {POINTS}, b as (select question_id, string_agg(point_id || '. ' || point_text || '（别名：' || array_to_string(aliases, '、') || '）', chr(10) order by point_id) as block from points group by 1)
    select answer_id, 'Question ' || question_id || chr(10) || block || chr(10) || 'Answer: ' || answer_text || chr(10) || 'Question id again: ' || question_id as prompt
    from answers join b using (question_id)""",
)
def render_prompts(spark, folder):
    jobs = views.answers(spark, folder).join(views.configs(spark, folder).select("question_id", "points"), "question_id")
    template = "Question {question_id}\n{points_block}\nAnswer: {student_answer}\nQuestion id again: {question_id}"
    values = {
        "question_id": F.col("question_id"),
        "points_block": builders.points_block(F.col("points")),
        "student_answer": F.col("answer_text"),
    }
    return builders.render_prompts(jobs, template, values).select("answer_id", "prompt")


@add(
    "option_queries",
    """select p_partkey from part where p_partkey % 2 = 0 or not regexp_matches(p_name || case p_partkey % 4 when 1 then '选B得3分' when 3 then 'A项' else '' end || p_brand, '(选\\s*[A-E]|[A-E]项)')""",
)
def option_queries(spark, folder):
    tail = F.when(F.col("p_partkey") % 4 == 1, "选B得3分").when(F.col("p_partkey") % 4 == 3, "A项").otherwise("")
    spans = views.table(spark, folder, "part").select(
        "p_partkey",
        F.concat("p_name", tail, "p_brand").alias("query"),
        (F.col("p_partkey") % 2 == 0).alias("is_impossible"),
    )
    return builders.drop_option_positives(spans).select("p_partkey")


@add(
    "seeded_cap",
    f"""select event_id from (select event_id, row_number() over (order by {_md5(42, 'event_id')}, event_id) as r from events) where r <= 4000""",
)
def seeded_cap(spark, folder):
    return tables.seeded_cap(views.table(spark, folder, "events").select("event_id"), ["event_id"], 4000)


@add(
    "scored_pairs",
    """select p_name as sentence1, p_brand as sentence2, round(least(greatest(p_retailprice / 1103.0, 0), 1), 3) as score, 'sas-part' as source, 'P-' || p_partkey as question_id
    from part where length(p_name) >= 4 and length(p_brand) >= 4""",
)
def scored_pairs(spark, folder):
    parts = views.table(spark, folder, "part")
    number = F.concat(F.lit("P-"), F.col("p_partkey").cast("string"))
    return tables.scored_pairs(parts, F.col("p_name"), F.col("p_brand"), F.col("p_retailprice") / 1103.0, "sas-part", number)


@add(
    "hash_ranks",
    f"""{"with " + LINES} select l_orderkey, l_linenumber, row_number() over (partition by rf order by {_md5(1, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) as rank,
    count(*) over (partition by rf) as total from lines""",
)
def hash_ranks(spark, folder):
    """Seeded ranks in three very large groups."""
    lines = views.lines(spark, folder).select("l_orderkey", "l_linenumber", "rf")
    return ranking.hash_rank(lines, ["l_orderkey", "l_linenumber"], 1, ["rf"]).drop("rf")
