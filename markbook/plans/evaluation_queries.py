"""Evaluation over lines, labels, vectors and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from markbook.operators import evaluate, tables
from markbook.plans import views
from markbook.plans.registry import ANSWERS, DETAILS, POINTS, RESULTS, Registry
from markbook.plans.text_queries import _sql_metric

registry = Registry()
add = registry.add

_JUDGED = """judged as (select l_orderkey, l_linestatus = 'O' as gold, (round(l_discount * 100) - round(l_tax * 100))::int as score_diff from lineitem)"""
_RATED = "rated as (select l.doc_id, quality = 1 as gold, n_chars % 97 / 97.0::double as score from labels l join documents d using (doc_id))"


@add(
    "pearson_guarded",
    """with g as (select l_returnflag as rf, count(*) as n, corr(l_quantity, l_extendedprice) as c from lineitem group by 1)
    select rf, n, round(c, 9) as pearson from g union all select 'none', count(*), 0.0 from lineitem""",
)
def pearson_guarded(spark, folder):
    """Per return flag, and against a constant, where there is no correlation to speak of."""
    lines = views.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("rf"), "l_quantity", "l_extendedprice")
    by_flag = evaluate.pearson_of(lines, "l_quantity", "l_extendedprice", ["rf"])
    constant = lines.select(F.lit("none").alias("rf"), F.lit(1.0).alias("x"), "l_quantity")
    flat = evaluate.pearson_of(constant, "x", "l_quantity", ["rf"])
    return by_flag.unionByName(flat).withColumn("pearson", F.round("pearson", 9))


@add(
    "threshold_search",
    f"""with {_JUDGED}, t as (select distinct score_diff as t from judged),
    a as (select t, avg(((score_diff > t) = gold)::int) as a from t cross join (select score_diff, gold from judged) j group by 1)
    select arg_min(t, (-a, t)) as threshold, round(max(a), 9) as accuracy from a""",
)
def threshold_search(spark, folder):
    out = evaluate.tune_threshold(views.judged(spark, folder))
    return out.withColumn("accuracy", F.round("accuracy", 9))


@add(
    "auc_midrank",
    f"""with {_RATED}, c as (select score, count(*) filter (gold) as p, count(*) filter (not gold) as n from rated group by 1),
    w as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as lower from c)
    select sum(p)::bigint as n_pos, sum(n)::bigint as n_neg, round(sum(p * (lower + 0.5::double * n)) / (sum(p) * sum(n)), 4) as auc,
    round(sum(score * p) / sum(p), 4) as mean_pos, round(sum(score * n) / sum(n), 4) as mean_neg,
    round(sum(case when score >= 0.6 then p else 0 end) / sum(p), 4) as recall, round(sum(case when score >= 0.6 then n else 0 end) / sum(n), 4) as fpr from w""",
)
def auc_midrank(spark, folder):
    return evaluate.auc(views.rated(spark, folder), "score", "gold", 0.6)


_GOLD = f"""{DETAILS}, g as (select *, point_id % 3 = 0 as is_impossible, weight as gold_weight from details)"""


def _aligned(spark, folder):
    details = views.details(spark, folder)
    gold = details.select(
        "answer_id", "point_id", F.concat(F.lit("p"), F.col("point_id").cast("string")).alias("query"), "weight",
        (F.col("point_id") % 3 == 0).alias("is_impossible"),
    )
    return evaluate.align_gold(details, gold, ["answer_id"])


@add(
    "confusion",
    f"""with {_GOLD}, c as (select count(*) filter (hit_status <> 'miss' and not is_impossible) as tp, count(*) filter (hit_status <> 'miss' and is_impossible) as fp,
    count(*) filter (hit_status = 'miss' and not is_impossible) as fn, count(*) filter (hit_status = 'miss' and is_impossible) as tn,
    count(*) filter (not is_impossible and point_score > 0) as credited from g)
    select *, (tp + tn) / (tp + fp + fn + tn) as point_accuracy, credited / (tp + fn) as credit_rate from c""",
)
def confusion(spark, folder):
    return evaluate.confusion(_aligned(spark, folder))


@add(
    "disagreement_top",
    f"""with {_GOLD} select answer_id, 'p' || point_id as point_text, hit_status, 'mrc' as source, c as conf, point_score as weight,
    'words of point ' || point_id || ' by answer ' || answer_id as span from (select *, round_even(weight / 60, 4) as c from g where hit_status <> 'miss' and is_impossible) order by c desc, answer_id, point_id limit 50""",
)
def disagreement_top(spark, folder):
    words = F.concat(F.lit("words of point "), F.col("point_id").cast("string"), F.lit(" by answer "), F.col("answer_id").cast("string"))
    aligned = _aligned(spark, folder).withColumns(
        {"confidence": F.col("weight") / 60, "similarity": F.lit(0.0), "source": F.lit("mrc"), "extracted_span": words}
    )
    sheet = evaluate.disagreements(aligned, ["answer_id", "point_id"])
    return evaluate.top_n(sheet, "conf", 50, "answer_id", "point_id").drop("point_id")


@add(
    "zero_band",
    f"""with {RESULTS}, t as (select answer_id, total_score, case when question_id % 3 = 0 then 0 else 1 end as expert_total from results)
    select answer_id, total_score from t where expert_total = 0 and total_score > 0""",
)
def zero_band(spark, folder):
    totals = views.results(spark, folder).withColumn("expert_total", F.when(F.col("question_id") % 3 == 0, 0).otherwise(1))
    return evaluate.zero_band(totals).select("answer_id", "total_score")


@add(
    "score_error",
    f"""with {RESULTS} select count(*) as n_answers, round(avg(abs(total_score - max_score / 2)), 6) as mae, round(corr(total_score, max_score / 2), 6) as pearson from results""",
)
def score_error(spark, folder):
    out = evaluate.score_error(views.results(spark, folder).withColumn("expert_total", F.col("max_score") / 2))
    return out.withColumns({"mae": F.round("mae", 6), "pearson": F.round("pearson", 6)})


_SPANS = f"""{ANSWERS}, {POINTS}, sp as (select answer_id, question_id, sha256(answer_text) as context_key, point_text as query, weight, aliases,
      (answer_id + point_id) % 4 = 0 as is_impossible, lpad(answer_id::varchar, 8, '0') || '#' || point_id as id from answers join points using (question_id)),
    pp as (select question_id, context_key, query, arg_min(is_impossible, id) as imp, arg_min(weight, id) as weight, arg_min(array_to_string(aliases, '|'), id) as aliases, min(id) as first,
      min(is_impossible::int) <> max(is_impossible::int) as conflict from sp group by 1, 2, 3),
    kept as (select *, row_number() over (partition by question_id, context_key order by first) as point_id from pp where not conflict)"""


def _gold(spark, folder):
    rows = views.answers(spark, folder).join(views.points(spark, folder), "question_id").select(
        F.concat(F.lpad(F.col("answer_id").cast("string"), 8, "0"), F.lit("#"), F.col("point_id").cast("string")).alias("id"),
        F.lit("full").alias("origin"), "question_id", F.col("answer_text").alias("context"), F.col("point_text").alias("query"),
        F.col("weight").alias("point_weight"), F.col("aliases").alias("query_aliases"),
        ((F.col("answer_id") + F.col("point_id")) % 4 == 0).alias("is_impossible"),
    )
    return evaluate.assemble_gold(rows)


@add(
    "gold_assembly",
    f"with {_SPANS} select question_id, context_key, point_id, query, weight, aliases, imp as is_impossible from kept",
)
def gold_assembly(spark, folder):
    return _gold(spark, folder)[0].withColumn("aliases", F.array_join("aliases", "|"))


@add(
    "gold_totals",
    f"""with {_SPANS}, c as (select question_id, context_key, count(*) filter (conflict) as conflicts from pp group by 1, 2)
    select k.question_id, k.context_key, count(*)::int as points, conflicts, sum(case when imp then 0 else weight end)::double as expert_total,
    round(sum(weight), 4)::double as max_total from kept k join c on c.question_id = k.question_id and c.context_key = k.context_key group by 1, 2, 4""",
)
def gold_totals(spark, folder):
    return _gold(spark, folder)[1]


@add(
    "systematic_sample",
    f"""with {RESULTS}, r as (select answer_id, total_score / max_score as ratio, row_number() over (order by total_score / max_score, md5('42#' || answer_id), answer_id) - 1 as place,
    count(*) over () as n from results)
    select answer_id, ratio from r where place in (select floor(i * n / 36)::bigint from unnest(range(36)) t(i)) or n <= 36""",
)
def systematic_sample(spark, folder):
    rows = views.results(spark, folder).select("answer_id", (F.col("total_score") / F.col("max_score")).alias("ratio"))
    return evaluate.systematic_sample(rows, "ratio", 36, ["answer_id"])


@add(
    "stride_sample",
    """with d as (select distinct l_partkey, l_suppkey from lineitem),
    r as (select *, row_number() over (order by md5('42#' || l_partkey || '#' || l_suppkey), l_partkey, l_suppkey) - 1 as p, count(*) over () as n from d)
    select l_partkey, l_suppkey from r where p % greatest(1, n // 50) = 0 and p // greatest(1, n // 50) < 50""",
)
def stride_sample(spark, folder):
    return evaluate.stride_sample(views.table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"], 50)


@add(
    "distinct_values",
    "select distinct l_partkey, l_suppkey from lineitem",
)
def distinct_values(spark, folder):
    return tables.distinct_values(views.table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"])


@add(
    "parity_report",
    """with a as (select o_orderkey, o_totalprice as x, o_orderstatus as s from orders where o_orderkey % 10 <> 0),
    b as (select o_orderkey, o_totalprice + case when o_orderkey % 7 = 0 then 0.5 else 0.0005 end as x,
      case when o_orderkey % 11 = 0 then '?' else o_orderstatus end as s from orders where o_orderkey % 13 <> 0)
    select count(*) as cases, count(*) filter (a.x is not null and b.x is not null and abs(a.x - b.x) <= 0.001 and a.s = b.s) as passed,
    count(*) filter (b.x is null) as only_left, count(*) filter (a.x is null) as only_right from a full join b using (o_orderkey)""",
)
def parity_report(spark, folder):
    k = F.col("o_orderkey")
    orders = views.table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), F.col("o_orderstatus").alias("s"))
    other = orders.where(k % 13 != 0).withColumns(
        {"x": F.col("x") + F.when(k % 7 == 0, 0.5).otherwise(0.0005), "s": F.when(k % 11 == 0, "?").otherwise(F.col("s"))}
    )
    return evaluate.parity(orders.where(k % 10 != 0), other, ["o_orderkey"], ["x"], ["s"])


_GRID = [i / 24 for i in range(24)]


@add(
    "threshold_sweep",
    f"""with {_RATED}, g as (select unnest({_GRID}::double[]) as threshold)
    select threshold, count(*) filter (score >= threshold and gold) as tp, count(*) filter (score >= threshold and not gold) as fp,
    count(*) filter (score < threshold and gold) as fn, count(*) filter (score < threshold and not gold) as tn,
    round(avg(((score >= threshold) = gold)::int), 6) as point_accuracy from rated cross join g group by 1""",
)
def threshold_sweep(spark, folder):
    return evaluate.sweep(views.rated(spark, folder), "score", "gold", _GRID)


@add(
    "metric_drops",
    """with r as (select l_returnflag as metric, avg(case when l_linestatus = 'O' then l_quantity / 50 end) as a,
    avg(case when l_linestatus = 'F' then l_quantity / 50 end) as b from lineitem group by 1)
    select metric, round(a - b, 4) as "drop", round(a - b, 4) < 0.01 as passed from r""",
)
def metric_drops(spark, folder):
    reports = views.table(spark, folder, "lineitem").groupBy(
        F.col("l_linestatus").alias("variant"), F.col("l_returnflag").alias("metric")
    ).agg(F.avg(F.col("l_quantity") / 50).alias("value"))
    return evaluate.metric_drops(reports, "O", "F", ["A", "N", "R"])


@add(
    "position_metrics",
    """with p as (select l_quantity::int as ps, l_linenumber as pe, case when l_linestatus = 'F' then 0 else case when l_suppkey % 3 = 0 then l_quantity::int else 99 end end as gs,
      case when l_linestatus = 'F' then case when l_suppkey % 2 = 0 then 0 else l_linenumber end else l_linenumber end as ge from lineitem),
    q as (select case when gs = 0 and ge <> 0 then 0 else ps end as ps, pe, gs, ge from p)
    select round(count(*) filter (ps = gs and pe = ge and gs <> 0) / count(*) filter (gs <> 0), 9) as span_exact,
    round(count(*) filter (ps = gs and pe = ge and gs = 0) / count(*) filter (gs = 0), 9) as null_acc,
    round(count(*) filter (ps = gs and pe = ge and gs <> 0) / count(*) filter (gs <> 0) + 0.2 * count(*) filter (ps = gs and pe = ge and gs = 0) / count(*) filter (gs = 0), 9) as key from q""",
)
def position_metrics(spark, folder):
    negative = F.col("l_linestatus") == "F"
    start = F.when(negative, 0).when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity").cast("int")).otherwise(99)
    end = F.when(negative & (F.col("l_suppkey") % 2 == 0), 0).otherwise(F.col("l_linenumber"))
    rows = views.table(spark, folder, "lineitem").select(
        F.when((start == 0) & (end != 0), 0).otherwise(F.col("l_quantity").cast("int")).alias("pred_start"),
        F.col("l_linenumber").alias("pred_end"),
        start.alias("gold_start"),
        end.alias("gold_end"),
    )
    out = evaluate.position_metrics(rows)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@add(
    "span_metrics",
    f"""with {ANSWERS}, {POINTS}, r as (select answer_id, point_id, point_text as answer, case when answer_id % 3 = 0 then point_text when answer_id % 3 = 1 then aliases[1] else '' end as pred,
      (answer_id * 7 + point_id) % 10 - 3 as diff, (answer_id + point_id) % 4 = 0 as imp, ['exact', 'semantic'][(answer_id % 2)::int + 1] as hit_type from answers join points using (question_id)),
    j as (select *, case when diff > 0 then pred else '' end as p, case when imp then '' else answer end as g from r),
    m as (select *, {_sql_metric('p')} as np, {_sql_metric('g')} as ng from j),
    f as (select *, (np = ng and np <> '')::int as em, case when np = '' or ng = '' then 0.0 else 2.0::double * list_sum(list_transform(list_distinct(string_split(np, '')),
      lambda c: least(length(np) - length(replace(np, c, '')), length(ng) - length(replace(ng, c, ''))))) / (length(np) + length(ng)) end::double as f1 from m)
    select round(avg(em) filter (not imp), 4) as em, round(avg(f1) filter (not imp), 4) as token_f1,
    round(avg(em) filter (not imp and hit_type = 'exact'), 4) as em_exact, round(avg(f1) filter (not imp and hit_type = 'exact'), 4) as f1_exact,
    round(avg(em) filter (not imp and hit_type = 'semantic'), 4) as em_semantic, round(avg(f1) filter (not imp and hit_type = 'semantic'), 4) as f1_semantic,
    count(*) as eval_n, count(*) filter (not imp) as positives, count(*) filter (not imp and hit_type = 'exact') as n_exact,
    count(*) filter (not imp and hit_type = 'semantic') as n_semantic, round(avg(((p <> '') <> imp)::int), 4) as point_accuracy,
    round(avg((p <> '')::int) filter (not imp and hit_type = 'semantic'), 4) as equivalence_hit_rate from f""",
)
def span_metrics(spark, folder):
    """Rubric words as gold, predicted right, as another word of the point, or not at all."""
    a, p = F.col("answer_id"), F.col("point_id")
    rows = views.answers(spark, folder).join(views.points(spark, folder), "question_id").select(
        F.col("point_text").alias("answer"),
        F.when(a % 3 == 0, F.col("point_text")).when(a % 3 == 1, F.get("aliases", F.lit(0))).otherwise("").alias("pred_text"),
        ((a * 7 + p) % 10 - 3).cast("double").alias("score_diff"),
        ((a + p) % 4 == 0).alias("is_impossible"),
        F.when(a % 2 == 0, "exact").otherwise("semantic").alias("hit_type"),
    )
    return evaluate.span_metrics(rows, 0.0)


@add(
    "score_correlation",
    f"""with {DETAILS}, t as (select answer_id, sum(case when point_id % 2 = 0 then weight else 0 end) as p, sum(case when hit_status <> 'miss' then weight else 0 end) as l, sum(weight) / 2 as e
      from details where question_id % 4 = 1 group by 1)
    select count(*) as n_samples, round(corr(p, e), 4) as pearson_vs_expert, round(corr(p, l), 4) as pearson_vs_label from t""",
)
def score_correlation(spark, folder):
    """Only questions of the test split, a quarter of them."""
    details = views.details(spark, folder)
    split = details.select("question_id", F.when(F.col("question_id") % 4 == 1, "test").otherwise("train").alias("split"))
    rows = evaluate.in_split(details, split)
    experts = details.groupBy("answer_id").agg((F.sum("weight") / 2).alias("expert_total"))
    points = rows.join(experts, "answer_id").select(
        F.col("answer_id").alias("sample_id"), "weight", (F.lit(0.5) - F.col("point_id") % 2).alias("score_diff"),
        (F.col("hit_status") != "miss").alias("hit"), "expert_total",
    )
    return evaluate.score_correlation(points, 0.0)


@add(
    "span_decode",
    """with t as (select vec_id, embedding::double[] as s, list_reverse(embedding)::double[] as e from embeddings),
    p as (select vec_id, i, j, s[i + 1] + e[j + 1] as v, row_number() over (partition by vec_id order by s[i + 1] + e[j + 1] desc, i, j) as r
      from t, unnest(range(1, 64)) a(i), unnest(range(1, 64)) b(j) where j >= i and j < i + 64)
    select p.vec_id, i::int as span_start, j::int as span_end, round(1 / (1 + exp(s[1] + e[1] - v)), 6) as has_answer_prob,
    round(v - 2 * ln(list_sum(list_transform(s, lambda x: exp(x)))), 6) as span_logprob,
    round(s[1] + e[1] - 2 * ln(list_sum(list_transform(s, lambda x: exp(x)))), 6) as null_logprob from p join t using (vec_id) where r = 1""",
)
def span_decode(spark, folder):
    out = evaluate.decode_spans(views.logits(spark, folder), ["vec_id"])
    logs = [F.round(c, 6).alias(c) for c in ("span_logprob", "null_logprob")]
    return out.select("vec_id", "span_start", "span_end", "has_answer_prob", *logs)


@add(
    "span_text",
    """with w as (select item_id, text, string_split(text, ' ') as w from benchmark)
    select item_id, array_to_string(w[(item_id % 5)::int + 1:(item_id % 5)::int + 4], ' ') as pred_text from w where item_id % 5 <> 0
    union all select item_id, '' from w where item_id % 5 = 0""",
)
def span_text(spark, folder):
    """Four words from one to four words in, by their character offsets; no span for every fifth item."""
    words = F.split("text", " ")
    step = F.aggregate(
        words,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("o")),
        lambda acc, w: F.struct(
            (acc["at"] + F.length(w) + 1).alias("at"),
            F.concat(acc["o"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(w)).alias("end")))).alias("o"),
        ),
        lambda acc: acc["o"],
    )
    first = (F.col("item_id") % 5).cast("int")
    rows = views.table(spark, folder, "benchmark").select(
        "item_id", F.col("text").alias("context"), step.alias("offsets"), first.alias("span_start"),
        F.when(first == 0, 0).otherwise(first + 3).alias("span_end"),
    )
    return evaluate.span_text(rows).select("item_id", "pred_text")
