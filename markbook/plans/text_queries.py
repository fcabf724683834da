"""Text normalisation, overlap and alignment over documents and benchmark items."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from markbook.functions import fixed, text
from markbook.operators import align, builders, overlap
from markbook.plans import views
from markbook.plans.registry import ANSWERS, POINTS, QUESTION, Registry, quoted

registry = Registry()
add = registry.add

_SPACE = quoted(fixed.whitespace())


def _sql_metric(x: str) -> str:
    return f"translate({x}, {quoted(fixed.metric_drop())}, '')"


def sql_stem(x: str) -> str:
    return f"translate({x}, {quoted(string.ascii_uppercase + fixed.stem_drop())}, {quoted(string.ascii_lowercase)})"


def _sql_trim_span(x: str) -> str:
    edges = quoted(fixed.whitespace() + fixed.SPAN_EDGE_PUNCT)
    return f"case when trim({x}, {edges}) = '' then {x} else trim({x}, {edges}) end"


@add("norm_metric", f"select doc_id, {_sql_metric('text')} as norm from documents")
def norm_metric(spark, folder):
    return views.documents(spark, folder).select("doc_id", text.norm_metric(F.col("text")).alias("norm"))


@add("norm_stem", f"select doc_id, {sql_stem('text')} as norm from documents")
def norm_stem(spark, folder):
    return views.documents(spark, folder).select("doc_id", text.norm_stem(F.col("text")).alias("norm"))


@add("norm_align", f"""with f as (select doc_id, text from documents)
    select doc_id, translate(text, {quoted(fixed.fold_table()[0] + fixed.align_drop())}, {quoted(fixed.fold_table()[1])}) as norm from f""")
def norm_align(spark, folder):
    return views.documents(spark, folder).select("doc_id", text.norm_align(F.col("text")).alias("norm"))


@add(
    "align_positions",
    f"""with c as (select item_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) - 1 as i
      from benchmark), k as (select * from c where strpos({quoted(fixed.align_drop())}, ch) = 0)
    select item_id, i::int as place, (row_number() over (partition by item_id order by i) - 1)::int as norm_place from k""",
)
def align_positions(spark, folder):
    """Where each kept character of an item stood in the original."""
    kept = text.norm_with_map(F.col("text"))["idx"]
    return views.table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(kept).alias("norm_place", "place")
    )


@add(
    "sentence_split",
    f"""with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？；\n，、]+'),
      lambda x: trim(x, {_SPACE})), lambda x: length(x) >= 6) as parts from documents)
    select doc_id, (i - 1)::int as pos, parts[i] as sentence from s, unnest(range(1, len(parts) + 1)) t(i)""",
)
def sentence_split(spark, folder):
    parts = text.sentences(F.col("text"))
    return views.documents(spark, folder).select("doc_id", F.posexplode(parts).alias("pos", "sentence"))


@add(
    "dedup_questions",
    f"""with k as (select translate(text, {_SPACE}, '') as key, doc_id, lang from documents),
    f as (select key, min(doc_id) as first, arg_min(lang, doc_id) as lang from k group by 1),
    n as (select *, row_number() over (partition by lang order by first) as n from f)
    select first as doc_id, 'SAS-' || lang || '-' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as question_id from n""",
)
def dedup_questions(spark, folder):
    """Whitespace-free distinct texts, numbered in first-seen order per language."""
    docs = views.documents(spark, folder)
    ids = builders.assign_question_ids(docs, "lang", "text", "doc_id")
    firsts = docs.groupBy(text.dedup_key(F.col("text")).alias("key")).agg(F.min("doc_id").alias("doc_id"))
    return firsts.join(ids, "key").select("doc_id", "question_id")


@add(
    "trim_span",
    f"""with w as (select doc_id, unnest(string_split(text, ' ')) as word from documents)
    select doc_id, {_sql_trim_span('word')} as span, count(*) as n from w group by 1, 2""",
)
def trim_span(spark, folder):
    words = views.documents(spark, folder).select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    return words.groupBy("doc_id", text.trim_span(F.col("word")).alias("span")).agg(F.count(F.lit(1)).alias("n"))


@add(
    "split_aliases",
    f"""with a as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[，,]'),
    lambda x: trim(x, {_SPACE})), lambda x: x <> '')) as alias from documents) select doc_id, alias, count(*) as n from a group by 1, 2""",
)
def split_aliases(spark, folder):
    docs = views.documents(spark, folder)
    return docs.select("doc_id", F.explode(text.split_aliases(F.col("text"))).alias("alias")).groupBy(
        "doc_id", "alias"
    ).agg(F.count(F.lit(1)).alias("n"))


@add(
    "mask_ranges",
    """select doc_id, case when text = '' then '' else
      substr(text, 1, least(doc_id % 40, length(text) - 1)::int) ||
      repeat(' ', (least(doc_id % 40 + 9, length(text) - 1) - least(doc_id % 40, length(text) - 1) + 1)::int) ||
      substr(text, (least(doc_id % 40 + 9, length(text) - 1) + 2)::int) end as masked from documents""",
)
def mask_ranges(spark, folder):
    """Ten characters blanked, in two overlapping ranges."""
    at = F.col("doc_id") % 40
    ranges = F.array(
        F.struct(at.alias("start"), (at + 6).alias("end")), F.struct((at + 4).alias("start"), (at + 9).alias("end"))
    )
    return views.documents(spark, folder).select("doc_id", text.mask_ranges(F.col("text"), ranges).alias("masked"))


@add(
    "char_f1",
    f"""with {ANSWERS}, t as (select answer_id, {_sql_metric('answer_text')} as p, {_sql_metric('b.text')} as g
      from answers join benchmark b on item_id = question_id),
    pc as (select answer_id, ch, count(*) as n from (select answer_id, unnest(string_split(p, '')) as ch from t) group by 1, 2),
    gc as (select answer_id, ch, count(*) as n from (select answer_id, unnest(string_split(g, '')) as ch from t) group by 1, 2),
    o as (select answer_id, sum(least(pc.n, gc.n)) as o from pc join gc using (answer_id, ch) group by 1)
    select answer_id, case when p = '' or g = '' then 0 else round(2.0::double * coalesce(o, 0) / (length(p) + length(g)), 6) end::double as f1,
    (p = g and p <> '')::int as em from t left join o using (answer_id)""",
)
def char_f1(spark, folder):
    """Documents against the item of their question."""
    gold = views.stems(spark, folder).withColumnRenamed("stem_id", "question_id")
    rows = views.answers(spark, folder).join(gold, "question_id")
    a, g = F.col("answer_text"), F.col("stem_text")
    return rows.select("answer_id", F.round(text.char_f1(a, g), 6).alias("f1"), text.exact_match(a, g).alias("em"))


@add("highlight_segments")
def highlight_segments(spark, folder):
    """Segments of every document with its rubric words marked; checked by brute force in the tests."""
    marks = views.points(spark, folder).groupBy("question_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("point_id", F.lit("hit_exact").alias("hit_status"), text.trim_span(F.col("point_text")).alias("extracted_span"))
            )
        ).alias("details")
    )
    rows = views.answers(spark, folder).join(marks, "question_id")
    segments = text.highlight_segments(F.col("answer_text"), F.col("details"))
    return rows.select("answer_id", F.posexplode(segments).alias("seg", "s")).select("answer_id", "seg", "s.*")


# --- overlap ------------------------------------------------------------------------------------
K = 24


def _grams(source: str, ids: str, out: str, k: int, place: str) -> str:
    """SQL for all k-grams of ``norm``, taken piece by piece."""
    return f"""{out} as (select {ids}, base + o as {place}, substr(piece, o + 1, {k}) as g from (
      select {ids}, b * 256 as base, substr(norm, b * 256 + 1, {255 + k}) as piece, length(norm) as n
      from {source}, unnest(range(0, (greatest(length(norm) - {k}, 0) // 256) + 1)) t(b) where length(norm) >= {k}),
      unnest(range(0, least(length(piece) - {k}, 255) + 1)) u(o) where length(piece) >= {k})"""


def _runs(k: int, on: str, left: str = "ln", right: str = "rn", ids: str = "answer_id, stem_id", lid: str = "answer_id", rid: str = "stem_id", extra: str = "") -> str:
    """SQL for shared runs: (ids, i, diag, run_end)."""
    return f"""{_grams(left, lid + extra, 'lg', k, 'i')}, {_grams(right, rid + extra, 'rg', k, 'j')},
    met as (select {ids}, i, i - j as diag from lg join rg on lg.g = rg.g {on}),
    isl as (select *, i - row_number() over (partition by {ids}, diag order by i) as grp from met),
    runs as (select {ids}, i, diag, max(i) over (partition by {ids}, diag, grp) + {k} as run_end from isl)"""


_NORM = f"""ln as (select doc_id as answer_id, {QUESTION} as q, {sql_stem('text')} as norm from documents),
    rn as (select item_id as stem_id, item_id as q, {sql_stem('text')} as norm from benchmark)"""


@add(
    "leak_pairs_lcs",
    f"""with {_NORM}, {_runs(K, '')} select answer_id, stem_id, max(run_end - i)::int as lcs_len from runs group by 1, 2""",
)
def leak_pairs_lcs(spark, folder):
    return overlap.lcs_pairs(views.answers(spark, folder), views.stems(spark, folder), K, "answer_id", "stem_id", "answer_text", "stem_text")


def _stripped(on: str) -> str:
    """SQL of the greedy pass and of the blanking, for the documents that have a match."""
    return f"""with recursive {_NORM}, {_runs(K, on, extra=', q', ids='answer_id, stem_id', lid='answer_id', rid='stem_id')},
    longest as (select answer_id, i, max(run_end) as e from runs group by 1, 2),
    taken(answer_id, s, e) as (
      select answer_id, min(i), arg_min(e, i) from longest group by 1
      union all
      select t.answer_id, n.i, n.e from taken t join lateral (
        select i, e from longest l where l.answer_id = t.answer_id and l.i >= t.e order by i limit 1) n on true),
    chars as (select doc_id as answer_id, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as place
      from documents where doc_id in (select answer_id from taken)),
    placed as (select *, case when strpos({quoted(fixed.stem_drop())}, ch) = 0 then
      sum(case when strpos({quoted(fixed.stem_drop())}, ch) = 0 then 1 else 0 end) over (partition by answer_id order by place) - 1 end as np
      from chars),
    marked as (select p.answer_id, p.place, p.ch, bool_or(t.s is not null) as hit from placed p
      left join taken t on t.answer_id = p.answer_id and p.np >= t.s and p.np < t.e group by 1, 2, 3),
    stripped as (select answer_id, string_agg(case when hit then ' ' else ch end, '' order by place) as stripped_text from marked group by 1),
    {ANSWERS}"""


STRIPPED_OWN = _stripped("and lg.q = rg.q")


@add(
    "stem_strip",
    f"""{_stripped('')} select a.answer_id, coalesce(stripped_text, answer_text) as stripped_text,
    stripped_text is not null as changed from answers a left join stripped using (answer_id)""",
)
def stem_strip(spark, folder):
    out = overlap.strip_stems(views.answers(spark, folder), views.stems(spark, folder), K)
    return out.select("answer_id", "stripped_text", (F.col("stripped_text") != F.col("answer_text")).alias("changed"))


@add(
    "strip_training_rows",
    f"""{_stripped('')} , t as (select a.answer_id, answer_text, stripped_text, answer_id % 200 as s,
      answer_id % 200 + 5 as e, coalesce(stripped_text is not null and stripped_text <> answer_text, false) as differs
      from answers a left join stripped using (answer_id)),
    v as (select *, case when not differs then 'same' when trim(substr(stripped_text, s::int + 1, 6), {_SPACE}) = '' then 'guarded' else 'changed' end as strip_status from t)
    select answer_id, strip_status, case when strip_status = 'changed' then stripped_text else answer_text end as context from v""",
)
def strip_training_rows(spark, folder):
    """Gold spans of five characters somewhere in the first two hundred."""
    a = F.col("answer_id")
    spans = views.answers(spark, folder).select(
        a.alias("id"), F.lit("full").alias("origin"), F.col("answer_text").alias("context"),
        (a % 200).cast("int").alias("answer_start"), (a % 200 + 5).cast("int").alias("answer_end"),
    )
    out = overlap.strip_training_rows(spans, views.stems(spark, folder), K, None)
    return out.select(F.col("id").alias("answer_id"), "strip_status", "context")


_REFS = """refs as (select item_id, unnest(string_split(text, '. ')) as ref, generate_subscripts(string_split(text, '. '), 1) as no
    from benchmark)"""


def _hits(left: str) -> str:
    """SQL for the longest shared substring (>= 8) of each text and reference, earliest first."""
    return f"""{_REFS}, ln as (select answer_id, q, {sql_stem('src')} as norm from {left}),
    rn as (select item_id as q, no, ref, {sql_stem('ref')} as norm from refs),
    {_grams('ln', 'answer_id, q', 'lg', 8, 'i')}, {_grams('rn', 'q, no', 'rg', 8, 'j')},
    met as (select answer_id, lg.q as q, no, i, i - j as diag from lg join rg on lg.g = rg.g and lg.q = rg.q),
    isl as (select *, i - row_number() over (partition by answer_id, no, diag order by i) as grp from met),
    runs as (select answer_id, q, no, min(i) as s, max(i) + 8 - min(i) as n from isl group by answer_id, q, no, diag, grp),
    best as (select * from (select *, row_number() over (partition by answer_id, no order by n desc, s) as r from runs) where r = 1),
    hits as (select best.*, rn.ref, substr(ln.norm, best.s::int + 1, best.n::int) as hit from best join ln using (answer_id) join rn on rn.q = best.q and rn.no = best.no)"""


def _references(spark, folder):
    items = views.table(spark, folder, "benchmark")
    refs = F.split("text", "\\. ")
    return items.select(F.col("item_id").alias("question_id"), refs.alias("refs"), overlap.reference_grams(refs).alias("grams"))


@add(
    "leak_scan",
    f"""with {ANSWERS}, src as (select answer_id, question_id as q, answer_text as src from answers), {_hits('src')},
    st as (select item_id, {sql_stem('text')} as stem from benchmark),
    j as (select h.*, stem from hits h join st on st.item_id = (h.q + 1) % (select count(*) from benchmark)),
    v as (select *, strpos(stem, hit) > 0
      or (length(hit) > 9 and (strpos(stem, substr(hit, 1, length(hit) - 1)) > 0 or strpos(stem, substr(hit, 2)) > 0))
      or (length(hit) > 10 and (strpos(stem, substr(hit, 1, length(hit) - 2)) > 0 or strpos(stem, substr(hit, 3)) > 0)) as own from j)
    select answer_id, ref, hit from (select *, row_number() over (partition by answer_id order by no) as f from v where not own) where f = 1""",
)
def leak_scan(spark, folder):
    """Documents repeating a sentence part of their question's item; the next item plays the stem."""
    items = views.table(spark, folder, "benchmark")
    count = items.agg(F.count(F.lit(1))).scalar()
    stems = items.select(((F.col("item_id") + count - 1) % count).alias("question_id"), F.col("text").alias("stem"))
    rows = (
        views.answers(spark, folder)
        .join(_references(spark, folder), "question_id")
        .join(stems, "question_id")
        .withColumnRenamed("answer_text", "context")
    )
    return overlap.leak_scan(rows, grams="grams").select("answer_id", "ref", "hit")


@add(
    "fp_attribution",
    f"""with {ANSWERS}, src as (select answer_id, question_id as q, answer_text as src from answers), {_hits('src')}
    select a.answer_id, case when hit is null then 'semantic-discussion' else 'verbatim-leak' end as category, coalesce(hit, '') as hit
    from answers a left join (select *, row_number() over (partition by answer_id order by no) as f from hits) h
      on h.answer_id = a.answer_id and f = 1""",
)
def fp_attribution(spark, folder):
    """Whole documents as wrongly credited spans, against the sentences of the question's item."""
    rows = views.answers(spark, folder).join(_references(spark, folder), "question_id")
    spans = rows.withColumn("extracted_span", F.col("answer_text"))
    return overlap.classify_fp(spans, grams="grams").select("answer_id", "category", "hit")


@add(
    "overlap_report",
    f"""with ln as (select doc_id as answer_id, translate(text, {_SPACE}, '') as norm from documents),
    rn as (select item_id as stem_id, translate(text, {_SPACE}, '') as norm from benchmark), {_runs(32, '')},
    p as (select answer_id, stem_id, max(run_end - i)::int as n from runs group by 1, 2),
    x as (select answer_id from ln where norm in (select norm from rn)),
    z as (select p.answer_id, max(n) as lcs_len, bool_or(n = least(length(ln.norm), length(rn.norm))) as c
      from p join ln using (answer_id) join rn using (stem_id) where p.answer_id not in (from x) group by 1)
    select answer_id, 'exact' as overlap, null::int as lcs_len from x
    union all select answer_id, case when c then 'containment' else 'shared' end, lcs_len from z""",
)
def overlap_report(spark, folder):
    own = views.stems(spark, folder).select("stem_id", F.col("stem_text").alias("body"))
    external = views.answers(spark, folder).select("answer_id", F.col("answer_text").alias("body"))
    return overlap.overlap_report(own, external, "stem_id", "answer_id", "body", 32)


# --- alignment and raw output ---------------------------------------------------------------------
def _quoted_spans(spark, folder):
    """Spans quoted from documents: as they are, upper-cased with other punctuation, or not at all."""
    docs = views.documents(spark, folder)
    piece = F.substring(F.col("text"), F.lit(11), F.lit(30))
    n = F.col("doc_id") % 3
    span = F.when(n == 0, piece).when(n == 1, F.translate(piece, string.ascii_lowercase + " .,", string.ascii_uppercase + "---")).otherwise(F.lit(""))
    return docs.select("doc_id", "text", span.alias("span"))


_ALIGNED = f"""s as (select doc_id, text, case doc_id % 3 when 0 then substr(text, 11, 30)
      when 1 then translate(substr(text, 11, 30), '{string.ascii_lowercase} .,', '{string.ascii_uppercase}---') else '' end as span from documents),
    t as (select doc_id, text, trim(span, {_SPACE}) as span from s),
    n as (select *, translate(text, {quoted(fixed.fold_table()[0] + fixed.align_drop())}, {quoted(fixed.fold_table()[1])}) as nt,
      translate(span, {quoted(fixed.fold_table()[0] + fixed.align_drop())}, {quoted(fixed.fold_table()[1])}) as ns from t),
    aligned as (select doc_id, case when span = '' then null when strpos(text, span) > 0 then 'exact'
      when ns <> '' and strpos(nt, ns) > 0 then 'fuzzy' end as strategy,
      case when span <> '' and strpos(text, span) > 0 then strpos(text, span) - 1 end::int as exact_start
    from n)"""


@add("align_spans", f"with {_ALIGNED} select doc_id, strategy, exact_start from aligned")
def align_spans(spark, folder):
    out = align.align_spans(_quoted_spans(spark, folder), "text", "span")
    exact = F.col("align.strategy") == "exact"
    return out.select("doc_id", "align.strategy", F.when(exact, F.col("align.start")).alias("exact_start"))


@add("align_blocks")
def align_blocks(spark, folder):
    """Rewritten item sentences found again by matching blocks; checked against difflib in the tests."""
    items = views.table(spark, folder, "benchmark")
    span = F.concat(F.substring("text", 5, 20), F.lit("xx"), F.substring("text", 28, 20))
    out = align.align_spans(items.select("item_id", "text", span.alias("span")), "text", "span")
    return out.select("item_id", "align.*")


@add(
    "align_report",
    f"""with {_ALIGNED} select count(*) filter (doc_id % 3 < 2) as hit_points, count(*) filter (doc_id % 3 < 2 and strategy is not null) as aligned,
    count(*) filter (strategy = 'exact') as exact, count(*) filter (strategy = 'fuzzy') as fuzzy, 0::bigint as lcs from aligned""",
)
def align_report(spark, folder):
    rows = _quoted_spans(spark, folder).withColumn("hit", F.col("doc_id") % 3 < 2)
    return align.align_report(align.align_spans(rows, "text", "span"))


@add(
    "output_parse",
    """select event_id, event_id % 10 <> 0 as good, case when event_id % 10 <> 0 then (props::json ->> 'k')::bigint end as k from events""",
)
def output_parse(spark, folder):
    rows = builders.parse_rows(views.raw_outputs(spark, folder), "k bigint")
    return rows.select("event_id", F.col("parsed").isNotNull().alias("good"), F.col("parsed.k").alias("k"))
