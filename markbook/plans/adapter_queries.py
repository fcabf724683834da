"""Registered queries for exam sources, option points and reading corpora: given tables in each source's layout, read by its adapter."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markbook.operators import scoring
from markbook.operators.matchers import LexicalMatcher
from markbook.plans import views
from markbook.plans.registry import Registry
from markbook.session import work_dir
from markbook.sources import adapters, io

registry = Registry()
add = registry.add


# --- files in the layout of a source --------------------------------------------------------------
def _put(rows: DataFrame, path: str, line: Column, order: str) -> None:
    """One file of the given name with a line per row, in order."""
    spark, folder = rows.sparkSession, f"{path}.parts"
    rows.select(order, line.alias("value")).coalesce(1).sortWithinPartitions(order).select("value").write.text(folder)
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = store.globStatus(files.Path(f"{folder}/part-*"))[0].getPath()
    if not store.rename(part, files.Path(path)):
        raise OSError(f"{path} is not written")


def _document(rows: DataFrame, path: str, field: str, element: Column, order: str) -> None:
    """One file with one JSON document: {field: [element of each row, in order]}."""
    joined = rows.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, element.alias("e")))), lambda s: s["e"]).alias(field))
    _put(joined.withColumn("_n", F.lit(0)), path, F.to_json(F.struct(field)), "_n")


def _csv_line(*values: Column) -> Column:
    """Fields in quotes, quotes doubled, so that commas and line breaks stay inside."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for v in values]
    return F.concat_ws(",", *quoted)


def _with_header(rows: DataFrame, order: str, header: list[str], *values: Column) -> tuple[DataFrame, Column]:
    lines = rows.select(F.col(order), _csv_line(*values).alias("_line"))
    top = rows.sparkSession.createDataFrame([(-1, ",".join(header))], "o long, l string").select(F.col("o").alias(order), F.col("l").alias("_line"))
    return top.unionByName(lines), F.col("_line")


def _base(spark, name: str) -> str:
    return os.path.join(work_dir(spark, "adapter"), name)


def _parts(spark, folder) -> DataFrame:
    """Parts as exam items: three options, sometimes an empty one, the letter of the right one sometimes left out."""
    p = views.table(spark, folder, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("k"), F.col("p_name").alias("q"), F.col("p_brand").alias("a"), F.when(k % 4 == 0, "").otherwise(F.col("p_type")).alias("b"),
        F.col("p_size").cast("string").alias("c"), F.when(k % 5 == 0, "").otherwise(F.element_at(F.array(*map(F.lit, "ABC")), (k % 3 + 1).cast("int"))).alias("l"),
    )


_ITEMS = """p as (select p_partkey as k, p_name as q, p_brand as a, case when p_partkey % 4 = 0 then '' else p_type end as b, p_size::varchar as c,
    case when p_partkey % 5 = 0 then '' else ['A', 'B', 'C'][p_partkey % 3 + 1] end as l from part),
  i as (select *, case l when 'A' then a when 'B' then b when 'C' then c else '' end as t, nullif(l, '') as letter,
    'A=' || a || (case when b = '' then '' else ';B=' || b end) || ';C=' || c as choices from p)"""


def _flat(items: DataFrame) -> DataFrame:
    """An items table with its choices as text, in order of the letters."""
    entries = F.array_sort(F.transform(F.map_entries("choices"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return items.withColumn("choices", F.array_join(entries, ";")).drop("source")


def _sql(source: str, files: str, **columns: str) -> str:
    """SQL for the items of a source: ``files`` gives file (reading order), and the columns of ``i``; rows follow k within a file."""
    filled = {
        "subject": "'其他'", "stage": "'高中'", "type": "'choice'", "question": "q", "material": "''", "choices": "choices",
        "answer_letter": "letter", "answer_text": "t", "explanation": "''", "difficulty": "null::varchar", "split": "'train'", "note": "''",
    } | columns
    listed = ", ".join(f"{v} as {k}" for k, v in filled.items())
    return f"""with {_ITEMS}, f as ({files}) select '{source}-' || lpad((row_number() over (order by file, k) - 1)::varchar, 6, '0') as qid, {listed} from f"""


@add(
    "adapt_m3ke",
    _sql("m3ke", "select *, case when k % 3 = 0 then 0 else 1 end as file from i", subject="case file when 0 then 'Botany' else 'Trade' end",
         stage="case file when 0 then '初中' else '大学' end", split="case file when 0 then 'dev' else 'test' end"),
)
def adapt_m3ke(spark, folder):
    base, rows = _base(spark, "m3ke"), _parts(spark, folder)
    line = F.to_json(F.struct(F.col("q").alias("question"), F.col("a").alias("A"), F.col("b").alias("B"), F.col("c").alias("C"), F.col("l").alias("answer")))
    _put(rows.where("k % 3 = 0"), f"{base}/m3ke/data/dev/Botany-Garden-Junior high school.jsonl", line, "k")
    _put(rows.where("k % 3 <> 0"), f"{base}/m3ke/data/test/Trade-Shop & Market-College.jsonl", line, "k")
    return _flat(adapters.adapt_m3ke(spark, base))


@add(
    "adapt_agieval",
    _sql("agieval", "select *, case when k % 2 = 0 then 0 else 1 end as file from i", subject="case file when 0 then '英语' else '历史' end",
         material="'about ' || a", note="'year ' || c", choices="replace(choices, 'C=', 'C=no ')", answer_text="case l when 'C' then 'no ' || c else t end"),
)
def adapt_agieval(spark, folder):
    """Options as '(A) text', one of them twice: the last one counts; others are no option at all."""
    base, rows = _base(spark, "agieval"), _parts(spark, folder)
    option = lambda letter, c: F.concat(F.lit(f" ({letter}) "), c)
    given = F.array(option("A", F.col("a")), F.when(F.col("b") != "", option("B", F.col("b"))), option("C", F.lit("first")), F.lit("none"), option("C", F.concat(F.lit("no "), "c")))
    line = F.to_json(F.struct(
        F.concat(F.lit(" about "), "a").alias("passage"), F.col("q").alias("question"), F.array_compact(given).alias("options"),
        F.col("l").alias("label"), F.struct(F.concat(F.lit("year "), "c").alias("source")).alias("other"),
    ))
    _put(rows.where("k % 2 = 0"), f"{base}/agieval/data/v1/gaokao-english.jsonl", line, "k")
    _put(rows.where("k % 2 = 1"), f"{base}/agieval/data/v1/gaokao-history.jsonl", line, "k")
    return _flat(adapters.adapt_agieval(spark, base))


@add(
    "adapt_cmmlu",
    _sql("cmmlu", "select *, case when k % 2 = 0 then 0 else 1 end as file from i", subject="case file when 0 then '小学语文' else 'high_school_trade' end",
         stage="case file when 0 then '小学' else '高中' end", question="q || ', \"or\" not'"),
)
def adapt_cmmlu(spark, folder):
    """Headered files, with commas and quotes inside the fields."""
    base, rows = _base(spark, "cmmlu"), _parts(spark, folder)
    header = ["", "Question", "A", "B", "C", "Answer"]
    fields = (F.col("k"), F.concat("q", F.lit(', "or" not')), F.col("a"), F.col("b"), F.col("c"), F.col("l"))
    for rest, path in ((0, "dev/elementary_chinese"), (1, "test/high_school_trade")):
        table, line = _with_header(rows.where(F.col("k") % 2 == rest), "k", header, *fields)
        _put(table, f"{base}/cmmlu/data/{path}.csv", line, "k")
    return _flat(adapters.adapt_cmmlu(spark, base))


@add(
    "adapt_ceval",
    _sql("ceval", "select *, case when k % 3 = 0 then 0 else 1 end as file from i where k % 3 < 2", subject="case file when 0 then '初中历史' else '法学' end",
         stage="case file when 0 then '初中' else '其他' end", explanation="case file when 0 then 'see ' || a else '' end", note="'C-Eval（CC BY-NC-SA 4.0）'"),
)
def adapt_ceval(spark, folder):
    """Three files of which one has a subject that is not taken and another has no explanations."""
    base, rows = _base(spark, "ceval"), _parts(spark, folder)
    common = (F.col("k"), F.col("q"), F.col("a"), F.col("b"), F.col("c"), F.col("l"))
    for rest, path in ((0, "dev/middle_school_history_dev"), (1, "val/law_val"), (2, "val/physics_val")):
        header, fields = ["id", "question", "A", "B", "C", "answer"], common
        if rest == 0:
            header, fields = [*header, "explanation"], (*common, F.concat(F.lit("see "), "a"))
        table, line = _with_header(rows.where(F.col("k") % 3 == rest), "k", header, *fields)
        _put(table, f"{base}/ceval/{path}.csv", line, "k")
    return _flat(adapters.adapt_ceval(spark, base))


@add(
    "adapt_exams",
    _sql("exams", "select *, 0 as file from i", subject="case when k % 2 = 0 then c else '其他' end", material="coalesce(a, '')",
         answer_letter="case when l <> '' and not (l = 'B' and b = '') then l end"),
)
def adapt_exams(spark, folder):
    """An answer counts only if it is one of the choices."""
    base, rows = _base(spark, "exams"), _parts(spark, folder)
    pairs = F.filter(F.array(*[F.struct(F.lit(x.upper()).alias("k"), F.col(x).alias("v")) for x in "abc"]), lambda p: p["v"] != "")
    line = F.to_json(F.struct(
        F.when(F.col("k") % 2 == 0, F.col("c")).alias("subject"), F.col("q").alias("question"), F.col("a").alias("context"),
        F.map_from_entries(pairs).alias("choices"), F.col("l").alias("answer"),
    ))
    _put(rows, f"{base}/exams/exams_zh.jsonl", line, "k")
    return _flat(adapters.adapt_exams(spark, base))


@add(
    "adapt_ncr",
    _sql("ncr", "select *, case when k % 2 = 0 then 0 else 1 end as file from i", subject="'语文'", stage="'初中'", material="'story of ' || a", answer_text="''",
         difficulty="c", split="case file when 0 then 'dev' else 'test' end"),
)
def adapt_ncr(spark, folder):
    """A JSON array of passages with one question each; a split is read off the file name."""
    base, rows = _base(spark, "ncr"), _parts(spark, folder)
    options = F.filter(F.array(*[F.when(F.col(x) != "", F.concat(F.lit(f"{x.upper()}、"), F.col(x))).otherwise("x") for x in "abc"]), lambda o: F.lit(True))
    question = F.struct(F.col("q").alias("Question"), options.alias("Choices"), F.col("l").alias("Answer"), F.col("k").cast("string").alias("Q_id"))
    element = F.struct(F.concat(F.lit("story of "), "a").alias("Content"), F.col("c").alias("Diff"), F.array(question).alias("Questions"))
    for rest, name in ((0, "a_valid"), (1, "b_test")):
        whole = rows.where(F.col("k") % 2 == rest).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", element.alias("e")))), lambda s: s["e"]).alias("all"))
        _put(whole.withColumn("_n", F.lit(0)), f"{base}/ncr/{name}.json", F.to_json("all"), "_n")
    return _flat(adapters.adapt_ncr(spark, base))


@add(
    "adapt_gaokao",
    _sql("gaokao-bench", "select *, case when k % 2 = 0 then 0 else 1 end as file from i", subject="case file when 0 then '历史' else '政治' end",
         type="case file when 0 then 'choice' else 'open' end", explanation="'why ' || a", difficulty="c", note="'2020 ' || a",
         choices="case file when 0 then 'A=' || a || ';B=x;C=' || c end",
         answer_letter="case file when 0 then letter end", answer_text="case file when 0 then (case l when 'B' then 'x' else t end) else 'as ' || c end"),
)
def adapt_gaokao(spark, folder):
    """Options inside the question; open items keep their answer as text."""
    base, rows = _base(spark, "gaokao"), _parts(spark, folder)
    inline = F.concat("q", F.lit(" A．"), "a", F.lit(" B．x C．"), "c")
    common = [F.lit("2020").alias("year"), F.col("a").alias("category"), F.concat(F.lit("why "), "a").alias("analysis"), F.col("c").alias("score")]
    choice = F.struct(*common, inline.alias("question"), F.when(F.col("l") != "", F.array("l")).otherwise(F.array().cast("array<string>")).alias("answer"))
    open_item = F.struct(*common, F.col("q").alias("question"), F.concat(F.lit("as "), "c").alias("answer"))
    _document(rows.where("k % 2 = 0"), f"{base}/gaokao-bench/Data/Objective_Questions/2010_History_MCQs.json", "example", choice, "k")
    _document(rows.where("k % 2 = 1"), f"{base}/gaokao-bench/Data/Subjective_Questions/2010_Political_Science_Open.json", "example", open_item, "k")
    return _flat(adapters.adapt_gaokao(spark, base))


@add(
    "adapt_internlm_history",
    _sql("internlm-history", "select *, case when k % 2 = 0 then 0 else 1 end as file from i", subject="'历史'", stage="'初中'", type="'open'", choices="null::varchar",
         answer_letter="null::varchar", answer_text="a", split="case file when 0 then 'train' else 'test' end", note="'专题分类标注'"),
)
def adapt_internlm_history(spark, folder):
    """Conversations of one turn and a blank one; the instruction before the question is cut."""
    base, rows = _base(spark, "internlm"), _parts(spark, folder)
    turn = lambda given, out: F.struct(given.alias("input"), out.alias("output"), F.lit("s").alias("system"))
    asked = F.concat(F.when(F.col("k") % 3 == 0, "请问以下问题属于中学历史学科中的哪一个专题？").otherwise(" "), "q")
    element = F.struct(F.array(turn(F.lit(" "), F.col("b")), turn(asked, F.col("a"))).alias("conversation"))
    for rest, name in ((0, "2022_junior_middle_history"), (1, "2022_junior_middle_history_test")):
        whole = rows.where(F.col("k") % 2 == rest).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", element.alias("e")))), lambda s: s["e"]).alias("all"))
        _put(whole.withColumn("_n", F.lit(0)), f"{base}/internlm-history/datasets/{name}.json", F.to_json("all"), "_n")
    return _flat(adapters.adapt_internlm_history(spark, base))


@add(
    "adapt_reciter",
    _sql("reciter", "select *, case when k % 2 = 0 then 0 else 1 end as file from i", subject="'语文'", type="case file when 0 then 'fill' else 'open' end",
         question="case file when 0 then q else a || '（默写篇目）' end", choices="null::varchar", answer_letter="null::varchar",
         answer_text="case file when 0 then a || '；' || c else q || '。' || a || '，' || c || '，' || 'x \"y\"' end", note="case file when 0 then a || '（' || c || '）' else c || ' 高考默写范围' end"),
)
def adapt_reciter(spark, folder):
    """Blanks with two answers, and verses in groups of any depth."""
    base, rows = _base(spark, "reciter"), _parts(spark, folder)
    fill = F.struct(F.col("a").alias("title"), F.col("c").alias("source"), F.col("q").alias("content"), F.array("a", "c").alias("answer"))
    _document(rows.where("k % 2 = 0"), f"{base}/reciter/comprehensions/comprehensions.json", "comprehensions", fill, "k")
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), '^\\{"v":(.*)\\}$', 1)
    nested = F.concat(F.lit("["), text(F.col("q")), F.lit(",["), text(F.col("a")), F.lit(",["), text(F.col("c")), F.lit(',"x \\"y\\""]]]'))
    poem = F.concat(F.lit('{"title":'), text(F.col("a")), F.lit(',"tag":'), text(F.col("c")), F.lit(',"content":'), nested, F.lit("}"))
    poems = rows.where("k % 2 = 1").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", poem.alias("e")))), lambda s: s["e"]).alias("e"))
    line = F.concat(F.lit('{"poems":['), F.array_join("e", ","), F.lit("]}"))
    _put(poems.withColumn("_n", F.lit(0)), f"{base}/reciter/normal/poems.json", line, "_n")
    return _flat(adapters.adapt_reciter(spark, base))


@add(
    "union_sources",
    f"""with {_ITEMS} select 'exams' as source, count(*) as rows, string_agg(distinct c, ';' order by c) as subjects, null::varchar as note from i
    union all select 'ncr', 0, null, 'on request'""",
)
def union_sources(spark, folder):
    """Two sources side by side; the one without files keeps its note."""
    base, rows = _base(spark, "union"), _parts(spark, folder)
    _put(rows, f"{base}/exams/exams_zh.jsonl", F.to_json(F.struct(F.col("c").alias("subject"), F.col("q").alias("question"))), "k")
    _, status = adapters.union_items(adapters.read_items(spark, base, ["exams", "ncr"]), {"ncr": "on request", "exams": "here"})
    return status.withColumn("subjects", F.array_join("subjects", ";"))


# --- configs, seed items, reading corpora ---------------------------------------------------------
@add(
    "read_configs",
    """select c_nationkey::varchar as question_id, count(*) as n_points, max(c_custkey) as last_point, round(sum(c_acctbal), 2) as weight, false as broken
    from customer where c_nationkey <> 7 group by 1 union all select '7', 0, null, null, true""",
)
def read_configs(spark, folder):
    """One rubric per nation as a file of its own, one of them cut off in the middle."""
    base, customers = _base(spark, "configs"), views.table(spark, folder, "customer")
    point = F.struct(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("point_text"), F.col("c_acctbal").cast("double").alias("weight"))
    rubrics = customers.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(point)).alias("points"))
    body = F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("question_id"), "points"))
    line = F.when(F.col("c_nationkey") == 7, F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body)
    for n in range(25):
        _put(rubrics.where(F.col("c_nationkey") == n), f"{base}/{n}.json", line, "c_nationkey")
    good, broken = io.read_configs(spark, f"{base}/*.json")
    points = F.col("points")
    read = good.select(
        "question_id", F.size(points).cast("bigint").alias("n_points"), F.array_max(F.transform(points, lambda p: p["point_id"])).alias("last_point"),
        F.round(F.aggregate(points, F.lit(0.0), lambda a, p: a + p["weight"]), 2).alias("weight"), F.lit(False).alias("broken"),
    )
    lost = broken.select(
        F.regexp_replace("file", "\\.json$", "").alias("question_id"), F.lit(0).cast("bigint").alias("n_points"), F.lit(None).cast("bigint").alias("last_point"),
        F.lit(None).cast("double").alias("weight"), F.lit(True).alias("broken"),
    )
    return read.unionByName(lost)


@add(
    "read_seed_items",
    """with c as (select conv_id, count(*) as n, string_agg(text, chr(31) order by turn) as steps from conversations where text is not null group by 1)
    select 'c' || conv_id as id, n as n_steps, md5(steps) as steps_md5, row_number() over (order by conv_id) - 1 as position from c""",
)
def read_seed_items(spark, folder):
    """Conversations as items with nested steps, in one file of a subject."""
    base, conv = _base(spark, "seeds"), views.table(spark, folder, "conversations").where("text is not null")
    step = F.struct(F.col("turn"), F.struct(F.col("text").alias("response"), F.lit("x").alias("label")).alias("s"))
    items = conv.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(step)), lambda t: t["s"]).alias("steps"))
    line = F.to_json(F.struct(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("id"), F.lit("q").alias("question"), "steps"))
    subject = next(iter(io.SEED_SUBJECTS))
    _put(items, f"{base}/{subject}.jsonl", line, "conv_id")
    read = io.read_seed_items(spark, base)
    steps = F.array_join(F.transform("steps", lambda s: s["response"]), "\x1f")
    return read.select("id", F.size("steps").cast("bigint").alias("n_steps"), F.md5(steps).alias("steps_md5"), "position")


_CORPUS = """a as (select doc_id, text, case doc_id % 4 when 0 then 'not in it' when 1 then '' else substr(text, 5, 12) end as answer from documents where length(text) > 20)"""


@add(
    "read_span_corpus",
    f"""with {_CORPUS} select 'flat' as layout, doc_id::varchar as id, answer, (strpos(text, answer) - 1)::int as answer_start from a where answer <> '' and strpos(text, answer) > 0
    union all select 'nested', doc_id::varchar, answer, (case when doc_id % 3 = 0 then 4 end)::int from a where answer <> '' and doc_id % 3 = 0""",
)
def read_span_corpus(spark, folder):
    """Both layouts of a reading corpus: given starts, and starts that are searched."""
    base = _base(spark, "corpus")
    docs = views.documents(spark, folder).where(F.length("text") > 20)
    answer = F.when(F.col("doc_id") % 4 == 0, "not in it").when(F.col("doc_id") % 4 == 1, "").otherwise(F.substring("text", 5, 12))
    docs = docs.select("doc_id", "text", answer.alias("answer"))
    name = F.col("doc_id").cast("string")
    flat = F.struct(F.col("text").alias("context_text"), F.array(F.struct(name.alias("query_id"), F.lit("?").alias("query_text"), F.array("answer").alias("answers"))).alias("qas"))
    docs.select(F.to_json(flat).alias("value")).write.text(f"{base}/flat.json")
    given = F.struct(F.col("answer").alias("text"), F.when(F.col("doc_id") % 3 == 0, 4).alias("answer_start"))
    qa = F.struct(name.alias("id"), F.lit("?").alias("question"), F.array(given).alias("answers"))
    nested = F.struct(F.array(F.struct(F.array(F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))).alias("paragraphs"))).alias("data"))
    docs.select(F.to_json(nested).alias("value")).write.text(f"{base}/nested.json")
    found = [
        part.select(F.lit(kind).alias("layout"), "id", "answer", "answer_start")
        for kind, part in (
            ("flat", io.span_corpus_flat(spark.read.schema(io.FLAT_CORPUS).json(f"{base}/flat.json"))),
            ("nested", io.span_corpus_nested(spark.read.schema(io.NESTED_CORPUS).json(f"{base}/nested.json"))),
        )
    ]
    return found[0].unionByName(found[1])


# --- option points --------------------------------------------------------------------------------
@add(
    "option_points",
    """with a as (select c_custkey as answer_id, ['A', 'B', 'C', 'D', 'E'][c_custkey % 5 + 1] as x, ['A', 'B', 'C', 'D', 'E'][c_nationkey % 5 + 1] as want, c_custkey % 4 as form from customer)
    select answer_id, want as letters, case when form < 3 and x = want then want end as hit, case when form < 3 and x = want then 2.0 else 0.0 end::double as total_score,
      case when form < 3 and x = want then 'option' end as source from a""",
)
def option_points(spark, folder):
    """Answers that choose an option in several ways, or only speak of a letter, scored against option points."""
    customers = views.table(spark, folder, "customer")
    letters = F.array(*map(F.lit, "ABCDE"))
    pick = lambda c: F.element_at(letters, (F.col(c) % 5 + 1).cast("int"))
    x, form = pick("c_custkey"), F.col("c_custkey") % 4
    text = F.when(form == 0, F.concat(F.lit("我选"), x)).when(form == 1, F.concat(F.lit("1）"), x)).when(form == 2, F.concat(x, F.lit("项"))).otherwise(F.concat(F.lit("x"), x, F.lit("z")))
    answers = customers.select(F.col("c_custkey").alias("answer_id"), F.col("c_nationkey").alias("question_id"), text.alias("answer_text"))
    want = F.concat(F.lit("选项"), pick("n_nationkey"))
    point = F.struct(F.lit(1).cast("bigint").alias("point_id"), want.alias("point_text"), F.lit(2.0).alias("weight"), F.array().cast("array<string>").alias("aliases"))
    configs = views.table(spark, folder, "nation").select(F.col("n_nationkey").alias("question_id"), F.lit(2.0).alias("total_score"), F.array(point).alias("points"), F.lit(None).cast("struct<similarity_high:double,similarity_low:double>").alias("thresholds"))
    scored = scoring.score_answers(answers, configs, LexicalMatcher())
    detail = F.get(F.col("point_details"), F.lit(0))
    expected = configs.select("question_id", F.array_join(scoring.option_letters(F.col("points")[0]["point_text"], F.col("points")[0]["aliases"]), ",").alias("letters"))
    chosen = F.when(detail["source"] == "option", detail["extracted_span"])
    source = F.when(detail["point_score"] > 0, detail["source"])
    found = scored.select("answer_id", "question_id", chosen.alias("hit"), "total_score", source.alias("source"))
    return found.join(expected, "question_id").select("answer_id", "letters", "hit", "total_score", "source")
