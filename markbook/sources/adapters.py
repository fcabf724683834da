"""Exam sources to the common items schema.

An adapter has a reader (files to raw rows, with their reading place) and a pure part (raw rows to items
without ids); ids are given by ``with_row_id`` over all rows of the source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.functions.scores import safe_num
from markbook.functions.text import strip_space
from markbook.operators.tables import scored_pairs, seeded_cap
from markbook.schemas import ITEMS
from markbook.sources.io import exists, number_rows, read_tsv, with_place

# --- fixed values: stages, subjects, names -----------------------------------------------------
M3KE_STAGES = {
    "Primary school": "小学",
    "Junior high school": "初中",
    "High school": "高中",
    "College": "大学",
    "Other": "其他",
}
GAOKAO_SUBJECTS = (
    ("History", "历史"),
    ("Geography", "地理"),
    ("Political_Science", "政治"),
    ("Chinese", "语文"),
    ("Chinese_Language", "语文"),
)
AGIEVAL_SUBJECTS = (("chinese", "语文"), ("history", "历史"), ("geography", "地理"), ("english", "英语"))
CMMLU_SUBJECTS = {
    "chinese_history": "中国历史",
    "world_history": "世界历史",
    "chinese_literature": "中国文学",
    "ancient_chinese": "古代汉语",
    "modern_chinese": "现代汉语",
    "elementary_chinese": "小学语文",
    "high_school_geography": "高中地理",
    "high_school_politics": "高中政治",
    "chinese_foreign_policy": "中国外交政策",
    "legal_and_moral_basis": "法律与道德基础",
    "education": "教育学",
    "sociology": "社会学",
    "philosophy": "哲学",
    "marxist_theory": "马克思主义理论",
    "world_religions": "世界宗教",
    "global_facts": "全球常识",
    "ethnology": "民族学",
    "journalism": "新闻学",
    "arts": "艺术",
    "chinese_teacher_qualification": "教师资格考试",
}
CEVAL_SUBJECTS = {
    "art_studies": "艺术",
    "chinese_language_and_literature": "中国语言文学",
    "education_science": "教育科学",
    "high_school_chinese": "高中语文",
    "high_school_geography": "高中地理",
    "high_school_history": "高中历史",
    "high_school_politics": "高中政治",
    "law": "法学",
    "middle_school_geography": "初中地理",
    "middle_school_history": "初中历史",
    "middle_school_politics": "初中政治",
    "modern_chinese_history": "中国近现代史",
}
HISTORY_PREFIX = "^请问以下问题属于中学历史学科中的哪一个专题？"
NO_STAGE = NO_SUBJECT = "其他"
HIGH_SCHOOL, MIDDLE_SCHOOL, PRIMARY_SCHOOL = "高中", "初中", "小学"
CHINESE, HISTORY = "语文", "历史"
TOPIC_NOTE = "专题分类标注"
CEVAL_NOTE = "C-Eval（CC BY-NC-SA 4.0）"
RECITE_TITLE, RECITE_NOTE = "（默写篇目）", " 高考默写范围"
# ----------------------------------------------------------------------------------------------

PLACE = ("_order", "_file", "_block", "_row")
BODY = [c.split(" ")[0] for c in ITEMS.replace("map<string,string>", "map").split(", ")]


def _text(col: Column) -> Column:
    return strip_space(F.coalesce(col.cast("string"), F.lit("")))


def _null_if_empty(col: Column) -> Column:
    return F.nullif(_text(col), F.lit(""))


def _choices(letters: str, value) -> Column:
    """Map of letter to text, empty choices left out, null when none is left."""
    pairs = F.filter(
        F.array(*[F.struct(F.lit(x).alias("key"), value(x).alias("value")) for x in letters]),
        lambda p: F.coalesce(p["value"], F.lit("")) != "",
    )
    return F.when(F.size(pairs) > 0, F.map_from_entries(pairs))


def _answer_of(choices: Column, letter: Column) -> Column:
    return F.coalesce(F.try_element_at(choices, letter), F.lit(""))


def _stem(df: DataFrame) -> Column:
    name = F.element_at(F.split(F.col("_file"), "/"), -1)
    # file paths are URL-encoded
    return F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "\\.[^.]*$", "")


def _pick(table: Mapping[str, str], key: Column, default: Column) -> Column:
    found = default
    for name, value in table.items():
        found = F.when(key == name, value).otherwise(found)
    return found


def _items(df: DataFrame, source: str, order: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Rows in the items schema (qid still empty), with their reading place."""
    defaults = {
        "source": F.lit(source),
        "qid": F.lit(None),
        "material": F.lit(""),
        "choices": F.lit(None),
        "answer_letter": F.lit(None),
        "answer_text": F.lit(""),
        "explanation": F.lit(""),
        "difficulty": F.lit(None),
        "split": F.lit("train"),
        "note": F.lit(""),
    }
    filled = {**defaults, **columns}
    types = {"choices": "map<string,string>"}
    return df.select(*[filled[c].cast(types.get(c, "string")).alias(c) for c in BODY], *PLACE, *order)


def with_row_id(items: DataFrame, source: str, sub: Sequence[str] = (), first: int = 0) -> DataFrame:
    """Give every row the id source-%06d, numbered over all files of the source in reading order."""
    numbered = number_rows(items, "_n", sub)
    return numbered.withColumn("qid", F.format_string(f"{source}-%06d", F.col("_n") + first)).select(*BODY)


def _read(spark: SparkSession, paths: Sequence[str], reader) -> DataFrame | None:
    out = None
    for order, path in enumerate(paths):
        if exists(spark, path):
            part = with_place(reader(path), order)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ITEMS)


def _jsonl(spark: SparkSession, schema: str):
    return lambda path: spark.read.schema(schema).json(path)


def _document(spark: SparkSession, schema: str):
    return lambda path: spark.read.schema(schema).option("multiLine", True).json(path)


def _csv(spark: SparkSession):
    return lambda path: (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    )


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# --- one function per source ------------------------------------------------------------------


def adapt_m3ke(spark: SparkSession, src: str) -> DataFrame:
    """Choice items by subject and stage, both from the file name; answers only where given."""
    schema = "question string, A string, B string, C string, D string, E string, answer string"
    folders = [f"{src}/m3ke/data/{split}" for split in ("dev", "train", "test")]
    raw = _read(spark, [f"{f}/*.jsonl" for f in folders], _jsonl(spark, schema))
    if raw is None:
        return _none(spark)
    parts = F.transform(F.split(_stem(raw), "-"), strip_space)
    stage = F.lit(NO_STAGE)
    for name, title in M3KE_STAGES.items():
        stage = F.when(F.array_contains(parts, name), title).otherwise(stage)
    split = F.get(F.array(F.lit("dev"), F.lit("train"), F.lit("test")), F.col("_order"))
    choices = _choices("ABCDE", F.col)
    letter = _null_if_empty(F.col("answer"))
    # a line without any field is a blank one
    rows = raw.where(F.coalesce("question", "A", "answer").isNotNull())
    items = _items(
        rows,
        "m3ke",
        subject=F.get(parts, F.lit(0)),
        stage=stage,
        type=F.lit("choice"),
        question=F.coalesce("question", F.lit("")),
        choices=choices,
        answer_letter=letter,
        answer_text=_answer_of(choices, letter),
        split=split,
    )
    return with_row_id(items, "m3ke")


def adapt_internlm_history(spark: SparkSession, src: str) -> DataFrame:
    """Topic-labelled history questions from conversations; the instruction before the question is cut."""
    schema = "conversation array<struct<input:string,output:string,system:string>>"
    folder = f"{src}/internlm-history/datasets"
    names = ("2022_junior_middle_history", "2022_junior_middle_history_test")
    raw = _read(spark, [f"{folder}/{n}.json" for n in names], _document(spark, schema))
    if raw is None:
        return _none(spark)
    turns = raw.select(*PLACE, F.posexplode("conversation").alias("_turn", "c"))
    question = strip_space(F.regexp_replace(F.coalesce("c.input", F.lit("")), HISTORY_PREFIX, ""))
    items = _items(
        turns.withColumn("_question", question).where(F.col("_question") != ""),
        "internlm-history",
        ["_turn"],
        subject=F.lit(HISTORY),
        stage=F.lit(MIDDLE_SCHOOL),
        type=F.lit("open"),
        question=F.col("_question"),
        answer_text=F.coalesce("c.output", F.lit("")),
        split=F.when(F.col("_order") == 1, "test").otherwise("train"),
        note=F.lit(TOPIC_NOTE),
    )
    return with_row_id(items, "internlm-history", ["_turn"])


def adapt_gaokao(spark: SparkSession, src: str) -> DataFrame:
    """Past papers: choice items with options inside the question, and open items with answer text."""
    fields = "year string, category string, question string, analysis string, score string"
    folder = f"{src}/gaokao-bench/Data"
    kinds = (("Objective_Questions", "array<string>"), ("Subjective_Questions", "string"))
    parts = []
    for order, (kind, answer_type) in enumerate(kinds):
        path = f"{folder}/{kind}/*.json"
        if not exists(spark, path):
            continue
        element = ",".join(f.strip().replace(" ", ":") for f in fields.split(",")) + f",answer:{answer_type}"
        raw = with_place(_document(spark, f"example array<struct<{element}>>")(path), order)
        subject = F.lit(CHINESE)
        for key, title in reversed(GAOKAO_SUBJECTS):
            subject = F.when(F.contains(_stem(raw), F.lit(key)), title).otherwise(subject)
        rows = raw.select(*PLACE, subject.alias("_subject"), F.posexplode("example").alias("_i", "e"))
        rows = rows.withColumn("_q", _text(F.col("e.question"))).where(F.col("_q") != "")
        common = {
            "subject": F.col("_subject"),
            "stage": F.lit(HIGH_SCHOOL),
            "explanation": _text(F.col("e.analysis")),
            "difficulty": F.col("e.score"),
            "note": strip_space(F.concat_ws(" ", F.col("e.year"), F.coalesce("e.category", F.lit("")))),
        }
        if order == 0:
            option = "\\s*([A-E])．"
            letters = F.regexp_extract_all("_q", F.lit(option), F.lit(1))
            pieces = F.split("_q", option)
            texts = F.transform(F.slice(pieces, 2, F.size(letters)), strip_space)
            inline = F.size(letters) > 0
            # of repeated letters the last one counts
            entries = F.arrays_zip(letters.alias("key"), texts.alias("value"))
            last = F.filter(
                entries, lambda e, i: ~F.array_contains(F.slice(letters, i + 2, F.size(letters)), e["key"])
            )
            choices = F.when(inline, F.map_from_entries(last))
            first = F.get(F.col("e.answer"), F.lit(0))
            letter = F.when(~inline | F.array_contains(letters, first), first)
            parts.append(
                _items(
                    rows,
                    "gaokao-bench",
                    ["_i"],
                    type=F.lit("choice"),
                    question=F.when(inline, strip_space(F.get(pieces, F.lit(0)))).otherwise(F.col("_q")),
                    choices=choices,
                    answer_letter=letter,
                    answer_text=_answer_of(choices, letter),
                    **common,
                )
            )
        else:
            parts.append(
                _items(
                    rows,
                    "gaokao-bench",
                    ["_i"],
                    type=F.lit("open"),
                    question=F.col("_q"),
                    answer_text=_text(F.col("e.answer")),
                    **common,
                )
            )
    if not parts:
        return _none(spark)
    items = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return with_row_id(items, "gaokao-bench", ["_i"])


def adapt_agieval(spark: SparkSession, src: str) -> DataFrame:
    """Choice items with '(A) text' options and a passage as material."""
    schema = "passage string, question string, options array<string>, label string, other struct<source:string>"
    raw = _read(spark, [f"{src}/agieval/data/v1/gaokao-*.jsonl"], _jsonl(spark, schema))
    if raw is None:
        return _none(spark)
    subject = F.lit(NO_SUBJECT)
    for key, title in reversed(AGIEVAL_SUBJECTS):
        subject = F.when(_stem(raw).endswith(key), title).otherwise(subject)
    option = "^\\(([A-E])\\)\\s*(.*)"
    listed = F.filter(
        F.transform(
            F.coalesce("options", F.array().cast("array<string>")),
            lambda o: F.struct(
                F.regexp_extract(strip_space(o), option, 1).alias("key"),
                strip_space(F.regexp_extract(strip_space(o), option, 2)).alias("value"),
            ),
        ),
        lambda p: p["key"] != "",
    )
    last = F.filter(
        listed, lambda p, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda later: later["key"] == p["key"])
    )
    choices = F.when(F.size(listed) > 0, F.map_from_entries(last))
    label = _null_if_empty(F.col("label"))
    items = _items(
        raw.where(F.coalesce("question", "passage", "label").isNotNull()),
        "agieval",
        subject=subject,
        stage=F.lit(HIGH_SCHOOL),
        type=F.lit("choice"),
        question=_text(F.col("question")),
        material=_text(F.col("passage")),
        choices=choices,
        answer_letter=label,
        answer_text=_answer_of(choices, label),
        note=F.coalesce("other.source", F.lit("")),
    )
    return with_row_id(items, "agieval")


def adapt_cmmlu(spark: SparkSession, src: str) -> DataFrame:
    """Knowledge tests; dev and test rows both train."""
    raw = _read(spark, [f"{src}/cmmlu/data/{s}/*.csv" for s in ("dev", "test")], _csv(spark))
    if raw is None:
        return _none(spark)
    stem = _stem(raw)
    stage = (
        F.when(F.contains(stem, F.lit("elementary")), PRIMARY_SCHOOL)
        .when(F.contains(stem, F.lit("high_school")), HIGH_SCHOOL)
        .otherwise(NO_STAGE)
    )
    choices = _choices("ABCD", lambda x: _text(_column(raw, x)))
    letter = _null_if_empty(_column(raw, "Answer"))
    items = _items(
        raw.where(_text(F.col("Question")) != ""),
        "cmmlu",
        subject=_pick(CMMLU_SUBJECTS, stem, stem),
        stage=stage,
        type=F.lit("choice"),
        question=_text(F.col("Question")),
        choices=choices,
        answer_letter=letter,
        answer_text=_answer_of(choices, letter),
    )
    return with_row_id(items, "cmmlu")


def _flat_verse(nested: Column) -> Column:
    """Lines of a verse group joined by a comma; groups may be nested, so their text is read as JSON.

    Strings are taken in order whatever their depth, which is what joining level by level gives.
    """
    strings = F.regexp_extract_all(nested, F.lit('"((?:[^"\\\\]|\\\\.)*)"'), F.lit(0))
    plain = F.transform(strings, lambda s: F.from_json(F.concat(F.lit('{"v":'), s, F.lit("}")), "v string")["v"])
    return F.array_join(F.filter(plain, lambda s: s != ""), "，")


def adapt_reciter(spark: SparkSession, src: str) -> DataFrame:
    """Recitation: fill-in items with answers joined by '；', and whole poems."""
    fill_schema = "comprehensions array<struct<title:string,source:string,content:string,answer:array<string>>>"
    poem_schema = "poems array<struct<title:string,tag:string,content:array<string>>>"
    parts = []
    path = f"{src}/reciter/comprehensions/comprehensions.json"
    if exists(spark, path):
        raw = with_place(_document(spark, fill_schema)(path), 0)
        rows = raw.select(*PLACE, F.posexplode("comprehensions").alias("_i", "e"))
        rows = rows.where((_text(F.col("e.content")) != "") & (F.coalesce(F.size("e.answer"), F.lit(0)) > 0))
        note = F.concat(F.coalesce("e.title", F.lit("None")), F.lit("（"), F.coalesce("e.source", F.lit("")), F.lit("）"))
        parts.append(
            _items(
                rows,
                "reciter",
                ["_i"],
                subject=F.lit(CHINESE),
                stage=F.lit(HIGH_SCHOOL),
                type=F.lit("fill"),
                question=_text(F.col("e.content")),
                answer_text=F.array_join("e.answer", "；"),
                note=note,
            )
        )
    path = f"{src}/reciter/normal/poems.json"
    if exists(spark, path):
        raw = with_place(_document(spark, poem_schema)(path), 1)
        rows = raw.select(*PLACE, F.posexplode("poems").alias("_i", "e"))
        # an element is a plain line, or a group kept as its JSON text
        lines = F.transform(
            F.col("e.content"), lambda c: F.when(F.ltrim(c).startswith("["), _flat_verse(c)).otherwise(c)
        )
        text = F.array_join(F.filter(lines, lambda x: x != ""), "。")
        parts.append(
            _items(
                rows.withColumn("_text", text).where(F.coalesce("_text", F.lit("")) != ""),
                "reciter",
                ["_i"],
                subject=F.lit(CHINESE),
                stage=F.lit(HIGH_SCHOOL),
                type=F.lit("open"),
                question=F.concat(F.coalesce("e.title", F.lit("None")), F.lit(RECITE_TITLE)),
                answer_text=F.col("_text"),
                note=F.concat(F.coalesce("e.tag", F.lit("")), F.lit(RECITE_NOTE)),
            )
        )
    if not parts:
        return _none(spark)
    items = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return with_row_id(items, "reciter", ["_i"])


def adapt_ceval(spark: SparkSession, src: str) -> DataFrame:
    """Knowledge tests of twelve subjects; dev and val rows train."""
    raw = _read(spark, [f"{src}/ceval/{s}/*.csv" for s in ("dev", "val")], _csv(spark))
    if raw is None:
        return _none(spark)
    suffix = F.when(F.col("_order") == 0, "_dev$").otherwise("_val$")
    stem = F.regexp_replace(_stem(raw), suffix, F.lit(""))
    subject = _pick(CEVAL_SUBJECTS, stem, F.lit(None).cast("string"))
    stage = (
        F.when(stem.startswith("middle_school"), MIDDLE_SCHOOL)
        .when(stem.startswith("high_school"), HIGH_SCHOOL)
        .otherwise(NO_STAGE)
    )
    choices = _choices("ABCD", lambda x: _text(_column(raw, x)))
    letter = _null_if_empty(_column(raw, "answer"))
    items = _items(
        raw.where(subject.isNotNull() & (_text(F.col("question")) != "")),
        "ceval",
        subject=subject,
        stage=stage,
        type=F.lit("choice"),
        question=_text(F.col("question")),
        choices=choices,
        answer_letter=letter,
        answer_text=_answer_of(choices, letter),
        explanation=_text(_column(raw, "explanation")),
        note=F.lit(CEVAL_NOTE),
    )
    return with_row_id(items, "ceval")


def adapt_ncr(spark: SparkSession, src: str) -> DataFrame:
    """Reading comprehension; the split is read off the file name, ids run over all files."""
    schema = (
        "Content string, Diff string, "
        "Questions array<struct<Question:string,Choices:array<string>,Answer:string,Q_id:string>>"
    )
    raw = _read(spark, [f"{src}/ncr/*.json"], _document(spark, schema))
    if raw is None:
        return _none(spark)
    name = F.lower(_stem(raw))
    split = (
        F.when(F.contains(name, F.lit("train")), "train")
        .when(name.rlike("dev|valid"), "dev")
        .when(F.contains(name, F.lit("test")), "test")
        .otherwise("train")
    )
    rows = raw.select(*PLACE, split.alias("_split"), "Content", "Diff", F.posexplode("Questions").alias("_i", "q"))
    listed = F.transform(
        F.filter(F.col("q.Choices"), lambda c: F.length(c) >= 2),
        lambda c: F.struct(
            F.substring(c, 1, 1).alias("key"), strip_space(F.substring(c, F.lit(3), F.length(c))).alias("value")
        ),
    )
    last = F.filter(
        listed, lambda p, i: ~F.exists(F.slice(listed, i + 2, F.size(listed)), lambda later: later["key"] == p["key"])
    )
    items = _items(
        rows,
        "ncr",
        ["_i"],
        subject=F.lit(CHINESE),
        stage=F.lit(MIDDLE_SCHOOL),
        type=F.lit("choice"),
        question=F.coalesce("q.Question", F.lit("")),
        material=F.coalesce("Content", F.lit("")),
        choices=F.map_from_entries(last),
        answer_letter=_null_if_empty(F.col("q.Answer")),
        difficulty=F.col("Diff"),
        split=F.col("_split"),
    )
    return with_row_id(items, "ncr", ["_i"])


def adapt_exams(spark: SparkSession, src: str) -> DataFrame:
    """Multilingual exams: passed through with defaults."""
    schema = (
        "subject string, question string, context string, choices map<string,string>, answer string, split string"
    )
    raw = _read(spark, [f"{src}/exams/exams_zh.jsonl"], _jsonl(spark, schema))
    if raw is None:
        return _none(spark)
    filled = F.when(F.size("choices") > 0, F.col("choices"))
    letter = F.when(F.try_element_at(filled, F.col("answer")).isNotNull(), F.col("answer"))
    items = _items(
        raw,
        "exams",
        subject=F.coalesce("subject", F.lit(NO_SUBJECT)),
        stage=F.lit(HIGH_SCHOOL),
        type=F.lit("choice"),
        question=F.coalesce("question", F.lit("")),
        material=F.coalesce("context", F.lit("")),
        choices=filled,
        answer_letter=letter,
        answer_text=_answer_of(filled, letter),
        split=F.coalesce("split", F.lit("train")),
    )
    return with_row_id(items, "exams")


ADAPTERS = {
    "m3ke": adapt_m3ke,
    "internlm-history": adapt_internlm_history,
    "gaokao-bench": adapt_gaokao,
    "agieval": adapt_agieval,
    "cmmlu": adapt_cmmlu,
    "reciter": adapt_reciter,
    "ceval": adapt_ceval,
    "ncr": adapt_ncr,
    "exams": adapt_exams,
}


def read_items(spark: SparkSession, src: str, sources: Sequence[str] = tuple(ADAPTERS)) -> dict[str, DataFrame]:
    return {name: ADAPTERS[name](spark, src) for name in sources}


def union_items(parts: Mapping[str, DataFrame], status: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(all items, status per source: rows, subjects, note). Sources without rows keep their note."""
    out = None
    for df in parts.values():
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    notes = dict(status or {})
    names = [(name, notes.get(name)) for name in dict.fromkeys([*parts, *notes])]
    frame = out.sparkSession.createDataFrame(names, "source string, note string")
    counted = out.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set("subject")).alias("subjects")
    )
    summary = frame.join(counted, "source", "left").select(
        "source",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        "subjects",
        F.when(F.col("rows").isNull(), F.col("note")).alias("note"),
    )
    return out, summary


# --- pairs with an outside score --------------------------------------------------------------


def adapt_scored_pairs(spark: SparkSession, raw: str, corpus: str) -> DataFrame:
    """Reference, answer and score in [0, 1] from one of the corpora ads, le, asag, sr."""
    base = f"{raw}/sas-datasets"
    if corpus == "ads":
        schema = "q_id string, reference1 string, answer string, score string"
        path = f"{base}/ADS/all.jsonl"
        rows = spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)
        number = F.concat(F.lit("ADS-"), F.coalesce("q_id", F.lit("x")))
        return scored_pairs(
            rows, F.col("reference1"), F.col("answer"), safe_num(F.col("score")) / 10.0, "sas-ads", number
        )
    if corpus == "le":
        rows = read_tsv(spark, f"{base}/LE/train.csv", 4)
        score = F.coalesce(safe_num(F.col("c3")), safe_num(F.col("c0")) / 100.0)
        number = F.concat(F.lit("LE-"), F.substring("c1", 1, 24))
        return scored_pairs(rows, F.col("c1"), F.col("c2"), score, "sas-le", number)
    if corpus == "asag":
        questions = read_tsv(spark, f"{base}/ASAG/qa_zh.csv", 3).select("c0", F.col("c2").alias("reference"))
        # of repeated question ids the last one counts; the file is one block's worth of questions
        questions = questions.withColumn("_r", F.monotonically_increasing_id()).groupBy("c0").agg(
            F.max_by("reference", "_r").alias("reference")
        )
        rows = read_tsv(spark, f"{base}/ASAG/train_zh.csv", 4).join(questions, "c0")
        number = F.concat(F.lit("ASAG-"), F.col("c0"))
        return scored_pairs(
            rows, F.col("reference"), F.col("c3"), safe_num(F.col("c1")) / 5.0, "sas-asag", number
        )
    if corpus == "sr":
        rows = read_tsv(spark, f"{base}/SR/sentences-goldstandard.csv", 8)
        number = F.concat(F.lit("SR-"), F.substring("c0", 1, 16))
        return scored_pairs(rows, F.col("c7"), F.col("c1"), safe_num(F.col("c3")), "sas-sr", number)
    raise ValueError(f"unknown corpus {corpus}")


def adapt_sts(spark: SparkSession, raw: str, limit: int = 4000, seed: int = 42) -> DataFrame:
    """Sentence similarity corpus: score / 5, ``limit`` rows in seeded order."""
    rows = read_tsv(spark, f"{raw}/sas-datasets/stsbenchmark/train_zh.csv", 7)
    number = F.concat(F.lit("STSB-"), F.col("c3"))
    pairs = scored_pairs(rows, F.col("c5"), F.col("c6"), safe_num(F.col("c4")) / 5.0, "stsb-zh", number)
    return seeded_cap(pairs, ["question_id", "sentence1", "sentence2"], limit, seed)
