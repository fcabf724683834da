"""Registered queries for scans and sinks: the given tables go out through a sink and come back through a scan."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from markbook.operators import evaluate, rubrics
from markbook.plans import views
from markbook.plans.registry import POINTS, QUESTION, RATING, RESULTS, Registry
from markbook.session import work_dir
from markbook.sources import io

registry = Registry()
add = registry.add


def _folder(spark, name: str) -> str:
    return os.path.join(work_dir(spark, "sources"), name)


@add(
    "read_labels",
    f"""select doc_id::varchar as sample_id, case when doc_id % 2 = 0 then 'full' else 'fragment' end as origin, {QUESTION} as question_id,
    text as student_answer, 2::bigint as n_points, doc_id % 3 = 0 as first_hit from documents""",
)
def read_labels(spark, folder):
    """Label records as JSON lines."""
    docs = views.documents(spark, folder)

    def point(no: int, hit):
        return F.struct(
            F.lit(no).alias("point_id"), hit.alias("hit"), F.when(hit, "exact").otherwise("miss").alias("hit_type"),
            F.lit("").alias("extracted_span"), F.lit(0.5).alias("confidence"),
        )

    records = docs.select(
        F.col("doc_id").cast("string").alias("sample_id"),
        F.when(F.col("doc_id") % 2 == 0, "full").otherwise("fragment").alias("origin"),
        F.struct(
            views.question_id(spark, folder).cast("string").alias("question_id"),
            F.col("text").alias("student_answer"),
            F.array(point(1, F.col("doc_id") % 3 == 0), point(2, F.lit(False))).alias("point_labels"),
        ).alias("labels"),
    )
    path = _folder(spark, "labels")
    records.write.json(path)
    read = io.read_labels(spark, path)
    points = F.col("labels.point_labels")
    return read.select(
        "sample_id",
        "origin",
        F.col("labels.question_id").cast("bigint").alias("question_id"),
        F.col("labels.student_answer").alias("student_answer"),
        F.size(points).cast("bigint").alias("n_points"),
        F.get(points, F.lit(0))["hit"].alias("first_hit"),
    )


@add(
    "write_splits",
    "select doc_id, text, case doc_id % 5 when 0 then 'test' when 1 then 'val' else 'train' end as split from documents",
)
def write_splits(spark, folder):
    """One folder per split; the split of a row is read from its folder."""
    n = F.col("doc_id") % 5
    rows = views.documents(spark, folder).select(
        "doc_id", "text", F.when(n == 0, "test").when(n == 1, "val").otherwise("train").alias("split")
    )
    path = _folder(spark, "splits")
    io.write_splits(rows, path)
    return spark.read.schema("doc_id bigint, text string, split string").json(path)


@add(
    "append_new",
    "select o_orderkey, case when o_orderkey % 2 = 0 then o_totalprice else -1.0 end as value from orders",
)
def append_new(spark, folder):
    """Half of the orders are written first, then all with another value: rows that are there stay as they are."""
    orders = views.table(spark, folder, "orders")
    path = _folder(spark, "store")
    io.append_new(orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_totalprice").alias("value")), path, "o_orderkey")
    late = orders.select("o_orderkey", F.lit(-1.0).alias("value"))
    io.append_new(late, path, "o_orderkey")
    io.append_new(late, path, "o_orderkey")
    return spark.read.schema(late.schema).parquet(path)


@add(
    "read_tsv",
    "select doc_id, case when doc_id % 50 < 2 then '' else coalesce(text, '') end as text, lang, source from documents",
)
def read_tsv(spark, folder):
    """Whole texts, with their line breaks, quotes and tabs, as tab-separated values; some are made empty and some null."""
    n = F.col("doc_id") % 50
    path = _folder(spark, "texts")
    rows = views.documents(spark, folder).select(
        F.col("doc_id").cast("string"), F.when(n == 0, "").when(n > 1, F.col("text")).alias("text"), "lang", "source"
    )
    rows.write.option("sep", "\t").option("quoteAll", True).option("escape", '"').csv(path)
    read = io.read_tsv(spark, path, 4)
    return read.select(F.col("c0").cast("bigint").alias("doc_id"), F.col("c1").alias("text"), F.col("c2").alias("lang"), F.col("c3").alias("source"))


@add(
    "read_csv_items",
    "select item_id, text, null::varchar as note from benchmark",
)
def read_csv_items(spark, folder):
    """Columns found by name, in another order and one of them absent."""
    items = views.table(spark, folder, "benchmark").select("text", F.col("item_id").cast("string"))
    path = _folder(spark, "items")
    items.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    read = io.read_csv_items(spark, path, ["item_id", "text", "note"])
    return read.select(F.col("item_id").cast("bigint").alias("item_id"), "text", "note")


@add(
    "export_results",
    f"""with {RESULTS} select answer_id, class_name, total_score, max_score, {RATING} as rating from results""",
)
def export_results(spark, folder):
    """Results as CSV with the fixed columns, read by name."""
    results = views.results(spark, folder).withColumn("student_id", F.lit(None).cast("string"))
    path = _folder(spark, "results")
    io.export_results(results, path)
    read = io.read_csv_items(spark, path, io.EXPORT_COLUMNS)
    return read.select(
        F.col("answer_id").cast("bigint").alias("answer_id"), "class_name", F.col("total_score").cast("double").alias("total_score"),
        F.col("max_score").cast("double").alias("max_score"), "rating",
    )


@add(
    "confirmed_only",
    f"with {POINTS} select question_id, count(*)::int as points from points where question_id % 3 = 0 group by 1",
)
def confirmed_only(spark, folder):
    """Every third rubric is confirmed, every other third not, and the rest does not say."""
    third = F.col("question_id") % 3
    meta = F.struct(
        F.lit("m").alias("parsed_by"), F.lit("t").alias("parsed_at"), F.when(third == 0, True).when(third == 1, False).alias("confirmed_by_teacher")
    )
    configs = views.configs(spark, folder).withColumn("meta", meta)
    return rubrics.confirmed_only(configs).select("question_id", F.size("points").alias("points"))


_PAIRED = f"""with {RESULTS}, x as (select answer_id, total_score as a, max_score * 0.6::double as b, question_id % 4 as g from results)"""


@add(
    "rmse",
    f"{_PAIRED} select g, round(sqrt(avg((a - b) * (a - b))), 6) as rmse from x group by 1",
)
def rmse(spark, folder):
    return evaluate.rmse(_pairs(spark, folder), "a", "b", ["g"]).withColumn("rmse", F.round("rmse", 6))


@add(
    "spearman",
    f"""{_PAIRED}, r as (select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra,
      rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from x)
    select round(corr(ra, rb), 6) as spearman from r""",
)
def spearman(spark, folder):
    return evaluate.spearman(_pairs(spark, folder), "a", "b").withColumn("spearman", F.round("spearman", 6))


@add(
    "weighted_kappa",
    f"""{_PAIRED}, k as (select least(floor(a / 20), 9)::bigint as i, least(floor(b / 20), 9)::bigint as j from x),
    o as (select i, j, count(*) as n from k group by 1, 2), m as (select i, count(*) as n from k group by 1), h as (select j, count(*) as n from k group by 1),
    e as (select sum((m.i - h.j) ** 2 * m.n * h.n) as e from m cross join h), d as (select sum((i - j) ** 2 * n) as d, sum(n) as n from o)
    select round(1 - d * n / nullif(e, 0), 6)::double as kappa from d cross join e""",
)
def weighted_kappa(spark, folder):
    grade = [F.least(F.floor(F.col(c) / 20), F.lit(9)).cast("bigint").alias(c) for c in ("a", "b")]
    out = evaluate.weighted_kappa(_pairs(spark, folder).select(*grade), "a", "b")
    return out.withColumn("kappa", F.round("kappa", 6))


def _pairs(spark, folder):
    """Scores next to six tenths of the greatest possible ones."""
    return views.results(spark, folder).select(
        "answer_id", F.col("total_score").alias("a"), (F.col("max_score") * 0.6).alias("b"), (F.col("question_id") % 4).alias("g")
    )
