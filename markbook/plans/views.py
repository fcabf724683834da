"""Views over the given tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from markbook.operators.rubrics import rubric_rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: a part of a table's files for work that is heavy per row
PART_BYTES = 2 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread rows by their key over all cores, and over more parts the larger the files are.

    For work that is heavy per row or makes many rows of one: a file may be one task, and a fixed number of parts would grow with
    the table. Data in many small files passes unchanged.
    """
    parts = _parts(df, PART_BYTES)
    return df.repartition(parts, key) if len(df.inputFiles()) < parts else df


def _parts(df: DataFrame, part_bytes: int) -> int:
    """How many parts of so many bytes a scan's files give, by the planner's statistics; no fewer than there are cores."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes))


def dealt(df: DataFrame, key: str, part_bytes: int) -> DataFrame:
    """Rows of a scan by ``key``, in as many parts as the size of its files asks for, and no fewer than there are cores.

    For rows that grow on their way through a task: parts that are cut to size after the shuffle would be too large for it. What
    is grouped by the key later on, alone or with others, needs no further shuffle.
    """
    return df.repartition(_parts(df, part_bytes), key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def question_id(spark: SparkSession, folder: str, doc_id: str = "doc_id") -> Column:
    """Documents answer the items of ``benchmark`` in turn, all of them."""
    items = table(spark, folder, "benchmark").agg(F.count(F.lit(1)))
    return F.col(doc_id) % items.scalar()


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as answers to the items of ``benchmark``."""
    return documents(spark, folder).select(
        F.col("doc_id").alias("answer_id"),
        question_id(spark, folder).alias("question_id"),
        F.col("lang").alias("subject"),
        F.col("source").alias("class_name"),
        F.col("text").alias("answer_text"),
    )


def stems(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("stem_id"), F.col("text").alias("stem_text"))


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Rubric points made of all words of the benchmark items, four to a question: a word and others as its aliases."""
    words = F.split(F.lower("text"), " ")

    def edge(p: Column) -> Column:
        return F.floor(p * F.size(words) / 4).cast("int")

    entries = F.transform(
        F.sequence(F.lit(1), F.lit(4)),
        lambda p: F.struct(
            p.cast("bigint").alias("point_id"),
            F.get(words, edge(p - 1)).alias("point_text"),
            F.slice(words, edge(p - 1) + 2, F.greatest(edge(p) - edge(p - 1) - 1, F.lit(0))).alias("aliases"),
            p.cast("double").alias("weight"),
        ),
    )
    items = table(spark, folder, "benchmark")
    return items.select(F.col("item_id").alias("question_id"), F.inline(entries))


def configs(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None)
    return rubric_rows(points(spark, folder)).select(
        "question_id",
        "total_score",
        none.cast("string").alias("subject"),
        "points",
        none.cast("struct<similarity_high:double,similarity_low:double>").alias("thresholds"),
        none.cast("struct<parsed_by:string,parsed_at:string,confirmed_by_teacher:boolean>").alias("meta"),
    )


#: a part of lineitem files that makes some hundred thousand lines
LINE_BYTES = 4 << 20


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem grouped to one row per (order, line number), all lines of an order in one part."""
    return (
        dealt(table(spark, folder, "lineitem"), "l_orderkey", LINE_BYTES)
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.sum("l_quantity").alias("qty"),
            F.max("l_partkey").alias("pk"),
            F.max("l_suppkey").alias("sk"),
            F.min("l_returnflag").alias("rf"),
            F.min("l_linestatus").alias("ls"),
        )
    )


def votes(spark: SparkSession, folder: str, rounds: int = 3) -> DataFrame:
    """Three rounds of point labels per line."""
    r = F.col("round")
    h = (F.col("pk") + r * F.col("sk")) % 3
    kinds = F.array(F.lit("miss"), F.lit("exact"), F.lit("semantic"))
    return (
        lines(spark, folder)
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
        .select(
            F.col("l_orderkey").alias("sample_id"),
            F.col("l_linenumber").alias("point_id"),
            "round",
            (h > 0).alias("hit"),
            F.get(kinds, h.cast("int")).alias("hit_type"),
            F.concat(F.lit("r"), r.cast("string"), F.lit("q"), F.col("qty").cast("int").cast("string")).alias(
                "extracted_span"
            ),
            ((F.col("qty") + 7 * r) % 50 / 50).alias("confidence"),
            F.when(h == 2, F.lit(0.5)).alias("partial_credit"),
            F.col("qty").cast("int").alias("span_length"),
            F.lit(60).alias("answer_length"),
        )
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """The first round, with the order's priority as origin."""
    origin = table(spark, folder, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderpriority").alias("origin"))
    return votes(spark, folder, 1).drop("round").join(origin, "sample_id")


def details(spark: SparkSession, folder: str) -> DataFrame:
    """Scored points of orders."""
    status = (
        F.when(F.col("rf") == "R", "hit_exact")
        .when(F.col("rf") == "A", "hit_semantic")
        .when(F.col("ls") == "O", "miss")
        .otherwise("partial")
    )
    share = F.when(status == "miss", 0.0).when(status == "partial", 0.25).otherwise(1.0)
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        (F.col("o_custkey") % 50).alias("question_id"),
        F.col("o_orderpriority").alias("class_name"),
    )
    return (
        lines(spark, folder)
        .join(orders, "l_orderkey")
        .select(
            F.col("l_orderkey").alias("answer_id"),
            "question_id",
            "class_name",
            F.col("l_linenumber").cast("bigint").alias("point_id"),
            F.col("qty").alias("weight"),
            status.alias("hit_status"),
            (F.col("qty") * share).alias("point_score"),
        )
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    """One result per order, totals from its points."""
    from markbook.functions.scores import rating

    return (
        details(spark, folder)
        .groupBy("answer_id", "question_id", "class_name")
        .agg(F.sum("point_score").alias("total_score"), F.sum("weight").alias("max_score"))
        .withColumn("rating", rating(F.col("total_score"), F.col("max_score")))
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a gold flag and a whole-number score difference."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        (F.col("l_linestatus") == "O").alias("gold"),
        (F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)).cast("int").alias("score_diff"),
    )


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score that has many ties."""
    labelled = table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("gold"))
    scores = table(spark, folder, "documents").select("doc_id", (F.col("n_chars") % 97 / 97.0).alias("score"))
    return labelled.join(scores, "doc_id")


def step_items(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as source items: their turns are the steps. A conversation is a short list."""
    step = F.struct("turn", F.col("text").alias("response"), (F.length("text") % 3).cast("string").alias("label"))
    return (
        table(spark, folder, "conversations")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(step)).alias("steps"))
    )


def step_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as fragments."""
    return table(spark, folder, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("#s"), F.col("turn").cast("string")).alias("sample_id"),
        F.col("conv_id").alias("question_id"),
        F.lit("fragment").alias("origin"),
        (F.length("text") % 3).cast("double").alias("expert_step_label"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as choice items."""
    key = F.col("p_partkey")
    letters = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return table(spark, folder, "part").select(
        F.lit("part").alias("source"),
        F.col("p_type").alias("subject"),
        key.cast("string").alias("qid"),
        F.lit("choice").alias("type"),
        F.col("p_name").alias("question"),
        F.col("p_type").alias("material"),
        F.create_map(
            F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"), F.lit("C"), F.col("p_size").cast("string")
        ).alias("choices"),
        F.get(letters, (key % 3).cast("int")).alias("answer_letter"),
        F.lit("").alias("answer_text"),
        F.when(key % 10 == 8, "dev").when(key % 10 == 9, "test").otherwise("train").alias("split"),
    )


def logits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.col("embedding").alias("start_logits"),
        F.reverse("embedding").alias("end_logits"),
        F.lit(1).alias("ctx_low"),
        (F.size("embedding") - 1).alias("ctx_high"),
    )


def ocr_lines(spark: SparkSession, folder: str) -> DataFrame:
    y, x = F.col("l_quantity"), F.col("l_extendedprice")
    corner = F.array(x, y)
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        F.col("l_linenumber").cast("string").alias("text"),
        F.array(corner, corner, corner, corner).alias("box"),
        (1 - 2 * F.col("l_tax")).alias("score"),
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.concat(
            F.lit('\x1b[32mINFO\x1b[0m phase="'), "event_type", F.lit('" ms='), F.col("value").cast("string"), F.lit(" done")
        ).alias("value")
    )


def raw_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as fenced model output, every tenth one cut off."""
    body = F.when(F.col("event_id") % 10 == 0, F.substring("props", F.lit(1), F.length("props") - 1)).otherwise(
        F.col("props")
    )
    return table(spark, folder, "events").select(
        "event_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("raw_text")
    )


def vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(one point vector per label, the other vectors as answers)."""
    every = table(spark, folder, "embeddings")
    chosen = every.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v"))
    point = chosen.select(F.col("label").alias("point_label"), F.col("v.vec_id").alias("point_vec"), F.col("v.embedding").alias("point_embedding"))
    rest = every.join(point.select(F.col("point_vec").alias("vec_id")), "vec_id", "left_anti")
    return point, rest


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def submissions(events: DataFrame) -> DataFrame:
    """Events as scored answers, one answer per user, rescored over time."""
    from markbook.functions.scores import rating

    return events.select(
        F.col("user_id").alias("answer_id"),
        (F.col("user_id") % 20).alias("question_id"),
        F.lit(None).cast("string").alias("class_name"),
        F.col("value").alias("total_score"),
        F.lit(50.0).alias("max_score"),
        "ts",
        "event_id",
    ).withColumn("rating", rating(F.col("total_score"), F.col("max_score")))
