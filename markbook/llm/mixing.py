"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markbook.llm.common import WORD, settled, text_of

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def _numbered(sources: DataFrame, key: str) -> DataFrame:
    """Add ``_place`` (from 0, by code point, null last): a sorted table, counted by partition, so no task sees all rows."""
    spots = settled(
        sources.orderBy(F.col(key).asc_nulls_last()).withColumn("_spot", F.monotonically_increasing_id()), "mix-sources"
    )
    part, inside = F.shiftright("_spot", 33), F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))
    counts = spots.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition of the sort
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (
        spots.withColumn("_part", part)
        .join(before, "_part")
        .withColumn("_place", F.col("_before") + inside)
        .drop("_part", "_spot", "_before")
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(_key, source_size, target) per source from rows (source, _key, source_size), by capped water-filling.

    Every source gets its weight's share of what is left; sources above ``max_epochs`` times their size are clamped there,
    their excess goes back, and the shares are taken again until none is above. A round is one aggregate over the sources;
    only two integers, the words and the weight left over, come back to the driver.
    """
    # long, not int: a weight is multiplied by all words left, and from 2^31 on an int product is an error
    cycle = F.array(*[F.lit(int(w)).cast("bigint") for w in weights])
    named = settled(
        _numbered(sizes, "source").withColumn("_w", F.get(cycle, (F.col("_place") % len(weights)).cast("int"))), "mix-weights"
    )
    total, weight = named.agg(
        F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0)).cast("bigint")
    ).head()
    cap = F.lit(max_epochs) * F.col("source_size")
    left, share = total, weight
    clamped = F.lit(False)
    while share:
        # integers compared exactly: left * w / share > cap
        clamped = F.col("_w") * F.lit(left).cast("decimal(38,0)") > cap.cast("decimal(25,0)") * F.lit(share)
        used, rest = named.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~clamped, F.col("_w"))), F.lit(0))
        ).head()
        if (total - used, rest) == (left, share):
            break
        left, share = total - used, rest
    even = (F.col("_w") * F.lit(left)).cast("double") / F.lit(max(share, 1)).cast("double")
    return named.select("_key", "source_size", F.when(clamped, cap.cast("double")).otherwise(even).alias("target"))


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))


def _decided(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int, digits: int) -> DataFrame:
    """Per document its source's plan (source_size, target, _whole) and whether it is taken once more (_more)."""
    sized = settled(
        docs.select(
            "doc_id",
            "source",
            _source_key().alias("_key"),
            F.size(F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))).cast("bigint").alias("size"),
            _order(seed).alias("_order"),
            F.substring(_order(seed), 1, digits).alias("_bucket"),
        ),
        "mix-sizes",
    )
    buckets = settled(sized.groupBy("_key", "source", "_bucket").agg(F.sum("size").alias("_words")), "mix-buckets")
    wanted = targets(buckets.groupBy("_key", "source").agg(F.sum("_words").alias("source_size")), weights, max_epochs)
    earlier = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    upto = F.col("_before") + F.col("_words")
    plan = (
        buckets.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .join(wanted, "_key")
        .withColumn("_whole", whole.cast("bigint"))
        .withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
        .withColumn("_side", F.when(upto <= F.col("_part"), 1).when(F.col("_before") > F.col("_part"), -1).otherwise(0))
        .select("_key", "_bucket", "_before", "source_size", "target", "_whole", "_part", "_side")
    )
    rows = sized.join(settled(plan, "mix-plan"), ["_key", "_bucket"])
    before = W.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    inside = rows.where("_side = 0").withColumn(
        "_sum", F.col("_before") + F.coalesce(F.sum("size").over(before), F.lit(0))
    )
    more = F.col("_sum") + F.col("size") / 2 <= F.col("_part")
    done = rows.where("_side <> 0").withColumn("_more", F.col("_side") == 1)
    return done.unionByName(inside.withColumn("_more", more).drop("_sum"))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    digits: int = 3,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken.

    size: words of the text. A source takes each document floor(target / source_size) times, and once more those that come
    first in a seeded order, up to the place nearest to the target: the words taken miss the target by half a document at
    most. The order is that of md5(seed:doc_id). Its first hex digits cut each source into 16 ** ``digits`` even buckets,
    however large it is; sums of whole buckets settle all but one bucket of a source, and only rows there are sorted.

    A null text has size 0; a null source is a source of its own, the last; rows that repeat an id are rows of their own
    (equal ones are exchangeable). A source without words has target 0. An empty table gives no rows.
    """
    repeats = F.col("_whole") + F.col("_more").cast("bigint")
    return _decided(docs, weights, max_epochs, seed, digits).select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken; columns unchanged.

    Those taken once more are a beginning of the seeded order of their source, so a source's plan is two values, and the texts
    meet a table with one row per source; they are not shuffled. Rows that repeat an id are taken equally often.
    """
    place = F.struct("_order", "doc_id")
    plans = settled(
        _decided(docs, weights, max_epochs, seed, 3)
        .groupBy("_key")
        .agg(F.max("_whole").alias("_whole"), F.max(F.when(F.col("_more"), place)).alias("_last")),
        "mix-plans",
    )
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"), _source_key().alias("_key"), F.struct(_order(seed).alias("_order"), "doc_id").alias("_place")
    )
    repeats = F.col("_whole") + F.coalesce(F.col("_place") <= F.col("_last"), F.lit(False)).cast("bigint")
    taken = rows.join(plans, "_key").withColumn("_n", repeats.cast("int")).where("_n > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy")).select("_row.*")


MIX_CTES = """
sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from {docs}),
sums as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, [5, 2, 1][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::bigint]::bigint as w from sums),
filled as (
  select *, sum(source_size) over () as total, sum(w) over () as weight,
         coalesce(sum(source_size) over before, 0) as size_before, coalesce(sum(w) over before, 0) as w_before
  from weighed
  window before as (order by source_size::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
marked as (
  select *, (total - 3 * size_before) * w > 3 * source_size * (weight - w_before) as clamped from filled),
level as (
  select coalesce(max(total), 0) - coalesce(sum(case when clamped then 3 * source_size end), 0) as rest,
         coalesce(sum(case when not clamped then w end), 0) as share
  from marked),
targets as (
  select source, source_size,
         case when clamped then (3 * source_size)::double
              else (w * rest)::double / greatest(share, 1)::double end as target
  from marked, level),
parts as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets),
ordered as (
  select s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size as part,
         coalesce(sum(s.size) over (partition by s.source order by md5('17:' || coalesce(s.doc_id::varchar, '')), s.doc_id, s.size
                                    rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join parts p on s.source is not distinct from p.source),
mix as (
  select doc_id, size::bigint as size, source_size, target,
         whole + (before + size / 2 <= part)::bigint as repeats from ordered)"""
MIX_SQL = "with " + MIX_CTES.format(docs="documents") + """
select doc_id, size, source_size, target, (size * repeats)::bigint as taken from mix"""
