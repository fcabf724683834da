"""Exact ranks, running totals and order statistics that do not need one big sorted partition.

Two building blocks carry all of them:

* an order given by a hash is uniform, so a hash prefix cuts any group, however hot, into even
  buckets; a rank is the count of earlier buckets plus the place inside the bucket;
* an order given by values is first reduced to distinct values (partial aggregation makes hot values
  cheap), then cut into value ranges, and running totals are base of the range plus place inside it.

Only the per-bucket counts, whose number is fixed, meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MIN_RANGES = 64
#: values drawn for each cut between two ranges
DRAWN = 8
#: a search halves the cuts so often: enough for a million ranges
HALVINGS = 20


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_digits(df: DataFrame) -> int:
    """Hex digits of the hash prefix: 256 buckets for a small job, 65,536 for thousands of partitions."""
    partitions = _partitions(df)
    return 2 if partitions <= 64 else 3 if partitions <= 1024 else 4


def value_ranges(df: DataFrame) -> int:
    return max(MIN_RANGES, 2 * _partitions(df))


def seeded(seed: int | str, *keys: Column) -> Column:
    """Repeatable pseudo-random order: md5 over seed and keys."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def hash_int(hexed: Column) -> Column:
    """First eight hex digits of a hash as a number."""
    return F.conv(F.substring(hexed, 1, 8), 16, 10).cast("bigint")


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    seed: int | str,
    group: Sequence[str] = (),
    rank: str = "rank",
    total: str = "total",
    upto: int | None = None,
) -> DataFrame:
    """Add ``rank`` (1..n in seeded order, ties by key) and ``total`` (n) within ``group``.

    With ``upto`` only ranks up to about that number are wanted: buckets that begin later are left out
    before anything is sorted.
    """
    # one struct as key: rows whose group is null form a group of their own and are not lost in the join
    hashed = df.withColumns(
        {"_g": _key(group), "_h": seeded(seed, *[F.col(k) for k in keys])}
    ).withColumn("_p", F.substring("_h", 1, hash_digits(df)))
    counts = hashed.groupBy("_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_g").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(
        "_g",
        "_p",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_n").over(W.partitionBy("_g")).alias(total),
    )
    if upto is not None:
        bases = bases.where(F.col("_base") < upto)
    inside = W.partitionBy("_g", "_p").orderBy("_h", *keys)
    return (
        hashed.join(bases, ["_g", "_p"])
        .withColumn("_i", F.row_number().over(inside))
        .withColumn(rank, F.col("_base") + F.col("_i"))
        .drop("_g", "_h", "_p", "_i", "_base")
    )


def _key(group: Sequence[str]) -> Column:
    return F.struct(*group) if group else F.struct(F.lit(0).alias("all"))


def split_points(df: DataFrame, column: str, ranges: int | None = None) -> Column:
    """At most ``ranges`` - 1 cut values of a column of different numbers, in order. They affect balance, not results.

    A subquery of the plan that uses it, so nothing runs before that. The values with the smallest hashes are a sample that is
    the same in every run; every DRAWN-th of them is a cut. Only these few leave a task.
    """
    ranges = ranges or value_ranges(df)
    value = F.col(column).cast("double")
    drawn = df.where(value.isNotNull()).select(value.alias("v")).orderBy(F.xxhash64("v"), "v").limit(DRAWN * ranges)
    every = F.filter(F.sort_array(F.collect_list("v")), lambda _, i: i % DRAWN == DRAWN - 1)
    return drawn.agg(every.alias("cuts")).scalar()


def range_of(value: Column, cuts: Column | Sequence[float]) -> Column:
    """How many of the sorted cuts lie below the value, by halving."""
    if not isinstance(cuts, Column):
        cuts = F.array(*[F.lit(float(v)) for v in cuts]) if cuts else F.array().cast("array<double>")

    def narrower(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(s["cuts"], middle) < s["value"], F.lit(False)) & (s["lo"] < s["hi"])
        lo, hi = F.when(below, middle + 1).otherwise(s["lo"]), F.when(below, s["hi"]).otherwise(F.least(middle, s["hi"]))
        return F.struct(lo.alias("lo"), hi.alias("hi"), s["value"].alias("value"), s["cuts"].alias("cuts"))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"), value.cast("double").alias("value"), cuts.alias("cuts"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, narrower, lambda s: s["lo"])


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``<name>_upto`` (sum over this and earlier ``order`` values) and ``<name>_all`` per group.

    ``df`` holds one row per (group, order) pair.
    """
    cuts = split_points(df.select(order).distinct() if group else df, order) if cuts is None else sorted(cuts)
    # a subquery may not stand inside a function over arrays
    with_cuts = df.withColumn("_cuts", cuts) if isinstance(cuts, Column) else df
    placed = range_of(F.col(order), F.col("_cuts") if isinstance(cuts, Column) else cuts)
    ranged = with_cuts.withColumns({"_g": _key(group), "_r": placed}).select(*df.columns, "_g", "_r")
    parts = ranged.groupBy("_g", "_r").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    earlier = W.partitionBy("_g").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select(
        "_g",
        "_r",
        *[F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)).alias(f"_{s}_base") for s in sums],
        *[F.sum(f"_{s}").over(W.partitionBy("_g")).alias(f"{s}_all") for s in sums],
    )
    inside = W.partitionBy("_g", "_r").orderBy(order)
    out = ranged.select(
        "*", *[F.sum(s).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"_{s}_in") for s in sums]
    ).join(bases, ["_g", "_r"])
    for s in sums:
        out = out.withColumn(f"{s}_upto", F.col(f"_{s}_base") + F.col(f"_{s}_in"))
    return out.drop("_g", "_r", *[f"_{s}_base" for s in sums], *[f"_{s}_in" for s in sums])


def value_rank(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    seed: int | str,
    rank: str = "rank",
    total: str = "total",
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Rank over all rows by ``value`` ascending, rows of one value in seeded order of ``keys``."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    bases = running_totals(counts, value, ["_c"], cuts=cuts).select(
        F.struct(value).alias("_v"), (F.col("_c_upto") - F.col("_c")).alias("_before"), F.col("_c_all").alias(total)
    )
    ranked = hash_rank(df, keys, seed, [value], rank="_within", total="_same").withColumn("_v", F.struct(value))
    return (
        ranked.join(bases, "_v")
        .withColumn(rank, F.col("_before") + F.col("_within"))
        .drop("_v", "_before", "_within", "_same")
    )


def order_statistics(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """(q, value): the value at 0-based place min(n-1, floor(q*n)) of the sorted column."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    runs = running_totals(counts, value, ["_c"], cuts=cuts)
    # each distinct value covers the places [upto - c, upto)
    first, after = F.col("_c_upto") - F.col("_c"), F.col("_c_upto")

    def covered(q: Column) -> Column:
        place = F.least(F.col("_c_all") - 1, F.floor(q * F.col("_c_all")))
        return (place >= first) & (place < after)

    wanted = F.array(*[F.lit(float(q)) for q in quantiles])
    return runs.select(F.explode(F.filter(wanted, covered)).alias("q"), F.col(value).alias("value"))
