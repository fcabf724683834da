"""Score expressions: numbers, ratings, buckets, vectors and guarded statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markbook.functions import fixed


def safe_num(col: Column) -> Column:
    """Number, or null when it does not parse."""
    return col.cast("string").try_cast("double")


def clamp(col: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def half_even(col: Column, digits: int) -> Column:
    return F.bround(col, digits)


def ratio(score: Column, maximum: Column) -> Column:
    """score / maximum, 0 when the maximum is not positive."""
    return F.when(maximum > 0, F.try_divide(score, maximum)).otherwise(F.lit(0.0))


def rating(score: Column, maximum: Column) -> Column:
    """excellent from .9, good from .75, pass from .6, else fail; no maximum is fail."""
    share = F.try_divide(score, maximum)
    return (
        F.when(maximum <= 0, "fail")
        .when(share >= 0.9, "excellent")
        .when(share >= 0.75, "good")
        .when(share >= 0.6, "pass")
        .otherwise("fail")
    )


def ratio_bucket(share: Column) -> Column:
    """Bucket 0..4 of 20 % each; the top one includes full marks."""
    percent = F.least(F.greatest(F.floor(share * 100.0), F.lit(0)), F.lit(99))
    return F.floor(percent / 20).cast("int")


def bucket_label(bucket: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in fixed.BUCKET_LABELS]), bucket)


def is_hit(hit_status: Column) -> Column:
    """Anything but a miss counts as hit."""
    return F.coalesce(hit_status != "miss", F.lit(True))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision with a small term against zero vectors, 6 digits."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.round(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9)), 6)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; 0 for fewer than two rows or zero variance."""
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(xs) * F.stddev_pop(ys)
    usable = (F.count(F.when(both, 1)) >= 2) & (spread > 0)
    return F.when(usable, F.try_divide(F.covar_pop(xs, ys), spread)).otherwise(F.lit(0.0))
