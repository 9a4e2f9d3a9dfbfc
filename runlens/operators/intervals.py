"""Interval joins with an equality key.

Both sides are cut into time buckets of a fixed width, so the join is an
ordinary equi join on (keys, bucket) that Spark can shuffle, and one hot group
spreads over its buckets. An interval is repeated once per bucket it touches;
a point has one bucket, so no pair comes out twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(at: Column, width: float) -> Column:
    return F.floor(at / F.lit(float(width))).cast("long")


def spread(intervals: DataFrame, lo: str, hi: str, width: float, name: str = "bucket") -> DataFrame:
    """One row per bucket an interval [lo, hi] touches."""
    return (intervals.where(F.col(lo) <= F.col(hi))
            .withColumn(name, F.explode(F.sequence(bucket(F.col(lo), width), bucket(F.col(hi), width)))))


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str],
                        at: str, lo: str, hi: str, width: float,
                        how: str = "inner") -> DataFrame:
    """Pairs of a point and an interval of the same keys with lo <= at <= hi.
    ``how`` is seen from the points: inner, left or left_semi."""
    p = points.withColumn("_bucket", bucket(F.col(at), width)).alias("p")
    i = spread(intervals, lo, hi, width, "_ibucket").alias("i")
    on = (F.col("p._bucket") == F.col("i._ibucket")) & F.col(f"p.{at}").between(F.col(f"i.{lo}"), F.col(f"i.{hi}"))
    for k in keys:
        on = on & (F.col(f"p.{k}") == F.col(f"i.{k}"))
    joined = p.join(i, on, how)
    cols = [F.col(f"p.{c}") for c in points.columns]
    if how != "left_semi":
        cols += [F.col(f"i.{c}") for c in intervals.columns if c not in keys]
    return joined.select(*cols)


def overlap_seconds(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Length of the overlap of two intervals, never negative."""
    return F.greatest(F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b), F.lit(0.0))


def sums_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], by: Sequence[str], at: str, lo: str, hi: str,
                      values: Sequence[str], width: float) -> DataFrame:
    """``by`` and the sum of each of ``values`` over the points of an interval's
    keys with lo <= at <= hi, for every interval (``by`` names it).

    Sums are running sums: an interval looks its two ends up in one ordered scan
    over points and ends, so no interval meets the points inside it, however long
    it is. Sums of numbers that a double does not hold exactly carry its rounding."""
    from runlens.operators import scan as S

    zero = [F.lit(0).cast(points.schema[v].dataType).alias(v) for v in values]
    each = points.groupBy(*keys, F.col(at).alias("_t")).agg(*[F.sum(v).cast(points.schema[v].dataType).alias(v) for v in values])
    name = F.struct(*[F.col(c) for c in by])
    none = F.lit(None).cast(intervals.select(name.alias("x")).schema["x"].dataType)
    end = lambda c, k: intervals.select(*keys, F.col(c).cast("double").alias("_t"), F.lit(k).alias("_k"), *zero, name.alias("_of"))
    both = (each.select(*keys, F.col("_t").cast("double").alias("_t"), F.lit(1).alias("_k"), *values, none.alias("_of"))
            .unionByName(end(lo, 0)).unionByName(end(hi, 2)))
    both = both.withColumn("chunk", bucket(F.col("_t"), width))
    sums = S.scan(both, list(keys), ["_t", "_k", "_of"], {f"_upto_{v}": S.total(F.col(v)) for v in values}).where("_of IS NOT NULL")
    sign = F.when(F.col("_k") == 2, 1).otherwise(-1)
    return sums.groupBy("_of").agg(*[F.sum(sign * F.col(f"_upto_{v}")).alias(v) for v in values]).select("_of.*", *values)
