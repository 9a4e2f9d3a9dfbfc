"""Exact ranks and order statistics over groups of any size.

Values are counted first, so equal values travel once. A monotone code cuts a
group's values into value buckets; a running count over the buckets (few rows)
gives each bucket its offset, and the window that ranks works inside one
bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import cut_lineage

STEPS_PER_OCTAVE = 256


def value_code(x: Column, steps: int = STEPS_PER_OCTAVE) -> Column:
    """A whole number that never decreases as ``x`` grows: the scaled
    logarithm of its size, with its sign."""
    size = F.floor(F.log2(F.lit(1.0) + F.abs(x.cast("double"))) * F.lit(steps)).cast("long")
    return F.when(x < 0, -size).otherwise(size)


def counted(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values of each group with their number ``n``."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def cumulative(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``counts`` (one row per group and value, with ``n``) plus ``upto``: how
    many rows of the group are no larger, and ``size``: rows of the group."""
    coded = counts.withColumn("_code", value_code(F.col(value)))
    per_code = coded.groupBy(*keys, "_code").agg(F.sum("n").alias("_n"))
    whole = Window.partitionBy(*keys)
    offsets = per_code.select(
        *keys, "_code",
        F.coalesce(F.sum("_n").over(whole.orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_base"),
        F.sum("_n").over(whole).alias("size"))
    inside = Window.partitionBy(*keys, "_code").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (coded.withColumn("_run", F.sum("n").over(inside))
            .join(offsets, [*keys, "_code"])
            .withColumn("upto", F.col("_base") + F.col("_run"))
            .drop("_code", "_run", "_base"))


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per group and distinct value: its 1-based rank, ties sharing
    their mean rank."""
    return (cumulative(counted(df, keys, value), keys, value)
            .select(*keys, value, "n",
                    (F.col("upto") - (F.col("n") - F.lit(1)) / F.lit(2.0)).alias("rank")))


def pick(df: DataFrame, keys: Sequence[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Per group, the value at each 1-based place of the sorted group. A place
    is an expression over ``size``, the number of values of the group."""
    c = cumulative(counted(df, keys, value), keys, value)
    at = {name: F.min(F.when(F.col("upto") >= place, F.col(value))) for name, place in places.items()}
    return c.groupBy(*keys).agg(F.max("size").alias("size"), *[e.alias(n) for n, e in at.items()])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place ceil(share x n)."""
    place = F.greatest(F.ceil(F.lit(float(share)) * F.col("size").cast("double")), F.lit(1))
    return pick(df, keys, value, {name: place})


def clamp_index(df: DataFrame, keys: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value at place floor(share x n) + 1, held inside the group."""
    place = F.least(F.col("size"), F.floor(F.lit(float(share)) * F.col("size").cast("double")) + 1)
    return pick(df, keys, value, {name: place})


def median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The middle value, the mean of the two middle ones for an even number."""
    size = F.col("size")
    picked = pick(df, keys, value, {"_lo": F.floor((size + 1) / 2), "_hi": F.floor(size / 2) + 1})
    return picked.select(*keys, "size", ((F.col("_lo") + F.col("_hi")) / 2.0).alias(name))


def positions(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with the place of each row in the order of the whole table, from 1.

    Rows are dealt out by ranges of the order and numbered in each; the rows of the
    ranges before are counted, one number for each range. No task sees the table.
    ``order`` must be unique. The ranges are written, since they come from a sample."""
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_nth", nth).join(starts, "_range").withColumn(name, F.col("_start") + F.col("_nth")).drop("_range", "_nth", "_start")
