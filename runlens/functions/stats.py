"""Statistics as column expressions and small DataFrame jobs."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators import ranks

# The series of the error of Stirling's formula.
STIRLING = (1 / 12, 1 / 360, 1 / 1260, 1 / 1680, 1 / 1188)
BLOCK = 4096


def mean4(x: Column) -> Column:
    return F.round(F.avg(x.cast("double")), 4)


def rate4(x: Column) -> Column:
    """Share of true among non-null booleans."""
    return F.round(F.avg(x.cast("int").cast("double")), 4)


def strict_sum(x: Column) -> Column:
    """The sum, null when any value is missing."""
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def delta(a: Column, b: Column) -> Column:
    return F.round(a - b, 4)


def significance_label(p: Column) -> Column:
    """The p-value as printed: two decimals, starred under .05 and .01."""
    return (F.when(p.isNull(), "-").when(p < 0.01, "p<.01**")
            .when(p < 0.05, F.concat(F.lit("p"), F.format_string("%.2f", p), F.lit("*")))
            .otherwise(F.concat(F.lit("p"), F.format_string("%.2f", p))))


def significance_grade(p: Column) -> Column:
    return (F.when(p.isNull(), "-").when(p < 0.01, "strong").when(p < 0.05, "significant").otherwise("not sig"))


def _smooth(x: Column) -> Column:
    """ln x! less (x ln x - x): Stirling's formula with its error term (Loader
    2000), exact factorials for small x."""
    small = F.ln(F.factorial(F.least(x, F.lit(15.0)).cast("int")).cast("double")) - x * F.ln(x) + x
    s0, s1, s2, s3, s4 = (F.lit(s) for s in STIRLING)
    sq = x * x
    error = (s0 - (s1 - (s2 - (s3 - s4 / sq) / sq) / sq) / sq) / x
    return F.when(x <= 0, F.lit(0.0)).when(x <= 15, small).otherwise(0.5 * F.ln(x * (2 * math.pi)) + error)


def _log_weight(k: Column) -> Column:
    """ln of the probability of the table whose first cell is ``k``, up to a
    constant of the margins: each cell's distance from its expected count,
    which keeps the precision that factorials of large counts would cancel."""
    r1, r2, c1, c2 = (F.col(c).cast("double") for c in ("_r1", "_r2", "_c1", "_c2"))
    n, k = r1 + r2, k.cast("double")
    cells = F.array(*[F.struct(x.alias("x"), (r * c / n).alias("e")) for x, r, c in (
        (k, r1, c1), (r1 - k, r1, c2), (c1 - k, r2, c1), (r2 - c1 + k, r2, c2))])
    part = F.transform(cells, lambda t: F.when(t["x"] <= 0, t["e"]).otherwise(
        t["x"] * F.log1p((t["x"] - t["e"]) / t["e"]) - (t["x"] - t["e"]) + _smooth(t["x"])))
    return -F.aggregate(part, F.lit(0.0), lambda acc, v: acc + v)


def _log_margins() -> Column:
    sizes = F.array(*[F.col(c).cast("double") for c in ("_r1", "_r2", "_c1", "_c2")])
    total = F.transform(F.array((F.col("_r1") + F.col("_r2")).cast("double")), _smooth)
    return F.aggregate(F.transform(sizes, _smooth), F.lit(0.0), lambda acc, v: acc + v) - total[0]


def fisher(df: DataFrame, keys: Sequence[str], a: str, b: str, c: str, d: str,
           name: str = "fisher_p") -> DataFrame:
    """Two-sided exact test of the table [[a, b], [c, d]] of each row: the sum
    of the tables no likelier than the one seen. Null on a zero margin.

    The sum runs over all tables in blocks. Their probabilities fall on either side
    of the mode, so the table of a block that is nearest to the mode bounds the
    block: where even that is zero as a double, the block adds nothing and its
    tables are not written out, which leaves about the root of the counts."""
    row1, row2 = F.col(a) + F.col(b), F.col(c) + F.col(d)
    col1, col2 = F.col(a) + F.col(c), F.col(b) + F.col(d)
    t = (df.select(*keys, row1.cast("long").alias("_r1"), row2.cast("long").alias("_r2"),
                   col1.cast("long").alias("_c1"), col2.cast("long").alias("_c2"), F.col(a).cast("long").alias("_a"))
         .where("_r1 > 0 AND _r2 > 0 AND _c1 > 0 AND _c2 > 0"))
    lo = F.greatest(F.lit(0), F.col("_c1") - F.col("_r2")).cast("long")
    hi = F.least(F.col("_r1"), F.col("_c1")).cast("long")
    mode = F.floor((F.col("_r1") + 1).cast("double") * (F.col("_c1") + 1) / (F.col("_r1") + F.col("_r2") + 2)).cast("long")
    blocks = (t.select("*", lo.alias("_lo"), hi.alias("_hi"), _log_margins().alias("_margins"))
              .withColumn("_seen", F.exp(F.col("_margins") + _log_weight(F.col("_a"))))
              .withColumn("_b", F.explode(F.sequence("_lo", "_hi", F.lit(BLOCK).cast("long"))))
              .withColumn("_e", F.least(F.col("_hi"), F.col("_b") + F.lit(BLOCK - 1))))
    # the mode is known to a rounding, so a block beside it is never left out
    nearest = F.greatest(F.col("_b"), F.least(F.col("_e"), mode))
    beside = (F.col("_b") - 2 <= mode) & (mode <= F.col("_e") + 2)
    tables = (blocks.where(beside | (F.exp(F.col("_margins") + _log_weight(nearest)) > 0))
              .withColumn("_k", F.explode(F.sequence("_b", "_e"))))
    p = F.exp(F.col("_margins") + _log_weight(F.col("_k")))
    total = (tables.select(*keys, "_seen", p.alias("_p"))
             .where(F.col("_p") <= F.col("_seen") * (1 + 1e-7))
             .groupBy(*keys).agg(F.least(F.lit(1.0), F.sum("_p")).alias(name)))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    return (df.alias("x").join(total.alias("y"), on, "left").select("x.*", F.col(f"y.{name}")))


def spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation of (x, y) per group with the number of pairs; null
    under three pairs or where one side does not vary."""
    keys = list(keys)
    whole = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counted = whole.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n"))
    rx = ranks.average_ranks(whole, keys, x).select(*keys, x, F.col("rank").alias("_rx"))
    ry = ranks.average_ranks(whole, keys, y).select(*keys, y, F.col("rank").alias("_ry"))
    size = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    j = counted.join(rx, [*keys, x]).join(ry, [*keys, y]).join(size, keys)
    mid = (F.col("_size") + 1) / F.lit(2.0)
    dx, dy, n = F.col("_rx") - mid, F.col("_ry") - mid, F.col("n")
    s = j.groupBy(*keys).agg(F.sum(n).alias("pairs"), F.sum(n * dx * dy).alias("sxy"),
                             F.sum(n * dx * dx).alias("sxx"), F.sum(n * dy * dy).alias("syy"))
    spread = F.sqrt(F.col("sxx")) * F.sqrt(F.col("syy"))
    rho = F.when((F.col("pairs") >= 3) & (spread > 0), F.round(F.try_divide(F.col("sxy"), spread), 3))
    return s.select(*keys, "pairs", rho.alias("rho"))
