"""Calibration: one reference per variant and arrangement from measured runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESTIMATED_SPREAD_S = 1.0
GROUP = ("variant", "arrangement")


def aggregate(runs: DataFrame, estimated_spread: float = ESTIMATED_SPREAD_S) -> DataFrame:
    """``runs`` has variant, arrangement, run, name and value. Keeps the names
    every run measured: their mean and sample deviation, or the estimated
    spread for a single run."""
    count = runs.select(*GROUP, "run").distinct().groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    named = runs.groupBy(*GROUP, "name").agg(
        F.count(F.lit(1)).alias("_has"), F.avg("value").alias("value"), F.stddev_samp("value").alias("_sd"))
    measured = F.col("n") >= 2
    return (named.join(count, list(GROUP)).where(F.col("_has") == F.col("n"))
            .select(*GROUP, "name", "value",
                    F.when(measured, F.col("_sd")).otherwise(F.lit(float(estimated_spread))).alias("spread"),
                    F.when(measured, "measured").otherwise("estimated").alias("kind"), "n"))
