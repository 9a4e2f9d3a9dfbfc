"""The scoreboard: cuts, groups, ranking, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import names, stats
from runlens.operators.metrics import RESULT_COLUMNS, group_metrics, ranked


def flat_rows(scores: DataFrame) -> DataFrame:
    """Score records as the flat results table."""
    return scores.withColumn("factors", names.factors_text(F.col("factors"))).select(*RESULT_COLUMNS)


def without_tainted(scores: DataFrame, validations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): a cell whose validation is TAINTED is left out and
    named with its first reason; a cell never validated stays. ``validations``
    has cell_id, verdict and first_taint."""
    v = validations.select("cell_id", "verdict", "first_taint")
    joined = scores.join(v, "cell_id", "left")
    bad = F.coalesce(F.col("verdict") == "TAINTED", F.lit(False))
    kept = joined.where(~bad).drop("verdict", "first_taint")
    excluded = joined.where(bad).select(
        "cell_id", F.coalesce("first_taint", F.lit("(no reason recorded)")).alias("reason"))
    return kept, excluded


def cuts(variant: str | None = None, impl: str | None = None,
         where: dict[str, str] | None = None) -> list[tuple[str, str, Column]]:
    """The cuts asked for, in order: label, wanted value, predicate."""
    asked = [("variant", variant, F.col("variant") == variant), ("impl", impl, F.col("impl") == impl)]
    asked += [(f"factor {k}", v, F.col("factors")[k] == v) for k, v in sorted((where or {}).items())]
    return [(label, want, F.coalesce(keep, F.lit(False))) for label, want, keep in asked if want is not None]


def cut(scores: DataFrame, wanted: list[tuple[str, str, Column]]) -> DataFrame:
    for _, _, keep in wanted:
        scores = scores.where(keep)
    return scores


def announce(scores: DataFrame, wanted: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per cut: how many of the cells before it are left. All counts
    come from one pass."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (_, _, keep) in enumerate(wanted, 1):
        passed = passed & keep
        counts.append(F.count_if(passed).alias(f"n{i}"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(label).alias("cut"), F.lit(want).alias("wanted"),
                     F.col(f"n{i}").alias("kept"), F.col(f"n{i - 1}").alias("of"))
            for i, (label, want, _) in enumerate(wanted, 1)]
    return scores.agg(*counts).select(F.inline(F.array(*rows)))


def board(scores: DataFrame, pool: DataFrame | None = None) -> DataFrame:
    """Group metrics per (pooled model, variant) with their place."""
    if pool is not None:
        scores = names.pooled(scores, pool)
    return ranked(group_metrics(scores))


def by_factor(scores: DataFrame) -> DataFrame:
    """Group metrics per level of every factor."""
    return group_metrics(scores.select("*", F.explode("factors").alias("factor", "level")), ("factor", "level"))


def compare(now: DataFrame, base: DataFrame) -> DataFrame:
    """Each row of ``now`` against the same (model, variant) of ``base``:
    deltas and an exact test of the green counts. Without a baseline row every
    figure is null."""
    b = base.select("model", "variant", F.col("n_cells").alias("base_n"), F.col("n_green").alias("base_green"),
                    F.col("green_rate").alias("base_rate"),
                    F.col("mean_iterations_to_green").alias("base_itg"))
    j = now.join(b, ["model", "variant"], "left")
    j = (j.withColumn("_miss", F.col("n_cells") - F.col("n_green"))
         .withColumn("_bmiss", F.col("base_n") - F.col("base_green")))
    t = stats.fisher(j, ["model", "variant"], "n_green", "_miss", "base_green", "_bmiss")
    return t.select("model", "variant", "place", "n_cells", "n_green", "green_rate",
                    F.col("mean_iterations_to_green").alias("mean_itg"), "base_n", "base_rate", "base_itg",
                    stats.delta(F.col("green_rate"), F.col("base_rate")).alias("d_green"),
                    stats.delta(F.col("mean_iterations_to_green"), F.col("base_itg")).alias("d_itg"),
                    "fisher_p")


def discrepancy() -> Column:
    """How far a row moved from its baseline: the green rate's delta, else the
    attempts' delta."""
    return F.coalesce(F.abs(F.col("d_green")), F.abs(F.col("d_itg")))


def comparison_order(by_discrepancy: bool, by_significance: bool) -> list[Column]:
    """Sort keys of a comparison. Rows without a baseline come last; the
    board's own order breaks ties."""
    gap = F.coalesce(discrepancy(), F.lit(0.0)).desc()
    lacks, p = F.col("base_n").isNull(), F.col("fisher_p")
    sure = F.coalesce(p < 0.05, F.lit(False))
    if by_significance and by_discrepancy:
        first = [lacks.asc(), sure.desc(), gap]
    elif by_significance:
        first = [lacks.asc(), sure.desc(), p.asc_nulls_last()]
    elif by_discrepancy:
        first = [discrepancy().isNull().asc(), gap]
    else:
        first = []
    return [*first, F.col("model").asc(), F.col("place").asc()]


def wall_vs_work(scores: DataFrame) -> DataFrame:
    """Per model, how the wall clock to green ranks its green cells against
    three measures of work, and the largest number of pairs."""
    work = ("out_tok", "turns", "tool_calls")
    g = scores.where(F.col("green") & F.col("agent_s_total").isNotNull())
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_total").cast("double").alias("y"))
                                  for f in work])).alias("w")
    pairs = g.select("model", F.col("agent_s_total").cast("double").alias("x"), stacked).select("model", "x", "w.*")
    rho = stats.spearman(pairs, ["model", "field"], "x", "y")
    out = rho.groupBy("model").agg(
        F.max("pairs").alias("n"),
        *[F.max(F.when(F.col("field") == f, F.col("rho"))).alias(f"rho_wall_{f}") for f in work])
    everyone = g.select("model").distinct()
    return everyone.join(out, "model", "left").withColumn("n", F.coalesce("n", F.lit(0)))
