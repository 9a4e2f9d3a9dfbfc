"""Group metrics over score records: one aggregate, no per-metric pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import stats

# The figures a transcript accounts for, per attempt.
USAGE_FIELDS = ("api_s", "tool_s", "turns", "tool_calls", "out_tok", "think_tok", "in_tok",
                "cost_usd", "retries", "retry_wait_s", "limited", "sandbox_fails")

# The columns of the flat results file, in order.
RESULT_COLUMNS = (
    "cell_id", "model", "task", "variant", "factors", "impl", "repeat",
    "first_pass_correct", "correctness_tier", "deploy_ok", "e2e_pass", "e2e_total", "e2e_green",
    "load_errors", "load_total", "k6_available", "verify_stage_failed",
    "iterations_to_green", "green", "revoked", "budget_exhausted",
    "agent_s_total", "agent_s_per_attempt", *[f"{f}_total" for f in USAGE_FIELDS], "api_ms_per_out_tok",
    "files", "language_count", "lines", "sloc", "total_lines", "grader", "grading_missing")


def pass_rate(passed: Column, total: Column) -> Column:
    """passed / total, null without a positive total."""
    return F.when(total > 0, passed / total)


def load_error_rate() -> Column:
    """Errors over requests of the cells whose functional test passed."""
    ran = F.col("e2e_green") & F.col("load_total").isNotNull()
    total = F.sum(F.when(ran, F.col("load_total")))
    errors = F.sum(F.when(ran, F.coalesce(F.col("load_errors"), F.lit(0))))
    return F.round(F.try_divide(errors.cast("double"), total.cast("double")), 4)


def metric_columns() -> list[Column]:
    """Every metric of a group of score records. The metrics' names."""
    green = F.col("green")
    won = lambda c: F.when(green, F.col(c))
    low = lambda x: F.min(x.cast("double"))
    high = lambda x: F.max(x.cast("double"))
    named = {
        "n_cells": F.count(F.lit(1)),
        "n_green": F.count_if(green),
        "first_pass_correct_rate": stats.rate4(F.col("first_pass_correct")),
        "e2e_green_rate": stats.rate4(F.col("e2e_green")),
        "green_rate": stats.rate4(green),
        "revoked_rate": stats.rate4(F.coalesce(F.col("revoked"), F.lit(False))),
        "mean_e2e_pass_rate": stats.mean4(pass_rate(F.col("e2e_pass"), F.col("e2e_total"))),
        "load_error_rate_on_green": load_error_rate(),
        "min_iterations_to_green": low(F.col("iterations_to_green")),
        "mean_iterations_to_green": stats.mean4(F.col("iterations_to_green")),
        "max_iterations_to_green": high(F.col("iterations_to_green")),
        "budget_censored_rate": stats.rate4(F.coalesce(F.col("budget_exhausted"), F.lit(False))),
        "min_agent_s_to_green": low(won("agent_s_total")),
        "mean_agent_s_to_green": stats.mean4(won("agent_s_total")),
        "max_agent_s_to_green": high(won("agent_s_total")),
        "mean_agent_s_per_attempt": stats.mean4(F.col("agent_s_per_attempt")),
        **{f"mean_{f}_to_green": stats.mean4(won(f"{f}_total")) for f in USAGE_FIELDS},
        "mean_api_ms_per_out_tok": stats.mean4(won("api_ms_per_out_tok")),
        "n_green_usage": F.count_if(green & F.col("api_s_total").isNotNull()),
        "n_green_surface": F.count_if(green & F.col("lines").isNotNull()),
        "mean_files": stats.mean4(won("files")),
        "mean_languages": stats.mean4(won("language_count")),
        "min_lines": low(won("lines")), "mean_lines": stats.mean4(won("lines")), "max_lines": high(won("lines")),
        "min_sloc": low(won("sloc")), "mean_sloc": stats.mean4(won("sloc")), "max_sloc": high(won("sloc")),
        "mean_lines_all_cells": stats.mean4(F.col("lines")),
    }
    return [c.alias(n) for n, c in named.items()]


def group_metrics(scores: DataFrame, by: Sequence[str] = ("model", "variant")) -> DataFrame:
    return scores.groupBy(*by).agg(*metric_columns())


def board_order() -> list[Column]:
    """Best green rate first, then fewest attempts with none last."""
    return [F.coalesce(F.col("green_rate"), F.lit(0.0)).desc(),
            F.col("mean_iterations_to_green").asc_nulls_last(), F.col("variant").asc()]


def ranked(metrics: DataFrame) -> DataFrame:
    """Group metrics with their 1-based ``place`` under each model."""
    return metrics.withColumn("place", F.row_number().over(Window.partitionBy("model").orderBy(*board_order())))
