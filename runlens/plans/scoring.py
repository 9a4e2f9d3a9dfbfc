"""Scores: one record per cell, and which cells need a new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators import ledger as L
from runlens.operators import usage
from runlens.operators.metrics import USAGE_FIELDS
from runlens.session import cut_lineage
from runlens.sources import sinks

# The metric fields read as numbers.
NUMERIC = ("load_total", "load_errors", "e2e_pass", "e2e_total", "ceiling_qps", "mount_delay_s")
FLAGS = ("deploy_ok", "e2e_green", "load_ran", "k6_available", "scaling_ok")


def read_metrics(docs: DataFrame, key: str = "cell", doc: str = "doc") -> DataFrame:
    """A metrics object per cell: six fields as numbers whatever their form,
    the flags, the failed stage, and everything else in ``rest``."""
    m = F.from_json(F.col(doc), "map<string,string>")
    number = lambda n: F.trim(m[n]).try_cast("double").alias(n)
    flag = lambda n: m[n].try_cast("boolean").alias(n)
    named = (*NUMERIC, *FLAGS, "stage_failed", "scaling_why", "variant")
    rest = F.map_filter(m, lambda k, v: ~k.isin(*named))
    return docs.select(key, *[number(n) for n in NUMERIC], *[flag(n) for n in FLAGS],
                       m["stage_failed"].alias("stage_failed"), m["scaling_why"].alias("scaling_why"), rest.alias("rest"))


def score(env: DataFrame, ledger: DataFrame, metrics: DataFrame, surface: DataFrame, accounts: DataFrame,
          variants: DataFrame | None = None, gate_n: int = 6) -> DataFrame:
    """One record per cell of ``env`` (cell, model, task, variant, impl,
    repeat). ``accounts`` comes from ``usage.by_attempt``. Every join is on
    the cell."""
    outcome = L.attempts_to_green(L.fold(ledger, gate_n))
    s = (env.join(outcome, "cell", "left").join(metrics.drop("rest", "scaling_why"), "cell", "left")
         .join(L.agent_time(ledger).select("cell", "agent_s_total", "agent_s_per_attempt"), "cell", "left")
         .join(usage.totals(accounts), "cell", "left").join(surface, "cell", "left"))
    if variants is not None:
        s = s.join(variants.select("variant", "factors"), "variant", "left")
    else:
        s = s.withColumn("factors", F.lit(None).cast("map<string,string>"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return s.select(
        F.col("cell").cast("string").alias("cell_id"), "model", "task", "variant",
        F.coalesce("factors", F.create_map().cast("map<string,string>")).alias("factors"),
        F.coalesce("impl", F.lit("bash")).alias("impl"), "repeat", F.lit(None).cast("boolean").alias("first_pass_correct"),
        F.lit(None).cast("string").alias("correctness_tier"), "deploy_ok", whole("e2e_pass"), whole("e2e_total"), "e2e_green",
        whole("load_errors"), whole("load_total"), "k6_available", F.col("stage_failed").alias("verify_stage_failed"),
        "iterations_to_green", yes("green"), yes("revoked"), yes("budget_exhausted"), "agent_s_total", "agent_s_per_attempt",
        *[f"{f}_total" for f in USAGE_FIELDS], "api_ms_per_out_tok", "files", "language_count", "lines", "sloc", "total_lines",
        F.lit(None).cast("string").alias("grader"), F.lit(None).cast("string").alias("grading_missing"))


def finished(status: DataFrame) -> DataFrame:
    """Cells that are done and not cancelled, with their outcome."""
    return status.where((F.col("state") == "DONE") & (F.col("why") != "cancelled"))


def stale(records: DataFrame) -> DataFrame:
    """Records older than one of their inputs, with the first newer one. Rows
    have cell, record, env, ledger, metrics times (null when absent)."""
    newer = F.coalesce(*[F.when(F.col(c) > F.col("record"), F.lit(c)) for c in ("env", "ledger", "metrics")])
    return records.select("cell", newer.alias("newer")).where("newer IS NOT NULL")


def key_of(rules: Column, sealed: Column, *inputs: Column) -> Column:
    """What a derived record depends on, as one comparable value."""
    return F.sha2(F.concat_ws("|", rules, *[F.coalesce(c.cast("string"), F.lit("-")) for c in (sealed, *inputs)]), 256)


def to_score(cells: DataFrame, stored: DataFrame) -> DataFrame:
    """Cells whose derived records must be computed: not sealed, never
    derived, or derived from other rules or inputs. ``cells`` has cell,
    sealed, key; ``stored`` cell, key of records that are complete."""
    done = stored.select("cell", "key")
    return cells.where(F.col("sealed").isNull()).unionByName(
        cells.where(F.col("sealed").isNotNull()).join(done, ["cell", "key"], "left_anti").select(*cells.columns))


def sweep(cells: DataFrame, stored: DataFrame, records: Callable[[DataFrame], DataFrame], path: str, batches: int = 64) -> tuple[DataFrame, DataFrame]:
    """A scoring sweep over finished ``cells`` (cell, sealed, key): what
    ``to_score`` names is scored by ``records``, which maps those cells to score
    records, and written over what the table at ``path`` holds of them. Cells that
    give no record, or one without model or task, stop nothing: they go to the
    errors beside the table and keep the record they had. Returns the whole table
    and this sweep's errors (cell, error)."""
    spark = cells.sparkSession
    todo = cut_lineage(to_score(cells, stored).select("cell").distinct())
    made = cut_lineage(records(todo))
    whole = F.col("model").isNotNull() & F.col("task").isNotNull()
    marks = made.select(F.col("cell_id").alias("_id"), whole.alias("_whole"))
    found = todo.join(marks, F.col("cell").cast("string") == F.col("_id"), "left")
    errors = found.where(~F.coalesce("_whole", F.lit(False))).select(
        F.col("cell").cast("string").alias("cell"), F.when(F.col("_id").isNull(), "no record").otherwise("no model or task").alias("error"))
    errors.write.mode("overwrite").parquet(f"{path}-errors")
    sinks.write_scores(made.where(whole), path, batches)
    return (spark.read.schema(made.schema).parquet(path), spark.read.schema("cell string, error string").parquet(f"{path}-errors"))


def changed_inputs(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Inputs to read again: (cell, source) whose time moved or that no cache
    of this rules version holds."""
    same = cached.select("cell", "source", "mtime", "version")
    on = [now[c].eqNullSafe(same[c]) for c in ("cell", "source", "mtime", "version")]
    return now.join(same, on, "left_anti")


def smoke_verdict() -> Column:
    """(green, text) of a cell checked on its own: the ledger decides, the
    metrics only say where it broke. Columns of ``fold`` and
    ``read_metrics``, and has_metrics."""
    e2e = F.concat(F.coalesce(F.col("e2e_pass").cast("long").cast("string"), F.lit("None")), F.lit("/"),
                   F.coalesce(F.col("e2e_total").cast("long").cast("string"), F.lit("None")))
    green = F.when(F.col("verdict").isNotNull(), F.col("verdict") == "green").otherwise(
        F.coalesce(F.col("e2e_green"), F.lit(False)) & F.coalesce(F.col("scaling_ok"), F.lit(True)))
    good = (F.when(F.col("k6_available") == F.lit(False), F.concat(F.lit("GREEN e2e "), e2e, F.lit(" — load generator missing, load not measured")))
            .when(F.col("green_at").isNotNull(), F.concat(F.lit("GREEN at attempt "), F.col("green_at").cast("string")))
            .otherwise(F.concat(F.lit("GREEN e2e "), e2e)))
    stage = F.col("stage_failed")
    bad = (F.when(F.col("halt_cause") != "", F.concat(F.lit("HALT — "), "halt_cause"))
           .when(~F.col("has_metrics"), "NO METRICS")
           .when(F.coalesce("e2e_green", F.lit(False)) & (F.col("scaling_ok") == F.lit(False)), F.concat(F.lit("SCALING FAILED — e2e "), e2e))
           .when(stage == "deploy", "DEPLOY FAILED").when(stage == "nostart", "NEVER STARTED")
           .when(stage == "e2e", F.concat(F.lit("E2E FAILED ("), e2e, F.lit(")"))).when(stage == "k6", "K6 STAGE ISSUE")
           .otherwise(F.concat(F.lit("NOT GREEN (stage="), F.coalesce(stage, F.lit("?")), F.lit(")"))))
    return F.struct(green.alias("green"), F.when(green, good).otherwise(bad).alias("text"))
