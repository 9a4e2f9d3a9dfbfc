"""Names: models, cell ids, selectors, factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_model(name: Column) -> Column:
    """A model's display name: no parenthesis, path, build date or vendor
    prefix, with the usual words shortened."""
    s = F.lower(F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", "")))
    s = F.substring_index(s, "/", -1)
    # Fixed patterns, in the order they apply.
    for pattern, by in ((r"-\d{8}$", ""), (r"^claude-", ""), (" ", "-"),
                        (r"-pro\b", "p"), (r"-flash\b", "f"), (r"(\d)-(\d)(?!\d)", "$1.$2")):
        s = F.regexp_replace(s, pattern, by)
    return F.when(s != "", s).when(name != "", name).otherwise("?")


def pooled(df: DataFrame, pool: DataFrame, model: str = "model") -> DataFrame:
    """``df`` with models replaced by their pool's row label; ``pool`` holds
    (model, label) rows."""
    p = pool.select(F.col("model").alias("_pm"), F.col("label").alias("_label"))
    return (df.join(p, F.col(model) == F.col("_pm"), "left")
            .withColumn(model, F.coalesce("_label", model)).drop("_pm", "_label"))


def factors_text(factors: Column) -> Column:
    """``k=v`` pairs sorted by key, joined by semicolons."""
    return F.coalesce(F.array_join(F.transform(
        F.array_sort(F.map_entries(factors)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), F.lit(""))


def cell_id(agent: Column, variant: Column, task: Column, rep: Column,
            effort: Column | None = None, smoke: Column | None = None) -> Column:
    """``<agent>[_<effort>][_smoke]_<variant>_<task>_r<rep>``."""
    parts = [agent]
    if effort is not None:
        parts.append(F.when(effort != "", effort))
    if smoke is not None:
        parts.append(F.when(smoke, F.lit("smoke")))
    return F.concat_ws("_", *parts, variant, task, F.concat(F.lit("r"), rep.cast("string")))


def shaped(cid: Column) -> Column:
    """Whether a name has the parts of a cell id: agent, effort, variant, task, repeat."""
    return cid.rlike(r"^[a-zA-Z0-9-]+_[^_]*_(.+_)?[^_]+_T\d_r\d+$")


def parse_cell_id(df: DataFrame, variants: DataFrame, cid: str = "cid") -> DataFrame:
    """The ids of ``df`` that are cells: agent, variant, task and rep beside
    the id. The variant may hold underscores and must be one of ``variants``
    (column ``variant``)."""
    t = F.split(F.col(cid), "_")
    n = F.size(t)
    start = F.when(F.element_at(t, 3) == "smoke", 4).otherwise(3)
    parsed = (df.where(n >= 5).select(
        "*", F.element_at(t, 1).alias("agent"),
        F.array_join(F.slice(t, start, F.greatest(n - 1 - start, F.lit(0))), "_").alias("variant"),
        F.element_at(t, -2).alias("task"),
        F.regexp_extract(F.element_at(t, -1), r"^r(\d+)$", 1).alias("rep")))
    shaped = parsed.where((F.col("rep") != "") & F.col("task").rlike(r"^T\d$")
                          & F.col("agent").rlike(r"^[a-zA-Z0-9-]+$") & (F.col("variant") != ""))
    return shaped.join(variants.select("variant").distinct(), "variant", "left_semi")


def selects(cid: Column, selector: Column) -> Column:
    """``all``, a whole id, or a run of whole tokens of it."""
    return (selector.isin("all", "*") | (cid == selector)
            | F.contains(F.concat(F.lit("_"), cid, F.lit("_")), F.concat(F.lit("_"), selector, F.lit("_"))))
