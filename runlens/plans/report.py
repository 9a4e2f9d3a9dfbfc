"""The scoreboard report as one job: refuse, drop, cut, rank, compare, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.hooks import Experiment
from runlens.operators import ranks
from runlens.operators.metrics import RESULT_COLUMNS, group_metrics
from runlens.plans import scoreboard, scoring
from runlens.session import cut_lineage

#: Stale records that a refusal names.
NAMED = 10


class Refused(ValueError):
    """Records are older than their inputs, so a report of them would look right and be wrong."""


@dataclass(frozen=True)
class Ask:
    """What a report is asked for. ``predecessors`` maps a driver to the one it is compared with."""
    variant: str | None = None
    impl: str | None = None
    where: dict[str, str] = field(default_factory=dict)
    allow_stale: bool = False
    include_tainted: bool = False
    by_discrepancy: bool = False
    by_significance: bool = False
    predecessors: dict[str, str] = field(default_factory=dict)


def report(scores: DataFrame, validations: DataFrame, records: DataFrame, ask: Ask, experiment: Experiment | None = None) -> dict[str, DataFrame]:
    """The tables of a report, each with what its stage set aside:

    * ``stale``: records (cell, record, env, ledger, metrics) older than an input. Any
      stops the report, unless the request allows them.
    * ``excluded``: tainted cells with their reason, left out unless asked for.
    * ``cuts``: how many cells each cut left.
    * ``rows``: the flat results of the cells that are left.
    * ``board``: their groups with place, baseline (the predecessor's cells under the
      same cuts, where a driver is asked for) and ``pos``, the place in the order asked for.
    * ``wall_vs_work``, and a table for each summary of the experiment.

    The cells that are left are written once and read by each table."""
    stale = scoring.stale(records)
    if not ask.allow_stale:
        first = stale.orderBy("cell").limit(NAMED).collect()
        if first:
            named = ", ".join(f"{r['cell']} ({r['newer']})" for r in first)
            raise Refused(f"{stale.count()} records are older than their inputs: {named}")
    kept, excluded = scoreboard.without_tainted(scores, validations)
    if ask.include_tainted:
        kept, excluded = scores, excluded.limit(0)
    kept = cut_lineage(kept)
    cuts = scoreboard.cuts(ask.variant, ask.impl, ask.where)
    cells = scoreboard.cut(kept, cuts)
    board = scoreboard.board(cells)
    if ask.impl is not None and ask.impl in ask.predecessors:
        before = scoreboard.cut(kept, scoreboard.cuts(ask.variant, ask.predecessors[ask.impl], ask.where))
        compared = scoreboard.compare(board, group_metrics(before)).select("model", "variant", "base_n", "base_rate", "base_itg", "d_green", "d_itg", "fisher_p")
        ordered = board.join(compared, ["model", "variant"])
        order = scoreboard.comparison_order(ask.by_discrepancy, ask.by_significance)
    else:
        ordered, order = board, [F.col("model").asc(), F.col("place").asc()]
    tables = {"stale": stale, "excluded": excluded, "cuts": scoreboard.announce(kept, cuts) if cuts else None,
              "rows": scoreboard.flat_rows(cells), "board": ranks.positions(ordered, order, "pos"), "wall_vs_work": scoreboard.wall_vs_work(cells)}
    extra = experiment.report(cells, group_metrics) if experiment else {}
    if clash := set(extra) & set(tables):
        raise ValueError(f"summaries named as tables of the report: {sorted(clash)}")
    return {name: t for name, t in (tables | extra).items() if t is not None}


def write(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Each table below ``folder``, the flat rows also as CSV with a header; read from there."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark: SparkSession = tables["rows"].sparkSession
    stored = {name: spark.read.schema(t.schema).parquet(f"{folder}/{name}") for name, t in tables.items()}
    stored["rows"].select(*RESULT_COLUMNS).write.mode("overwrite").option("header", "true").csv(f"{folder}/rows.csv")
    return stored
