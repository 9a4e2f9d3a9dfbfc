"""The scoreboard report, from records to its ranked table."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, with_ctes
from runlens.catalog.frames import SCORES
from runlens.catalog.scoring import COMPARED
from runlens.catalog.trust import VAL, _records, _validated
from runlens.hooks import Experiment
from runlens.plans import report
from runlens.session import shared_folder
from runlens.sources import tables

KEPT = "kept AS (SELECT scores.* FROM scores LEFT JOIN vld USING (cell_id) WHERE coalesce(verdict, '') <> 'TAINTED')"
CUT = ["cutc AS (SELECT * FROM kept WHERE impl = 'py' AND f_quarter = 'q2')", "basec AS (SELECT * FROM kept WHERE impl = 'bash' AND f_quarter = 'q2')"]


def _report(spark, sf):
    experiment = Experiment()
    experiment.register_summary("by_factor", lambda cells, metrics: metrics(cells.select("*", F.explode("factors").alias("factor", "level")), ("factor", "level")))
    ask = report.Ask(impl="py", where={"quarter": "q2"}, allow_stale=True, by_discrepancy=True, by_significance=True, predecessors={"py": "bash"})
    made = report.report(tables.scores(spark, sf), _validated(spark, sf), _records(spark, sf), ask, experiment)
    return report.write(made, shared_folder(spark))


@query("scoreboard_report", with_ctes(SCORES, VAL, KEPT, *CUT, *COMPARED[3:], """
    d AS (SELECT *, coalesce(abs(d_green), abs(d_itg)) AS gap FROM cmp)""",
    """SELECT model, variant, place, n_cells, n_green, green_rate, base_n, base_rate, d_green, d_itg, round(fisher_p, 8) AS fisher_p,
      row_number() OVER (ORDER BY base_n IS NULL, coalesce(fisher_p < 0.05, false) DESC, coalesce(gap, 0) DESC, model, place) AS pos FROM d"""))
def scoreboard_report(spark, sf):
    return _report(spark, sf)["board"].select("model", "variant", "place", "n_cells", "n_green", "green_rate", "base_n", "base_rate", "d_green", "d_itg",
                                              F.round("fisher_p", 8).alias("fisher_p"), "pos")
