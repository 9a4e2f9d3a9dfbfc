"""Scores, statistics and the scoreboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import SCORES
from runlens.functions import names, stats
from runlens.operators import metrics, ranks
from runlens.operators.metrics import RESULT_COLUMNS, USAGE_FIELDS
from runlens.plans import scoreboard as board
from runlens.sources import tables

POOL = (("HOUSEHOLD", "home"), ("FURNITURE", "home"))
POOL_SQL = "pool AS (SELECT * FROM (VALUES ('HOUSEHOLD', 'home'), ('FURNITURE', 'home')) t(pm, label))"


def pool(spark):
    return spark.createDataFrame(list(POOL), "model string, label string")


def _won(c):
    return f"CASE WHEN green THEN {c} END"


def metrics_sql(source, by):
    """The whole metric list over a CTE ``source`` grouped by ``by``."""
    m = lambda c: f"round(avg(CAST({c} AS DOUBLE)), 4)"
    r = lambda c: f"round(avg(CAST(CAST({c} AS INT) AS DOUBLE)), 4)"
    lo = lambda c: f"min(CAST({c} AS DOUBLE))"
    hi = lambda c: f"max(CAST({c} AS DOUBLE))"
    load = "e2e_green AND load_total IS NOT NULL"
    cols = {
        "n_cells": "count(*)", "n_green": "count(*) FILTER (green)",
        "first_pass_correct_rate": r("first_pass_correct"), "e2e_green_rate": r("e2e_green"),
        "green_rate": r("green"), "revoked_rate": r("coalesce(revoked, false)"),
        "mean_e2e_pass_rate": m("CASE WHEN e2e_total > 0 THEN e2e_pass / e2e_total END"),
        "load_error_rate_on_green": f"round(CAST(sum(coalesce(load_errors, 0)) FILTER ({load}) AS DOUBLE)"
                                    f" / nullif(CAST(sum(load_total) FILTER ({load}) AS DOUBLE), 0), 4)",
        "min_iterations_to_green": lo("iterations_to_green"), "mean_iterations_to_green": m("iterations_to_green"),
        "max_iterations_to_green": hi("iterations_to_green"),
        "budget_censored_rate": r("coalesce(budget_exhausted, false)"),
        "min_agent_s_to_green": lo(_won("agent_s_total")), "mean_agent_s_to_green": m(_won("agent_s_total")),
        "max_agent_s_to_green": hi(_won("agent_s_total")),
        "mean_agent_s_per_attempt": m("agent_s_per_attempt"),
        **{f"mean_{f}_to_green": m(_won(f"{f}_total")) for f in USAGE_FIELDS},
        "mean_api_ms_per_out_tok": m(_won("api_ms_per_out_tok")),
        "n_green_usage": "count(*) FILTER (green AND api_s_total IS NOT NULL)",
        "n_green_surface": "count(*) FILTER (green AND lines IS NOT NULL)",
        "mean_files": m(_won("files")), "mean_languages": m(_won("language_count")),
        **{f"{p}_{c}": fn(_won(c)) for c in ("lines", "sloc") for p, fn in (("min", lo), ("mean", m), ("max", hi))},
        "mean_lines_all_cells": m("lines"),
    }
    body = ",\n  ".join(f"{v} AS {k}" for k, v in cols.items())
    keys = ", ".join(by)
    return f"SELECT {keys},\n  {body}\nFROM {source} GROUP BY {keys}"


PLACE_SQL = ("CAST(row_number() OVER (PARTITION BY model ORDER BY coalesce(green_rate, 0) DESC, "
             "mean_iterations_to_green ASC NULLS LAST, variant) AS INT) AS place")


@query("scoreboard", with_ctes(
    SCORES, f"grouped AS ({metrics_sql('scores', ('model', 'variant'))})",
    f"SELECT *, {PLACE_SQL} FROM grouped"))
def scoreboard(spark, sf):
    return board.board(tables.scores(spark, sf)).orderBy("model", "place")


@query("scoreboard_pooled_models", with_ctes(
    SCORES, POOL_SQL,
    "pooled AS (SELECT coalesce(label, model) AS model, * EXCLUDE (model) FROM scores LEFT JOIN pool ON model = pm)",
    f"grouped AS ({metrics_sql('pooled', ('model', 'variant'))})", f"SELECT *, {PLACE_SQL} FROM grouped"))
def scoreboard_pooled_models(spark, sf):
    return board.board(tables.scores(spark, sf), pool(spark))


@query("metrics_by_factor", with_ctes(
    SCORES,
    "levels AS (SELECT 'quarter' AS factor, f_quarter AS level, * FROM scores "
    "UNION ALL SELECT 'home', f_home, * FROM scores)", metrics_sql("levels", ("factor", "level"))))
def metrics_by_factor(spark, sf):
    return board.by_factor(tables.scores(spark, sf))


@query("flat_results", with_ctes(
    SCORES, "SELECT " + ", ".join("'home=' || f_home || ';quarter=' || f_quarter AS factors" if c == "factors" else c
                                  for c in RESULT_COLUMNS) + " FROM scores"))
def flat_results(spark, sf):
    return board.flat_rows(tables.scores(spark, sf))


@query("factors_text", with_ctes(
    SCORES, "SELECT 'home=' || f_home || ';quarter=' || f_quarter AS factors, count(*) AS n FROM scores GROUP BY 1"))
def factors_text(spark, sf):
    s = tables.scores(spark, sf).withColumn("factors", names.factors_text(F.col("factors")))
    return s.groupBy("factors").agg(F.count(F.lit(1)).alias("n"))


def _model_names(spark, sf):
    size = F.col("p_size").cast("string")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("Gemini "), size, F.lit(".1 Pro (High)")))
        .when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("claude-"), F.lower("p_type"), F.lit("-"), size, F.lit("-5-20251001")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("gate/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("-flash")))
        .otherwise(F.when(F.col("p_size") > 25, F.lit("(only)")).otherwise(F.lit(""))).alias("name"))


NAMES_SQL = """raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Gemini ' || p_size || '.1 Pro (High)'
    WHEN 1 THEN 'claude-' || lower(p_type) || '-' || p_size || '-5-20251001'
    WHEN 2 THEN 'gate/' || p_brand || '/' || p_name || '-flash' ELSE CASE WHEN p_size > 25 THEN '(only)' ELSE '' END END AS name
  FROM part)"""


@query("short_model_names", with_ctes(
    NAMES_SQL,
    r"s1 AS (SELECT *, lower(trim(regexp_replace(name, '\s*\([^)]*\)', '', 'g'))) AS s FROM raw)",
    r"s2 AS (SELECT * EXCLUDE (s), regexp_replace(regexp_replace(string_split(s, '/')[-1], '-\d{8}$', ''), '^claude-', '') AS s FROM s1)",
    r"s3 AS (SELECT * EXCLUDE (s), regexp_replace(regexp_replace(replace(s, ' ', '-'), '-pro\b', 'p', 'g'), '-flash\b', 'f', 'g') AS s FROM s2)",
    r"SELECT p_partkey, name, CASE WHEN s <> '' THEN regexp_replace(s, '(\d)-(\d)($|[^\d])', '\1.\2\3', 'g') "
    r"WHEN name <> '' THEN name ELSE '?' END AS short FROM s3"))
def short_model_names(spark, sf):
    return _model_names(spark, sf).withColumn("short", names.short_model(F.col("name")))


@query("announced_cuts", with_ctes(
    SCORES,
    "c AS (SELECT count(*) n0, count(*) FILTER (variant = '1-URGENT') n1, "
    "count(*) FILTER (variant = '1-URGENT' AND impl = 'py') n2, "
    "count(*) FILTER (variant = '1-URGENT' AND impl = 'py' AND f_home = '7') n3, "
    "count(*) FILTER (variant = '1-URGENT' AND impl = 'py' AND f_home = '7' AND f_quarter = 'q1') n4 FROM scores)",
    "SELECT 1 AS step, 'variant' AS cut, '1-URGENT' AS wanted, n1 AS kept, n0 AS of FROM c "
    "UNION ALL SELECT 2, 'impl', 'py', n2, n1 FROM c UNION ALL SELECT 3, 'factor home', '7', n3, n2 FROM c "
    "UNION ALL SELECT 4, 'factor quarter', 'q1', n4, n3 FROM c"))
def announced_cuts(spark, sf):
    wanted = board.cuts("1-URGENT", "py", {"quarter": "q1", "home": "7"})
    return board.announce(tables.scores(spark, sf), wanted)


@query("cut_scoreboard", with_ctes(
    SCORES, "kept AS (SELECT * FROM scores WHERE impl = 'py' AND f_quarter = 'q2')",
    f"grouped AS ({metrics_sql('kept', ('model', 'variant'))})", f"SELECT *, {PLACE_SQL} FROM grouped"))
def cut_scoreboard(spark, sf):
    return board.board(board.cut(tables.scores(spark, sf), board.cuts(None, "py", {"quarter": "q2"})))


FISHER_SQL = """support AS (
  SELECT {keys}, a + b AS r1, c + d AS r2, a + c AS c1, b + d AS c2, a,
    unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS k
  FROM two WHERE a + b > 0 AND c + d > 0 AND a + c > 0 AND b + d > 0),
probs AS (SELECT *, exp(lgamma(r1 + 1) - lgamma(k + 1) - lgamma(r1 - k + 1) + lgamma(r2 + 1) - lgamma(c1 - k + 1)
    - lgamma(r2 - c1 + k + 1) - lgamma(r1 + r2 + 1) + lgamma(c1 + 1) + lgamma(c2 + 1)) AS p FROM support),
seen AS (SELECT {keys}, p AS pobs FROM probs WHERE k = a),
fish AS (SELECT {keys}, least(1.0::DOUBLE, sum(p) FILTER (p <= pobs * (1 + 1e-7::DOUBLE))) AS fisher_p
  FROM probs JOIN seen USING ({keys}) GROUP BY {keys})"""

COMPARED = [
    SCORES, "cutc AS (SELECT * FROM scores WHERE impl = 'py')", "basec AS (SELECT * FROM scores WHERE impl = 'bash')",
    f"g AS (SELECT *, {PLACE_SQL} FROM ({metrics_sql('cutc', ('model', 'variant'))}))",
    f"h AS ({metrics_sql('basec', ('model', 'variant'))})",
    "two AS (SELECT model, variant, g.n_green AS a, g.n_cells - g.n_green AS b, h.n_green AS c, "
    "h.n_cells - h.n_green AS d FROM g JOIN h USING (model, variant))",
    FISHER_SQL.format(keys="model, variant"),
    "cmp AS (SELECT g.model, g.variant, g.place, g.n_cells, g.n_green, g.green_rate, "
    "g.mean_iterations_to_green AS mean_itg, h.n_cells AS base_n, h.green_rate AS base_rate, "
    "h.mean_iterations_to_green AS base_itg, round(g.green_rate - h.green_rate, 4) AS d_green, "
    "round(g.mean_iterations_to_green - h.mean_iterations_to_green, 4) AS d_itg, fisher_p "
    "FROM g LEFT JOIN h USING (model, variant) LEFT JOIN fish USING (model, variant))"]


def compared(spark, sf, predecessors=(("py", "bash"),)):
    """The newest driver's cells against its predecessor's."""
    s = tables.scores(spark, sf)
    impl, base = predecessors[0]
    return board.compare(board.board(s.where(F.col("impl") == impl)),
                         metrics.group_metrics(s.where(F.col("impl") == base)))


@query("baseline_comparison", with_ctes(*COMPARED, "SELECT * EXCLUDE (fisher_p), round(fisher_p, 8) AS fisher_p FROM cmp"))
def baseline_comparison(spark, sf):
    return compared(spark, sf).withColumn("fisher_p", F.round("fisher_p", 8))


def _ordered(order_sql):
    return with_ctes(*COMPARED,
                     "d AS (SELECT * REPLACE (round(fisher_p, 8) AS fisher_p), coalesce(abs(d_green), abs(d_itg)) AS gap FROM cmp)",
                     f"SELECT model, variant, gap, CAST(row_number() OVER (ORDER BY {order_sql}model, place) AS INT) AS pos FROM d")


def _positions(spark, sf, by_discrepancy, by_significance):
    c = compared(spark, sf).withColumn("fisher_p", F.round("fisher_p", 8)).withColumn("gap", board.discrepancy())
    order = board.comparison_order(by_discrepancy, by_significance)
    return ranks.positions(c, order, "pos").select("model", "variant", "gap", F.col("pos").cast("int").alias("pos"))


@query("rows_by_discrepancy", _ordered("gap IS NULL, coalesce(gap, 0) DESC, "))
def rows_by_discrepancy(spark, sf):
    return _positions(spark, sf, True, False)


@query("rows_by_significance", _ordered("base_n IS NULL, coalesce(fisher_p < 0.05, false) DESC, fisher_p ASC NULLS LAST, "))
def rows_by_significance(spark, sf):
    return _positions(spark, sf, False, True)


@query("rows_by_both", _ordered("base_n IS NULL, coalesce(fisher_p < 0.05, false) DESC, coalesce(gap, 0) DESC, "))
def rows_by_both(spark, sf):
    return _positions(spark, sf, True, True)


TWO_BY_TWO = """two AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS a,
    count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c,
    count(*) FILTER (quality = 0 AND toxic = 0) AS d FROM labels JOIN documents USING (doc_id) GROUP BY lang)"""


def two_by_two(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    return j.groupBy("lang").agg(F.count_if((q == 1) & (t == 1)).alias("a"), F.count_if((q == 1) & (t == 0)).alias("b"),
                                 F.count_if((q == 0) & (t == 1)).alias("c"), F.count_if((q == 0) & (t == 0)).alias("d"))


@query("fisher_exact", with_ctes(
    TWO_BY_TWO, FISHER_SQL.format(keys="lang"),
    "f AS (SELECT two.*, round(fisher_p, 8) AS fisher_p FROM two LEFT JOIN fish USING (lang))",
    "SELECT *, CASE WHEN fisher_p IS NULL THEN '-' WHEN fisher_p < 0.01 THEN 'p<.01**' WHEN fisher_p < 0.05 "
    "THEN printf('p%.2f*', fisher_p) ELSE printf('p%.2f', fisher_p) END AS label, "
    "CASE WHEN fisher_p IS NULL THEN '-' WHEN fisher_p < 0.01 THEN 'strong' WHEN fisher_p < 0.05 THEN 'significant' "
    "ELSE 'not sig' END AS grade FROM f"))
def fisher_exact(spark, sf):
    f = stats.fisher(two_by_two(spark, sf), ["lang"], "a", "b", "c", "d").withColumn("fisher_p", F.round("fisher_p", 8))
    return f.select("*", stats.significance_label(F.col("fisher_p")).alias("label"),
                    stats.significance_grade(F.col("fisher_p")).alias("grade"))


def _rank_sql(part, by, name):
    return (f"rank() OVER (PARTITION BY {part} ORDER BY {by}) + (count(*) OVER (PARTITION BY {part}, {by}) - 1) / 2.0::DOUBLE "
            f"AS {name}")


@query("wall_vs_work", with_ctes(
    SCORES,
    "pairs AS (" + " UNION ALL ".join(
        f"SELECT model, '{f}' AS field, agent_s_total AS x, CAST({f}_total AS DOUBLE) AS y FROM scores "
        f"WHERE green AND agent_s_total IS NOT NULL AND {f}_total IS NOT NULL" for f in ("out_tok", "turns", "tool_calls")) + ")",
    f"ranked AS (SELECT model, field, {_rank_sql('model, field', 'x', 'rx')}, {_rank_sql('model, field', 'y', 'ry')} FROM pairs)",
    "m AS (SELECT *, avg(rx) OVER (PARTITION BY model, field) mx, avg(ry) OVER (PARTITION BY model, field) my FROM ranked)",
    "rho AS (SELECT model, field, count(*) AS n, CASE WHEN count(*) >= 3 AND sum((rx-mx)*(rx-mx)) > 0 AND sum((ry-my)*(ry-my)) > 0 "
    "THEN round(sum((rx-mx)*(ry-my)) / sqrt(sum((rx-mx)*(rx-mx))) / sqrt(sum((ry-my)*(ry-my))), 3) END AS rho FROM m GROUP BY 1, 2)",
    "SELECT model, max(n) AS n, " + ", ".join(f"max(rho) FILTER (field = '{f}') AS rho_wall_{f}" for f in ("out_tok", "turns", "tool_calls"))
    + " FROM rho GROUP BY model"))
def wall_vs_work(spark, sf):
    return board.wall_vs_work(tables.scores(spark, sf))


@query("average_ranks", "SELECT l_returnflag AS grp, l_quantity AS x, count(*) AS n, min(rk) AS rank FROM ("
       "SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) "
       "+ (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rk FROM lineitem) GROUP BY 1, 2")
def average_ranks(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"))
    return ranks.average_ranks(li, ["grp"], "x")


@query("pass_rates_and_deltas", with_ctes(
    SCORES, "SELECT cell_id, CASE WHEN e2e_total > 0 THEN e2e_pass / e2e_total END AS pass_rate, "
            "round(agent_s_total - api_s_total, 4) AS d FROM scores"))
def pass_rates_and_deltas(spark, sf):
    return tables.scores(spark, sf).select(
        "cell_id", metrics.pass_rate(F.col("e2e_pass"), F.col("e2e_total")).alias("pass_rate"),
        stats.delta(F.col("agent_s_total"), F.col("api_s_total")).alias("d"))


@query("calibration_aggregate", with_ctes(
    "m AS (SELECT l_returnflag AS variant, l_linestatus AS arrangement, l_suppkey AS run, l_linenumber AS name, "
    "max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)",
    "n AS (SELECT variant, arrangement, count(DISTINCT run) AS runs FROM m GROUP BY 1, 2)",
    "SELECT variant, arrangement, 'v' || CAST(name AS VARCHAR) AS name, round(avg(v), 4) AS value, "
    "round(CASE WHEN max(runs) >= 2 THEN stddev_samp(v) ELSE 1.0::DOUBLE END, 4) AS spread, "
    "CASE WHEN max(runs) >= 2 THEN 'measured' ELSE 'estimated' END AS kind, max(runs) AS n "
    "FROM m JOIN n USING (variant, arrangement) GROUP BY variant, arrangement, name HAVING count(*) = max(runs)"))
def calibration_aggregate(spark, sf):
    from runlens.plans.calibration import aggregate
    runs = table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("arrangement"),
        F.col("l_suppkey").alias("run"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("name")
    ).agg(F.max("l_quantity").alias("value"))
    return aggregate(runs).withColumn("value", F.round("value", 4)).withColumn("spread", F.round("spread", 4))
