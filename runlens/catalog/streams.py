"""Streaming jobs run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, with_ctes
from runlens.catalog.frames import EVENTS, LEDGER
from runlens.catalog.ledgers import GATES, PAY
from runlens.plans import fleet
from runlens.sources import tables
from runlens.streaming import live, run


#: Longer than the events last, so that no key is forgotten on the way.
FOREVER = 390 * 86400.0


def _of(frame):
    return frame.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("time"), F.col("event_type").alias("kind"),
                        "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _events(spark, sf):
    return _of(run.read_table(spark, sf, "events"))


def _bounded(spark, sf):
    """Events as a stream that is closed after the last one."""
    source = run.bounded(spark, sf, "events", "ts")
    return source, _of(source.frame)


@query("stream_trace_windows", with_ctes(EVENTS, """
w AS (SELECT run, floor(ts / 3600) * 3600 AS hr, kind, value, k FROM ev)""", """SELECT run, CAST(hr AS BIGINT) AS hour_s, coalesce(sum(floor(value)) FILTER (kind = 'view'), 0) AS fired,
    count(*) FILTER (kind = 'click' AND k % 3 = 0) AS http_2xx, count(*) FILTER (kind = 'click' AND k % 3 = 1) AS http_404, count(*) FILTER (kind = 'click' AND k % 3 = 2) AS err
    FROM w GROUP BY run, hr"""))
def stream_trace_windows(spark, sf):
    k = F.col("k")
    source, e = _bounded(spark, sf)
    p = e.select("run", "time", F.when(F.col("kind") == "view", "fired").when(F.col("kind") == "click", "http_reqs").otherwise("http_req_duration").alias("metric"),
                 F.when(F.col("kind") == "view", F.floor("value")).otherwise(F.col("value")).cast("double").alias("value"),
                 F.when(k % 3 == 0, "200").when(k % 3 == 1, "404").otherwise("0").alias("status"))
    s = run.to_end(live.trace_seconds(p, late="1 hour", window="1 hour"), source=source)
    return s.select("run", F.unix_seconds("second").alias("hour_s"), "fired", "http_2xx", "http_404", "err")


@query("stream_gate_progress", with_ctes(PAY, GATES, "SELECT cell, attempt, n_passed AS passed FROM gates WHERE n_passed > 0"))
def stream_gate_progress(spark, sf):
    led = tables.ledger_of(_events(spark, sf).withColumn("ts", F.unix_micros("time") / F.lit(1e6)).withColumn("chunk", F.lit(0)))
    out = run.to_end(live.gate_progress(led), "update")
    return out.groupBy("cell", "attempt").agg(F.max_by("passed", "batch").alias("passed"))


@query("stream_alerts_once", with_ctes(LEDGER, "SELECT cell, fields[3] AS rule, count(DISTINCT k) AS episodes FROM led WHERE event = 'ALERT' GROUP BY 1, 2"))
def stream_alerts_once(spark, sf):
    led = tables.ledger_of(_events(spark, sf).withColumn("ts", F.unix_micros("time") / F.lit(1e6)).withColumn("chunk", F.lit(0)))
    a = led.where("event = 'ALERT'").select("cell", F.col("fields")[2].alias("rule"), F.col("k").alias("episode"), F.timestamp_seconds("ts").alias("time"))
    once = run.to_end(live.alerts_once(a, late="60 days"))
    return once.groupBy("cell", "rule").agg(F.count(F.lit(1)).alias("episodes"))


@query("stream_two_sweeps", with_ctes(EVENTS, """
r AS (SELECT run AS cell, seq, ts, CASE WHEN k % 3 = 0 THEN seq ELSE seq // 3000 END AS rx, CASE WHEN k % 10 = 0 THEN 2 ELSE 0 END AS cpu FROM ev),
m AS (SELECT *, lag(rx) OVER w AS pr, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY cell ORDER BY seq)),
f AS (SELECT *, n - coalesce(max(CASE WHEN cpu > 0.5 OR pr IS NULL OR rx > pr THEN n END) OVER (PARTITION BY cell ORDER BY seq), 0) AS flat FROM m)""",
    "SELECT cell, seq FROM f WHERE flat = 2"))
def stream_two_sweeps(spark, sf):
    k = F.col("k")
    source, e = _bounded(spark, sf)
    r = e.select(F.col("run").alias("cell"), "seq", "time", F.when(k % 3 == 0, F.col("seq")).otherwise(F.floor(F.col("seq") / 3000)).cast("long").alias("rx"),
                                  F.when(k % 10 == 0, 2.0).otherwise(0.0).alias("cpu"))
    return run.to_end(live.two_sweeps(r, late="1 hour", forget_s=FOREVER), source=source)


@query("stream_denied_tools", "SELECT conv_id // 4 AS cell, 'tool_' || CAST(length(text) % 6 AS VARCHAR) AS tool, count(*) AS calls FROM conversations WHERE turn % 4 = 1 AND length(text) % 6 > 2 GROUP BY 1, 2")
def stream_denied_tools(spark, sf):
    lines = tables.transcripts_b_of(run.read_table(spark, sf, "conversations"))
    allowed = spark.createDataFrame([(f"tool_{i}",) for i in range(3)], "tool string")
    return run.to_end(live.denied_tools(lines, allowed)).groupBy("cell", "tool").agg(F.count(F.lit(1)).alias("calls"))


@query("stream_first_moments", with_ctes(EVENTS, """
t AS (SELECT run, seq, ts, CASE WHEN kind = 'click' THEN k ELSE 0 END AS fired, kind = 'signup' AS decided, k % 4 < 2 AS claimed, k % 3 > 0 AS probed, value FROM ev),
m AS (SELECT run, min(ts) FILTER (decided) AS decision, min(ts) FILTER (claimed AND probed) AS mount, min(ts) FILTER (value >= 95) AS saturation,
        86400 + CASE WHEN min(ts) FILTER (fired > 0) <= min(ts) + 86400 THEN min(ts) FILTER (fired > 0) ELSE min(ts) END AS over FROM t GROUP BY run),
r AS (SELECT run, min(ts) AS release FROM t JOIN m USING (run) WHERE NOT claimed AND NOT probed AND ts > mount GROUP BY run)""", """
SELECT run, moment, round(ts, 3) AS ts FROM (SELECT run, 'decision' AS moment, decision AS ts FROM m UNION ALL SELECT run, 'mount', mount FROM m UNION ALL SELECT run, 'saturation', saturation FROM m
    UNION ALL SELECT run, 'over', over FROM m UNION ALL SELECT run, 'release', release FROM r) WHERE ts IS NOT NULL"""))
def stream_first_moments(spark, sf):
    k = F.col("k")
    source, e = _bounded(spark, sf)
    ticks = e.select("run", (F.unix_micros("time") / F.lit(1e6)).alias("ts"), F.when(F.col("kind") == "click", k).otherwise(0).alias("fired"), (F.col("kind") == "signup").alias("decided"),
                     (k % 4 < 2).alias("claimed"), (k % 3 > 0).alias("probed"), F.col("value").alias("p99"))
    told = run.to_end(live.first_moments(ticks, 95.0, 86400.0, late="1 hour", forget_s=FOREVER), source=source)
    return told.select("run", "moment", F.round("ts", 3).alias("ts"))


@query("stream_sleep_seconds", with_ctes(EVENTS, """
c AS (SELECT run, seq, ts AS wall, CAST(floor(ts / 7200) * 3600 AS DOUBLE) AS mono FROM ev),
g AS (SELECT run, seq, (wall - lag(wall) OVER w) - (mono - lag(mono) OVER w) AS gap FROM c WINDOW w AS (PARTITION BY run ORDER BY wall, seq)),
s AS (SELECT c.run, c.seq, sum(CASE WHEN gap > 30 THEN gap ELSE 0 END) OVER (PARTITION BY c.run ORDER BY wall, c.seq) AS slept FROM c JOIN g USING (run, seq))""",
    "SELECT run, seq, round(slept, 2) AS slept FROM s"))
def stream_sleep_seconds(spark, sf):
    source, e = _bounded(spark, sf)
    wall = F.unix_micros("time") / F.lit(1e6)
    ticks = e.select("run", "seq", wall.alias("wall"), (F.floor(wall / 7200) * 3600).cast("double").alias("mono"))
    told = run.to_end(live.sleep_seconds(ticks, late="1 hour", forget_s=FOREVER), source=source)
    return told.select("run", "seq", F.round("slept", 2).alias("slept"))


READINGS = EVENTS + """,
rd AS (SELECT run AS cell, CASE kind WHEN 'click' THEN 'verify-quiet' WHEN 'view' THEN 'phase-stalled' ELSE 'silent-hang' END AS rule, seq, k % 5 < 3 AS "on",
    CASE WHEN k % 11 > 0 THEN 'attempt ' || CAST(k // 50 AS VARCHAR) END AS key, k % 17 = 0 AS reset FROM ev),
pv AS (SELECT *, lag("on", 1, false) OVER w AS was, lag(key) OVER w AS pk FROM rd WINDOW w AS (PARTITION BY cell, rule ORDER BY seq)),
op AS (SELECT *, "on" AND (NOT was OR reset OR key IS DISTINCT FROM pk) AS opens FROM pv),
nu AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY cell, rule ORDER BY seq) AS n FROM op)"""
EDGES = with_ctes(READINGS, """SELECT cell, rule, seq, CAST(n AS BIGINT) AS episode, key, 'opened' AS edge FROM nu WHERE opens
    UNION ALL SELECT cell, rule, seq, CAST(n - CASE WHEN opens THEN 1 ELSE 0 END AS BIGINT), pk, 'lifted' FROM nu WHERE was AND (opens OR NOT "on")""")


def _readings(e):
    k = F.col("k")
    rule = F.when(F.col("kind") == "click", "verify-quiet").when(F.col("kind") == "view", "phase-stalled").otherwise("silent-hang")
    return e.select(F.col("run").alias("cell"), rule.alias("rule"), "seq", (k % 5 < 3).alias("on"),
                    F.when(k % 11 > 0, F.concat(F.lit("attempt "), F.floor(k / 50).cast("string"))).alias("key"), (k % 17 == 0).alias("reset"),
                    *[c for c in ("time", "chunk") if c in e.columns])


@query("alert_episodes", EDGES)
def alert_episodes(spark, sf):
    return fleet.alert_edges(_readings(tables.events(spark, sf)))


@query("stream_alert_episodes", EDGES)
def stream_alert_episodes(spark, sf):
    source, e = _bounded(spark, sf)
    return run.to_end(live.alert_edges(_readings(e), late="1 hour", forget_s=FOREVER), source=source)
