"""Load traces, calibration values and the load-shape law."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import EVENTS, TRACE
from runlens.operators import ranks, traces
from runlens.operators import scan as S
from runlens.plans import law
from runlens.sources import tables

WIDTH = 86400.0
LIMITS = law.Limits(sat_p99=150.0, max_mount=86400.0, max_pct=20.0, max_lag=86400.0)
SETTINGS = (law.Setting("off"), law.Setting("on", 2.0, True))

TICKS = TRACE.replace("trace AS (\n  SELECT run, seq, ts,", "trace AS (\n  SELECT run, seq, round(ts - 1704067200.0::DOUBLE, 3) AS ts,")
EPISODES = """chg AS (SELECT * FROM (SELECT run, seq, ts, up, coalesce(lag(up) OVER (PARTITION BY run ORDER BY seq), false) AS pv FROM trace) WHERE up <> pv),
chn AS (SELECT *, lead(ts) OVER (PARTITION BY run ORDER BY seq) AS nt FROM chg),
eps AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY seq) AS n, ts AS m0, nt AS m1 FROM chn WHERE up)"""
SPIKES = """spk AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY day) AS i, day * 86400.0::DOUBLE AS t0,
    (day + 2) * 86400.0::DOUBLE AS t1, day * 600.0::DOUBLE AS ms, day * 300.0::DOUBLE AS rs
  FROM (SELECT DISTINCT run, CAST(floor((ts - 1704067200.0::DOUBLE) / 86400) AS BIGINT) AS day FROM ev) WHERE day % 10 = 2)"""
FACTS = """snt AS (SELECT spk.run, i, arg_max(sent, seq) AS sent FROM spk JOIN trace t ON t.run = spk.run AND t.ts <= t1 GROUP BY 1, 2),
inn AS (SELECT spk.run, spk.i, min(ts) FILTER (ts <= t1 AND p99 >= 150) AS sat, arg_min(offered_rps, ts) FILTER (ts <= t1 AND p99 >= 150) AS sat_rps,
    max(p99) FILTER (ts <= t1) AS peak, min(ts) FILTER (ts >= t1 AND done >= sent_at) AS answered
  FROM spk JOIN (SELECT run, i, sent AS sent_at FROM snt) USING (run, i)
  JOIN trace t ON t.run = spk.run AND ts BETWEEN t0 AND t1 + 86400 GROUP BY 1, 2),
facts AS (SELECT spk.*, sat, sat_rps, coalesce(peak, 0) AS peak,
    CASE WHEN snt.sent IS NULL THEN 0 WHEN answered IS NULL THEN 86400 WHEN answered - t1 >= 3 THEN answered - t1 ELSE 0 END AS lag
  FROM spk LEFT JOIN snt USING (run, i) LEFT JOIN inn USING (run, i))"""


def parts(spark, sf):
    t = tables.ticks(spark, sf)
    return t, tables.spikes(spark, sf), traces.episodes(t)


@query("trace_episodes", with_ctes(TICKS, EPISODES, "SELECT run, n, m0, m1 FROM eps"))
def trace_episodes(spark, sf):
    return traces.episodes(tables.ticks(spark, sf))


@query("spike_facts", with_ctes(TICKS, SPIKES, FACTS,
       "SELECT run, i, t0, t1, sat, sat_rps, peak, round(lag, 3) AS lag FROM facts"))
def spike_facts(spark, sf):
    t, s, _ = parts(spark, sf)
    return traces.spike_facts(t, s, 150.0, 86400.0, WIDTH).withColumn("lag", F.round("lag", 3))


@query("calibration_values", with_ctes(TICKS, SPIKES, FACTS, EPISODES, """
fe AS (SELECT f.run, f.i, min(m0) AS m0, arg_min(m1, m0) AS m1 FROM facts f JOIN eps ON eps.run = f.run AND m0 BETWEEN t0 - 3 AND t1 GROUP BY 1, 2),
v AS (SELECT f.*, fe.m0, (SELECT m1 FROM eps e WHERE e.run = f.run AND e.m0 = fe.m0) AS m1 FROM facts f LEFT JOIN fe USING (run, i)),
u AS (SELECT run, 'spike' || i || '_lag_s' AS name, round(lag, 3) AS value FROM v
  UNION ALL SELECT run, 'spike' || i || '_sat_s', round(sat - t0, 3) FROM v
  UNION ALL SELECT run, 'spike' || i || '_sat_rps', CAST(sat_rps AS DOUBLE) FROM v WHERE sat IS NOT NULL
  UNION ALL SELECT run, 'spike' || i || '_mount_s', round(m0 - sat, 3) FROM v
  UNION ALL SELECT run, 'spike' || i || '_release_s', round(m1 - (t1 + lag), 3) FROM v WHERE sat IS NOT NULL)""",
    "SELECT * FROM u WHERE value IS NOT NULL"))
def calibration_values(spark, sf):
    t, s, eps = parts(spark, sf)
    return traces.calibration_values(traces.spike_facts(t, s, 150.0, 86400.0, WIDTH), eps, WIDTH)


DELAYS = """dl AS (SELECT f.run, f.i, sat, t0, lead(t0) OVER (PARTITION BY f.run ORDER BY f.i) - 3 AS nd FROM facts f),
delays AS (SELECT dl.run, i, round(greatest(min(m0) - max(sat), 0), 2) AS delay FROM dl
  LEFT JOIN eps ON eps.run = dl.run AND m0 >= t0 - 3 AND (nd IS NULL OR m0 < nd) GROUP BY 1, 2),
delays2 AS (SELECT dl.run, dl.i, CASE WHEN sat IS NOT NULL AND EXISTS (SELECT 1 FROM eps WHERE eps.run = dl.run AND m0 >= t0 - 3 AND (nd IS NULL OR m0 < nd)) THEN delay END AS delay
  FROM dl JOIN delays USING (run, i))"""


@query("spike_mount_delays", with_ctes(TICKS, SPIKES, FACTS, EPISODES, DELAYS, "SELECT run, i, delay FROM delays2"))
def spike_mount_delays(spark, sf):
    t, s, eps = parts(spark, sf)
    return traces.spike_mount_delays(traces.spike_facts(t, s, 150.0, 86400.0, WIDTH), eps, WIDTH)


FIRSTS = """tm AS (SELECT *, kind = 'click' AND p99 > 120 AS dec, p99 > 60 AS claim, offered_rps % 2 = 0 AS probe FROM trace),
mt AS (SELECT run, min(ts) FILTER (claim AND probe) AS mount, min(ts) FILTER (dec) AS decision, min(ts) FILTER (p99 >= 150) AS saturation FROM tm GROUP BY run),
firsts AS (SELECT mt.run, max(decision) AS decision, max(mount) AS mount, min(ts) FILTER (NOT claim AND NOT probe AND ts > mount) AS release,
    max(saturation) AS saturation FROM mt JOIN tm USING (run) GROUP BY mt.run)"""


def _firsts(t):
    return traces.first_times(t, (F.col("kind") == "click") & (F.col("p99") > 120), F.col("p99") > 60, F.col("offered_rps") % 2 == 0, 150.0)


@query("first_time_events", with_ctes(TICKS, FIRSTS, "SELECT * FROM firsts"))
def first_time_events(spark, sf):
    return _firsts(tables.ticks(spark, sf))


@query("mount_delays", with_ctes(TICKS, SPIKES, FACTS, EPISODES, DELAYS, FIRSTS, """
    SELECT firsts.run, CASE WHEN mount IS NULL THEN NULL WHEN decision IS NOT NULL THEN round(greatest(mount - decision, 0), 2)
      WHEN d.run IS NOT NULL THEN d.delay ELSE round(greatest(mount - saturation, 0), 2) * CASE WHEN saturation IS NULL THEN NULL ELSE 1 END END AS mount_delay_s
    FROM firsts LEFT JOIN (SELECT * FROM delays2 WHERE i = 1) d ON d.run = firsts.run"""))
def mount_delays(spark, sf):
    t, s, eps = parts(spark, sf)
    d = traces.spike_mount_delays(traces.spike_facts(t, s, 150.0, 86400.0, WIDTH), eps, WIDTH)
    return traces.mount_delay(_firsts(t), d)


ERR = "'load errors ' || errors || '/' || total || ' = ' || printf('%.1f', err_pct) || '% > 20% (the policy must serve every request)'"
RUNS = """rn AS (SELECT run, CASE WHEN run % 25 <> 0 THEN 1 END AS started, count(*) AS total, count(*) FILTER (kind = 'error') AS errors FROM ev GROUP BY run),
rf AS (SELECT rn.*, 100.0::DOUBLE * errors / total AS err_pct, (SELECT arg_max(ts, seq) FROM trace t WHERE t.run = rn.run) AS last_ts,
    (SELECT count(*) FROM eps e WHERE e.run = rn.run) AS n_eps, coalesce((SELECT arg_max(coalesce(m1, -1), n) FROM eps e WHERE e.run = rn.run), 0) <> -1 AS released FROM rn)"""
JUDGE = """st AS (SELECT * FROM (VALUES ('off', 0.0::DOUBLE, false), ('on', 2.0::DOUBLE, true)) t(setting, k, pre)),
a1 AS (SELECT f.*, st.*, coalesce(lag(lag) OVER (PARTITION BY f.run, setting ORDER BY f.i), 0) AS pl, lead(t0) OVER (PARTITION BY f.run, setting ORDER BY f.i) AS nt,
    count(*) OVER (PARTITION BY f.run, setting) AS ns, k * ms AS mt, k * rs AS rt FROM facts f, st),
a2 AS (SELECT a1.*, h.n AS hn, h.m0 AS h0, h.m1 AS h1, o.n AS onn, o.m0 AS o0, p.n AS pn, p.m0, p.m1, rf.* EXCLUDE (run)
  FROM a1 LEFT JOIN eps h ON h.run = a1.run AND h.m0 < t0 - 3 - mt AND (h.m1 IS NULL OR h.m1 > t0 + 3)
  LEFT JOIN eps o ON o.run = a1.run AND o.m0 <= t0 + 3 AND (o.m1 IS NULL OR o.m1 > t0 + 3)
  LEFT JOIN eps p ON p.run = a1.run AND p.n = a1.i JOIN rf ON rf.run = a1.run),
a3 AS (SELECT *, 'p99 max ' || printf('%.0f', peak) || 'ms < 150ms over [' || printf('%.0f', t0) || '..' || printf('%.0f', t1) || ']' AS span,
    CASE WHEN err_pct > 20 THEN '; ' || ERRTXT ELSE '' END AS perr FROM a2),
a4 AS (SELECT *, CASE
    WHEN hn IS NOT NULL AND pl > 0 AND err_pct <= 20 AND h1 IS NOT NULL AND h1 <= t0 + pl + 3 THEN
      'void|spike ' || (i - 1) || '''s traffic was answered ' || printf('%.0f', pl) || 's past its schedule and episode ' || hn || ' was released within that time, inside spike ' || i || ' (ts=' || printf('%.0f', h1) || ') — the host is too slow for this schedule'
    WHEN sat IS NULL AND hn IS NOT NULL THEN 'false|episode ' || hn || ' never released before spike ' || i || ' (its cache absorbed the spike: ' || span || ')' || perr
    WHEN sat IS NULL AND pre AND onn IS NOT NULL THEN 'false|episode ' || onn || ' mounted before spike ' || i || ' (ts=' || printf('%.0f', o0) || ', spike at ' || printf('%.0f', t0) || ') with no earlier spike to hold it, and absorbed it: ' || span || perr
    WHEN sat IS NULL AND err_pct > 20 THEN 'false|spike ' || i || ' never saturated the store (' || span || ') while requests failed — the service did not answer' || perr
    WHEN sat IS NULL THEN 'void|spike ' || i || ' never saturated the store (' || span || ') — the host''s knee is above the ramp; raise [load] top' END AS stop,
    concat_ws('; ',
      CASE WHEN pn IS NOT NULL AND NOT (m0 BETWEEN t0 - 3 - mt AND sat + 86400 + mt) THEN 'mount ' || i || ' at ts=' || printf('%.0f', m0) || ' outside spike ' || i || '''s window [' || printf('%.0f', t0 - 3 - mt) || '..' || printf('%.0f', sat + 86400 + mt) || '] (saturated at ts=' || printf('%.0f', sat) || ', deadline 86400s after it)' END,
      CASE WHEN m1 < t1 - 3 - rt THEN 'episode ' || i || ' released MID-spike (ts=' || printf('%.0f', m1) || ' < spike end ' || printf('%.0f', t1) || ')' END,
      CASE WHEN pn IS NOT NULL AND m1 IS NULL AND nt IS NOT NULL THEN 'episode ' || i || ' never released before spike ' || (i + 1)
        WHEN m1 > coalesce(nt, last_ts + 3) + lag + 3 + rt THEN 'episode ' || i || ' released too late (ts=' || printf('%.0f', m1) || ', next spike at ' || printf('%.0f', coalesce(nt, last_ts + 3)) || CASE WHEN lag > 0 THEN ', traffic ' || printf('%.0f', lag) || 's past schedule' ELSE '' END || ')' END) AS why
  FROM a3),
a5 AS (SELECT run, setting, arg_min(stop, i) FILTER (stop IS NOT NULL) AS stop, max(started) AS started,
    string_agg(why, '; ' ORDER BY i) FILTER (why <> '') AS why, max(ns) AS ns, max(n_eps) AS n_eps, bool_and(released) AS released, max(err_pct) AS err_pct, max(errors) AS errors, max(total) AS total
  FROM a4 GROUP BY run, setting),
a6 AS (SELECT *, concat_ws('; ', CASE WHEN n_eps <> ns THEN 'expected ' || ns || ' mount episode(s) (one per spike), saw ' || n_eps END, why,
    CASE WHEN n_eps > 0 AND NOT released THEN 'cache never released after the tail (traffic below the knee must release it)' END, CASE WHEN err_pct > 20 THEN ERRTXT END) AS rest FROM a5),
judged AS (SELECT run, setting, CASE WHEN started IS NULL THEN 'void' WHEN stop IS NOT NULL THEN split_part(stop, '|', 1) WHEN rest = '' THEN 'true' ELSE 'false' END AS verdict,
    CASE WHEN started IS NULL THEN 'the load generator''s start was not recorded — its schedule cannot be placed on the trace' WHEN stop IS NOT NULL THEN split_part(stop, '|', 2) ELSE rest END AS reasons FROM a6)""".replace("ERRTXT", ERR)
LAW = [TICKS, EPISODES, SPIKES, FACTS, RUNS, JUDGE]


@query("load_shape_law", with_ctes(*LAW, "SELECT * FROM judged"))
def load_shape_law(spark, sf):
    t, s, _ = parts(spark, sf)
    return law.judge(t, s, tables.law_runs(spark, sf), LIMITS, WIDTH, SETTINGS)


RECORD = "rec AS (SELECT run, 'v' || CAST(run % 3 AS VARCHAR) AS variant, run % 2 = 0 AS ok FROM rn)"


@query("law_replay", with_ctes(*LAW, RECORD, """
pv AS (SELECT run, max(verdict) FILTER (setting = 'off') AS off, max(verdict) FILTER (setting = 'on') AS on_ FROM judged GROUP BY run),
j AS (SELECT variant, off, on_, ok FROM pv JOIN rec USING (run)),
k AS (SELECT * FROM j UNION ALL SELECT 'total', off, on_, ok FROM j)""",
    "SELECT variant, count(*) AS counted, count(*) FILTER ((off = 'true') = ok) AS off_agrees, "
    + ", ".join(f"count(*) FILTER (off = '{a}' AND on_ = '{b}') AS {a}_to_{b}" for a in ("true", "false", "void")
                for b in ("true", "false", "void") if a != b) + " FROM k GROUP BY variant"))
def law_replay(spark, sf):
    t, s, _ = parts(spark, sf)
    runs = tables.law_runs(spark, sf)
    rec = runs.select("run", F.concat(F.lit("v"), (F.col("run") % 3).cast("string")).alias("variant"), (F.col("run") % 2 == 0).alias("ok"))
    return law.replay_changes(law.judge(t, s, runs, LIMITS, WIDTH, SETTINGS), rec)


@query("load_shape_law_unscheduled", with_ctes(TICKS, EPISODES, RUNS, """
h AS (SELECT run, arg_min(ts, seq) FILTER (p99 >= 150) AS sat, max(p99) AS peak FROM trace GROUP BY run),
f AS (SELECT rf.*, sat, peak, (SELECT m0 FROM eps e WHERE e.run = rf.run AND n = 1) AS m0 FROM rf JOIN h USING (run)),
g AS (SELECT *, concat_ws('; ', CASE WHEN n_eps = 0 THEN 'cache never mounted under load' END,
    CASE WHEN n_eps > 1 THEN 'cache flapped (' || n_eps || ' mount episodes; the policy must hold through the sustained spike)' END,
    CASE WHEN m0 < sat - 3 THEN 'cache mounted BEFORE saturation (ts=' || printf('%.0f', m0) || ' — a blip must be rejected)'
      WHEN m0 - sat > 86400 THEN 'mount too late: saturation->mount ' || printf('%.0f', m0 - sat) || 's > 86400s' END,
    CASE WHEN n_eps > 0 AND NOT released THEN 'cache never released after the tail (traffic below the knee must release it)' END,
    CASE WHEN err_pct > 20 THEN ERRTXT END) AS rest,
    'load never saturated the store (p99 max ' || printf('%.0f', peak) || 'ms < 150ms)' AS un FROM f)""".replace("ERRTXT", ERR),
    """SELECT run, CASE WHEN sat IS NULL THEN CASE WHEN err_pct > 20 THEN 'false' ELSE 'void' END WHEN rest = '' THEN 'true' ELSE 'false' END AS verdict,
    CASE WHEN sat IS NULL AND err_pct > 20 THEN un || ' while requests failed — the service did not answer; ' || ERRTXT
      WHEN sat IS NULL THEN un || ' — the host''s knee is above the ramp; raise [load] top' ELSE rest END AS reasons FROM g""".replace("ERRTXT", ERR)))
def load_shape_law_unscheduled(spark, sf):
    return law.judge_unscheduled(tables.ticks(spark, sf), tables.law_runs(spark, sf), LIMITS)


@query("replay_skips", """WITH r AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'files missing' WHEN o_orderkey % 19 = 0 THEN 'unreadable'
    WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN 'decided before the law' END AS why FROM orders)
SELECT coalesce(why, 'judged') AS why, count(*) AS n FROM r GROUP BY 1""")
def replay_skips(spark, sf):
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select((k % 17 != 0).alias("files_ok"), (k % 19 != 0).alias("readable"), (F.col("o_orderstatus") == "F").alias("ok"),
                                          F.when(k % 2 == 0, "e2e").otherwise("scaling").alias("stage"))
    return (r.select(F.coalesce(law.skip_reason(("scaling",)), F.lit("judged")).alias("why"))
            .groupBy("why").agg(F.count(F.lit(1)).alias("n")))


BUSY = EVENTS + """,
isl AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY seq) - row_number() OVER (PARTITION BY run, value > 30 ORDER BY seq) AS g, value > 30 AS hot FROM ev),
str AS (SELECT run, g, count(*) AS n, max(value) AS peak FROM isl WHERE hot GROUP BY run, g HAVING count(*) >= 3)"""


def _busy(spark, sf):
    return tables.events(spark, sf).withColumnRenamed("value", "busy")


@query("busy_spikes", with_ctes(BUSY, "SELECT run, CAST(sum(n) AS BIGINT) AS seconds, round(max(peak), 3) AS peak FROM str GROUP BY run"))
def busy_spikes(spark, sf):
    return traces.busy_spike(_busy(spark, sf), F.lit(30.0), run=3)


@query("busy_p95", with_ctes(EVENTS, "o AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY value) AS r, count(*) OVER (PARTITION BY run) AS n FROM ev)",
       "SELECT run, round(max(value) FILTER (r = CAST(ceil(0.95::DOUBLE * n) AS BIGINT)), 3) AS p95 FROM o GROUP BY run"))
def busy_p95(spark, sf):
    p = ranks.nearest_rank(tables.events(spark, sf), ["run"], "value", 0.95, "p95")
    return p.select("run", F.round("p95", 3).alias("p95"))


@query("host_spike_marks", with_ctes(EVENTS, """
p AS (SELECT run, round(max(value) FILTER (r = CAST(ceil(0.5::DOUBLE * n) AS BIGINT)), 3) AS p FROM (SELECT run, value,
    row_number() OVER (PARTITION BY run ORDER BY value) AS r, count(*) OVER (PARTITION BY run) AS n FROM ev) GROUP BY run),
q AS (SELECT ev.run, seq, value, p + 0.15::DOUBLE AS lim FROM ev JOIN p USING (run)),
isl AS (SELECT run, value, lim, value > lim AS hot, row_number() OVER (PARTITION BY run ORDER BY seq) - row_number() OVER (PARTITION BY run, value > lim ORDER BY seq) AS g FROM q),
str AS (SELECT run, g, count(*) AS n, max(value) AS peak, max(lim) AS lim FROM isl WHERE hot GROUP BY run, g HAVING count(*) >= 5)""",
    "SELECT run, CAST(sum(n) AS BIGINT) AS seconds, round(max(peak), 3) AS peak FROM str GROUP BY run"))
def host_spike_marks(spark, sf):
    ref = ranks.nearest_rank(tables.events(spark, sf), ["run"], "value", 0.5, "p").select("run", (F.round("p", 3) + 0.15).alias("limit"))
    return traces.busy_spike(_busy(spark, sf).join(ref, "run"), F.col("limit"))


@query("clamped_percentiles", with_ctes(EVENTS, "o AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY value) AS r, count(*) OVER (PARTITION BY run) AS n FROM ev)",
       "SELECT run, max(value) FILTER (r = least(n, CAST(floor(0.9::DOUBLE * n) AS BIGINT) + 1)) AS p90 FROM o GROUP BY run"))
def clamped_percentiles(spark, sf):
    return ranks.clamp_index(tables.events(spark, sf), ["run"], "value", 0.9, "p90").select("run", "p90")


@query("sliding_percentiles", with_ctes(EVENTS, """
tk AS (SELECT DISTINCT run, (floor(ts / 86400) + 1) * 86400 AS tick FROM ev),
w AS (SELECT tk.run, tick, value, row_number() OVER (PARTITION BY tk.run, tick ORDER BY value) AS r, count(*) OVER (PARTITION BY tk.run, tick) AS n
  FROM tk JOIN ev ON ev.run = tk.run AND ts BETWEEN tick - 172800 AND tick)""",
    "SELECT run, tick, max(value) FILTER (r = least(n, CAST(floor(0.99::DOUBLE * n) AS BIGINT) + 1)) AS p99 FROM w GROUP BY 1, 2"))
def sliding_percentiles(spark, sf):
    e = tables.events(spark, sf)
    ticks = e.select("run", ((F.floor(F.col("ts") / 86400) + 1) * 86400).cast("double").alias("tick")).distinct()
    pts = e.select("run", F.col("ts").alias("at"), F.col("value").alias("latency"))
    return traces.sliding_percentile(pts, ticks, 172800.0, 0.99, "p99")


@query("counter_rates", with_ctes(TICKS, "p AS (SELECT run, seq, ts, sent, lag(ts) OVER w AS pt, lag(done) OVER w AS pc, done FROM trace WINDOW w AS (PARTITION BY run ORDER BY seq))",
       "SELECT run, seq, round((done - pc) / greatest(ts - pt, 1e-3::DOUBLE), 6) AS rate FROM p"))
def counter_rates(spark, sf):
    r = traces.counter_rates(tables.ticks(spark, sf), "done", "rate")
    return r.select("run", "seq", F.round("rate", 6).alias("rate"))


STATUS = EVENTS + """,
pts AS (SELECT run, seq, CASE k % 8 WHEN 0 THEN '200' WHEN 1 THEN '404' WHEN 2 THEN '429' WHEN 3 THEN '503' WHEN 4 THEN '0' WHEN 5 THEN '' WHEN 6 THEN 'none' ELSE '302' END AS status FROM ev),
bk AS (SELECT *, CASE WHEN status = '404' THEN 'http_404' WHEN status = '429' THEN 'http_429' WHEN status IN ('200', '302') THEN 'http_2xx' WHEN status = '503' THEN 'http_5xx' ELSE 'err' END AS b FROM pts)"""


def _points(spark, sf):
    status = F.array(*[F.lit(s) for s in ("200", "404", "429", "503", "0", "", "none", "302")])
    return tables.events(spark, sf).select("run", "seq", "chunk", status[(F.col("k") % 8).cast("int")].alias("status"))


@query("response_mix", with_ctes(STATUS, "SELECT run, seq, " + ", ".join(
    f"CAST(sum(CASE WHEN b = '{k}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {k}" for k in ("http_2xx", "http_404", "http_429", "http_5xx", "err"))
    + " FROM bk WINDOW w AS (PARTITION BY run ORDER BY seq)"))
def response_mix(spark, sf):
    return traces.response_mix(_points(spark, sf)).drop("chunk", "status")


@query("status_buckets", with_ctes(STATUS, "SELECT b AS bucket, count(*) AS n FROM bk GROUP BY 1"))
def status_buckets(spark, sf):
    p = _points(spark, sf).select(traces.status_bucket(F.col("status")).alias("bucket"))
    return p.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("point_times", with_ctes(EVENTS, "SELECT seq, CASE WHEN k % 10 = 9 THEN NULL ELSE round(floor(ts) + k / 1000.0::DOUBLE + 7e-9::DOUBLE - CASE WHEN k % 2 = 1 THEN 7200 ELSE 0 END, 6) END AS at FROM ev"))
def point_times(spark, sf):
    e = tables.events(spark, sf)
    clock = F.date_format(F.timestamp_seconds(F.floor("ts").cast("long")), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(F.col("k") % 10 == 9, F.lit("later")).otherwise(F.concat(
        clock, F.lit("."), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit("000007"), F.when(F.col("k") % 2 == 1, "+02:00").otherwise("Z")))
    return e.select("seq", F.round(traces.point_epoch(stamp), 6).alias("at"))


@query("first_requests", with_ctes(EVENTS, "SELECT run, arg_min(ts, seq) AS first_at FROM ev WHERE kind = 'view' GROUP BY run"))
def first_requests(spark, sf):
    return tables.events(spark, sf).where("kind = 'view'").groupBy("run").agg(F.min_by("ts", "seq").alias("first_at"))


@query("load_summaries", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END AS total,
    CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(round_even((o_orderkey % 100) / 400.0::DOUBLE * o_custkey, 0) AS BIGINT) + CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 5 ELSE 0 END END AS errors,
    CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 = 0 THEN o_orderkey % 5 ELSE 0 END AS content FROM orders""")
def load_summaries(spark, sf):
    k = F.col("o_orderkey")
    doc = F.to_json(F.struct(F.struct(
        F.struct(F.col("o_custkey").alias("count")).alias("http_reqs"),
        F.struct(((k % 100) / F.lit(400.0)).alias("value")).alias("http_req_failed"),
        F.when(k % 4 == 0, F.struct((k % 5).alias("count"))).alias("content_errors")).alias("metrics")))
    s = traces.load_summary(F.when(k % 9 == 0, F.lit("not json")).otherwise(doc))
    return table(spark, sf, "orders").select("o_orderkey", s["total"].alias("total"), s["errors"].alias("errors"), s["content"].alias("content"))


@query("schedules", """WITH s AS (SELECT o_orderkey AS run, ['BBS', 'BSB', 'SBB', 'SSB', 'SBS', 'BSS'][o_orderkey % 6 + 1] AS shape FROM orders),
e AS (SELECT run, shape, unnest(range(1, 4)) AS i FROM s),
d AS (SELECT *, substr(shape, i, 1) AS ev, CASE WHEN len(replace(shape, 'B', '')) >= 2 THEN 15 ELSE 8 END AS base,
    CASE WHEN substr(shape, i, 1) = 'B' THEN 22 WHEN len(replace(shape, 'B', '')) >= 2 THEN 48 ELSE 53 END AS ln FROM e),
c AS (SELECT *, sum(base + ln) OVER (PARTITION BY run ORDER BY i) AS t FROM d)
SELECT run, shape, CAST(i AS INT) AS i, CASE ev WHEN 'B' THEN 'blip' ELSE 'spike' END AS kind, CAST(t - ln AS DOUBLE) AS t0, CAST(t AS DOUBLE) AS t1 FROM c""")
def schedules(spark, sf):
    shapes = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), traces.curated_shape(F.col("o_orderkey")).alias("shape"))
    return traces.expand_schedule(shapes)


@query("arrangement_seconds", """WITH r AS (SELECT o_custkey AS cell, o_orderpriority AS arrangement, o_orderkey, o_orderstatus = 'F' AS green,
    CAST(epoch(o_orderdate) AS DOUBLE) AS started, epoch(o_orderdate) + o_totalprice AS ended FROM orders)
SELECT cell, arrangement, round(arg_max(ended - started, o_orderkey), 3) AS seconds FROM r WHERE green GROUP BY 1, 2""")
def arrangement_seconds(spark, sf):
    start = tables.epoch(F.col("o_orderdate"))
    r = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("cell"), F.col("o_orderpriority").alias("arrangement"), "o_orderkey",
        (start + F.col("o_totalprice") - start).alias("s"))
    return r.groupBy("cell", "arrangement").agg(F.round(F.max_by("s", "o_orderkey"), 3).alias("seconds"))


@query("trace_seconds", with_ctes(EVENTS, "SELECT seq, CASE WHEN run % 3 <> 0 AND k % 4 <> 0 THEN round(ts - 1704067200.0::DOUBLE, 3) WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) ELSE 0.0::DOUBLE END AS second FROM ev"))
def trace_seconds(spark, sf):
    e = tables.events(spark, sf)
    return e.select("seq", traces.second(F.when(F.col("k") % 4 != 0, F.col("ts")), F.when(F.col("run") % 3 != 0, F.lit(tables.START_EPOCH)),
                                         F.when(F.col("k") % 5 != 0, F.col("k").cast("double"))).alias("second"))
