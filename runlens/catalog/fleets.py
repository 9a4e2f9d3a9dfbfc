"""Fleet status, backlog, alerts and dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import EVENTS
from runlens.catalog.ledgers import FOLD
from runlens.operators import ledger as L
from runlens.plans import fleet
from runlens.sources import dimensions, tables

CELLS = """fc AS (SELECT c_custkey AS cell, c_custkey % 17 = 0 AS cancelled, CASE WHEN c_custkey % 6 = 1 THEN 'operator' END AS pause,
    CASE c_custkey % 5 WHEN 0 THEN 'agent' WHEN 1 THEN 'verify' WHEN 2 THEN 'limit' END AS phase, CASE WHEN c_custkey % 4 = 0 THEN 'usage limit hit' ELSE 'not logged in' END AS wait_reason,
    c_custkey % 3 = 0 AS looping, c_custkey % 2 = 0 AS queued FROM customer WHERE c_custkey <= 400 OR c_custkey > 400)"""
STATUS = """s0 AS (SELECT fc.*, fold.* EXCLUDE (cell), CASE WHEN phase = 'limit' THEN 'WAITING' WHEN phase IS NOT NULL THEN 'RUNNING' WHEN looping THEN 'RUNNING' ELSE 'CRASHED' END AS ls,
    CASE WHEN phase IS NOT NULL THEN phase WHEN looping THEN 'idle' ELSE 'loop' END AS lw,
    CASE WHEN phase = 'limit' THEN wait_reason WHEN phase IS NOT NULL OR looping THEN '' WHEN queued THEN 'no loop — queued, admission resumes it' ELSE 'no loop — resume the cell' END AS ld
  FROM fc LEFT JOIN fold ON fold.cell = fc.cell),
s1 AS (SELECT *, cancelled OR verdict IS NOT NULL AS dn, pause IS NOT NULL AND ls = 'CRASHED' AS pz, coalesce(last_ev = 'HALT', false) AND ls = 'CRASHED' AS hl FROM s0),
stt AS (SELECT cell, CASE WHEN dn THEN 'DONE' WHEN pz THEN 'PAUSED' WHEN hl THEN 'CRASHED' ELSE ls END AS state,
    CASE WHEN cancelled THEN 'cancelled' WHEN dn THEN verdict WHEN pz THEN pause WHEN hl THEN CASE WHEN contains(halt_cause, 'infra') THEN 'infra' ELSE 'agent' END ELSE lw END AS why,
    CASE WHEN cancelled THEN '' WHEN verdict = 'revoked' THEN 'green revoked by the 6-shape gate' WHEN dn OR pz THEN '' WHEN hl THEN halt_cause WHEN pause IS NOT NULL THEN trim(ld || '  (pause pending)') ELSE ld END AS detail,
    CASE WHEN dn THEN coalesce(att, 0) ELSE greatest(coalesce(att, 0) + CASE WHEN last_ev = 'ITER' THEN 0 ELSE 1 END, 1) END AS att,
    CASE WHEN NOT cancelled AND verdict = 'green' THEN green_at END AS green_at,
    CASE WHEN phase = 'verify' AND NOT coalesce(reverify_active, false) THEN coalesce(live_shape_pass, 0) || '/6*' WHEN reverify_active THEN rev_pass || '/6' WHEN gate IS NOT NULL THEN gate || '/6' ELSE '-' END AS shape,
    coalesce((CASE WHEN dn THEN 'DONE' WHEN pz THEN 'PAUSED' WHEN hl THEN 'CRASHED' ELSE ls END) = 'CRASHED' AND (events IS NULL OR (events = 1 AND prepared)), false) AS never_started,
    coalesce(noedit, 0) AS noedit, noedit_last, coalesce(alerts_open, 0) AS alerts_open, alert_last, queued, looping, pause IS NOT NULL AS paused FROM s1)"""
CELLS = CELLS.replace(" WHERE c_custkey <= 400 OR c_custkey > 400", "")


def cells(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("cell"), (c % 17 == 0).alias("cancelled"), F.when(c % 6 == 1, "operator").alias("pause"),
        F.when(c % 5 == 0, "agent").when(c % 5 == 1, "verify").when(c % 5 == 2, "limit").alias("phase"),
        F.when(c % 4 == 0, "usage limit hit").otherwise("not logged in").alias("wait_reason"), (c % 3 == 0).alias("looping"), (c % 2 == 0).alias("queued"))


def status(spark, sf):
    return fleet.status(L.fold(tables.ledger(spark, sf)), cells(spark, sf))


@query("fleet_status", with_ctes(FOLD, CELLS, STATUS, "SELECT * FROM stt"))
def fleet_status(spark, sf):
    return status(spark, sf)


@query("finished_cells", with_ctes(FOLD, CELLS, STATUS, "SELECT cell, why AS outcome FROM stt WHERE state = 'DONE' AND why <> 'cancelled'"))
def finished_cells(spark, sf):
    from runlens.plans.scoring import finished
    return finished(status(spark, sf)).select("cell", F.col("why").alias("outcome"))


@query("outcome_counts", with_ctes(FOLD, CELLS, STATUS, "SELECT state, why, count(*) AS cells FROM stt GROUP BY 1, 2"))
def outcome_counts(spark, sf):
    return status(spark, sf).groupBy("state", "why").agg(F.count(F.lit(1)).alias("cells"))


@query("triage_list", with_ctes(FOLD, CELLS, STATUS, """SELECT cell, 'CRASHED/' || why || ': ' || detail AS reason FROM stt WHERE state = 'CRASHED' AND NOT queued
    UNION ALL SELECT cell, 'waiting on a limit: ' || detail FROM stt WHERE state = 'WAITING' AND why = 'limit'
    UNION ALL SELECT cell, alerts_open || '× ALERT — ' || alert_last FROM stt WHERE alerts_open > 0 AND state NOT IN ('DONE', 'PAUSED')
    UNION ALL SELECT cell, noedit || '× NOEDIT — investigate (agent fault or no-op): ' || noedit_last FROM stt WHERE noedit > 0 AND NOT (state = 'DONE' AND why = 'green')"""))
def triage_list(spark, sf):
    return fleet.triage(status(spark, sf))


SPECS = """sp AS (SELECT o_orderkey AS seq, o_custkey AS cell, 'lane' || (o_custkey % 5) AS lane FROM orders),
fg AS (SELECT c_custkey AS cell, c_custkey % 8 = 3 AS flagged FROM customer WHERE c_custkey % 9 <> 0),
pk AS (SELECT sp.*, CASE WHEN fg.cell IS NULL THEN 'fresh' WHEN flagged THEN 'flagged' WHEN coalesce(paused, false) THEN 'paused' WHEN coalesce(looping, false) THEN 'running'
    WHEN state = 'DONE' THEN 'done' WHEN coalesce(never_started, false) THEN 'prepared' ELSE 'interrupted' END AS kind FROM sp LEFT JOIN fg USING (cell) LEFT JOIN stt USING (cell))"""


def _specs(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("cell"), F.concat(F.lit("lane"), (F.col("o_custkey") % 5).cast("string")).alias("lane"))
    flags = table(spark, sf, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("cell"), (F.col("c_custkey") % 8 == 3).alias("flagged"))
    return fleet.pending_kind(o, status(spark, sf), flags)


@query("pending_kinds", with_ctes(FOLD, CELLS, STATUS, SPECS, "SELECT seq, cell, lane, kind FROM pk"))
def pending_kinds(spark, sf):
    return _specs(spark, sf)


@query("backlog", with_ctes(FOLD, CELLS, STATUS, SPECS, "SELECT lane, count(*) AS pending, arg_min(cell, (seq, cell)) AS head, "
       + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in fleet.KINDS) + " FROM pk GROUP BY lane"))
def backlog(spark, sf):
    return fleet.backlog(_specs(spark, sf))


WEEKLY = EVENTS + """,
we AS (SELECT run AS lane, floor(ts / 86400) AS mtime, seq AS pos, CASE WHEN kind = 'view' THEN 'five_hour' ELSE 'seven_day' END AS kd, CASE WHEN k % 5 = 0 THEN 'rejected' WHEN k % 5 < 3 THEN 'allowed_warning' ELSE 'allowed' END AS status,
    k / 100.0::DOUBLE AS u, floor(ts) + k * 86400 AS resets_at FROM ev),
wl AS (SELECT lane, arg_max(status, (mtime, pos)) AS status, arg_max(u, (mtime, pos)) AS u, arg_max(resets_at, (mtime, pos)) AS resets_at FROM we WHERE kd = 'seven_day' GROUP BY lane)"""


@query("weekly_readings", with_ctes(WEEKLY, "SELECT lane, CASE WHEN resets_at <= 1707000000 THEN NULL WHEN status = 'rejected' THEN 1.0::DOUBLE WHEN status = 'allowed_warning' THEN u END AS utilization, resets_at FROM wl"))
def weekly_readings(spark, sf):
    k = F.col("k")
    e = tables.events(spark, sf).select(
        F.col("run").alias("lane"), F.floor(F.col("ts") / 86400).alias("mtime"), F.col("seq").alias("pos"), F.when(F.col("kind") == "view", "five_hour").otherwise("seven_day").alias("kind"),
        F.when(k % 5 == 0, "rejected").when(k % 5 < 3, "allowed_warning").otherwise("allowed").alias("status"), (k / 100.0).alias("utilization"),
        (F.floor("ts") + k * 86400).cast("double").alias("resets_at"))
    return fleet.weekly_reading(e, F.lit(1707000000.0))


@query("slow_verify_limits", """WITH r AS (SELECT o_orderpriority AS variant, max(o_totalprice / 1000) AS s FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT o_orderkey AS cell, greatest(420.0::DOUBLE, 1.5::DOUBLE * coalesce(s, 0)) AS limit_s FROM orders LEFT JOIN r ON variant = o_orderpriority""")
def slow_verify_limits(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "variant")
    ref = o.where("o_orderstatus = 'F' AND variant <> '5-LOW'").select("variant", (F.col("o_totalprice") / 1000).alias("seconds"))
    return fleet.slow_limits(o.select(F.col("o_orderkey").alias("cell"), "variant"), ref).select("cell", "limit_s")


WORK = """g AS (SELECT c_custkey, rep FROM customer, range(1, 6) r(rep)),
ran AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 5 + 1 AS rep FROM orders WHERE o_orderstatus = 'F'), q AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 5 + 1 AS rep FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0),
need AS (SELECT * FROM g WHERE (c_custkey, rep) NOT IN (SELECT c, rep FROM ran) AND (c_custkey, rep) NOT IN (SELECT c, rep FROM q))"""


def _missing(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("variant"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("rep"), "o_orderstatus", "o_orderkey")
    v = table(spark, sf, "customer").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("variant"), F.col("c_custkey").alias("ord"))
    return fleet.missing_work(v, 5, o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P' AND o_orderkey % 2 = 0"))


@query("missing_work", "WITH " + WORK + " SELECT CAST(rep AS INT) AS rep, c_custkey AS ord, 'v' || c_custkey AS variant FROM need")
def missing_work(spark, sf):
    return _missing(spark, sf).orderBy("rep", "ord")


@query("reps_left_by_variant", "WITH " + WORK + " SELECT 'v' || c_custkey AS variant, count(*) AS need, CAST(min(rep) AS INT) AS next_rep FROM need GROUP BY 1")
def reps_left_by_variant(spark, sf):
    return _missing(spark, sf).groupBy("variant").agg(F.count(F.lit(1)).alias("need"), F.min("rep").alias("next_rep"))


@query("orphan_resources", """WITH r AS (SELECT 'box-' || o_orderkey AS name, o_custkey AS owner, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey * 13) % 1500 END AS ia, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey * 29) % 7000 END AS oa FROM orders)
SELECT name, owner FROM r WHERE owner NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) AND coalesce(ia, oa) >= CASE WHEN ia IS NOT NULL THEN 600 ELSE 3600 END""")
def orphan_resources(spark, sf):
    k = F.col("o_orderkey")
    r = table(spark, sf, "orders").select(F.concat(F.lit("box-"), k.cast("string")).alias("name"), F.col("o_custkey").alias("owner"),
                                          F.when(k % 3 != 0, k * 13 % 1500).alias("iter_age"), F.when(k % 4 != 0, k * 29 % 7000).alias("own_age"))
    return fleet.orphans(r, table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("cell")))


SWEEP = """sw AS (SELECT o_orderkey AS cell, ['RUNNING', 'WAITING', 'DONE', 'CRASHED'][o_orderkey % 4 + 1] AS state, CASE WHEN o_orderkey % 4 = 1 THEN 'limit' ELSE 'agent' END AS why,
    CASE o_custkey % 3 WHEN 0 THEN 'Please run /login' WHEN 1 THEN 'usage limit' ELSE 'connection refused' END AS detail, o_orderkey % 23 = 0 AS flagged, CASE WHEN o_orderkey % 19 = 0 THEN 'pause' ELSE 'run' END AS intent,
    o_orderkey % 2 = 0 AS loop, o_custkey % 2 = 0 AS in_box, CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 4 * 100 END AS out_size, CASE WHEN o_custkey % 5 <> 0 THEN (o_orderkey * 7) % 1300 END AS out_age,
    (o_orderkey * 11) % 1900 AS iter_age, CASE o_orderkey % 6 WHEN 0 THEN 'AcquireVerify' WHEN 1 THEN 'Admit' WHEN 2 THEN 'Crash' WHEN 3 THEN 'AcquireVerify' WHEN 4 THEN 'VerifyFail' END AS last_action,
    CASE WHEN o_orderkey % 6 < 5 THEN (o_orderkey * 17) % 20000 END AS last_age, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 5) % 900 END AS quiet_s, 420.0::DOUBLE + o_custkey % 100 AS limit_s,
    CASE o_custkey % 4 WHEN 0 THEN 'setup' WHEN 1 THEN 'agent' WHEN 2 THEN 'verify-lock' END AS phase, CASE WHEN o_custkey % 4 < 3 THEN (o_orderkey * 3) % 13000 END AS phase_age,
    CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 31) % 15000 END AS slot_age, o_custkey % 4 AS flat FROM orders),
sx AS (SELECT *, NOT flagged AND intent = 'run' AS go, state = 'DONE' AS dn, state IN ('RUNNING', 'WAITING') AS act, coalesce(quiet_s, last_age) AS slow, coalesce(phase = 'verify-lock', false) AS wt,
    CASE phase WHEN 'setup' THEN 900 WHEN 'agent' THEN 10800 WHEN 'verify-lock' THEN 3600 END AS pl, CASE WHEN phase IN ('agent', 'verify-lock') THEN 0 ELSE coalesce(phase_age, 1801) END AS sil FROM sw)"""


def sweep(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda n, *xs: F.array(*[F.lit(x).cast("string") for x in xs])[n.cast("int")]
    return table(spark, sf, "orders").select(
        k.alias("cell"), pick(k % 4, "RUNNING", "WAITING", "DONE", "CRASHED").alias("state"), F.when(k % 4 == 1, "limit").otherwise("agent").alias("why"),
        pick(c % 3, "Please run /login", "usage limit", "connection refused").alias("detail"), (k % 23 == 0).alias("flagged"), F.when(k % 19 == 0, "pause").otherwise("run").alias("intent"),
        (k % 2 == 0).alias("loop"), (c % 2 == 0).alias("in_box"), F.when(c % 5 != 0, c % 4 * 100).alias("out_size"), F.when(c % 5 != 0, k * 7 % 1300).alias("out_age"), (k * 11 % 1900).alias("iter_age"),
        pick(k % 6, "AcquireVerify", "Admit", "Crash", "AcquireVerify", "VerifyFail", None).alias("last_action"), F.when(k % 6 < 5, k * 17 % 20000).alias("last_age"),
        F.when(k % 7 != 0, k * 5 % 900).alias("quiet_s"), (c % 100 + 420.0).alias("limit_s"), pick(c % 4, "setup", "agent", "verify-lock", None).alias("phase"),
        F.when(c % 4 < 3, k * 3 % 13000).alias("phase_age"), F.when(k % 3 == 0, k * 31 % 15000).alias("slot_age"), (c % 4).alias("flat"))


@query("sweep_alerts", with_ctes(SWEEP, """
    SELECT cell, 'dead-loop' AS rule, 'last=' || last_action AS detail FROM sx WHERE NOT loop AND NOT in_box AND NOT dn AND last_action NOT IN ('Crash') AND coalesce(out_age >= 300, true) AND coalesce(last_age >= 300, true)
    UNION ALL SELECT cell, 'verify-quiet', 'no progress for ' || CAST(slow AS BIGINT) || 's > ' || CAST(limit_s AS BIGINT) || 's' FROM sx WHERE go AND NOT dn AND last_action = 'AcquireVerify' AND slow > limit_s
    UNION ALL SELECT cell, 'verify-wedged', 'held ' || last_age || 's' FROM sx WHERE go AND NOT dn AND last_action = 'AcquireVerify' AND last_age > 14400
    UNION ALL SELECT cell, 'wait-long', phase || ' unchanged ' || phase_age || 's' FROM sx WHERE go AND act AND wt AND phase_age > pl
    UNION ALL SELECT cell, 'phase-stalled', phase || ' unchanged ' || phase_age || 's' FROM sx WHERE go AND act AND NOT wt AND phase_age > pl
    UNION ALL SELECT cell, 'slot-stuck', 'slot held ' || slot_age || 's' FROM sx WHERE go AND act AND slot_age > 10800 AND sil > 1800
    UNION ALL SELECT cell, 'silent-hang', 'flat ' || flat || ' sweeps' FROM sx WHERE go AND NOT dn AND in_box AND (coalesce(out_size, 0) = 0 OR out_age > 600) AND iter_age > 600 AND flat >= 2
    UNION ALL SELECT cell, 'limit-wall', CASE WHEN detail = 'Please run /login' THEN 'AUTH ' ELSE 'limit ' END || detail FROM sx WHERE go AND state = 'WAITING' AND why = 'limit' AND detail <> 'connection refused'
    UNION ALL SELECT cell, 'orphan-loop', 'alive ' || iter_age || 's past the end' FROM sx WHERE go AND dn AND loop AND iter_age >= 600"""))
def sweep_alerts(spark, sf):
    return fleet.alerts(sweep(spark, sf))


@query("memory_pressure_edges", with_ctes(EVENTS, """
l AS (SELECT run // 16 AS host, seq, CASE WHEN k < 60 THEN 1 WHEN k < 85 THEN 2 ELSE 4 END AS level FROM ev),
p AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY host ORDER BY seq), 0) AS was FROM l)""",
    "SELECT host, seq, level, CASE WHEN level >= 2 THEN 'pressure' ELSE 'normal' END AS edge FROM p WHERE (level >= 2 AND level <> was) OR (level < 2 AND was >= 2)"))
def memory_pressure_edges(spark, sf):
    e = tables.events(spark, sf).select(tables.host_of("run").alias("host"), "seq", "chunk", F.when(F.col("k") < 60, 1).when(F.col("k") < 85, 2).otherwise(4).alias("level"))
    return fleet.memory_edges(e)


@query("flat_sweeps", with_ctes(EVENTS, """
r AS (SELECT run AS cell, seq, CASE WHEN k % 3 = 0 THEN seq ELSE seq // 3000 END AS rx, CASE WHEN k % 10 = 0 THEN 2 ELSE 0 END AS cpu FROM ev),
m AS (SELECT *, lag(rx) OVER w AS pr, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY cell ORDER BY seq)),
f AS (SELECT *, max(CASE WHEN cpu > 0.5 OR pr IS NULL OR rx > pr THEN n END) OVER (PARTITION BY cell ORDER BY seq) AS lm FROM m)""",
    "SELECT cell, seq, n - coalesce(lm, 0) AS flat FROM f"))
def flat_sweeps(spark, sf):
    k = F.col("k")
    r = tables.events(spark, sf).select(F.col("run").alias("cell"), "seq", "chunk", F.when(k % 3 == 0, F.col("seq")).otherwise(F.floor(F.col("seq") / 3000)).cast("long").alias("rx"),
                                        F.when(k % 10 == 0, 2.0).otherwise(0.0).alias("cpu"))
    return fleet.flat_sweeps(r).select("cell", "seq", "flat")


@query("first_seals", """WITH f AS (SELECT o_custkey AS cell, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS verdict, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS attempts, min(o_orderdate) AS sealed FROM orders GROUP BY 1)
SELECT cell, verdict, attempts, CAST(epoch(sealed) AS BIGINT) AS sealed FROM f WHERE cell NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)""")
def first_seals(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("cell"), tables.epoch(F.col("o_orderdate")).cast("long").alias("sealed"), F.col("o_orderstatus").alias("verdict"),
                                          F.col("o_orderkey").alias("attempts"), F.lit("cell").alias("by"), F.col("o_orderkey").alias("seq"))
    sealed = table(spark, sf, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("cell"))
    return fleet.first_seals(o, sealed).drop("by")


REFS = """m AS (SELECT l_returnflag AS variant, l_linestatus || l_linenumber AS arrangement, count(*) AS n, avg(l_quantity) AS v, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1, 2)"""


@query("reference_lookups", with_ctes(REFS, "SELECT l_orderkey, l_linenumber, CASE WHEN n > 0 THEN round(v, 4) END AS value FROM lineitem l LEFT JOIN (SELECT * FROM m WHERE arrangement NOT LIKE '%7') m ON m.variant = l_returnflag AND m.arrangement = l_linestatus || l_linenumber"))
def reference_lookups(spark, sf):
    li = table(spark, sf, "lineitem")
    arr = F.concat("l_linestatus", F.col("l_linenumber").cast("string"))
    refs = li.groupBy(F.col("l_returnflag").alias("variant"), arr.alias("arrangement")).agg(F.avg("l_quantity").alias("v"))
    refs = refs.select("variant", "arrangement", F.create_map(F.lit("busy_p95"), F.col("v")).alias("values")).where("arrangement NOT LIKE '%7'")
    runs = li.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("variant"), arr.alias("arrangement"))
    j = dimensions.reference(runs, refs)
    return j.select("l_orderkey", "l_linenumber", F.round(F.try_element_at("values", F.lit("busy_p95")), 4).alias("value"))


@query("calibration_breaks", """WITH r AS (SELECT l_suppkey % 9 AS host, l_returnflag AS variant, l_linestatus AS arrangement, l_linenumber AS n, l_quantity AS q FROM lineitem)
SELECT CAST(host AS VARCHAR) AS host, variant, arrangement, 'appears twice' AS problem FROM r GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT CAST(host AS VARCHAR), variant, arrangement, 'measured needs n >= 2' FROM r WHERE n = 1
UNION ALL SELECT DISTINCT CAST(host AS VARCHAR), variant, arrangement, 'spreads for no value: other' FROM r WHERE q = 50""")
def calibration_breaks(spark, sf):
    r = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 9).cast("string").alias("host"), F.col("l_returnflag").alias("variant"), F.col("l_linestatus").alias("arrangement"),
                                            F.create_map(F.lit("mount_s"), F.col("l_quantity")).alias("values"),
                                            F.create_map(F.when(F.col("l_quantity") == 50, "other").otherwise("mount_s"), F.lit(1.0)).alias("spreads"),
                                            F.lit("measured").alias("spread"), F.col("l_linenumber").alias("n"))
    return dimensions.reference_breaks(r)


@query("dangling_models", "SELECT o_orderkey AS tag, 'agent' || o_custkey AS agent FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def dangling_models(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_orderkey").alias("tag"), F.concat(F.lit("agent"), F.col("o_custkey").cast("string")).alias("agent"))
    a = table(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.concat(F.lit("agent"), F.col("c_custkey").cast("string")).alias("agent"))
    return dimensions.dangling(m, a)


@query("metric_name_intersection", """WITH m AS (SELECT DISTINCT l_suppkey AS run, l_linenumber AS name FROM lineitem)
SELECT name FROM m GROUP BY name HAVING count(*) = (SELECT count(DISTINCT l_suppkey) FROM lineitem)""")
def metric_name_intersection(spark, sf):
    m = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("name")).distinct()
    runs = m.select("run").distinct().agg(F.count(F.lit(1)).alias("runs"))
    # one row with the number of runs
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(runs), F.col("n") == F.col("runs")).select("name")
