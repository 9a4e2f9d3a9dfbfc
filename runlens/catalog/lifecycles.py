"""Lifecycle logs: epochs, incarnations, replay, caps and timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import EVENTS
from runlens.operators import lifecycle as C
from runlens.sources import lines, tables
from runlens.sources.tables import ACTION_OF

LOG = EVENTS + """,
tr AS (SELECT CAST(run AS VARCHAR) AS cid, run // 16 AS log, seq, ts, k % 4 = 0 AS void, CASE WHEN k % 2 = 0 THEN 'loop=none' ELSE 'loop=agent' END AS note,
    CASE kind """ + " ".join(f"WHEN '{k}' THEN {list(v)}[k % 10 + 1]" for k, v in ACTION_OF.items()) + """ END AS action FROM ev)"""


@query("last_epoch_block", with_ctes(LOG, """
p AS (SELECT *, lag(action) OVER (PARTITION BY log ORDER BY seq) AS pa FROM tr),
c AS (SELECT log, max(seq) AS cut FROM p WHERE action = 'EPOCH' AND pa IS DISTINCT FROM 'EPOCH' GROUP BY log)""",
    "SELECT tr.log, tr.seq, tr.action FROM tr LEFT JOIN c USING (log) WHERE cut IS NULL OR seq >= cut"))
def last_epoch_block(spark, sf):
    return C.from_last_epoch(tables.transitions(spark, sf)).select("log", "seq", "action")


@query("cell_incarnations", with_ctes(LOG, """
g AS (SELECT *, coalesce(sum(CASE WHEN action = 'Retire' THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM tr)""",
    "SELECT seq, action, CASE WHEN gen > 0 THEN cid || '#' || CAST(gen AS BIGINT) ELSE cid END AS cid FROM g WHERE action <> 'Retire'"))
def cell_incarnations(spark, sf):
    return C.incarnations(tables.transitions(spark, sf)).select("seq", "action", "cid")


def replayed(spark, sf):
    return C.replay(C.incarnations(tables.transitions(spark, sf)).where("action <> 'EPOCH'"), since=F.col("ts") >= 1705000000.0)


REPLAY = LOG.replace("ev AS (", "RECURSIVE_MARK ev AS (") + """,
inc AS (SELECT * REPLACE (CASE WHEN gen > 0 THEN cid || '#' || CAST(gen AS BIGINT) ELSE cid END AS cid) FROM (SELECT *,
    coalesce(sum(CASE WHEN action = 'Retire' THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gen FROM tr)
  WHERE action NOT IN ('Retire', 'EPOCH', 'Noted')),
num AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY seq) AS r FROM inc),
fold AS (
  SELECT cid, r, seq, ts, log, action, lp0 AS lp, it0 AS it, sl0 AS sl, vf0 AS vf, rg0 AS rg, dn0 AS dn, at0 AS at_, en0 AS en, bad0 AS bad FROM (
    SELECT cid, r, seq, ts, log, action, CASE WHEN action = 'Admit' THEN 'agent' ELSE 'none' END AS lp0,
      CASE action WHEN 'Pause' THEN 'paused' WHEN 'Kill' THEN 'killed' ELSE 'run' END AS it0, action = 'Admit' AS sl0, false AS vf0, false AS rg0, false AS dn0,
      CASE WHEN action = 'Admit' THEN 1 ELSE 0 END AS at0, action IN ('Admit', 'Pause', 'Kill') AS en0, 0 AS bad0 FROM num WHERE r = 1)
  UNION ALL
  SELECT cid, r, seq, ts, log, action,
    CASE WHEN NOT ok THEN lp WHEN action = 'Admit' OR action = 'VerifyFail' THEN 'agent' WHEN action = 'AcquireVerify' THEN 'verify'
      WHEN action IN ('VerifyGreen', 'ReleaseSlot', 'Crash', 'StandDown') THEN 'none' ELSE lp END,
    CASE WHEN NOT ok THEN it WHEN action = 'Pause' THEN 'paused' WHEN action = 'Resume' THEN 'run' WHEN action = 'Kill' THEN 'killed' ELSE it END,
    CASE WHEN NOT ok THEN sl WHEN action = 'Admit' THEN true WHEN action IN ('VerifyGreen', 'ReleaseSlot', 'Crash', 'StandDown') THEN false ELSE sl END,
    CASE WHEN NOT ok THEN vf WHEN action = 'AcquireVerify' THEN true WHEN action IN ('VerifyGreen', 'VerifyFail', 'ReleaseSlot', 'Crash') THEN false ELSE vf END,
    CASE WHEN NOT ok THEN rg WHEN action = 'AcquireRig' THEN true WHEN action IN ('ReleaseRig', 'VerifyGreen', 'ReleaseSlot', 'Crash') THEN false ELSE rg END,
    CASE WHEN ok AND action = 'VerifyGreen' THEN true ELSE dn END,
    at_ + CASE WHEN NOT ok THEN 0 WHEN action = 'Admit' THEN 1 WHEN action IN ('ReleaseSlot', 'Crash') AND lp IN ('agent', 'verify') THEN -1
      WHEN action = 'StandDown' AND lp = 'agent' THEN -1 ELSE 0 END, ok, bad FROM (
    SELECT n.cid, n.r, n.seq, n.ts, n.log, n.action, lp, it, sl, vf, rg, dn, at_, bad + CASE WHEN f.en THEN 0 ELSE 1 END AS bad,
      CASE n.action WHEN 'Admit' THEN lp = 'none' AND it = 'run' AND NOT dn AND NOT sl WHEN 'AcquireVerify' THEN lp = 'agent' AND NOT vf AND it = 'run'
        WHEN 'AcquireRig' THEN lp = 'verify' AND NOT rg WHEN 'ReleaseRig' THEN rg WHEN 'VerifyGreen' THEN lp = 'verify' WHEN 'VerifyFail' THEN lp = 'verify'
        WHEN 'ReleaseSlot' THEN lp <> 'none' WHEN 'Crash' THEN lp <> 'none' WHEN 'StandDown' THEN lp IN ('idle', 'agent') AND it <> 'run'
        WHEN 'Pause' THEN it = 'run' WHEN 'Resume' THEN it = 'paused' WHEN 'Kill' THEN it <> 'killed' END AS ok
    FROM fold f JOIN num n ON n.cid = f.cid AND n.r = f.r + 1))"""
REPLAY = REPLAY.replace("RECURSIVE_MARK ", "")


def recursive(*parts):
    return with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


@query("lifecycle_replay", recursive(REPLAY, "SELECT cid, seq, action, en AS applied, CAST(at_ AS BIGINT) AS attempts, NOT en AND bad > 0 AS cascade, ts >= 1705000000.0::DOUBLE AS judged FROM fold"))
def lifecycle_replay(spark, sf):
    return replayed(spark, sf).select("cid", "seq", "action", "applied", "attempts", "cascade", "judged")


@query("lifecycle_violations", recursive(REPLAY, """SELECT log, count(*) FILTER (NOT en AND ts >= 1705000000.0::DOUBLE) AS violations,
    count(*) FILTER (NOT en AND bad > 0 AND ts >= 1705000000.0::DOUBLE) AS cascades, count(*) FILTER (NOT en AND ts < 1705000000.0::DOUBLE) AS stale, count(*) AS events FROM fold GROUP BY log"""))
def lifecycle_violations(spark, sf):
    r, bad = replayed(spark, sf), ~F.col("applied")
    return r.groupBy("log").agg(F.count_if(bad & F.col("judged")).alias("violations"), F.count_if(F.col("cascade") & F.col("judged")).alias("cascades"),
                                F.count_if(bad & ~F.col("judged")).alias("stale"), F.count(F.lit(1)).alias("events"))


@query("concurrency_caps", recursive(REPLAY, """
ch AS (SELECT log, seq, en, CAST(sl AS INT) - coalesce(lag(CAST(sl AS INT)) OVER w, 0) AS ds, CAST(vf AS INT) - coalesce(lag(CAST(vf AS INT)) OVER w, 0) AS dv FROM fold WINDOW w AS (PARTITION BY cid ORDER BY r)),
cc AS (SELECT log, seq, sum(ds) OVER (PARTITION BY log ORDER BY seq) AS slots, sum(dv) OVER (PARTITION BY log ORDER BY seq) AS verifies FROM ch WHERE en)""",
    "SELECT log, CAST(max(slots) AS BIGINT) AS most_slots, CAST(max(verifies) AS BIGINT) AS most_verifies, count(*) FILTER (slots > 2) AS over_work_cap, count(*) FILTER (verifies > 1) AS over_verify_cap FROM cc GROUP BY log"))
def concurrency_caps(spark, sf):
    c = C.concurrency(replayed(spark, sf), width=1 << 16)
    return c.groupBy("log").agg(F.max("slots").alias("most_slots"), F.max("verifies").alias("most_verifies"),
                                F.count_if(F.col("slots") > 2).alias("over_work_cap"), F.count_if(F.col("verifies") > 1).alias("over_verify_cap"))


TIMES = """mv AS (SELECT *, lag(action) OVER w AS pa, lag(ts) OVER w AS pt FROM tr WHERE action IN ('AcquireVerify', 'VerifyGreen', 'VerifyFail') WINDOW w AS (PARTITION BY cid ORDER BY seq)),
vt AS (SELECT cid, seq, action, void, ts - pt AS seconds FROM mv WHERE action <> 'AcquireVerify' AND pa = 'AcquireVerify')"""


@query("verify_times", with_ctes(LOG, TIMES, "SELECT cid, seq, action, round(seconds, 3) AS seconds FROM vt"))
def verify_times(spark, sf):
    return C.verify_times(tables.transitions(spark, sf)).select("cid", "seq", "action", F.round("seconds", 3).alias("seconds"))


@query("short_verifies", with_ctes(LOG, TIMES, "SELECT cid, seq, action FROM vt WHERE seconds < 43200 AND NOT (action = 'VerifyFail' AND void)"))
def short_verifies(spark, sf):
    return C.short_verifies(C.verify_times(tables.transitions(spark, sf)), 43200.0).select("cid", "seq", "action")


@query("last_loop_actions", with_ctes(LOG, "SELECT cid, arg_max(CASE WHEN action = 'EPOCH' AND note <> 'loop=none' THEN 'EPOCH-live' ELSE action END, seq) AS action, "
       "arg_max(ts, seq) AS ts FROM tr WHERE action NOT IN ('Pause', 'Resume') GROUP BY cid"))
def last_loop_actions(spark, sf):
    return C.last_loop_actions(tables.transitions(spark, sf))


@query("transition_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(translate(text, '. ', chr(9) || chr(9)), chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, split_part(line, chr(9), 1) AS ts, split_part(line, chr(9), 2) AS action, split_part(line, chr(9), 3) AS cid, split_part(line, chr(9), 4) AS note
FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND len(string_split(line, chr(9))) >= 3""")
def transition_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.translate("text", ". ", "\t\t").alias("text"))
    rows = lines.numbered(d, "text", "doc_id")
    # a log per document: its number rides along through the line number
    keyed = rows.withColumn("line_no", F.struct("doc_id", "line_no"))
    return lines.transitions(keyed).select("line_no.*", "ts", "action", "cid", "note")


@query("observed_epochs", """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS cid, CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN NULL ELSE 'revoked' END AS verdict, o_custkey % 3 AS att,
    o_orderkey % 7 = 0 AS cancelled, o_orderkey % 5 = 0 AS paused, o_orderkey % 2 = 0 AS live, ['verify', 'agent', 'verify-lock', ''][o_orderkey % 4 + 1] AS phase, o_orderkey % 3 <> 0 AS slot, o_orderkey % 8 = 0 AS vf FROM orders),
e AS (SELECT cid, coalesce(verdict, 'none') AS outcome, CASE WHEN cancelled THEN 'killed' WHEN paused THEN 'paused' ELSE 'run' END AS intent,
    CASE WHEN NOT live THEN 'none' WHEN phase = 'verify' THEN 'verify' WHEN NOT slot THEN 'idle' ELSE 'agent' END AS loop, att AS attempts, live AND slot AS slot, live AND vf AS verify FROM o)
SELECT *, outcome = 'none' AND intent = 'run' AND loop = 'none' AND attempts = 0 AND NOT slot AND NOT verify AS initial FROM e""")
def observed_epochs(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    cid = k.cast("string").alias("cid")
    phases = F.array(*[F.lit(p) for p in ("verify", "agent", "verify-lock", "")])
    outcomes = o.select(cid, F.when(F.col("o_orderstatus") == "F", "green").when(F.col("o_orderstatus") == "P", "revoked").alias("verdict"), (F.col("o_custkey") % 3).alias("att"))
    markers = o.select(cid, (k % 7 == 0).alias("cancelled"), (k % 5 == 0).alias("paused"))
    loops = o.where("o_orderkey % 2 = 0").select(cid, phases[(k % 4).cast("int")].alias("phase"), (k % 3 != 0).alias("slot"), (k % 8 == 0).alias("verify"))
    return C.observed_epoch(outcomes, markers, loops)
