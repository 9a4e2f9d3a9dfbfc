"""Ledger folds, rules and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import LEDGER
from runlens.functions import names, text
from runlens.operators import ledger as L
from runlens.sources import lines, tables

ATT = r"TRY_CAST(regexp_extract({x}, 'attempt=(\d+)', 1) AS BIGINT)"
PAY = LEDGER + r""",
lp AS (SELECT *, array_to_string(fields[2:], chr(9)) AS pay, coalesce(fields[2], '') AS note,
    fields[len(fields)] AS lastf,
    event = 'END' AND contains(array_to_string(fields[2:], chr(9)), 'green=true') AS gend,
    event = 'SHAPE' AND ends_with(rtrim(array_to_string(fields[2:], chr(9))), 'pass') AS spass,
    contains(array_to_string(fields[2:], chr(9)), 'reverify') AS rev FROM led)"""

FOLD = PAY + r""",
sg AS (SELECT *, CASE WHEN event = 'REVERIFY' AND contains(pay, 'start') THEN line_no END AS sgl,
    CASE WHEN event IN ('REVERIFY_END', 'END', 'HALT', 'VERIFY_NOSTART') OR (event = 'REVERIFY' AND regexp_matches(pay, 'PASS|REVOKED|ERROR')) THEN line_no END AS egl
  FROM lp),
cellg AS (SELECT cell, max(sgl) AS rs, max(line_no) FILTER (event = 'START') AS ls FROM sg GROUP BY cell),
doneg AS (SELECT sg.cell, min(egl) AS dl FROM sg JOIN cellg USING (cell) WHERE egl > rs GROUP BY sg.cell),
numb AS (SELECT *, sum(CASE WHEN event = 'ITER' THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY line_no) AS nth FROM sg),
agg AS (SELECT cell, count(*) AS events, count(*) FILTER (event = 'ITER') AS att,
    arg_max(event, line_no) AS lst, arg_max(gend, line_no) AS lstg,
    arg_max(event, line_no) FILTER (event IN ('END','HALT','VERIFY_NOSTART')) AS le,
    arg_max(gend, line_no) FILTER (event IN ('END','HALT','VERIFY_NOSTART')) AS leg,
    arg_max(gend, line_no) FILTER (event = 'END') AS last_end_green,
    bool_or(gend) AS green_seen, bool_or(event = 'REVERIFY') AS reverified, bool_or(event = 'PREPARED') AS prepared,
    max(rs) IS NOT NULL AND max(dl) IS NULL AS reverify_active,
    count(*) FILTER (spass AND rev AND line_no > rs AND (dl IS NULL OR line_no < dl)) AS rev_pass,
    CAST(min(nth) FILTER (event = 'ITER' AND fields[1] = 'green') AS BIGINT) AS gi,
    left(arg_max(lastf, line_no) FILTER (event IN ('HALT','VERIFY_NOSTART')), 70) AS halt_cause,
    count(*) FILTER (event = 'NOEDIT') AS noedit, left(arg_max(lastf, line_no) FILTER (event = 'NOEDIT'), 110) AS noedit_last,
    count(*) FILTER (event = 'ALERT') AS alerts,
    count(*) FILTER (event = 'ALERT' AND (ls IS NULL OR line_no > ls)) AS alerts_open,
    left(arg_max(lastf, line_no) FILTER (event = 'ALERT'), 110) AS alert_last,
    arg_max(note, line_no) FILTER (event = 'ITER') AS last_note,
    bool_or(event = 'ITER' AND fields[1] = 'budget') AS budget_exhausted
  FROM numb LEFT JOIN cellg USING (cell) LEFT JOIN doneg USING (cell) GROUP BY cell),
passes AS (SELECT cell, """ + ATT.format(x="pay") + r""" AS attempt, count(*) AS passed FROM lp WHERE spass AND NOT rev GROUP BY 1, 2),
ver AS (SELECT *, CASE WHEN lst IN ('END','HALT','ITER','START','VERIFY_NOSTART') OR le IS NULL THEN lst ELSE le END AS last_ev,
    CASE WHEN lst IN ('END','HALT','ITER','START','VERIFY_NOSTART') OR le IS NULL THEN lstg ELSE leg END AS lg FROM agg),
ver2 AS (SELECT *, CASE WHEN last_ev = 'END' THEN CASE WHEN lg THEN 'green' WHEN green_seen AND reverified THEN 'revoked' ELSE 'failed' END END AS verdict FROM ver),
fold AS (SELECT v.cell, events, att, last_ev, last_end_green, green_seen, reverified, reverify_active, rev_pass, prepared, verdict,
    CASE WHEN verdict = 'green' THEN att ELSE gi END AS green_at, halt_cause, noedit, noedit_last, alerts, alerts_open, alert_last,
    CASE WHEN contains(last_note, 'shapes=all') THEN 6 WHEN contains(last_note, 'shape-gate=') THEN 1 + coalesce(p.passed, 0)
      WHEN contains(last_note, 'stage=') THEN 0 END AS gate,
    coalesce(q.passed, 0) AS live_shape_pass, budget_exhausted, last_note
  FROM ver2 v LEFT JOIN passes p ON p.cell = v.cell AND p.attempt = coalesce(""" + ATT.format(x="last_note") + r""", att)
  LEFT JOIN passes q ON q.cell = v.cell AND q.attempt = att + 1)"""


@query("ledger_outcomes", with_ctes(FOLD, "SELECT * FROM fold"))
def ledger_outcomes(spark, sf):
    return L.fold(tables.ledger(spark, sf))


@query("attempts_to_green", with_ctes(FOLD, """SELECT cell, CASE WHEN verdict = 'green' THEN green_at END AS iterations_to_green,
    coalesce(verdict = 'green', false) AS green, coalesce(verdict = 'revoked', false) AS revoked, budget_exhausted FROM fold"""))
def attempts_to_green(spark, sf):
    return L.attempts_to_green(L.fold(tables.ledger(spark, sf)))


RULES = r"""w AS (SELECT *, TRY_CAST(regexp_extract(array_to_string(fields, chr(9)), 'attempt=(\d+)', 1) AS BIGINT) AS attempt FROM lp),
x AS (SELECT *, count(*) FILTER (event = 'END') OVER b AS ends,
    count(*) FILTER (event = 'ITER' AND fields[1] = 'green') OVER b AS greens,
    count(*) FILTER (event = 'START' AND attempt IS NOT NULL) OVER b AS starts,
    last_value(CASE WHEN event = 'ITER' THEN attempt END IGNORE NULLS) OVER b AS prev_att,
    count(*) FILTER (event = 'START') OVER (PARTITION BY cell, attempt ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own
  FROM w WINDOW b AS (PARTITION BY cell ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT cell, line_no, CASE
    WHEN ends > 0 AND event NOT IN ('SHAPE','REVERIFY','REVERIFY_END','PAUSED','ALERT','END') THEN 3
    WHEN event = 'END' AND (ends > 0 OR (gend AND greens = 0)) THEN 4
    WHEN event = 'ITER' AND attempt <> coalesce(prev_att, 0) + 1 THEN 1
    WHEN event = 'ITER' AND attempt > 3 THEN 2
    WHEN event = 'ITER' AND attempt IS NOT NULL AND starts > 0 AND own = 0 THEN 5 END AS rule,
    event || chr(9) || array_to_string(fields, chr(9)) AS line FROM x),
rb AS (SELECT cell, arg_min(rule, line_no) AS rule, min(line_no) AS line_no, arg_min(line, line_no) AS line FROM r WHERE rule IS NOT NULL GROUP BY cell)"""


@query("ledger_rule_breaks", with_ctes(PAY, RULES, "SELECT * FROM rb"))
def ledger_rule_breaks(spark, sf):
    return L.rule_breaks(tables.ledger(spark, sf), budget=3)


TOKEN = r"""tok AS (SELECT cell, line_no, fields[1] AS result, note, regexp_extract(note, '(?:^|\s)stage=(\S*)', 1) AS st,
    regexp_extract(note, '(?:^|\s)e2e=(\S*)', 1) AS e2e, regexp_extract(note, '(?:^|\s)shape-gate=(\S*)', 1) AS sg,
    contains(note, 'stage=') AS has_st, contains(note, 'shape-gate=') AS has_sg FROM lp WHERE event = 'ITER'),
tok2 AS (SELECT *, CASE WHEN result = 'green' THEN 'green' ELSE concat_ws(' ', CASE WHEN has_st THEN st ELSE result END,
    CASE WHEN e2e <> '' AND NOT (split_part(e2e, '/', 1) = split_part(e2e, '/', 2) AND split_part(e2e, '/', 1) NOT IN ('', '0')) THEN 'e2e NOK:' || e2e END,
    CASE WHEN has_sg THEN 'gate=' || sg END) END AS token FROM tok)"""


@query("attempt_tokens", with_ctes(PAY, TOKEN, "SELECT cell, line_no, token FROM tok2"))
def attempt_tokens(spark, sf):
    led = tables.ledger(spark, sf).where("event = 'ITER'")
    return led.select("cell", "line_no", text.stage_token(F.col("fields")[0], F.col("fields")[1]).alias("token"))


@query("attempt_history", with_ctes(PAY, TOKEN, """
h AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY line_no) - row_number() OVER (PARTITION BY cell, token ORDER BY line_no) AS isl FROM tok2),
g AS (SELECT cell, token, isl, count(*) AS n, max(line_no) AS mx FROM h GROUP BY 1, 2, 3),
l AS (SELECT cell, arg_max(token, mx) AS token, arg_max(n, mx) AS n FROM g GROUP BY cell)""",
    "SELECT cell, CASE WHEN n > 1 THEN token || ' ×' || CAST(n AS VARCHAR) ELSE token END AS history FROM l"))
def attempt_history(spark, sf):
    return L.history(tables.ledger(spark, sf))


AGENT = r"""ag0 AS (SELECT cell, line_no, TRY_CAST(regexp_extract(pay, 'attempt=(\d+)', 1) AS BIGINT) AS attempt,
    CAST(regexp_extract(pay, '\ss=(\d+)', 1) AS BIGINT) AS s, CAST(regexp_extract(pay, 'last_s=(\d+)', 1) AS BIGINT) AS last_s,
    regexp_extract(pay, 'client=([^:]*)', 1) AS client FROM lp WHERE event = 'AGENT'),
ag AS (SELECT cell, attempt, arg_max(s, line_no) AS s, arg_max(last_s, line_no) AS last_s, arg_max(client, line_no) AS client FROM ag0 GROUP BY 1, 2),
it0 AS (SELECT cell, line_no, fields[1] AS result, TRY_CAST(regexp_extract(note, 'attempt=(\d+)', 1) AS BIGINT) AS attempt FROM lp WHERE event = 'ITER'),
it AS (SELECT cell, attempt, count(*) AS lines FROM it0 GROUP BY 1, 2),
ga AS (SELECT cell, arg_min(attempt, line_no) AS gat FROM it0 WHERE result = 'green' GROUP BY cell),
ch AS (SELECT it.*, gat IS NULL OR it.attempt <= gat AS counted FROM it LEFT JOIN ga USING (cell))"""


@query("agent_time", with_ctes(PAY, AGENT, """
t AS (SELECT ch.cell, CAST(sum(lines) AS BIGINT) AS charged, CAST(sum(lines) FILTER (counted) AS BIGINT) AS counted,
    CAST(sum(lines) FILTER (counted AND s IS NOT NULL) AS BIGINT) AS have, CAST(sum(s * lines) FILTER (counted) AS BIGINT) AS tot
  FROM ch LEFT JOIN ag USING (cell, attempt) GROUP BY ch.cell)""",
    """SELECT cell, charged, counted, CASE WHEN counted = have THEN tot END AS agent_s_total,
    round(CASE WHEN counted = have THEN tot END / counted, 1) AS agent_s_per_attempt FROM t"""))
def agent_time(spark, sf):
    return L.agent_time(tables.ledger(spark, sf))


GATES = r"""gt AS (SELECT cell, line_no, TRY_CAST(regexp_extract(pay, 'attempt=(\d+)', 1) AS BIGINT) AS attempt, spass AS ok,
    regexp_extract(pay, '\b([BS]{3})\b', 1) AS shape FROM lp WHERE event = 'SHAPE' AND NOT rev),
gates AS (SELECT cell, attempt, count(*) AS results, count(*) FILTER (ok) AS n_passed,
    coalesce(array_to_string(list_sort(list(DISTINCT shape) FILTER (ok)), ' '), '') AS passed,
    arg_min(shape, line_no) FILTER (NOT ok) AS failed FROM gt GROUP BY 1, 2)"""


@query("gate_results", with_ctes(PAY, GATES, "SELECT * FROM gates"))
def gate_results(spark, sf):
    return L.gates(tables.ledger(spark, sf))


@query("attempt_verdicts", with_ctes(PAY, GATES, """SELECT cell, attempt, CASE WHEN NOT (n_passed = results AND results >= 2) THEN 'fail'
    WHEN attempt <= 3 THEN 'green' ELSE 'budget' END AS verdict FROM gates"""))
def attempt_verdicts(spark, sf):
    return L.attempt_verdict(L.gates(tables.ledger(spark, sf)), required=2, budget=3)


@query("live_gate_passes", with_ctes(PAY, GATES, "SELECT cell, attempt, n_passed AS passed FROM gates WHERE n_passed > 0"))
def live_gate_passes(spark, sf):
    return L.passes_by_attempt(tables.ledger(spark, sf))


@query("allowed_verify_events", with_ctes(LEDGER, "SELECT cell, line_no, event FROM led WHERE event IN ('ALERT', 'VERIFY_READY')"))
def allowed_verify_events(spark, sf):
    return tables.ledger(spark, sf).where(L.is_(*L.VERIFY_EVENTS)).select("cell", "line_no", "event")


CURRENT = r"""cur AS (SELECT cell, arg_max(TRY_CAST(regexp_extract(pay, 'attempt=(\d+)', 1) AS BIGINT), line_no) AS attempt,
    arg_max(ts, line_no) AS since FROM lp WHERE event = 'START' GROUP BY cell)"""


@query("verify_progress", with_ctes(PAY, CURRENT, """SELECT cur.cell, cur.attempt, round(max(ts) - max(since), 3) AS mark_after_s FROM cur
    JOIN lp ON lp.cell = cur.cell AND lp.ts >= since AND event IN ('VERIFY_READY', 'SHAPE', 'WAKE') GROUP BY cur.cell, cur.attempt"""))
def verify_progress(spark, sf):
    led = tables.ledger(spark, sf)
    cur = L.current_attempt(led)
    return (L.verify_progress(led, cur.select("cell", "since")).join(cur, "cell")
            .select("cell", "attempt", F.round(F.col("mark") - F.col("since"), 3).alias("mark_after_s")))


RIG = r"""al AS (SELECT cell, line_no, TRY_CAST(regexp_extract(pay, 'attempt=(\d+)', 1) AS BIGINT) AS attempt, left(substr(lastf, 12), 100) AS what
    FROM lp WHERE event = 'ALERT' AND starts_with(lastf, 'RIG-OUTPUT ')),
jd AS (SELECT cell, TRY_CAST(regexp_extract(pay, 'attempt=(\d+)', 1) AS BIGINT) AS attempt, max(line_no) AS jl FROM lp WHERE event = 'ITER' GROUP BY 1, 2),
rig AS (SELECT al.cell, al.line_no, CASE WHEN coalesce(jl > line_no, false) THEN 'warn' ELSE 'taint' END AS severity,
    'attempt ' || CAST(attempt AS VARCHAR) || CASE WHEN coalesce(jl > line_no, false) THEN ' re-verified after a verify halted on a rig defect: '
      ELSE ' was never re-verified after a verify halted on a rig defect: ' END || what AS text FROM al LEFT JOIN jd USING (cell, attempt))"""


@query("rig_output_alerts", with_ctes(PAY, RIG, "SELECT * FROM rig"))
def rig_output_alerts(spark, sf):
    return L.rig_output(tables.ledger(spark, sf))


@query("sanitised_fields", r"SELECT doc_id, left(regexp_replace(text, '[\t\r\n]', ' ', 'g'), 400) AS field FROM documents")
def sanitised_fields(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_field(F.col("text")).alias("field"))


@query("ledger_lines_from_text", r"""
WITH l AS (SELECT doc_id, unnest(string_split(translate(text, ' ', chr(9)), chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
f AS (SELECT doc_id, line_no, string_split(line, chr(9)) AS f FROM l WHERE NOT starts_with(line, '#'))
SELECT doc_id, line_no, f[1] AS stamp, f[2] AS event, len(f) - 2 AS n_fields, f[3] AS first_field FROM f WHERE len(f) >= 3""")
def ledger_lines_from_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.translate("text", " ", "\t").alias("text"))
    e = lines.ledger_lines(lines.numbered(d, "text", "doc_id"), "doc_id")
    return e.select("doc_id", "line_no", "stamp", "event", F.size("fields").cast("long").alias("n_fields"),
                    F.col("fields")[0].alias("first_field"))


@query("note_values", with_ctes(PAY, r"""SELECT line_no, nullif(regexp_extract(note, '(?:^|\s)stage=(\S*)', 1), '') AS stage,
    nullif(regexp_extract(note, '(?:^|\s)e2e=(\S*)', 1), '') AS e2e, len(regexp_extract_all(note, '\S+=\S*')) AS n_keys FROM lp WHERE event = 'ITER'"""))
def note_values(spark, sf):
    it = tables.ledger(spark, sf).where("event = 'ITER'").select("line_no", F.col("fields")[1].alias("note"))
    m = text.kv_map(F.col("note"))
    return it.select("line_no", text.kv(F.col("note"), "stage").alias("stage"), F.try_element_at(m, F.lit("e2e")).alias("e2e"),
                     F.size(m).cast("long").alias("n_keys"))


IDS = """ids AS (SELECT o_orderkey, 'ag-' || CAST(o_custkey % 5 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '_high' ELSE '_low' END
    || CASE WHEN o_orderkey % 3 = 0 THEN '_smoke' ELSE '' END || '_' || replace(lower(o_orderpriority), ' ', '_')
    || CASE WHEN o_orderkey % 10 = 0 THEN '_x' ELSE '' END || '_T' || CAST(o_orderkey % 12 AS VARCHAR) || '_r' || CAST(o_orderkey % 7 AS VARCHAR) AS cid FROM orders)"""


def _ids(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    variant = F.concat(F.regexp_replace(F.lower("o_orderpriority"), " ", "_"), F.when(k % 10 == 0, "_x").otherwise(""))
    return o.select("o_orderkey", names.cell_id(
        F.concat(F.lit("ag-"), (F.col("o_custkey") % 5).cast("string")), variant,
        F.concat(F.lit("T"), (k % 12).cast("string")), k % 7,
        effort=F.when(k % 2 == 0, "high").otherwise("low"), smoke=k % 3 == 0).alias("cid"))


@query("parsed_cell_ids", with_ctes(IDS, """
t AS (SELECT *, string_split(cid, '_') AS t FROM ids),
p AS (SELECT o_orderkey, cid, t[1] AS agent, array_to_string(t[CASE WHEN t[3] = 'smoke' THEN 4 ELSE 3 END : len(t) - 2], '_') AS variant,
    t[len(t) - 1] AS task, regexp_extract(t[len(t)], '^r(\\d+)$', 1) AS rep FROM t WHERE len(t) >= 5)""".replace("\\\\", "\\"),
    r"""SELECT * FROM p WHERE rep <> '' AND regexp_matches(task, '^T\d$') AND variant IN (SELECT replace(lower(o_orderpriority), ' ', '_') FROM orders)"""))
def parsed_cell_ids(spark, sf):
    variants = table(spark, sf, "orders").select(F.regexp_replace(F.lower("o_orderpriority"), " ", "_").alias("variant")).distinct()
    return names.parse_cell_id(_ids(spark, sf), variants).select("o_orderkey", "cid", "agent", "variant", "task", "rep")


@query("selected_cells", with_ctes(IDS, "SELECT sel, count(*) AS n FROM ids, (VALUES ('all'), ('high'), ('2-high'), ('r1'), ('T1_r1'), ('hig')) s(sel) "
       "WHERE sel = 'all' OR cid = sel OR contains('_' || cid || '_', '_' || sel || '_') GROUP BY sel"))
def selected_cells(spark, sf):
    sel = F.explode(F.array(*[F.lit(s) for s in ("all", "high", "2-high", "r1", "T1_r1", "hig")])).alias("sel")
    return (_ids(spark, sf).select("cid", sel).where(names.selects(F.col("cid"), F.col("sel")))
            .groupBy("sel").agg(F.count(F.lit(1)).alias("n")))
