"""Transcripts, usage totals and provider faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import EVENTS
from runlens.catalog.ledgers import AGENT, PAY
from runlens.functions import faults
from runlens.operators import usage
from runlens.operators.metrics import USAGE_FIELDS
from runlens.sources import lines, tables

CONV = """cv AS (SELECT conv_id // 4 AS cell, conv_id % 4 + 1 AS attempt, turn, turn % 4 AS four, CAST(length(text) AS BIGINT) AS n FROM conversations)"""
USE_A = CONV + """,
ca AS (SELECT * FROM cv WHERE turn % 16 <> 15),
a0 AS (SELECT cell, attempt, count(*) FILTER (four = 3) AS closings,
    round(arg_max(n * 40, turn) FILTER (four = 3) / 1000.0::DOUBLE, 1) AS api_s, CAST(sum(turn) FILTER (four = 3) AS BIGINT) AS turns,
    CAST(sum(n % 997) FILTER (four = 3) AS BIGINT) AS out_tok, CAST(sum(n % 89) FILTER (four = 3) AS BIGINT) AS think_tok,
    CASE WHEN count(*) FILTER (four = 3 AND n % 10 = 0) = 0 THEN CAST(sum(n * 6) FILTER (four = 3) AS BIGINT) END AS in_tok,
    arg_max(n / 64.0::DOUBLE, turn) FILTER (four = 3) AS cost_usd, count(*) FILTER (four = 0) AS retries,
    round(coalesce(sum(n) FILTER (four = 0), 0) / 1000.0::DOUBLE, 1) AS retry_wait_s, count(*) FILTER (four = 2 AND n % 2 = 1) AS limited,
    CAST(sum(n * 100) FILTER (four = 3) AS DOUBLE) / 1000 AS client_s FROM ca GROUP BY 1, 2 HAVING count(*) FILTER (four = 3) > 0),
atl AS (SELECT cell, attempt, count(DISTINCT t) AS tool_calls FROM (SELECT cell, attempt, unnest([n % 5, n % 3]) AS t FROM ca WHERE four = 1) GROUP BY 1, 2),
usa AS (SELECT a0.*, coalesce(tool_calls, 0) AS tool_calls, CAST(NULL AS BIGINT) AS sandbox_fails FROM a0 LEFT JOIN atl USING (cell, attempt))"""
USE_B = """b0 AS (SELECT cell, attempt, count(*) AS closings, CAST(sum(n * 5) AS BIGINT) AS out_tok,
    CASE WHEN count(*) FILTER (n % 11 = 0) = 0 THEN CAST(sum(n) AS BIGINT) END AS think_tok, CAST(sum(n * 8) AS BIGINT) AS in_tok,
    sum(n / 8.0::DOUBLE) AS client_s FROM cv WHERE four = 3 GROUP BY 1, 2),
bs AS (SELECT cell, attempt, count(DISTINCT n // 100) FILTER (four <> 1) AS turns, count(DISTINCT n // 100) FILTER (four = 1) AS tool_calls,
    count(DISTINCT n // 100) FILTER (n % 7 = 0) AS sandbox_fails FROM cv WHERE four <> 3 GROUP BY 1, 2),
usb AS (SELECT b0.*, coalesce(turns, 0) AS turns, coalesce(tool_calls, 0) AS tool_calls, coalesce(sandbox_fails, 0) AS sandbox_fails,
    CAST(NULL AS DOUBLE) AS api_s, CAST(NULL AS DOUBLE) AS cost_usd, CAST(NULL AS BIGINT) AS retries, CAST(NULL AS DOUBLE) AS retry_wait_s,
    CAST(NULL AS BIGINT) AS limited FROM b0 LEFT JOIN bs USING (cell, attempt))"""


@query("usage_client_a", with_ctes(USE_A, "SELECT * FROM usa"))
def usage_client_a(spark, sf):
    return usage.client_a(tables.transcripts_a(spark, sf))


@query("usage_client_b", with_ctes(USE_A, USE_B, "SELECT * FROM usb"))
def usage_client_b(spark, sf):
    return usage.client_b(tables.transcripts_b(spark, sf))


@query("client_seconds", with_ctes(USE_A, USE_B, "SELECT 'A' AS client, cell, attempt, client_s, closings FROM usa UNION ALL SELECT 'B', cell, attempt, client_s, closings FROM usb"))
def client_seconds(spark, sf):
    cols = ("cell", "attempt", "client_s", "closings")
    a = usage.client_a(tables.transcripts_a(spark, sf)).select(F.lit("A").alias("client"), *cols)
    return a.unionByName(usage.client_b(tables.transcripts_b(spark, sf)).select(F.lit("B").alias("client"), *cols))


_FIG = ", ".join(usage.FIGURES)
ATTEMPTS = f"""acc AS (SELECT 'A' AS client, cell, attempt, {_FIG} FROM usa UNION ALL SELECT 'B', cell, attempt, {_FIG} FROM usb),
ba AS (SELECT ch.cell, ch.attempt, ch.lines, ch.counted, ag.client, last_s, {_FIG}, round(last_s - api_s, 1) AS tool_s
  FROM ch LEFT JOIN ag USING (cell, attempt) LEFT JOIN acc ON acc.cell = ch.cell AND acc.attempt = ch.attempt AND acc.client = ag.client)"""
TOTALS = "rep AS (SELECT ba.* FROM ba, range(20) r(x) WHERE counted AND x < lines),\ntot AS (SELECT cell, " + ", ".join(
    f"round(CASE WHEN count({f}) = count(*) THEN sum(CAST({f} AS DOUBLE)) END, {4 if f == 'cost_usd' else 1}) AS {f}_total" for f in USAGE_FIELDS) + " FROM rep GROUP BY cell)"


@query("usage_by_attempt", with_ctes(PAY, AGENT, USE_A, USE_B, ATTEMPTS, f"SELECT cell, attempt, counted, client, {', '.join(USAGE_FIELDS)} FROM ba"))
def usage_by_attempt(spark, sf):
    return usage_attempts(spark, sf).select("cell", "attempt", "counted", "client", *USAGE_FIELDS)


def usage_attempts(spark, sf):
    # each client's reader sees its own kind of transcript
    a, b = tables.transcripts_a(spark, sf), tables.transcripts_b(spark, sf)
    return usage.by_attempt(a, tables.ledger(spark, sf), {"A": usage.client_a, "B": lambda _: usage.client_b(b)})


@query("usage_totals", with_ctes(PAY, AGENT, USE_A, USE_B, ATTEMPTS, TOTALS,
       "SELECT *, round(1000 * api_s_total / nullif(out_tok_total, 0), 2) AS api_ms_per_out_tok FROM tot"))
def usage_totals(spark, sf):
    return usage.totals(usage_attempts(spark, sf))


@query("transcript_lines", with_ctes(CONV, "SELECT cell, attempt, count(*) AS objects, count(*) FILTER (four = 3) AS results FROM cv WHERE turn % 16 <> 15 GROUP BY 1, 2"))
def transcript_lines(spark, sf):
    docs = lines.json_lines(tables.transcripts_a(spark, sf))
    kind = F.try_variant_get("doc", "$.type", "string")
    return docs.groupBy("cell", "attempt").agg(F.count(F.lit(1)).alias("objects"), F.count_if(kind == "result").alias("results"))


_DQ = lambda p: p.replace("'", "''")
LOGS = """tails AS (SELECT doc_id, text, doc_id % 3 AS rc, ['Error: you hit your weekly limit, resets in 3 hours', 'quota exceeded for this plan', 'please run /login now',
    'API Error: overloaded_error', 'all tests passed', '{"type": "result", "is_error": false, "result": "done"}',
    '{"type": "result", "is_error": true, "result": "Bad gateway from provider"}',
    '{"type": "result", "api_error_status": 401, "is_error": true, "result": "denied"}',
    '{"type": "result", "api_error_status": 429, "is_error": true, "result": "rate limit"}', '{"type": "result", broken'][doc_id % 10 + 1] AS tail FROM documents),
ll AS (SELECT doc_id, rc, unnest(string_split(text || chr(10) || tail || chr(10) || '  ' || chr(10), chr(10))) AS line,
    generate_subscripts(string_split(text || chr(10) || tail || chr(10) || '  ' || chr(10), chr(10)), 1) AS line_no FROM tails),
lf AS (SELECT *, regexp_matches(line, '(?i)AUTHRE') AS au, regexp_matches(line, '(?i)PLAINRE') AS li,
    CASE WHEN contains(line, '"type"') AND contains(line, '"result"') AND json_valid(line) THEN line END AS js FROM ll),
lr AS (SELECT doc_id, max(rc) AS rc, arg_max(js, line_no) FILTER (js IS NOT NULL) AS js, bool_or(au) AS au, bool_or(li) AS li,
    arg_max(trim(line), line_no) FILTER ((au OR li) AND trim(line) <> '') AS wall, arg_max(trim(line), line_no) FILTER (trim(line) <> '') AS lastl FROM lf GROUP BY doc_id),
lg AS (SELECT *, CAST(json_extract_string(js, '$.api_error_status') AS INT) AS st, coalesce(json_extract_string(js, '$.is_error') = 'true', false) AS er,
    coalesce(json_extract_string(js, '$.result'), '') AS tx FROM lr)""".replace("AUTHRE", _DQ(faults.AUTH)).replace("PLAINRE", _DQ(faults.PLAIN_LIMIT))


def _log_facts(spark, sf):
    rows = lines.numbered(tables.logs(spark, sf), "log", "doc_id", "rc")
    return faults.read_logs(rows, ("doc_id", "rc"))


@query("fault_classes", with_ctes(LOGS, f"""SELECT doc_id, CASE WHEN js IS NOT NULL THEN
      CASE WHEN st IS NOT NULL THEN CASE WHEN st IN (401, 403, 404) OR regexp_matches(tx, '(?i){_DQ(faults.AUTH)}') THEN 'auth' ELSE 'limit' END
        WHEN er THEN CASE WHEN regexp_matches(tx, '(?i){_DQ(faults.AUTH)}') THEN 'auth' WHEN regexp_matches(tx, '(?i){_DQ(faults.QUOTA + '|' + faults.TRANSIENT)}') THEN 'limit' END END
    WHEN rc <> 0 THEN CASE WHEN au THEN 'auth' WHEN li THEN 'limit' END END AS fault,
    CASE WHEN tx <> '' THEN trim(tx) ELSE coalesce(wall, lastl, '') END AS reason,
    regexp_matches(CASE WHEN tx <> '' THEN trim(tx) ELSE coalesce(wall, lastl, '') END, '(?i){_DQ(faults.QUOTA)}') AS quota FROM lg"""))
def fault_classes(spark, sf):
    f = _log_facts(spark, sf).select("doc_id", faults.classify(F.col("rc")).alias("fault"), faults.reason().alias("reason"))
    return f.withColumn("quota", faults.quota_wall(F.col("reason")))


@query("last_result_lines", with_ctes(LOGS, "SELECT doc_id, st AS status, er AS is_error, tx AS result FROM lg WHERE js IS NOT NULL"))
def last_result_lines(spark, sf):
    r = F.col("result")
    return (_log_facts(spark, sf).where(r.isNotNull())
            .select("doc_id", r["status"].alias("status"), r["is_error"].alias("is_error"), r["text"].alias("result")))


HINT_NOW = "to_timestamp(CAST(floor(ts) AS BIGINT)) AT TIME ZONE 'UTC'"


@query("reset_hints", with_ctes(EVENTS, f"""
n AS (SELECT seq, k, k % 6 AS c, floor(ts) AS t, floor(ts / 86400) * 86400 AS d0 FROM ev)""", """
    SELECT seq, CAST(CASE c WHEN 0 THEN CASE WHEN k > 0 THEN k * 3600 END WHEN 1 THEN k * 60 + 15 WHEN 2 THEN
        d0 + ((k % 12) + 12) * 3600 + 30 * 60 + CASE WHEN d0 + ((k % 12) + 12) * 3600 + 1800 <= t THEN 86400 ELSE 0 END - t
      WHEN 3 THEN d0 + CASE WHEN d0 <= t THEN 86400 ELSE 0 END - t
      WHEN 4 THEN epoch(make_timestamp(2024 + CASE WHEN make_timestamp(2024, 1, CAST(k % 28 + 1 AS BIGINT), 3, 0, 0) <= make_timestamp(CAST(t * 1000000 AS BIGINT)) THEN 1 ELSE 0 END, 1, CAST(k % 28 + 1 AS BIGINT), 3, 0, 0)) - t
      END AS BIGINT) AS hint_s FROM n"""))
def reset_hints(spark, sf):
    k = F.col("k")
    s = k.cast("string")
    text = (F.when(k % 6 == 0, F.concat(F.lit("usage limit. Resets in "), s, F.lit(" hours, sorry")))
            .when(k % 6 == 1, F.concat(F.lit("please try again after "), s, F.lit("m15s")))
            .when(k % 6 == 2, F.concat(F.lit("limit resets "), F.when(k % 12 == 0, "12").otherwise((k % 12).cast("string")), F.lit(":30pm (UTC)")))
            .when(k % 6 == 3, F.lit("resets 12am (UTC)"))
            .when(k % 6 == 4, F.concat(F.lit("resets Jan "), (k % 28 + 1).cast("string"), F.lit(", 3am (UTC)")))
            .otherwise(F.lit("no hint here")))
    now = F.timestamp_seconds(F.floor("ts").cast("long"))
    return tables.events(spark, sf).select("seq", faults.reset_hint_s(text, now).alias("hint_s"))


@query("clock_labels", with_ctes(EVENTS, """SELECT seq, CASE WHEN k % 9 = 0 THEN '-' WHEN abs(value * 10 - k * 8) <= greatest(60.0::DOUBLE, 0.1::DOUBLE * k * 8) THEN 'agree'
    WHEN k % 3 > 1 AND k * 8 < value * 10 THEN 'resumed' ELSE 'disagree' END AS label FROM ev"""))
def clock_labels(spark, sf):
    client = F.when(F.col("k") % 9 != 0, F.col("k") * 8)
    return tables.events(spark, sf).select("seq", faults.clock_label(F.col("value") * 10, client, F.col("k") % 3).alias("label"))
