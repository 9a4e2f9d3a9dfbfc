"""Validation, archives, score records and what must be scored again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import EVENTS, SCORES
from runlens.catalog.hosts import RELIABLE
from runlens.catalog.ledgers import AGENT, FOLD, PAY, RIG, RULES
from runlens.catalog.scoring import PLACE_SQL, metrics_sql
from runlens.catalog.surfaces import SURF, skeleton
from runlens.catalog.usage import ATTEMPTS, TOTALS, USE_A, USE_B, usage_attempts
from runlens.functions import faults, text
from runlens.operators import ledger as L
from runlens.operators import samples, surface
from runlens.operators.metrics import USAGE_FIELDS
from runlens.plans import scoreboard as board
from runlens.plans import scoring, validation
from runlens.session import cut_lineage, shared_folder
from runlens.sources import lines, tables

RUNS = r"""ar0 AS (SELECT run AS cell, seq, CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'deploy' ELSE 'load' END END AS stage, k,
    lpad(CAST(seq % 100 AS VARCHAR), 2, '0') AS nn, ['BBS', 'BSB', 'SSB'][k % 3 + 1] AS sh FROM ev),
ar AS (SELECT cell, seq, stage, sh AS shape, CASE WHEN k % 13 <> 0 THEN k // 25 + 1 END AS attempt,
    CASE WHEN k % 13 <> 0 THEN ['green', 'charged', 'refunded', 'interrupted'][k % 4 + 1] END AS end_state FROM ar0 WHERE k % 13 = 0 OR k % 29 <> 0)"""


def runs(spark, sf):
    return validation.archived_runs(tables.archive_dirs(spark, sf))


@query("archived_runs", with_ctes(EVENTS, RUNS, "SELECT cell, seq, attempt, shape, end_state, end_state IS NULL OR end_state IN ('green', 'charged') AS judged FROM ar"))
def archived_runs(spark, sf):
    return runs(spark, sf).select("cell", "seq", "attempt", "shape", "end_state", validation.judged().alias("judged"))


@query("run_end_states", """SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'interrupted' WHEN o_orderstatus = 'F' THEN 'green' WHEN o_orderstatus = 'O' THEN 'charged' ELSE 'refunded' END AS end_state, count(*) AS n FROM orders GROUP BY 1""")
def run_end_states(spark, sf):
    s = F.col("o_orderstatus")
    e = table(spark, sf, "orders").select(validation.end_state(s == "F", s == "O", F.col("o_orderkey") % 10 != 0).alias("end_state"))
    return e.groupBy("end_state").agg(F.count(F.lit(1)).alias("n"))


REFUNDS = """rf0 AS (SELECT cell, coalesce(stage, end_state) AS st, count(*) AS n FROM ar WHERE end_state IN ('refunded', 'interrupted') GROUP BY 1, 2),
rf1 AS (SELECT cell, sum(n) AS al, max(n) AS mx, string_agg(st || 'x' || n, ', ' ORDER BY st) AS dt FROM rf0 GROUP BY cell),
refunds AS (SELECT cell, al || ' verify run(s) not charged (' || dt || ')' AS text FROM rf1 WHERE al >= 3 OR mx > 1)"""


@query("refund_warnings", with_ctes(EVENTS, RUNS, REFUNDS, "SELECT * FROM refunds"))
def refund_warnings(spark, sf):
    return validation.refunds(runs(spark, sf))


MISMATCH = r"""fa AS (SELECT cell, min(attempt) AS fa FROM ar WHERE end_state IS NOT NULL AND attempt > 0 GROUP BY cell),
ls0 AS (SELECT cell, TRY_CAST(regexp_extract(note, 'attempt=(\d+)', 1) AS BIGINT) AS attempt, arg_max(CASE WHEN fields[1] = 'green' THEN 'green' ELSE 'charged' END, line_no) AS led
  FROM lp WHERE event = 'ITER' AND NOT contains(note, 'stage=no-edit') GROUP BY 1, 2),
ls AS (SELECT ls0.* FROM ls0 JOIN fa USING (cell) WHERE attempt >= fa),
as0 AS (SELECT cell, attempt, CASE WHEN bool_or(end_state = 'charged') THEN 'charged' WHEN bool_or(end_state = 'green') THEN 'green' END AS arc FROM ar WHERE end_state IS NOT NULL AND attempt > 0 GROUP BY 1, 2),
mm AS (SELECT cell, attempt, 'archive/ledger mismatch at attempt ' || attempt || ': ledger ' || coalesce(led, 'no verdict') || ', archive ' || coalesce(arc, 'no judged run') AS text
  FROM ls FULL JOIN (SELECT * FROM as0 WHERE arc IS NOT NULL) a USING (cell, attempt) WHERE led IS DISTINCT FROM arc)"""


@query("archive_mismatches", with_ctes(PAY, RUNS, MISMATCH, "SELECT * FROM mm"))
def archive_mismatches(spark, sf):
    return validation.archive_mismatches(runs(spark, sf), tables.ledger(spark, sf))


def attempt_logs(spark, sf):
    """Log lines per cell and attempt."""
    d = F.col("doc_id")
    return lines.numbered(tables.logs(spark, sf).select(F.floor(d / 4).alias("cell"), (d % 4 + 1).alias("attempt"), "doc_id", "log"),
                          "log", "cell", "attempt", "doc_id").withColumn("line_no", F.col("doc_id") * 100000000 + F.col("line_no")).drop("doc_id")


_DQ = lambda p: p.replace("'", "''")
WALLS = rf"""wl AS (SELECT doc_id // 4 AS cell, doc_id % 4 + 1 AS attempt, unnest(string_split(text || chr(10) || tail || chr(10) || '  ' || chr(10), chr(10))) AS line,
    doc_id * 100000000 + generate_subscripts(string_split(text || chr(10) || tail || chr(10) || '  ' || chr(10), chr(10)), 1) AS line_no FROM tails),
wf AS (SELECT *, regexp_matches(line, '(?i){_DQ(faults.AUTH)}') AS au, regexp_matches(line, '(?i){_DQ(faults.PLAIN_LIMIT)}') AS li,
    CASE WHEN contains(line, '"type"') AND contains(line, '"result"') AND json_valid(line) THEN line END AS js FROM wl),
wr AS (SELECT cell, attempt, arg_max(js, line_no) FILTER (js IS NOT NULL) AS js, bool_or(au) AS au, bool_or(li) AS li,
    arg_max(trim(line), line_no) FILTER ((au OR li) AND trim(line) <> '') AS wall, arg_max(trim(line), line_no) FILTER (trim(line) <> '') AS lastl FROM wf GROUP BY 1, 2),
wg AS (SELECT *, CAST(json_extract_string(js, '$.api_error_status') AS INT) AS st, coalesce(json_extract_string(js, '$.is_error') = 'true', false) AS er, coalesce(json_extract_string(js, '$.result'), '') AS tx FROM wr),
wi AS (SELECT cell, line_no, TRY_CAST(regexp_extract(note, 'attempt=(\d+)', 1) AS BIGINT) AS attempt, contains(note, 'stage=no-edit') AS ne FROM lp WHERE event = 'ITER' AND fields[1] IN ('fail', 'budget')),
wk AS (SELECT wi.cell, wi.line_no, attempt, CASE WHEN js IS NOT NULL THEN CASE WHEN st IS NOT NULL THEN CASE WHEN st IN (401, 403, 404) OR regexp_matches(tx, '(?i){_DQ(faults.AUTH)}') THEN 'auth' ELSE 'limit' END
    WHEN er THEN CASE WHEN regexp_matches(tx, '(?i){_DQ(faults.AUTH)}') THEN 'auth' WHEN regexp_matches(tx, '(?i){_DQ(faults.QUOTA + '|' + faults.TRANSIENT)}') THEN 'limit' END END
    WHEN ne THEN CASE WHEN au THEN 'auth' WHEN li THEN 'limit' END END AS kind, CASE WHEN tx <> '' THEN trim(tx) ELSE coalesce(wall, lastl, '') END AS why FROM wi JOIN wg USING (cell, attempt)),
walls AS (SELECT cell, line_no, 'attempt ' || attempt || ' charged on a provider ' || kind || ' wall: ' || left(why, 80) AS text FROM wk WHERE kind IS NOT NULL)"""
TAILS = """tails AS (SELECT doc_id, text, ['Error: you hit your weekly limit, resets in 3 hours', 'quota exceeded for this plan', 'please run /login now',
    'API Error: overloaded_error', 'all tests passed', '{"type": "result", "is_error": false, "result": "done"}',
    '{"type": "result", "is_error": true, "result": "Bad gateway from provider"}',
    '{"type": "result", "api_error_status": 401, "is_error": true, "result": "denied"}',
    '{"type": "result", "api_error_status": 429, "is_error": true, "result": "rate limit"}', '{"type": "result", broken'][doc_id % 10 + 1] AS tail FROM documents)"""


@query("charged_provider_walls", with_ctes(PAY, TAILS, WALLS, "SELECT * FROM walls"))
def charged_provider_walls(spark, sf):
    return validation.charged_walls(tables.ledger(spark, sf), attempt_logs(spark, sf))


FOUND = [PAY, RULES, RIG, RELIABLE[len(EVENTS) + 2:], RUNS, REFUNDS, MISMATCH, TAILS, WALLS, f"""
found AS (SELECT cell, 'taint' AS severity, '1-rules' AS rule, line_no, 'ledger rule ' || rule || ' broken at line ' || line_no || ' (' || CASE rule {' '.join(f"WHEN {n} THEN '{_DQ(t)}'" for n, t in L.RULES.items())} END || '): ' || left(trim(line), 100) AS text FROM rb
  UNION ALL SELECT cell, 'taint', '2-integrity', line_no, 'a verify changed the cell''s record: ' || left(substr(lastf, 11), 100) FROM lp WHERE event = 'ALERT' AND starts_with(lastf, 'INTEGRITY ')
  UNION ALL SELECT cell, severity, '3-rig-output', line_no, text FROM rig
  UNION ALL SELECT cell, 'warn', '4-rig-abort', min(line_no), 'a reverify aborted on a rig fault (green intact, gate incomplete)' FROM lp WHERE contains(array_to_string(fields, chr(9)), 'ERROR[rig]') GROUP BY cell
  UNION ALL SELECT cell, 'taint', '5-wall', line_no, text FROM walls
  UNION ALL SELECT cell, 'warn', '6-footprint', 0, 'footprint unreliable (' || unreliable_samples || ' sample(s) disagreed' || CASE WHEN unchecked_samples > 0 THEN ', ' || unchecked_samples || ' unchecked' ELSE '' END || ', of ' || samples || ')' FROM rel WHERE NOT reliable
  UNION ALL SELECT cell, 'warn', '7-refunds', 0, text FROM refunds
  UNION ALL SELECT cell, 'warn', '8-archive', attempt, text FROM mm
  UNION ALL SELECT cell, 'warn', '9-quick', max(line_no), 'paused often' FROM lp WHERE event = 'PAUSED' GROUP BY cell HAVING count(*) > 1)"""]


def paused_often(evidence):
    """An experiment's own rule: a cell paused more than once is worth a look."""
    p = evidence["ledger"].where("event = 'PAUSED'").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("line_no"))
    return p.where("n > 1").select("cell", F.lit("warn").alias("severity"), F.lit("9-quick").alias("rule"), "line_no", F.lit("paused often").alias("text"))


def found(spark, sf):
    checks = samples.reliability(samples.cross_check(tables.resource_samples(spark, sf)))
    evidence = {"ledger": tables.ledger(spark, sf), "logs": attempt_logs(spark, sf), "footprints": checks, "runs": runs(spark, sf)}
    return validation.findings(evidence, budget=3, rules=(paused_often,))


@query("findings", with_ctes(*FOUND, "SELECT * FROM found"))
def findings(spark, sf):
    return found(spark, sf)


VERDICTS = """vd AS (SELECT c.cell, CASE WHEN coalesce(t, 0) > 0 THEN 'TAINTED' ELSE 'VALID' END AS verdict, coalesce(t, 0) AS taints, coalesce(w, 0) AS warns, first_taint
  FROM (SELECT DISTINCT cell FROM lp) c LEFT JOIN (SELECT cell, count(*) FILTER (severity = 'taint') AS t, count(*) FILTER (severity <> 'taint') AS w,
    arg_min(text, (rule, line_no, text)) FILTER (severity = 'taint') AS first_taint FROM found GROUP BY cell) f ON f.cell = c.cell)"""


@query("validations", with_ctes(*FOUND, VERDICTS, "SELECT * FROM vd"))
def validations(spark, sf):
    return validation.verdicts(tables.ledger(spark, sf).select("cell").distinct(), found(spark, sf))


@query("warning_recap", with_ctes(
    PAY, RUNS, REFUNDS, MISMATCH, "w AS (SELECT cell, text FROM refunds UNION ALL SELECT cell, text FROM mm)",
    r"SELECT trim(regexp_replace(regexp_replace(regexp_split_to_array(text, ' \(|: ')[1], '\d+', '', 'g'), '\s+', ' ', 'g')) AS kind, count(DISTINCT cell) AS cells FROM w GROUP BY 1"))
def warning_recap(spark, sf):
    r = runs(spark, sf)
    warn = lambda df: df.select("cell", F.lit("warn").alias("severity"), "text")
    return validation.warning_recap(warn(validation.refunds(r)).unionByName(warn(validation.archive_mismatches(r, tables.ledger(spark, sf)))))


@query("validation_tally", """WITH v AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'failed' ELSE 'revoked' END AS outcome,
    CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 'TAINTED' ELSE 'VALID' END AS verdict, o_orderkey % 3 AS warns FROM orders)
SELECT outcome, count(*) AS cells, count(*) FILTER (verdict = 'VALID') AS valid, count(*) FILTER (verdict = 'TAINTED') AS tainted, count(*) FILTER (verdict IS NULL) AS held,
  count(*) FILTER (verdict = 'VALID' AND warns > 0) AS with_warnings FROM v GROUP BY outcome""")
def validation_tally(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return validation.tally(table(spark, sf, "orders").select(
        F.when(s == "F", "green").when(s == "O", "failed").otherwise("revoked").alias("outcome"),
        F.when(k % 9 == 0, None).when(k % 4 == 0, "TAINTED").otherwise("VALID").alias("verdict"), (k % 3).alias("warns")))


@query("missing_outputs", """SELECT o_orderkey AS run, n AS name FROM orders, (VALUES ('trace.csv'), ('metrics.json'), ('k6.log')) t(n)
WHERE CASE n WHEN 'trace.csv' THEN o_orderkey % 5 = 0 WHEN 'metrics.json' THEN o_custkey % 7 = 0 OR o_custkey % 7 = 1 ELSE false END""")
def missing_outputs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run"), "o_custkey", F.lit(1000.0).alias("started"))
    required = o.select("run", F.explode(F.array(*[F.lit(n) for n in ("trace.csv", "metrics.json", "k6.log")])).alias("name"), "started")
    mtime = F.when(F.col("o_custkey") % 7 == 1, 990.0).otherwise(999.5)
    outputs = (o.where("run % 5 <> 0").select("run", F.lit("trace.csv").alias("name"), F.lit(1001.0).alias("mtime"))
               .unionByName(o.where("o_custkey % 7 <> 0").select("run", F.lit("metrics.json").alias("name"), mtime.alias("mtime")))
               .unionByName(o.select("run", F.lit("k6.log").alias("name"), F.lit(999.0).alias("mtime"))))
    return validation.missing_outputs(required, outputs)


ENV = """env AS (SELECT c_custkey AS cell, c_mktsegment AS model, 'T' || (c_custkey % 3 + 1) AS task, 'v' || (c_custkey % 4) AS variant,
    CASE WHEN c_custkey % 6 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'py' ELSE 'bash' END END AS impl, c_custkey % 5 + 1 AS repeat FROM customer)"""


def env(spark, sf):
    e = lines.env_map(lines.numbered(tables.cell_env(spark, sf), "text", "cell"), "cell")
    names = {"AGENT_MODEL": "model", "TASK": "task", "VARIANT": "variant", "IMPL": "impl", "REPEAT": "repeat"}
    g = e.groupBy("cell").agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(v) for k, v in names.items()])
    return g.withColumn("repeat", F.col("repeat").try_cast("long"))


@query("cell_declarations", with_ctes(ENV, "SELECT * FROM env"))
def cell_declarations(spark, sf):
    return env(spark, sf)


METRICS = """mx AS (SELECT p_partkey AS cell, p_partkey % 20 <> 7 AS rd, CAST(p_size * 100 AS DOUBLE) AS load_total, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS DOUBLE) END AS load_errors,
    CAST(p_size % 9 AS DOUBLE) AS e2e_pass, 8.0::DOUBLE AS e2e_total, p_size % 9 = 8 AS e2e_green, p_partkey % 3 <> 0 AS k6_available, true AS deploy_ok, p_partkey % 5 <> 0 AS scaling_ok,
    CASE WHEN p_size % 9 <> 8 THEN ['deploy', 'nostart', 'e2e', 'k6', 'other'][p_partkey % 5 + 1] END AS stage_failed, p_brand AS brand FROM part),
met AS (SELECT cell, """ + ", ".join(f"CASE WHEN rd THEN {c} END AS {c}" for c in (
    "load_total", "load_errors", "e2e_pass", "e2e_total", "e2e_green", "k6_available", "deploy_ok", "scaling_ok", "stage_failed", "brand")) + " FROM mx)"


@query("metrics_read", with_ctes(METRICS, "SELECT * FROM met"))
def metrics_read(spark, sf):
    m = scoring.read_metrics(tables.metrics_docs(spark, sf))
    return m.select("cell", "load_total", "load_errors", "e2e_pass", "e2e_total", "e2e_green", "k6_available", "deploy_ok", "scaling_ok", "stage_failed",
                    F.try_element_at("rest", F.lit("brand")).alias("brand"))


SCORED = [FOLD, AGENT, """
agt0 AS (SELECT ch.cell, CAST(sum(lines) AS BIGINT) AS charged, CAST(sum(lines) FILTER (counted) AS BIGINT) AS counted,
    CAST(sum(lines) FILTER (counted AND s IS NOT NULL) AS BIGINT) AS have, CAST(sum(s * lines) FILTER (counted) AS BIGINT) AS tot FROM ch LEFT JOIN ag USING (cell, attempt) GROUP BY ch.cell),
agt AS (SELECT cell, CASE WHEN counted = have THEN tot END AS agent_s_total, round(CASE WHEN counted = have THEN tot END / counted, 1) AS agent_s_per_attempt FROM agt0)""",
    USE_A, USE_B, ATTEMPTS, TOTALS, SURF, """
sfc AS (SELECT CAST(substr(cell, 4) AS BIGINT) AS cell, count(*) FILTER (authored) AS files, count(DISTINCT language) FILTER (authored) AS language_count,
    CAST(coalesce(sum(lines) FILTER (authored), 0) AS BIGINT) AS lines, CAST(coalesce(sum(sloc) FILTER (authored), 0) AS BIGINT) AS sloc, CAST(sum(lines) AS BIGINT) AS total_lines FROM pf GROUP BY cell)""",
    ENV, METRICS, """
vf AS (SELECT 'v' || n_nationkey AS variant, n_name AS tech FROM nation WHERE n_nationkey < 3),
scored AS (SELECT CAST(env.cell AS VARCHAR) AS cell_id, model, task, env.variant, tech, coalesce(impl, 'bash') AS impl, repeat, CAST(NULL AS BOOLEAN) AS first_pass_correct,
    deploy_ok, CAST(e2e_pass AS BIGINT) AS e2e_pass, CAST(e2e_total AS BIGINT) AS e2e_total, e2e_green, CAST(load_errors AS BIGINT) AS load_errors, CAST(load_total AS BIGINT) AS load_total, k6_available,
    stage_failed AS verify_stage_failed, CASE WHEN verdict = 'green' THEN green_at END AS iterations_to_green, coalesce(verdict = 'green', false) AS green,
    coalesce(verdict = 'revoked', false) AS revoked, coalesce(budget_exhausted, false) AS budget_exhausted, agent_s_total, agent_s_per_attempt, """
    + ", ".join(f"{f}_total" for f in USAGE_FIELDS) + """, round(1000 * api_s_total / nullif(out_tok_total, 0), 2) AS api_ms_per_out_tok,
    files, language_count, lines, sloc, total_lines
  FROM env LEFT JOIN fold ON fold.cell = env.cell LEFT JOIN met ON met.cell = env.cell LEFT JOIN agt ON agt.cell = env.cell LEFT JOIN tot ON tot.cell = env.cell
  LEFT JOIN sfc ON sfc.cell = env.cell LEFT JOIN vf ON vf.variant = env.variant)"""]


def variants(spark, sf):
    """Factors of three of the four variants; the fourth is retired."""
    n = table(spark, sf, "nation").where("n_nationkey < 3")
    return n.select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("variant"), F.create_map(F.lit("tech"), F.col("n_name")).alias("factors"))


def scored(spark, sf):
    s = surface.author_surface(surface.per_file(tables.files(spark, sf), skeleton(spark, sf)))
    s = s.withColumn("cell", F.substring("cell", 4, 20).try_cast("long"))
    return scoring.score(env(spark, sf), tables.ledger(spark, sf), scoring.read_metrics(tables.metrics_docs(spark, sf)), s,
                         usage_attempts(spark, sf), variants(spark, sf))


@query("cell_scores", with_ctes(*SCORED, "SELECT * FROM scored"))
def cell_scores(spark, sf):
    return scored(spark, sf).withColumn("tech", F.try_element_at("factors", F.lit("tech"))).drop("factors", "correctness_tier", "grader", "grading_missing")


@query("score_sweep", with_ctes(*SCORED, "SELECT cell_id, model, task, e2e_pass, e2e_total, e2e_green, green, iterations_to_green, agent_s_total, lines FROM scored"))
def score_sweep(spark, sf):
    """Two sweeps: the first over half of the cells, with outcomes that the second
    finds out of date for some of them; the table ends as one sweep over all."""
    every = cut_lineage(scored(spark, sf))
    key = lambda rules: scoring.key_of(F.lit(rules), F.lit("sealed"), F.col("cell"))
    cells = env(spark, sf).select("cell", F.lit("sealed").alias("sealed"))
    records = lambda todo: every.join(todo.select(F.col("cell").cast("string").alias("cell_id")), "cell_id", "left_semi").select(*every.columns)
    old = cells.where("cell % 2 = 0").withColumn("key", F.when(F.col("cell") % 3 == 0, key("rules-1")).otherwise(key("rules-2")))
    path = f"{shared_folder(spark)}/scores"
    before = lambda todo: records(todo).withColumn("e2e_pass", F.when(F.col("cell_id").cast("long") % 3 == 0, F.lit(-1)).otherwise(F.col("e2e_pass")).cast("long"))
    scoring.sweep(old, old.limit(0).select("cell", "key"), before, path)
    table_, _ = scoring.sweep(cells.withColumn("key", key("rules-2")), old.select("cell", "key"), records, path)
    return table_.select("cell_id", "model", "task", "e2e_pass", "e2e_total", "e2e_green", "green", "iterations_to_green", "agent_s_total", "lines")


@query("cell_factors", with_ctes(ENV, "vf AS (SELECT 'v' || n_nationkey AS variant, n_name AS tech FROM nation WHERE n_nationkey < 3)",
       "SELECT cell, CASE WHEN tech IS NOT NULL THEN 'tech=' || tech ELSE '' END AS factors FROM env LEFT JOIN vf USING (variant)"))
def cell_factors(spark, sf):
    from runlens.functions import names
    j = env(spark, sf).join(variants(spark, sf), "variant", "left")
    return j.select("cell", names.factors_text(F.col("factors")).alias("factors"))


VAL = """vld AS (SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, CASE WHEN o_orderkey % 6 = 0 THEN 'TAINTED' ELSE 'VALID' END AS verdict,
    CASE WHEN o_orderkey % 12 = 0 THEN 'integrity' END AS first_taint FROM orders WHERE o_orderkey % 5 <> 0)"""


def _validated(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").where("o_orderkey % 5 <> 0").select(
        k.cast("string").alias("cell_id"), F.when(k % 6 == 0, "TAINTED").otherwise("VALID").alias("verdict"), F.when(k % 12 == 0, "integrity").alias("first_taint"))


@query("untainted_scoreboard", with_ctes(SCORES, VAL, "kept AS (SELECT scores.* FROM scores LEFT JOIN vld USING (cell_id) WHERE coalesce(verdict, '') <> 'TAINTED')",
       f"grouped AS ({metrics_sql('kept', ('model', 'variant'))})", f"SELECT *, {PLACE_SQL} FROM grouped"))
def untainted_scoreboard(spark, sf):
    kept, _ = board.without_tainted(tables.scores(spark, sf), _validated(spark, sf))
    return board.board(kept)


@query("tainted_cells", with_ctes(VAL, "SELECT cell_id, coalesce(first_taint, '(no reason recorded)') AS reason FROM vld WHERE verdict = 'TAINTED'"))
def tainted_cells(spark, sf):
    return board.without_tainted(tables.scores(spark, sf), _validated(spark, sf))[1]


STALE = """rc AS (SELECT o_orderkey AS cell, 1000 AS record, 900 + o_orderkey % 150 AS env, CASE WHEN o_orderkey % 4 <> 0 THEN 950 + o_custkey % 70 END AS ledger, 900 + (o_orderkey * 7) % 120 AS metrics FROM orders),
stl AS (SELECT * FROM (SELECT cell, CASE WHEN env > record THEN 'env' WHEN ledger > record THEN 'ledger' WHEN metrics > record THEN 'metrics' END AS newer FROM rc) WHERE newer IS NOT NULL)"""


@query("stale_records", with_ctes(STALE, "SELECT * FROM stl"))
def stale_records(spark, sf):
    return scoring.stale(_records(spark, sf))


def _records(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("cell"), F.lit(1000).alias("record"), (k % 150 + 900).alias("env"),
        F.when(k % 4 != 0, F.col("o_custkey") % 70 + 950).alias("ledger"), (k * 7 % 120 + 900).alias("metrics"))


@query("first_stale_records", with_ctes(STALE, "n AS (SELECT *, row_number() OVER (PARTITION BY newer ORDER BY cell) AS r FROM stl)", "SELECT newer, cell FROM n WHERE r <= 10"))
def first_stale_records(spark, sf):
    # ten of each kind are named: ten per salt first, so no task ranks them all
    s = scoring.stale(_records(spark, sf)).withColumn("_salt", F.col("cell") % 64)
    few = s.withColumn("_n", F.row_number().over(Window.partitionBy("newer", "_salt").orderBy("cell"))).where("_n <= 10")
    return few.withColumn("_n", F.row_number().over(Window.partitionBy("newer").orderBy("cell"))).where("_n <= 10").select("newer", "cell")


@query("cells_to_score", """SELECT o_orderkey AS cell FROM orders WHERE o_orderkey % 8 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0""")
def cells_to_score(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    now = o.select(k.alias("cell"), F.when(k % 8 != 0, F.lit("2024-01-01T00:00:00Z")).alias("sealed"),
                   scoring.key_of(F.lit("rules-2"), F.lit("2024-01-01T00:00:00Z"), k, F.col("o_custkey")).alias("key"))
    stored = o.where("o_orderkey % 3 <> 0").select(k.alias("cell"), scoring.key_of(
        F.lit("rules-2"), F.lit("2024-01-01T00:00:00Z"), k + (k % 5 == 0).cast("long"), F.col("o_custkey")).alias("key"))
    return scoring.to_score(now, stored).select("cell")


@query("changed_inputs", "SELECT doc_id AS cell, source, n_chars AS mtime FROM documents WHERE doc_id % 4 = 0 OR doc_id % 6 = 1")
def changed_inputs(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("cell"), "source", F.col("n_chars").alias("mtime"), F.lit(4).alias("version"))
    moved = F.when(F.col("cell") % 6 == 1, F.col("mtime") - 1).otherwise(F.col("mtime"))
    return scoring.changed_inputs(d, d.where("cell % 4 <> 0").withColumn("mtime", moved)).drop("version")


@query("smoke_verdicts", with_ctes(FOLD, METRICS, """
j AS (SELECT f.cell, verdict, green_at, halt_cause, met.* EXCLUDE (cell), met.cell IS NOT NULL AND e2e_total IS NOT NULL AS hm FROM fold f LEFT JOIN met ON met.cell = f.cell),
g AS (SELECT *, coalesce(CAST(CAST(e2e_pass AS BIGINT) AS VARCHAR), 'None') || '/' || coalesce(CAST(CAST(e2e_total AS BIGINT) AS VARCHAR), 'None') AS e,
    CASE WHEN verdict IS NOT NULL THEN verdict = 'green' ELSE coalesce(e2e_green, false) AND coalesce(scaling_ok, true) END AS green FROM j)""", """
    SELECT cell, green, CASE WHEN green THEN CASE WHEN k6_available = false THEN 'GREEN e2e ' || e || ' — load generator missing, load not measured'
      WHEN green_at IS NOT NULL THEN 'GREEN at attempt ' || green_at ELSE 'GREEN e2e ' || e END
      ELSE CASE WHEN halt_cause <> '' THEN 'HALT — ' || halt_cause WHEN NOT hm THEN 'NO METRICS' WHEN coalesce(e2e_green, false) AND scaling_ok = false THEN 'SCALING FAILED — e2e ' || e
        WHEN stage_failed = 'deploy' THEN 'DEPLOY FAILED' WHEN stage_failed = 'nostart' THEN 'NEVER STARTED' WHEN stage_failed = 'e2e' THEN 'E2E FAILED (' || e || ')' WHEN stage_failed = 'k6' THEN 'K6 STAGE ISSUE'
        ELSE 'NOT GREEN (stage=' || coalesce(stage_failed, '?') || ')' END END AS text FROM g"""))
def smoke_verdicts(spark, sf):
    m = scoring.read_metrics(tables.metrics_docs(spark, sf))
    j = L.fold(tables.ledger(spark, sf)).join(m, "cell", "left").withColumn("has_metrics", F.col("e2e_total").isNotNull())
    return j.select("cell", scoring.smoke_verdict().alias("v")).select("cell", "v.green", "v.text")


@query("warning_kinds", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_split_to_array(replace(text, chr(10), ' '), ' \(|: ')[1], '\d+', '', 'g'), '\s+', ' ', 'g')) AS kind FROM documents""")
def warning_kinds(spark, sf):
    t = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", text.warning_kind(t).alias("kind"))
