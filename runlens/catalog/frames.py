"""SQL texts of the derived tables, one CTE each, matching sources.tables."""

SCORES = """lines AS (
  SELECT l_orderkey, count(*) AS n,
         count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'R') AS n_r,
         count(*) FILTER (l_returnflag = 'N') AS n_n,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R') AS BIGINT) AS errs,
         CAST(sum(l_linenumber) AS BIGINT) AS calls,
         CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS ext
  FROM lineitem GROUP BY l_orderkey),
scores AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS cell_id, coalesce(c_mktsegment, 'unknown') AS model,
    'T' || CAST(o_orderkey % 3 + 1 AS VARCHAR) AS task, o_orderpriority AS variant,
    'q' || CAST(quarter(o_orderdate) AS VARCHAR) AS f_quarter, coalesce(CAST(c_nationkey AS VARCHAR), '-') AS f_home,
    CASE WHEN year(o_orderdate) % 2 = 0 THEN 'py' ELSE 'bash' END AS impl,
    o_orderkey % 5 + 1 AS repeat,
    CASE WHEN o_orderkey % 7 <> 0 THEN n = 1 END AS first_pass_correct,
    CAST(NULL AS VARCHAR) AS correctness_tier,
    o_orderkey % 11 <> 0 AS deploy_ok,
    n_a AS e2e_pass, n AS e2e_total, n_a * 2 >= n AS e2e_green,
    errs AS load_errors, qty AS load_total, o_orderkey % 13 <> 0 AS k6_available,
    CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'e2e' ELSE 'scaling' END END AS verify_stage_failed,
    CASE WHEN o_orderstatus = 'F' THEN n END AS iterations_to_green,
    o_orderstatus = 'F' AS green, o_orderstatus = 'P' AS revoked,
    n >= 6 AND o_orderstatus <> 'F' AS budget_exhausted,
    o_totalprice AS agent_s_total, o_totalprice / n AS agent_s_per_attempt,
    CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 2) END AS api_s_total,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice - floor(o_totalprice / 2) END AS tool_s_total,
    qty AS turns_total, CASE WHEN o_orderkey % 3 <> 0 THEN calls END AS tool_calls_total,
    ext AS out_tok_total, ext // 3 AS think_tok_total, ext * 2 AS in_tok_total,
    ext / 10000.0::DOUBLE AS cost_usd_total, n_r AS retries_total,
    CAST(errs AS DOUBLE) AS retry_wait_s_total, n_n AS limited_total, CAST(NULL AS BIGINT) AS sandbox_fails_total,
    qty * 1000.0::DOUBLE / ext AS api_ms_per_out_tok,
    n AS files, CAST(n_a > 0 AS BIGINT) + CAST(n_r > 0 AS BIGINT) + CAST(n_n > 0 AS BIGINT) AS language_count,
    ext // 100 AS lines, ext // 150 AS sloc, ext // 80 AS total_lines,
    CAST(NULL AS VARCHAR) AS grader, CAST(NULL AS VARCHAR) AS grading_missing
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey)"""

EVENTS = """ev AS (
  SELECT user_id AS run, event_id AS seq, epoch_us(ts) / 1e6::DOUBLE AS ts, event_type AS kind, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

LEDGER = EVENTS + """,
led0 AS (
  SELECT run AS cell, seq AS line_no, ts, k, value, kind, k % 10 AS ten,
    CAST(run AS VARCHAR) AS c, 'attempt=' || CAST(k // 25 + 1 AS VARCHAR) AS a,
    CASE WHEN kind = 'signup' THEN
           CASE k % 10 WHEN 0 THEN 'END' WHEN 1 THEN 'END' WHEN 2 THEN 'REVERIFY' WHEN 3 THEN 'HALT'
             WHEN 4 THEN 'PREPARED' WHEN 5 THEN 'REVERIFY_END' WHEN 6 THEN 'VERIFY_NOSTART' ELSE 'START' END
         WHEN kind = 'error' THEN CASE WHEN k % 10 = 0 THEN 'NOEDIT' ELSE 'ITER' END
         WHEN kind = 'purchase' THEN 'ITER'
         WHEN kind = 'view' THEN CASE WHEN k % 10 = 0 THEN 'VERIFY_READY' ELSE 'SHAPE' END
         ELSE CASE WHEN k % 10 = 0 THEN 'ALERT' WHEN k % 10 <= 4 THEN 'AGENT' WHEN k % 10 = 5 THEN 'REVERIFY'
              WHEN k % 10 = 6 THEN 'PAUSED' WHEN k % 10 = 7 THEN 'WAKE' ELSE 'START' END END AS event,
    CASE WHEN k % 10 <= 3 THEN 'e2e' WHEN k % 10 <= 5 THEN 'scaling' WHEN k % 10 = 6 THEN 'no-edit' ELSE 'load' END AS stage,
    CASE k % 3 WHEN 0 THEN 'BBS' WHEN 1 THEN 'BSB' ELSE 'SSB' END AS shape,
    CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS secs
  FROM ev),
led AS (
  SELECT cell, line_no, ts, k, value, event,
    CASE WHEN event = 'ITER' AND kind = 'purchase'
           THEN [CASE WHEN ten = 0 THEN 'budget' ELSE 'green' END, a || ' shapes=all']
         WHEN event = 'ITER' THEN ['fail', a || ' stage=' || stage || ' e2e=' || CAST(ten AS VARCHAR) || '/8'
              || CASE WHEN stage = 'scaling' THEN ' shape-gate=BSB' ELSE '' END]
         WHEN event = 'END' THEN [c, CASE WHEN ten = 0 THEN 'green=true' ELSE 'green=false' END]
         WHEN event = 'REVERIFY' THEN [c, CASE WHEN ten = 2 THEN 'start' WHEN k % 4 = 1 THEN 'PASS' ELSE 'queued' END]
         WHEN event = 'HALT' THEN [c, a, CASE WHEN k % 4 = 3 THEN 'infra gone' ELSE 'agent-fault' END]
         WHEN event = 'ALERT' THEN [c, a, CASE WHEN k % 20 = 0 THEN 'RIG-OUTPUT trace missing' ELSE 'INTEGRITY verify wrote the ledger' END]
         WHEN event = 'AGENT' THEN [c, a, 's=' || secs, 'last_s=' || secs, 'client=' || CASE WHEN k % 2 = 0 THEN 'A:1.0' ELSE 'B:2.1' END]
         WHEN event = 'SHAPE' THEN [c, a, CASE WHEN ten = 9 THEN 'reverify ' ELSE '' END || shape || CASE WHEN ten <= 2 THEN ' FAIL' ELSE ' pass' END]
         WHEN event = 'NOEDIT' THEN [c, a, 'no file changed']
         ELSE [c, a] END AS fields
  FROM led0)"""

TRACE = EVENTS + """,
trace AS (
  SELECT run, seq, ts, value AS p99, value > 60 AS up, k AS offered_rps, kind, kind = 'error' AS failed,
    seq AS sent, seq - k % 3 * 300 AS done
  FROM ev)"""

SAMPLES = EVENTS + """,
samples AS (
  SELECT run // 16 AS host, floor(ts / 3600) * 3600 AS ts,
    CASE WHEN kind = 'signup' THEN 'host' ELSE 'container' END AS scope,
    CASE WHEN kind = 'signup' THEN CASE k % 3 WHEN 0 THEN 'cpu_idle' WHEN 1 THEN 'load1' ELSE 'mem_used_gb' END
         ELSE 'box-' || CAST(run AS VARCHAR) END AS name,
    CASE WHEN kind = 'signup' OR k % 9 = 0 THEN '' ELSE CAST(run AS VARCHAR) END AS owner,
    CASE WHEN kind = 'signup' THEN '' ELSE kind END AS role,
    max(CASE WHEN k <> 17 THEN floor(value) END) AS cpu_pct,
    max(CASE WHEN k % 5 <> 0 THEN CAST(k * 4 AS DOUBLE) END) AS mem_mb
  FROM ev GROUP BY 1, 2, 3, 4, 5, 6)"""

RESOURCES = EVENTS + """,
res AS (
  SELECT run AS cell, floor(ts / 86400) * 86400 AS ts, seq,
    CASE WHEN kind IN ('view', 'click') THEN 'docker' WHEN kind = 'signup' THEN 'host' ELSE 'k8s' END AS plane,
    CASE WHEN kind = 'view' THEN 'grid-' || CASE WHEN k % 2 = 0 THEN 'worker' ELSE 'control-plane' END
         ELSE kind || '-' || CAST(k % 4 AS VARCHAR) END AS name,
    CASE WHEN k % 3 = 0 THEN 'infra' ELSE 'app' END AS tag,
    floor(value) AS cpu_pct, CAST(k * 8 AS DOUBLE) AS mem_mb,
    CASE WHEN k % 7 <> 0 THEN k * 8 + floor(value) END AS other_mb,
    CASE WHEN k % 4 <> 0 THEN k * 8 + floor(value / 2) END AS again_mb
  FROM ev)"""

FILES = """files AS (
  SELECT source AS cell, doc_id, text AS content,
    CASE WHEN doc_id % 17 = 0 THEN 'node_modules' WHEN doc_id % 5 = 0 THEN 'lib' ELSE 'src' END
      || '/' || CAST(doc_id AS VARCHAR) || '/' ||
      CASE WHEN doc_id % 23 = 0 THEN 'Dockerfile' ELSE 'f' || CAST(doc_id AS VARCHAR) ||
        CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.YAML' WHEN 'fr' THEN '.md' ELSE '.rs' END END AS rel
  FROM documents)"""
