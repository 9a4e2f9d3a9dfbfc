"""Resource samples, host load, unit parsing and clocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.catalog.base import query, table, with_ctes
from runlens.catalog.frames import EVENTS, LEDGER, RESOURCES, SAMPLES
from runlens.functions import units
from runlens.operators import samples
from runlens.operators.asof import asof
from runlens.sources import lines, tables

DAY = 86400.0
_NODE = "regexp_matches(name, '(control-plane|worker)')"
_GROUPS = {"total": "plane IN ('docker', 'host')", "pods": "plane = 'k8s'",
           "app": f"((plane = 'docker' AND NOT {_NODE}) OR plane IN ('k8s', 'host')) AND tag = 'app'",
           "docker_app": f"plane = 'docker' AND NOT {_NODE} AND tag = 'app'", "k8s_app": "plane = 'k8s' AND tag = 'app'",
           "host_app": "plane = 'host'", "infra_pods": "plane = 'k8s' AND tag <> 'app'", "node": f"plane = 'docker' AND {_NODE}"}
TOTALS = RESOURCES + ",\nmt AS (SELECT cell, ts, " + ", ".join(
    f"round(coalesce(sum({c}) FILTER ({w}), 0), 1) AS {n}_{c}" for n, w in _GROUPS.items() for c in ("mem_mb", "cpu_pct")) + f""",
    count(*) FILTER ({_GROUPS['app']}) AS component_count FROM res GROUP BY cell, ts)"""


@query("machine_totals", with_ctes(TOTALS, "SELECT * FROM mt"))
def machine_totals(spark, sf):
    return samples.machine_totals(tables.resource_samples(spark, sf))


@query("footprints", with_ctes(TOTALS, """
d AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY cell ORDER BY ts), 5) AS dt FROM mt),
g AS (SELECT cell, count(*) AS samples, sum(dt) AS window_s, round(sum(total_cpu_pct / 100.0::DOUBLE * dt), 1) AS cpu_core_seconds,
    round(sum(total_mem_mb * dt), 0) AS mem_mb_seconds, round(max(total_cpu_pct), 1) AS max_cpu_pct, max(component_count) AS max_components,
    arg_max(ts, (total_mem_mb, -ts)) AS peak_ts FROM d GROUP BY cell)""", """
    SELECT g.*, round(cpu_core_seconds / window_s, 3) AS avg_cores, total_mem_mb AS peak_mem_mb, total_cpu_pct AS peak_cpu_pct, component_count AS peak_components
    FROM g JOIN mt ON mt.cell = g.cell AND mt.ts = g.peak_ts"""))
def footprints(spark, sf):
    return samples.footprint(tables.resource_samples(spark, sf), 5.0, 65536 * DAY)


CHECKS = RESOURCES + f""",
cc AS (SELECT *, abs(mem_mb - other_mb) <= greatest(0.2::DOUBLE * greatest(mem_mb, other_mb, 1), 16) AS near,
    again_mb IS NOT NULL AND least(mem_mb, again_mb) - greatest(0.2::DOUBLE * greatest(least(mem_mb, again_mb), 1), 16) <= other_mb
      AND other_mb <= greatest(mem_mb, again_mb) + greatest(0.2::DOUBLE * greatest(mem_mb, again_mb, 1), 16) AS resc FROM res),
cd AS (SELECT cell, ts, count(*) FILTER (plane = 'docker' AND other_mb IS NOT NULL AND NOT near AND NOT resc) AS dis,
    count(*) FILTER (plane = 'docker' AND other_mb IS NULL) AS unchecked,
    coalesce(sum(mem_mb) FILTER (plane = 'docker' AND {_NODE}), 0) AS nd, coalesce(sum(mem_mb) FILTER (plane = 'k8s'), 0) AS pd FROM cc GROUP BY 1, 2),
chk AS (SELECT cell, ts, dis + CASE WHEN pd > 0 AND nd > 0 AND pd > nd + greatest(0.2::DOUBLE * greatest(nd, 1), 16) THEN 1 ELSE 0 END AS disagree, unchecked FROM cd)"""


@query("memory_cross_checks", with_ctes(CHECKS, "SELECT * FROM chk"))
def memory_cross_checks(spark, sf):
    return samples.cross_check(tables.resource_samples(spark, sf))


RELIABLE = CHECKS + """,
rel0 AS (SELECT cell, count(*) AS samples, count(*) FILTER (disagree > 0) AS unreliable_samples, count(*) FILTER (unchecked > 0) AS unchecked_samples FROM chk GROUP BY cell),
rel AS (SELECT *, greatest(unreliable_samples, unchecked_samples) <= samples * 10 / 100.0::DOUBLE AS reliable FROM rel0)"""


@query("footprint_reliability", with_ctes(RELIABLE, "SELECT * FROM rel"))
def footprint_reliability(spark, sf):
    return samples.reliability(samples.cross_check(tables.resource_samples(spark, sf)))


@query("first_findings", with_ctes(CHECKS, """
f AS (SELECT cell, CASE WHEN disagree > 1 THEN 'many disagree' WHEN disagree = 1 THEN 'one disagrees' ELSE 'unchecked ' || unchecked END AS finding, min(ts) AS ts FROM chk WHERE disagree + unchecked > 0 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts, finding) AS n FROM f)""", "SELECT cell, ts, finding FROM n WHERE n <= 20"))
def first_findings(spark, sf):
    c = samples.cross_check(tables.resource_samples(spark, sf)).where(F.col("disagree") + F.col("unchecked") > 0)
    text = (F.when(F.col("disagree") > 1, "many disagree").when(F.col("disagree") == 1, "one disagrees")
            .otherwise(F.concat(F.lit("unchecked "), F.col("unchecked").cast("string"))))
    return samples.first_findings(c.select("cell", "ts", text.alias("finding")), keep=20)


@query("plane_union", with_ctes(RESOURCES, "SELECT plane, count(*) AS n, sum(mem_mb) AS mem_mb FROM res GROUP BY plane"))
def plane_union(spark, sf):
    r = tables.resource_samples(spark, sf).select("plane", "mem_mb")
    parts = [r.where(F.col("plane") == p) for p in ("docker", "k8s", "host")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("plane").agg(F.count(F.lit(1)).alias("n"), F.sum("mem_mb").alias("mem_mb"))


@query("generator_union", with_ctes(EVENTS, "SELECT run, CAST(sum(k) AS BIGINT) AS total, CAST(sum(k) FILTER (kind <> 'click') AS BIGINT) AS main FROM ev GROUP BY run"))
def generator_union(spark, sf):
    e = tables.events(spark, sf)
    part = lambda cond, main: e.where(cond).select("run", "k", F.lit(main).alias("is_main"))
    u = part(F.col("kind") != "click", True).unionByName(part(F.col("kind") == "click", False))
    return u.groupBy("run").agg(F.sum("k").alias("total"), F.sum(F.when(F.col("is_main"), F.col("k"))).alias("main"))


LIMITED = SAMPLES + """,
sl AS (SELECT host, ts, scope, name, owner, cpu_pct, mem_mb FROM samples UNION ALL SELECT DISTINCT host, ts, 'host', 'docker_cpus', '', 8.0::DOUBLE, NULL FROM samples WHERE ts % 7200 = 0
  UNION ALL SELECT DISTINCT host, ts, 'host', 'docker_mem_mb', '', NULL, 4096.0::DOUBLE FROM samples WHERE ts % 10800 = 0),
dl AS (SELECT host, ts, coalesce(sum(cpu_pct) FILTER (scope = 'container'), 0) AS cpu, coalesce(sum(mem_mb) FILTER (scope = 'container'), 0) AS mem,
    max(cpu_pct) FILTER (name = 'docker_cpus') AS cpus, max(mem_mb) FILTER (name = 'docker_mem_mb') AS mib FROM sl GROUP BY host, ts)"""


@query("docker_load", with_ctes(LIMITED, "SELECT host, ts, 'cpu' AS resource, round(cpu / cpus, 1) AS pct, cpus AS has FROM dl WHERE cpus IS NOT NULL "
       "UNION ALL SELECT host, ts, 'mem', round(100.0::DOUBLE * mem / mib, 1), mib FROM dl WHERE mib IS NOT NULL"))
def docker_load(spark, sf):
    s = tables.samples(spark, sf).select("host", "ts", "scope", "name", "owner", "cpu_pct", "mem_mb")
    at = s.select("host", "ts").distinct()
    row = lambda df, name, cpu, mem: df.select("host", "ts", F.lit("host").alias("scope"), F.lit(name).alias("name"), F.lit("").alias("owner"),
                                               F.lit(cpu).cast("double").alias("cpu_pct"), F.lit(mem).cast("double").alias("mem_mb"))
    return samples.docker_load(s.unionByName(row(at.where("ts % 7200 = 0"), "docker_cpus", 8.0, None))
                               .unionByName(row(at.where("ts % 10800 = 0"), "docker_mem_mb", None, 4096.0)))


WINDOWS = LEDGER + r""",
mk AS (SELECT cell, line_no, event, ts, fields[len(fields)] AS tx, lag(event) OVER w AS pe, lag(ts) OVER w AS pt FROM led WHERE event IN ('VERIFY_READY', 'SHAPE') WINDOW w AS (PARTITION BY cell ORDER BY line_no)),
vw AS (SELECT CAST(cell AS VARCHAR) AS cell, line_no, pt AS ready, ts AS closed, regexp_extract(tx, '\b([BS]{3}) (pass|FAIL)\b', 1) AS arrangement, regexp_extract(tx, '\b([BS]{3}) (pass|FAIL)\b', 2) AS outcome
  FROM mk WHERE event = 'SHAPE' AND pe = 'VERIFY_READY')"""


@query("verify_windows", with_ctes(WINDOWS, "SELECT CAST(cell AS BIGINT) AS cell, line_no, ready, closed, arrangement, outcome FROM vw"))
def verify_windows(spark, sf):
    return samples.verify_windows(tables.ledger(spark, sf))


SAMPLES_ONLY = SAMPLES[len(EVENTS) + 2:]


#: The samples of all runs as those of one machine.
FLEET_SAMPLES = SAMPLES_ONLY.replace("run // 16 AS host, ", "").replace("GROUP BY 1, 2, 3, 4, 5, 6", "GROUP BY 1, 2, 3, 4, 5")


@query("host_load_summary", with_ctes(WINDOWS, FLEET_SAMPLES, """
per AS (SELECT ts, coalesce(sum(cpu_pct) FILTER (scope = 'container'), 0) AS al, coalesce(sum(cpu_pct) FILTER (scope = 'container' AND owner = ''), 0) AS fr,
    max(cpu_pct) FILTER (name = 'cpu_idle') AS idle, max(cpu_pct) FILTER (name = 'load1') AS load1, max(cpu_pct) FILTER (name = 'mem_used_gb') AS mem FROM samples GROUP BY ts),
w AS (SELECT * FROM vw WHERE closed >= (SELECT min(ts) FROM per) AND ready <= (SELECT max(ts) FROM per)),
own AS (SELECT ts, owner, sum(cpu_pct) AS c FROM samples WHERE scope = 'container' AND owner <> '' AND cpu_pct IS NOT NULL GROUP BY 1, 2),
ins AS (SELECT w.cell, w.line_no, per.*, coalesce(own.c, 0) AS ow FROM w JOIN per ON per.ts BETWEEN ready AND closed LEFT JOIN own ON own.ts = per.ts AND own.owner = w.cell),
g AS (SELECT cell, line_no, count(*) AS samples, min(idle) AS idle_min, round(median(idle), 1) AS idle_median, max(load1) AS load1_max, max(mem) AS mem_used_gb_max,
    round(median(ow), 1) AS own_cpu_median, round(median(al - ow - fr), 1) AS other_cells_cpu_median, round(median(fr), 1) AS unowned_cpu_median FROM ins GROUP BY 1, 2),
ot AS (SELECT w.cell, w.line_no, s.role, s.owner, sum(cpu_pct) AS c FROM w JOIN samples s ON s.ts BETWEEN ready AND closed AND scope = 'container' AND owner <> '' AND owner <> w.cell AND cpu_pct IS NOT NULL GROUP BY 1, 2, 3, 4),
tp AS (SELECT cell, line_no, arg_max(role || ':' || owner, (c, role, owner)) AS nm, max(c) AS c FROM ot GROUP BY 1, 2)""", """
    SELECT w.*, coalesce(samples, 0) AS samples, idle_min, idle_median, load1_max, mem_used_gb_max, own_cpu_median, other_cells_cpu_median, unowned_cpu_median,
      nm || '=' || printf('%.0f', c / samples) AS top_other FROM w LEFT JOIN g USING (cell, line_no) LEFT JOIN tp USING (cell, line_no)"""))
def host_load_summary(spark, sf):
    one = F.lit(0).cast("long")
    windows = samples.verify_windows(tables.ledger(spark, sf)).withColumn("host", one)
    return samples.host_summary(windows, tables.samples(spark, sf, one), DAY).drop("host")


@query("container_owners", """WITH n AS (SELECT DISTINCT CASE c_custkey % 5 WHEN 0 THEN 'agent-' || c_custkey || '-box' WHEN 1 THEN 'dind-' || c_custkey WHEN 2 THEN 'grid' || c_nationkey || '-worker2'
    WHEN 3 THEN 'grid' || c_nationkey || '-control-plane' ELSE 'db' || c_custkey || 'x' END AS name FROM customer),
ids AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS cid FROM orders WHERE o_orderkey % 3 = 0),
h AS (SELECT name, arg_min(cid, (-len(cid), cid)) AS cid FROM n JOIN ids ON ends_with(name, cid) OR contains(name, '-' || cid || '-') GROUP BY name),
c AS (SELECT 'grid' || n_nationkey AS cluster, n_name AS cc FROM nation WHERE n_nationkey % 2 = 0),
j AS (SELECT n.name, h.cid, cc, regexp_extract(n.name, '^(.+)-(?:control-plane|worker\\d*)$', 1) AS cl FROM n LEFT JOIN h USING (name) LEFT JOIN c ON c.cluster = regexp_extract(n.name, '^(.+)-(?:control-plane|worker\\d*)$', 1))
SELECT name, CASE WHEN cid IS NOT NULL THEN cid WHEN cl <> '' THEN coalesce(cc, '') ELSE '' END AS owner,
  CASE WHEN cid IS NOT NULL THEN coalesce(nullif(rtrim(left(name, instr(name, cid) - 1), '-'), ''), 'cell') WHEN cl <> '' THEN 'kind' ELSE 'other' END AS role FROM j""".replace("\\\\", "\\"))
def container_owners(spark, sf):
    k = F.col("c_custkey")
    c, n = k.cast("string"), F.col("c_nationkey").cast("string")
    name = (F.when(k % 5 == 0, F.concat(F.lit("agent-"), c, F.lit("-box"))).when(k % 5 == 1, F.concat(F.lit("dind-"), c))
            .when(k % 5 == 2, F.concat(F.lit("grid"), n, F.lit("-worker2"))).when(k % 5 == 3, F.concat(F.lit("grid"), n, F.lit("-control-plane")))
            .otherwise(F.concat(F.lit("db"), c, F.lit("x"))))
    cells = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("cid"))
    clusters = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(
        F.concat(F.lit("grid"), F.col("n_nationkey").cast("string")).alias("cluster"), F.col("n_name").alias("cid"))
    return samples.container_owners(table(spark, sf, "customer").select(name.alias("name")), cells, clusters)


UNIT = EVENTS + """,
un AS (SELECT seq, CAST(k AS VARCHAR) || CASE k % 8 WHEN 0 THEN 'MiB' WHEN 1 THEN '.5GiB' WHEN 2 THEN 'Ki' WHEN 3 THEN 'kB' WHEN 4 THEN 'MB' WHEN 5 THEN '' WHEN 6 THEN 'm' ELSE '%' END AS s, k, k % 8 AS u FROM ev)"""


def _figures(spark, sf):
    tails = F.array(*[F.lit(t) for t in ("MiB", ".5GiB", "Ki", "kB", "MB", "", "m", "%")])
    return tables.events(spark, sf).select("seq", F.concat(F.col("k").cast("string"), tails[(F.col("k") % 8).cast("int")]).alias("s"))


@query("unit_parsing", with_ctes(UNIT, """SELECT seq,
    CAST(CASE u WHEN 0 THEN k WHEN 1 THEN (k + 0.5) * 1024 WHEN 2 THEN k / 1024 WHEN 3 THEN k / 1024 WHEN 4 THEN k WHEN 5 THEN k / 1048576.0::DOUBLE WHEN 6 THEN k ELSE k / 1048576.0::DOUBLE END AS DOUBLE) AS sample_mb,
    round(CAST(CASE u WHEN 0 THEN k WHEN 1 THEN (k + 0.5) * 1024 WHEN 4 THEN k END AS DOUBLE), 1) AS host_mib,
    CAST(CASE u WHEN 0 THEN k * 1048576 WHEN 1 THEN (k + 0.5) * 1073741824 WHEN 2 THEN 0 WHEN 3 THEN k * 1000 WHEN 4 THEN k * 1000000 WHEN 6 THEN 0 END AS DOUBLE) AS bytes,
    CAST(CASE u WHEN 5 THEN k WHEN 6 THEN k / 10.0::DOUBLE WHEN 7 THEN k ELSE 0 END AS DOUBLE) AS cpu FROM un"""))
def unit_parsing(spark, sf):
    s = F.col("s")
    return _figures(spark, sf).select("seq", units.sample_mem_mb(s).alias("sample_mb"), units.host_mem_mib(s).alias("host_mib"),
                                      units.size_bytes(s).alias("bytes"), units.cpu_pct(s).alias("cpu"))


@query("cgroup_memory", with_ctes(EVENTS, "SELECT seq, CASE WHEN k % 7 = 0 THEN NULL ELSE greatest(seq * 1000 - CASE WHEN k % 5 = 0 THEN 0 ELSE k * 5000 END, 0) / 1048576.0::DOUBLE END AS mb FROM ev"))
def cgroup_memory(spark, sf):
    k = F.col("k")
    tail = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("\ntotal_inactive_file "), (k * 5000).cast("string")))
    text = F.when(k % 7 == 0, F.lit("no such file")).otherwise(F.concat((F.col("seq") * 1000).cast("string"), tail))
    return tables.events(spark, sf).select("seq", units.cgroup_mem_mb(text).alias("mb"))


@query("container_stats", with_ctes(EVENTS, "SELECT seq, 'box' || run AS name, CAST(k AS DOUBLE) + 0.5 AS cpu_pct, CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) END AS mem_mb FROM ev WHERE k % 3 <> 0 "
       "UNION ALL SELECT seq, 'side', 2.0, 1024.0 FROM ev"))
def container_stats(spark, sf):
    k = F.col("k")
    first = F.concat(F.lit("box"), F.col("run").cast("string"), F.lit("\t"), F.when(k % 3 == 0, F.lit("--")).otherwise(F.concat(k.cast("string"), F.lit(".5%"))),
                     F.lit("\t"), F.when(k % 4 == 0, F.lit("--")).otherwise(F.concat(k.cast("string"), F.lit("MiB / 8GiB"))))
    text = F.concat(first, F.lit("\nbroken line\nside\t2.0%\t1GiB / 8GiB\n"))
    return tables.events(spark, sf).select("seq", F.inline(units.stats_rows(text)))


@query("host_reports", with_ctes(EVENTS, "SELECT seq, CAST(k AS DOUBLE) AS cpu_user, 2.5::DOUBLE AS cpu_sys, CAST(CASE WHEN k % 2 = 0 THEN 10 ELSE 90 END AS DOUBLE) AS cpu_idle, "
       "CASE WHEN k % 3 <> 0 THEN k + 0.25::DOUBLE END AS load1 FROM ev"))
def host_reports(spark, sf):
    k = F.col("k")
    cpu = lambda idle: F.concat(F.lit("CPU usage: "), k.cast("string"), F.lit("% user, 2.5% sys, "), idle, F.lit("% idle\n"))
    text = F.concat(cpu(F.lit("55")), F.when(k % 3 != 0, F.concat(F.lit("Load Avg: "), k.cast("string"), F.lit(".25, 1.0\n"))).otherwise(F.lit("")),
                    cpu(F.when(k % 2 == 0, "10").otherwise("90")))
    return tables.events(spark, sf).select("seq", units.top_last(text).alias("t")).select("seq", "t.*")


@query("torn_busy_lines", r"""WITH l AS (SELECT doc_id, unnest(string_split(translate(text, ' ', ','), chr(10)) || ['12.5,0.25', '13,0.5', '14.5']) AS line,
    generate_subscripts(string_split(text, chr(10)) || ['', '', ''], 1) AS line_no FROM documents)
SELECT doc_id, line_no, TRY_CAST(split_part(line, ',', 1) AS DOUBLE) AS epoch, TRY_CAST(split_part(line, ',', 2) AS DOUBLE) AS busy FROM l
WHERE len(string_split(line, ',')) = 2 AND TRY_CAST(split_part(line, ',', 1) AS DOUBLE) IS NOT NULL AND TRY_CAST(split_part(line, ',', 2) AS DOUBLE) IS NOT NULL""")
def torn_busy_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.translate("text", " ", ","), F.lit("\n12.5,0.25\n13,0.5\n14.5")).alias("text"))
    return lines.busy(lines.numbered(d, "text", "doc_id"), "doc_id")




def _clock(spark, sf, host=None):
    """One host's two clocks: the monotonic one advances by half, in steps."""
    e = tables.events(spark, sf)
    mono = (F.floor(F.col("ts") / 7200) * 3600).cast("double")
    return e.select((tables.host_of("run") if host is None else host).alias("host"), "seq", "chunk", F.col("ts").alias("wall"), mono.alias("mono"))


CLOCK = EVENTS + """,
rd AS (SELECT run // 16 AS host, seq, ts AS wall, floor(ts / 7200) * 3600 AS mono FROM ev),
pr AS (SELECT *, lag(wall) OVER w AS pw, lag(mono) OVER w AS pm FROM rd WINDOW w AS (PARTITION BY host ORDER BY seq)),
gp AS (SELECT host, pw AS start, (wall - pw) - (mono - pm) AS s FROM pr WHERE (wall - pw) - (mono - pm) > 30)"""


@query("sleep_gaps", with_ctes(CLOCK, "SELECT host, start, round(s, 3) AS s FROM gp WHERE start + s >= (SELECT max(wall) FROM rd r WHERE r.host = gp.host) - 864000"))
def sleep_gaps(spark, sf):
    return samples.sleep_gaps(_clock(spark, sf), 864000.0).withColumn("s", F.round("s", 3))


@query("awake_ages", with_ctes(CLOCK.replace("run // 16 AS host", "run % 10 AS host"), "ag AS (SELECT run % 10 AS host, seq, ts AS since, ts + k * 3600 AS now FROM ev)",
       """SELECT ag.host, seq, round(max(now - since) - coalesce(sum(greatest(least(start + s, now) - greatest(start, since), 0)) FILTER (start IS NOT NULL), 0), 2) AS age
       FROM ag LEFT JOIN gp ON gp.host = ag.host AND start < now AND start + s > since GROUP BY 1, 2"""))
def awake_ages(spark, sf):
    host = F.col("run") % 10
    ages = tables.events(spark, sf).select(host.alias("host"), "seq", F.col("ts").alias("since"), (F.col("ts") + F.col("k") * 3600).alias("now"))
    a = samples.awake_age(ages, samples.sleep_gaps(_clock(spark, sf, host)), 4 * DAY)
    return a.select("host", "seq", F.round("age", 2).alias("age"))


@query("cpu_busy_shares", with_ctes(EVENTS, """
c AS (SELECT run AS host, seq, seq * 10 AS total, seq * 7 + k AS idle FROM ev),
d AS (SELECT host, seq, total - lag(total) OVER w AS dt, idle - lag(idle) OVER w AS di FROM c WINDOW w AS (PARTITION BY host ORDER BY seq))""",
    "SELECT host, seq, round(CASE WHEN dt > 0 THEN (dt - di) / dt ELSE 0 END, 6) AS busy FROM d WHERE dt IS NOT NULL"))
def cpu_busy_shares(spark, sf):
    c = tables.events(spark, sf).select(F.col("run").alias("host"), "seq", "chunk", (F.col("seq") * 10).alias("total"), (F.col("seq") * 7 + F.col("k")).alias("idle"))
    return samples.cpu_busy(c).select("host", "seq", F.round("busy", 6).alias("busy"))


@query("top_other_owners", with_ctes(SAMPLES, "o AS (SELECT host, ts, role, owner, sum(cpu_pct) AS c FROM samples WHERE scope = 'container' AND owner <> '' AND cpu_pct IS NOT NULL GROUP BY 1, 2, 3, 4)",
       "SELECT host, ts, arg_max(role || ':' || owner, (c, role, owner)) AS top_other FROM o GROUP BY host, ts"))
def top_other_owners(spark, sf):
    s = tables.samples(spark, sf).where("scope = 'container' AND owner <> '' AND cpu_pct IS NOT NULL")
    o = s.groupBy("host", "ts", "role", "owner").agg(F.sum("cpu_pct").alias("c"))
    return o.groupBy("host", "ts").agg(F.max_by(F.concat("role", F.lit(":"), "owner"), F.struct("c", "role", "owner")).alias("top_other"))


@query("regimes_of_cells", with_ctes(EVENTS, """
rg AS (SELECT run // 16 AS host, seq, ts, 'cap' || k AS regime FROM ev WHERE kind = 'signup'),
st AS (SELECT run // 16 AS host, seq AS cell, ts AS started FROM ev WHERE kind = 'purchase')""",
    "SELECT st.host, cell, (SELECT arg_max(regime, (ts, seq)) FROM rg WHERE rg.host = st.host AND ts <= started) AS regime FROM st"))
def regimes_of_cells(spark, sf):
    e = tables.events(spark, sf).withColumn("host", tables.host_of("run"))
    regimes = e.where("kind = 'signup'").select("host", "seq", "ts", F.concat(F.lit("cap"), F.col("k").cast("string")).alias("regime"))
    cells = e.where("kind = 'purchase'").select("host", F.col("seq").alias("cell"), F.col("ts").alias("started"))
    return asof(cells, regimes, ["host"], "started", "ts", ["regime"], 4 * DAY, tie="seq").select("host", "cell", "regime")
