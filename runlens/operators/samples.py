"""Resource and host samples: footprints, host load around verifies, sleep."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from runlens.functions.units import sleep_gap
from runlens.operators import scan as S
from runlens.operators.asof import asof
from runlens.operators.intervals import bucket, spread

# Fixed pattern: the containers that are cluster nodes.
NODE = r"(control-plane|worker)"
NODE_NAME = r"^(.+)-(?:control-plane|worker\d*)$"
#: Blocks that a host's owners are dealt into, running sums that a block holds at once, and spans that meet them at once.
BLOCKS, TILE, SPANS = 48, 1 << 22, 64


# --- footprints ------------------------------------------------------------

def machine_totals(rows: DataFrame) -> DataFrame:
    """Five disjoint groups per sample. A cluster node already holds its pods,
    so pods are not added to the machine's total again. Rows have cell, ts,
    plane, name, tag, cpu_pct, mem_mb."""
    docker, pods, host = (F.col("plane") == p for p in ("docker", "k8s", "host"))
    node, app = F.col("name").rlike(NODE), F.col("tag") == "app"
    groups = {"docker_app": docker & ~node & app, "k8s_app": pods & app, "host_app": host,
              "infra_pods": pods & ~app, "node": docker & node}
    sums = lambda cond, c: F.round(F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0)), 1)
    component = ((docker & ~node) | pods | host) & app
    named = {"total": docker | host, "pods": pods, "app": component, **groups}
    return rows.groupBy("cell", "ts").agg(
        *[sums(cond, c).alias(f"{n}_{c}") for n, cond in named.items() for c in ("mem_mb", "cpu_pct")],
        F.count_if(component).alias("component_count"))


def cross_check(rows: DataFrame, tolerance_pct: float = 20.0, floor_mb: float = 16.0) -> DataFrame:
    """Per sample, how many components' two memory sources disagree and how
    many were measured once. Rows also have other_mb (the second source) and
    again_mb (a third reading), null when absent."""
    slack = lambda mb: F.greatest(tolerance_pct / 100.0 * F.greatest(mb, F.lit(1.0)), F.lit(floor_mb))
    docker, pods = F.col("plane") == "docker", F.col("plane") == "k8s"
    mem, other, again = F.col("mem_mb"), F.col("other_mb"), F.col("again_mb")
    lo, hi = F.least(mem, again), F.greatest(mem, again)
    close = F.abs(mem - other) <= slack(F.greatest(mem, other))
    rescued = again.isNotNull() & (lo - slack(lo) <= other) & (other <= hi + slack(hi))
    g = rows.groupBy("cell", "ts").agg(
        F.count_if(docker & other.isNotNull() & ~close & ~rescued).alias("disagree"),
        F.count_if(docker & other.isNull()).alias("unchecked"),
        F.coalesce(F.sum(F.when(docker & F.col("name").rlike(NODE), mem)), F.lit(0.0)).alias("_node"),
        F.coalesce(F.sum(F.when(pods, mem)), F.lit(0.0)).alias("_pods"))
    over = (F.col("_pods") > 0) & (F.col("_node") > 0) & (F.col("_pods") > F.col("_node") + slack(F.col("_node")))
    return g.select("cell", "ts", (F.col("disagree") + over.cast("int")).alias("disagree"), "unchecked")


def footprint(rows: DataFrame, interval_s: float, width: float) -> DataFrame:
    """Core-seconds and MB-seconds over the real time between samples, peaks,
    and the sample of highest memory (the first of equals). ``width`` seconds
    of samples make one chunk."""
    t = machine_totals(rows).withColumn("chunk", bucket(F.col("ts"), width))
    s = S.scan(t, ["cell"], ["ts"], {"_before": S.prev(F.col("ts"))})
    dt = F.coalesce(F.col("ts") - F.col("_before"), F.lit(float(interval_s)))
    peak = F.struct("ts", F.col("total_mem_mb").alias("mem_mb"), F.col("total_cpu_pct").alias("cpu_pct"), "component_count")
    g = s.groupBy("cell").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.sum(F.col("total_cpu_pct") / 100.0 * dt), 1).alias("cpu_core_seconds"),
        F.round(F.sum(F.col("total_mem_mb") * dt), 0).alias("mem_mb_seconds"), F.sum(dt).alias("window_s"),
        F.round(F.max("total_cpu_pct"), 1).alias("max_cpu_pct"), F.max("component_count").alias("max_components"),
        F.max_by(peak, F.struct("total_mem_mb", -F.col("ts"))).alias("p"))
    return g.select("cell", "samples", "window_s", "cpu_core_seconds", F.round(F.try_divide("cpu_core_seconds", "window_s"), 3).alias("avg_cores"),
                    "mem_mb_seconds", "max_cpu_pct", "max_components", F.col("p.ts").alias("peak_ts"),
                    F.col("p.mem_mb").alias("peak_mem_mb"), F.col("p.cpu_pct").alias("peak_cpu_pct"),
                    F.col("p.component_count").alias("peak_components"))


def reliability(checks: DataFrame, scoped: bool = True, checked: bool = True, max_bad_pct: float = 10.0) -> DataFrame:
    """Whether a cell's footprint may be quoted."""
    g = checks.groupBy("cell").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("disagree") > 0).alias("unreliable_samples"),
                                   F.count_if(F.col("unchecked") > 0).alias("unchecked_samples"))
    worst = F.greatest("unreliable_samples", "unchecked_samples")
    ok = F.lit(scoped and checked) & (F.col("samples") > 0) & (worst <= F.col("samples") * max_bad_pct / 100.0)
    return g.withColumn("reliable", ok)


# --- host load -------------------------------------------------------------

def docker_load(rows: DataFrame) -> DataFrame:
    """Containers' CPU and memory as a percent of what the engine has, per
    sample of a host; a sample without that figure has no row for it."""
    box = F.col("scope") == "container"
    limit = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    g = rows.groupBy("host", "ts").agg(
        F.sum(F.when(box, F.col("cpu_pct"))).alias("cpu"), F.sum(F.when(box, F.coalesce("mem_mb", F.lit(0.0)))).alias("mem"),
        limit("docker_cpus", "cpu_pct").alias("cpus"), limit("docker_mem_mb", "mem_mb").alias("mib"))
    pct = lambda used, has, scale: F.when(F.col(has) != 0, F.round(scale * F.coalesce(used, F.lit(0.0)) / F.col(has), 1))
    both = F.array(F.struct(F.lit("cpu").alias("resource"), pct("cpu", "cpus", 1.0).alias("pct"), F.col("cpus").alias("has")),
                   F.struct(F.lit("mem").alias("resource"), pct("mem", "mib", 100.0).alias("pct"), F.col("mib").alias("has")))
    return g.select("host", "ts", F.inline(both)).where("pct IS NOT NULL")


def verify_windows(ledger: DataFrame) -> DataFrame:
    """VERIFY_READY to the next SHAPE of a cell; a SHAPE closes at most one
    window, and one without a READY since the SHAPE before it is dropped."""
    marks = ledger.where(F.col("event").isin("VERIFY_READY", "SHAPE"))
    ready = F.col("event") == "VERIFY_READY"
    s = S.scan(marks, ["cell"], ["line_no"], {"_before": S.prev(F.struct("event", "ts"))})
    text = F.element_at("fields", -1)
    arrangement, outcome = F.regexp_extract(text, r"\b([BS]{3}) (pass|FAIL)\b", 1), F.regexp_extract(text, r"\b([BS]{3}) (pass|FAIL)\b", 2)
    return s.where(~ready & (F.col("_before.event") == "VERIFY_READY") & (arrangement != "")).select(
        "cell", "line_no", F.col("_before.ts").alias("ready"), F.col("ts").alias("closed"), arrangement.alias("arrangement"), outcome.alias("outcome"))


def _middle(xs: Column) -> Column:
    """The median of a list, to a tenth; null values are left out."""
    s = F.sort_array(F.filter(xs, lambda x: x.isNotNull()))
    n = F.size(s)
    both = F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))
    return F.round(both / 2.0, 1)


def _two_most(used: dict, spans: dict) -> dict:
    """For each span [lo, hi] the row (role, owner) with the largest sum of cpu over its
    times, and the largest of another owner. Equal sums: the greater role, then owner.
    Only rows with a time inside count. Running sums between the spans' ends are made
    for as many rows at once as TILE numbers hold."""
    lo, hi = spans["lo"], spans["hi"]
    marks = np.unique(np.concatenate([lo, np.nextafter(hi, np.inf)]))
    first, last = np.searchsorted(marks, lo), np.searchsorted(marks, np.nextafter(hi, np.inf))
    names = sorted(set(zip(used["role"], used["owner"], strict=True)), key=lambda x: (x[0] is not None, x[0] or "", x[1]), reverse=True)
    place = {x: i for i, x in enumerate(names)}
    row = np.array([place[x] for x in zip(used["role"], used["owner"], strict=True)], dtype=np.int64)
    number: dict[str, int] = {}
    owner = np.array([number.setdefault(o, len(number)) for _, o in names], dtype=np.int64)
    slot, cpu = np.searchsorted(marks, used["ts"], side="right"), used["cpu"]
    most = np.full((2, len(lo)), -np.inf)
    who = np.full((2, len(lo)), -1, dtype=np.int64)
    width = max(1, TILE // (len(marks) + 1))
    for a in range(0, len(names), width):
        b = min(a + width, len(names))
        some = (row >= a) & (row < b)
        sums, times = np.zeros((len(marks) + 1, b - a)), np.zeros((len(marks) + 1, b - a), dtype="i4")
        np.add.at(sums, (slot[some], row[some] - a), cpu[some])
        np.add.at(times, (slot[some], row[some] - a), 1)
        sums, times = sums.cumsum(axis=0), times.cumsum(axis=0, dtype="i4")
        _, of, roles = np.unique(owner[a:b], return_inverse=True, return_counts=True)
        starts = np.cumsum(roles) - roles
        columns = np.argsort(of, kind="stable")[np.minimum(starts[:, None] + np.arange(roles.max()), (starts + roles - 1)[:, None])]
        for at in range(0, len(lo), SPANS):
            x, y = first[at:at + SPANS], last[at:at + SPANS]
            held, every, whole = sums[y] - sums[x], np.arange(len(x)), False
            m, w = most[:, at:at + SPANS], who[:, at:at + SPANS]
            for _ in range(2):
                found = held.argmax(axis=1)
                if not whole and (held[every, found] <= 0).any():  # rows without a time inside have a sum of zero too
                    held[times[y] == times[x]], whole = -np.inf, True
                    found = held.argmax(axis=1)
                v, f = held[every, found], a + found
                same = (w[0] >= 0) & (owner[f] == owner[w[0]])
                up, second = v > m[0], ~same & (v > m[1])
                m[1], w[1] = np.where(up & ~same, m[0], np.where(second & ~up, v, m[1])), np.where(up & ~same, w[0], np.where(second & ~up, f, w[1]))
                m[0], w[0] = np.where(up, v, m[0]), np.where(up, f, w[0])
                held[every[:, None], columns[of[found]]] = -np.inf
    rank, at = np.nonzero(who >= 0)
    told = [names[i] for i in who[rank, at]]
    return {"lo": lo[at], "hi": hi[at], "role": [x[0] for x in told], "owner": [x[1] for x in told], "cpu": most[rank, at]}


def _most_used(by_role: DataFrame, spans: DataFrame) -> DataFrame:
    """``host, lo, hi, best`` for each span [lo, hi] of a host: the (role, owner, cpu) with
    the most cpu inside, and the most of another owner, largest first. Owners are dealt
    into BLOCKS; a block tells two rows for a span, however many owners it has."""
    block = F.pmod(F.xxhash64("owner"), F.lit(BLOCKS)).cast("int").alias("block")
    used = by_role.select("host", block, F.col("ts").cast("double").alias("ts"), "role", "owner", F.col("cpu").cast("double").alias("cpu"))
    asked = spans.select("host", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"), "lo", "hi")
    kinds = {f.name: f.dataType for f in by_role.schema.fields}
    schema = StructType([StructField("host", kinds["host"]), StructField("lo", DoubleType()), StructField("hi", DoubleType()), StructField("role", StringType()),
                         StructField("owner", StringType()), StructField("cpu", DoubleType())])
    arrow = to_arrow_schema(schema)

    def tell(key, own, some):
        own, some = ({c: t[c].to_pylist() if c in ("role", "owner") else t[c].to_numpy() for c in t.column_names if c not in ("host", "block")} for t in (own, some))
        told = _two_most(own, some) if len(own["ts"]) and len(some["lo"]) else {c: [] for c in ("lo", "hi", "role", "owner", "cpu")}
        return pa.table({"host": pa.repeat(key[0], len(told["lo"])), **told}, schema=arrow)

    told = used.groupBy("host", "block").cogroup(asked.groupBy("host", "block")).applyInArrow(tell, schema)
    by_owner = told.groupBy("host", "lo", "hi", "owner").agg(F.max(F.struct("cpu", "role")).alias("most"))
    ranked = F.sort_array(F.collect_list(F.struct("most.cpu", "most.role", "owner")), asc=False)
    return by_owner.groupBy("host", "lo", "hi").agg(F.slice(ranked, 1, 2).alias("best"))


def host_summary(windows: DataFrame, rows: DataFrame, width: float) -> DataFrame:
    """One row per verify window over the samples of its host inside it.

    Both have ``host``; a cell's windows are judged against what their own machine
    did. A host's samples become one run per ``width`` seconds, and a window meets
    runs, not samples: as many rows as time spans it touches. What a window then
    holds is its samples, which its length bounds. What other owners used is read off
    running sums, a block of owners at a time, and each block names its two most only."""
    box, cpu = F.col("scope") == "container", F.col("cpu_pct")
    host = lambda n: F.max(F.when((F.col("scope") == "host") & (F.col("name") == n), cpu))
    per = rows.groupBy("host", "ts").agg(
        F.coalesce(F.sum(F.when(box, cpu)), F.lit(0.0)).alias("all_cpu"),
        F.coalesce(F.sum(F.when(box & (F.col("owner") == ""), cpu)), F.lit(0.0)).alias("free_cpu"),
        host("cpu_idle").alias("idle"), host("load1").alias("load1"), host("mem_used_gb").alias("mem"))
    key, at = ["cell", "line_no"], bucket(F.col("ts"), width).alias("bucket")
    runs = per.groupBy("host", at).agg(F.collect_list(F.struct("ts", "all_cpu", "free_cpu", "idle", "load1", "mem")).alias("run"))
    span = per.groupBy("host").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    w = (windows.withColumn("cell", F.col("cell").cast("string")).join(span, "host")
         .where((F.col("closed") >= F.col("_first")) & (F.col("ready") <= F.col("_last"))).drop("_first", "_last"))
    by_role = (rows.where(box & (F.col("owner") != "") & cpu.isNotNull()).groupBy("host", "ts", "owner", "role")
               .agg(F.sum(cpu).alias("cpu")))
    own = (by_role.groupBy("host", F.col("owner").alias("cell"), "ts").agg(F.sum("cpu").alias("cpu"))
           .groupBy("host", "cell", at).agg(F.map_from_entries(F.collect_list(F.struct("ts", "cpu"))).alias("own")))

    met = spread(w.select("host", *key, "ready", "closed"), "ready", "closed", width)
    j = met.join(runs, ["host", "bucket"]).join(own, ["host", "bucket", "cell"], "left")
    mine = lambda x: F.coalesce(F.element_at("own", x["ts"]), F.lit(0.0))
    inside = F.transform(F.filter("run", lambda x: x["ts"].between(F.col("ready"), F.col("closed"))), lambda x: F.struct(
        mine(x).alias("own"), x["free_cpu"].alias("free"), (x["all_cpu"] - mine(x) - x["free_cpu"]).alias("other"), x["idle"].alias("idle"),
        x["load1"].alias("load1"), x["mem"].alias("mem"), x["ts"].cast("double").alias("ts")))
    g = j.select(*key, inside.alias("_in")).groupBy(*key).agg(F.flatten(F.collect_list("_in")).alias("_in"))
    g = g.select(*key, F.size("_in").alias("samples"), F.array_min("_in.idle").alias("idle_min"), _middle(F.col("_in.idle")).alias("idle_median"),
                 F.array_max("_in.load1").alias("load1_max"), F.array_max("_in.mem").alias("mem_used_gb_max"), _middle(F.col("_in.own")).alias("own_cpu_median"),
                 _middle(F.col("_in.other")).alias("other_cells_cpu_median"), _middle(F.col("_in.free")).alias("unowned_cpu_median"),
                 F.array_min("_in.ts").alias("lo"), F.array_max("_in.ts").alias("hi"))

    # windows that hold the same samples are one span
    asked = w.join(g.where("samples > 0"), key).select("host", *key, "lo", "hi")
    best = _most_used(by_role, asked.select("host", "lo", "hi").distinct())
    other = lambda x: x["owner"] != F.col("cell")
    top = asked.join(best, ["host", "lo", "hi"]).select(*key, F.get(F.filter("best", other), F.lit(0)).alias("top")).where("top IS NOT NULL")
    out = w.join(g.where("samples > 0").drop("lo", "hi"), key, "left").join(top, key, "left")
    name = F.concat("top.role", F.lit(":"), "top.owner", F.lit("="), F.format_string("%.0f", F.bround(F.col("top.cpu") / F.col("samples"), 0)))
    return out.withColumn("samples", F.coalesce(F.col("samples").cast("long"), F.lit(0).cast("long"))).withColumn("top_other", name).drop("top")


def container_owners(names: DataFrame, cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Owner and role of each container ``name``: the longest cell id the name
    ends with or holds between dashes, else the owner of its cluster, else
    nobody. The pieces of a name are looked up by equality, so no name meets
    every cell."""
    n = F.length("name")
    parts = F.split(F.col("name"), "-")
    endings = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("name"), i, n))
    last = F.size(parts) - 1
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.greatest(last, F.lit(2))), lambda i: F.transform(
        F.sequence(F.lit(1), F.greatest(last - i + 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, i, k), "-"))))
    pieces = F.array_distinct(F.when(last >= 2, F.concat(endings, inner)).otherwise(endings))
    distinct = names.select("name").distinct()
    cids = cells.select(F.col("cid").alias("piece")).distinct()
    hit = (distinct.select("name", F.explode(pieces).alias("piece")).join(cids, "piece")
           .groupBy("name").agg(F.min_by("piece", F.struct(-F.length("piece"), "piece")).alias("cid")))
    cluster = F.regexp_extract("name", NODE_NAME, 1)
    own = clusters.select(F.col("cluster").alias("_cluster"), F.col("cid").alias("_ccid"))
    j = distinct.join(hit, "name", "left").withColumn("_cluster", cluster).join(own, "_cluster", "left")
    before = F.regexp_replace(F.substring(F.col("name"), F.lit(1), F.position(F.col("cid"), F.col("name")) - 1), "-+$", "")
    owned = F.col("cid").isNotNull()
    return j.select("name", F.when(owned, F.col("cid")).when(F.col("_cluster") != "", F.coalesce("_ccid", F.lit(""))).otherwise("").alias("owner"),
                    F.when(owned, F.when(before != "", before).otherwise("cell")).when(F.col("_cluster") != "", "kind").otherwise("other").alias("role"))


# --- clocks ----------------------------------------------------------------

def sleep_gaps(readings: DataFrame, keep_s: float | None = None) -> DataFrame:
    """Sleeps between successive (wall, mono) readings of a host, as start and
    seconds; ``keep_s`` drops what ended that long before the last reading."""
    s = S.scan(readings, ["host"], ["seq"], {"_before": S.prev(F.struct("wall", "mono"))})
    g = s.select("host", F.col("_before.wall").alias("start"),
                 sleep_gap(F.col("wall") - F.col("_before.wall"), F.col("mono") - F.col("_before.mono")).alias("s")).where("s > 0")
    if keep_s is None:
        return g
    last = readings.groupBy("host").agg(F.max("wall").alias("_now"))
    return g.join(last, "host").where(F.col("start") + F.col("s") >= F.col("_now") - float(keep_s)).drop("_now")


def awake_age(ages: DataFrame, gaps: DataFrame, width: float) -> DataFrame:
    """Age of each row (host, since, now) less the host's sleep in it. Sleep up
    to an instant is a running sum over the gaps plus the part of the gap the
    instant lies in, so two lookups replace an overlap join."""
    g = gaps.withColumn("chunk", bucket(F.col("start"), width))
    upto = S.scan(g, ["host"], ["start"], {"slept": S.total_before(F.col("s"))}).select("host", "start", "s", "slept")

    def slept(df, at, name):
        hit = asof(df, upto.withColumn("_at", F.col("start")), ["host"], at, "_at", ["start", "s", "slept"], width)
        inside = F.least(F.col("s"), F.col(at) - F.col("start"))
        return hit.withColumn(name, F.coalesce(F.col("slept") + inside, F.lit(0.0))).drop("start", "s", "slept")
    j = slept(slept(ages, "since", "_s0"), "now", "_s1")
    return j.withColumn("age", F.col("now") - F.col("since") - (F.col("_s1") - F.col("_s0"))).drop("_s0", "_s1")


def cpu_busy(rows: DataFrame) -> DataFrame:
    """Busy share between successive counter rows (host, seq, total, idle):
    idle counts as not busy, a standing clock reads 0."""
    s = S.scan(rows, ["host"], ["seq"], {"_before": S.prev(F.struct("total", "idle"))})
    total = F.col("total") - F.col("_before.total")
    idle = F.col("idle") - F.col("_before.idle")
    return s.where("_before IS NOT NULL").withColumn("busy", F.when(total > 0, (total - idle) / total).otherwise(0.0)).drop("_before")


def first_findings(findings: DataFrame, keep: int | None = None) -> DataFrame:
    """Each finding once, at its first sample, in that order; ``keep`` limits
    the list a report shows."""
    g = findings.groupBy("cell", "finding").agg(F.min("ts").alias("ts"))
    if keep is None:
        return g
    place = F.row_number().over(Window.partitionBy("cell").orderBy("ts", "finding"))
    return g.withColumn("_n", place).where(F.col("_n") <= keep).drop("_n")
