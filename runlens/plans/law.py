"""The load-shape law: verdict and reasons per run.

Every fact is computed per spike, then the first spike that decides a run is
taken; when none does, the reasons of all spikes are put in order. Fixed values:
the texts of the reasons, which results are compared by.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators import traces
from runlens.operators.asof import asof
from runlens.operators.traces import GRACE_S
from runlens.session import cut_lineage


@dataclass(frozen=True)
class Limits:
    """Thresholds of the law."""
    sat_p99: float = 150.0
    max_mount: float = 30.0
    max_pct: float = 0.0
    max_lag: float = 20.0


@dataclass(frozen=True)
class Setting:
    """One way to judge: the tolerance per second of calibrated spread, and
    whether a cache mounted before its spike is charged."""
    name: str
    k: float = 0.0
    charge_premount: bool = False


def number(x: Column) -> Column:
    """A threshold as text: whole numbers without a fraction."""
    x = x.cast("double")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def whole(x: Column) -> Column:
    return F.format_string("%.0f", F.bround(x, 0))


def lit(x: float) -> Column:
    return F.lit(float(x))


def run_facts(trace: DataFrame, eps: DataFrame, runs: DataFrame) -> DataFrame:
    """Run rows with last tick, episodes, whether the last one ended, and the
    error share. ``runs`` has run, started, release, total, errors."""
    last = trace.groupBy("run").agg(F.max_by("ts", "seq").alias("last_ts"))
    e = eps.groupBy("run").agg(F.count(F.lit(1)).alias("n_eps"), F.max_by(F.struct("m1"), "n").alias("_last"))
    r = runs.join(last, "run", "left").join(e, "run", "left")
    pct = F.when(F.col("total") > 0, lit(100.0) * F.col("errors") / F.col("total")).otherwise(100.0)
    return r.select("run", "started", "total", "errors", F.coalesce("last_ts", lit(0)).alias("last_ts"),
                    F.coalesce("n_eps", F.lit(0)).alias("n_eps"),
                    (F.col("n_eps").isNull() | F.col("_last.m1").isNotNull() | F.col("release").isNotNull()).alias("released"),
                    pct.alias("err_pct"))


def errors_text(max_pct: float) -> Column:
    return F.concat(F.lit("load errors "), F.col("errors").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" = "),
                    F.format_string("%.1f", F.bround("err_pct", 1)), F.lit("% > "), number(lit(max_pct)),
                    F.lit("% (the policy must serve every request)"))


def judge(trace: DataFrame, spikes: DataFrame, runs: DataFrame, limits: Limits, width: float,
          settings: Sequence[Setting] = (Setting("plain"),)) -> DataFrame:
    """(run, setting, verdict, reasons), one row per run and way to judge.
    ``spikes`` may carry mount_spread and release_spread."""
    for c in ("mount_spread", "release_spread"):
        if c not in spikes.columns:
            spikes = spikes.withColumn(c, lit(0))
    eps = cut_lineage(traces.episodes(trace))  # read four times below
    by_run = Window.partitionBy("run").orderBy("i")
    facts = (traces.spike_facts(trace, spikes, limits.sat_p99, limits.max_lag, width)
             .join(spikes.select("run", "i", "mount_spread", "release_spread"), ["run", "i"])
             .withColumn("prev_lag", F.coalesce(F.lag("lag").over(by_run), lit(0)))
             .withColumn("next_t0", F.lead("t0").over(by_run))
             .withColumn("n_spikes", F.count(F.lit(1)).over(Window.partitionBy("run"))))
    # Episodes do not overlap, so at most one is up at the spike's start; it is
    # an earlier spike's when it began before the spike's own mount window.
    hits = eps.select("run", F.col("m0").alias("_at"), F.struct("n", "m0", "m1").alias("over"))
    facts = asof(facts.withColumn("_q", F.col("t0") + GRACE_S), hits, ["run"], "_q", "_at", ["over"], width).drop("_q")
    covers = F.col("over").isNotNull() & (F.col("over.m1").isNull() | (F.col("over.m1") > F.col("t0") + GRACE_S))
    ways = F.array(*[F.struct(F.lit(w.name).alias("setting"), lit(w.k).alias("k"),
                              F.lit(w.charge_premount).alias("charge_premount")) for w in settings])
    facts = (facts.withColumn("over", F.when(covers, F.col("over"))).select("*", F.inline(ways))
             .withColumn("mt", F.coalesce(F.col("k") * F.col("mount_spread"), lit(0)))
             .withColumn("rt", F.coalesce(F.col("k") * F.col("release_spread"), lit(0)))
             .withColumn("held", F.when(F.col("over.m0") < F.col("t0") - GRACE_S - F.col("mt"), F.col("over"))))
    paired = eps.select("run", F.col("n").cast("int").alias("i"), F.struct("m0", "m1").alias("pair"))
    r = run_facts(trace, eps, runs)
    f = facts.withColumn("i", F.col("i").cast("int")).join(paired, ["run", "i"], "left").join(r, "run")

    i, before = F.col("i").cast("string"), (F.col("i") - 1).cast("string")
    bad_load = F.col("err_pct") > limits.max_pct
    span = F.concat(F.lit("p99 max "), whole(F.col("peak")), F.lit("ms < "), number(lit(limits.sat_p99)), F.lit("ms over ["),
                    whole(F.col("t0")), F.lit(".."), whole(F.col("t1")), F.lit("]"))
    end = F.col("held.m1")
    too_slow = (F.col("held").isNotNull() & (F.col("prev_lag") > 0) & ~bad_load & end.isNotNull()
                & (end <= F.col("t0") + F.col("prev_lag") + GRACE_S))
    slow_text = F.concat(F.lit("spike "), before, F.lit("'s traffic was answered "), whole(F.col("prev_lag")),
                         F.lit("s past its schedule and episode "), F.col("held.n").cast("string"),
                         F.lit(" was released within that time, inside spike "), i, F.lit(" (ts="), whole(end),
                         F.lit(") — the host is too slow for this schedule"))
    held_text = F.concat(F.lit("episode "), F.col("held.n").cast("string"), F.lit(" never released before spike "), i,
                         F.lit(" (its cache absorbed the spike: "), span, F.lit(")"))
    pre_text = F.concat(F.lit("episode "), F.col("over.n").cast("string"), F.lit(" mounted before spike "), i, F.lit(" (ts="),
                        whole(F.col("over.m0")), F.lit(", spike at "), whole(F.col("t0")),
                        F.lit(") with no earlier spike to hold it, and absorbed it: "), span)
    unsat = F.concat(F.lit("spike "), i, F.lit(" never saturated the store ("), span, F.lit(")"))
    err = errors_text(limits.max_pct)
    plus_errors = lambda t: F.when(bad_load, F.array(t, err)).otherwise(F.array(t))
    out = lambda v, reasons: F.struct(F.lit(v).alias("verdict"), reasons.alias("reasons"))
    stop = (F.when(too_slow, out("void", F.array(slow_text)))
            .when(F.col("sat").isNull() & F.col("held").isNotNull(), out("false", plus_errors(held_text)))
            .when(F.col("sat").isNull() & F.col("charge_premount") & F.col("over").isNotNull(), out("false", plus_errors(pre_text)))
            .when(F.col("sat").isNull() & bad_load,
                  out("false", F.array(F.concat(unsat, F.lit(" while requests failed — the service did not answer")), err)))
            .when(F.col("sat").isNull(),
                  out("void", F.array(F.concat(unsat, F.lit(" — the host's knee is above the ramp; raise [load] top"))))))

    m0, m1 = F.col("pair.m0"), F.col("pair.m1")
    has = F.col("pair").isNotNull()
    lo, hi = F.col("t0") - GRACE_S - F.col("mt"), F.col("sat") + limits.max_mount + F.col("mt")
    nxt = F.coalesce("next_t0", F.col("last_ts") + GRACE_S)
    later = F.col("next_t0").isNotNull()
    lag_text = F.when(F.col("lag") > 0, F.concat(F.lit(", traffic "), whole(F.col("lag")), F.lit("s past schedule"))).otherwise("")
    reasons = F.filter(F.array(
        F.when(has & ~m0.between(lo, hi), F.concat(
            F.lit("mount "), i, F.lit(" at ts="), whole(m0), F.lit(" outside spike "), i, F.lit("'s window ["), whole(lo), F.lit(".."),
            whole(hi), F.lit("] (saturated at ts="), whole(F.col("sat")), F.lit(", deadline "), number(lit(limits.max_mount)),
            F.lit("s after it)"))),
        F.when(has & (m1 < F.col("t1") - GRACE_S - F.col("rt")), F.concat(
            F.lit("episode "), i, F.lit(" released MID-spike (ts="), whole(m1), F.lit(" < spike end "), whole(F.col("t1")), F.lit(")"))),
        F.when(has & m1.isNull() & later, F.concat(
            F.lit("episode "), i, F.lit(" never released before spike "), (F.col("i") + 1).cast("string")))
        .when(has & (m1 > nxt + F.col("lag") + GRACE_S + F.col("rt")), F.concat(
            F.lit("episode "), i, F.lit(" released too late (ts="), whole(m1), F.lit(", next spike at "), whole(nxt), lag_text, F.lit(")")))),
        lambda t: t.isNotNull())
    per = f.select("run", "setting", "i", "n_spikes", "n_eps", "released", "err_pct", "errors", "total", "started",
                   stop.alias("stop"), reasons.alias("why"))
    # at most three reasons per spike, and as many spikes as one schedule has
    g = per.groupBy("run", "setting").agg(
        F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("i"))).alias("stop"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "why"))), lambda x: x["why"])).alias("why"),
        *[F.first(c).alias(c) for c in ("n_spikes", "n_eps", "released", "err_pct", "errors", "total", "started")])
    optional = lambda cond, text: F.when(cond, F.array(text)).otherwise(F.array().cast("array<string>"))
    count = F.concat(F.lit("expected "), F.col("n_spikes").cast("string"),
                     F.lit(" mount episode(s) (one per spike), saw "), F.col("n_eps").cast("string"))
    rest = F.concat(optional(F.col("n_eps") != F.col("n_spikes"), count), F.col("why"),
                    optional((F.col("n_eps") > 0) & ~F.col("released"), F.lit(TAIL_TEXT)), optional(bad_load, err))
    verdict = (F.when(F.col("started").isNull(), out("void", F.array(F.lit(NO_START_TEXT))))
               .when(F.col("stop").isNotNull(), F.col("stop"))
               .otherwise(F.struct(F.when(F.size(rest) == 0, "true").otherwise("false").alias("verdict"), rest.alias("reasons"))))
    return g.select("run", "setting", verdict.alias("v")).select("run", "setting", "v.verdict", F.array_join("v.reasons", "; ").alias("reasons"))


TAIL_TEXT = "cache never released after the tail (traffic below the knee must release it)"
NO_START_TEXT = "the load generator's start was not recorded — its schedule cannot be placed on the trace"


def judge_unscheduled(trace: DataFrame, runs: DataFrame, limits: Limits, mount_tol: float = 0.0) -> DataFrame:
    """The law of a run without a schedule: one episode around the first
    saturation."""
    eps = traces.episodes(trace)
    first = eps.groupBy("run").agg(F.min_by("m0", "n").alias("m0"))
    hot = trace.groupBy("run").agg(F.min_by("ts", F.when(F.col("p99") >= limits.sat_p99, F.col("seq"))).alias("sat"),
                                   F.max("p99").alias("peak"))
    f = run_facts(trace, eps, runs).join(first, "run", "left").join(hot, "run", "left")
    bad_load = F.col("err_pct") > limits.max_pct
    err = errors_text(limits.max_pct)
    unsat = F.concat(F.lit("load never saturated the store (p99 max "), whole(F.coalesce("peak", lit(0))), F.lit("ms < "),
                     number(lit(limits.sat_p99)), F.lit("ms)"))
    wait = F.col("m0") - F.col("sat")
    reasons = F.filter(F.array(
        F.when(F.col("n_eps") == 0, "cache never mounted under load"),
        F.when(F.col("n_eps") > 1, F.concat(F.lit("cache flapped ("), F.col("n_eps").cast("string"),
                                            F.lit(" mount episodes; the policy must hold through the sustained spike)"))),
        F.when(F.col("m0") < F.col("sat") - GRACE_S - mount_tol, F.concat(
            F.lit("cache mounted BEFORE saturation (ts="), whole(F.col("m0")), F.lit(" — a blip must be rejected)")))
        .when(wait > limits.max_mount + mount_tol, F.concat(
            F.lit("mount too late: saturation->mount "), whole(wait), F.lit("s > "), number(lit(limits.max_mount)), F.lit("s"))),
        F.when((F.col("n_eps") > 0) & ~F.col("released"), F.lit(TAIL_TEXT)),
        F.when(bad_load, err)), lambda t: t.isNotNull())
    out = lambda v, reasons: F.struct(F.lit(v).alias("verdict"), reasons.alias("reasons"))
    verdict = (F.when(F.col("sat").isNull() & bad_load, out("false", F.array(
        F.concat(unsat, F.lit(" while requests failed — the service did not answer")), err)))
        .when(F.col("sat").isNull(), out("void", F.array(F.concat(unsat, F.lit(" — the host's knee is above the ramp; raise [load] top")))))
        .otherwise(F.struct(F.when(F.size(reasons) == 0, "true").otherwise("false").alias("verdict"), reasons.alias("reasons"))))
    return f.select("run", verdict.alias("v")).select("run", "v.verdict", F.array_join("v.reasons", "; ").alias("reasons"))


def skip_reason(law_stages: tuple[str, ...]) -> Column:
    """Why an archived run is not judged again, null when it is. Runs have
    files_ok, readable, ok and stage."""
    early = F.lit(bool(law_stages)) & ~F.coalesce("ok", F.lit(False)) & ~F.coalesce(F.col("stage").isin(*law_stages), F.lit(False))
    return F.when(~F.col("files_ok"), "files missing").when(~F.col("readable"), "unreadable").when(early, "decided before the law")


def replay_changes(verdicts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Verdicts under settings ``off`` and ``on`` beside the recorded one
    (run, variant, ok): per variant the runs counted, how often ``off`` agrees
    with the record, and the number of each change; ``total`` over all."""
    v = verdicts.groupBy("run").agg(F.max(F.when(F.col("setting") == "off", F.col("verdict"))).alias("off"),
                                    F.max(F.when(F.col("setting") == "on", F.col("verdict"))).alias("on"))
    j = v.join(recorded, "run").withColumn("change", F.when(F.col("off") != F.col("on"), F.concat("off", F.lit("->"), "on")))
    kinds = [f"{a}->{b}" for a in ("true", "false", "void") for b in ("true", "false", "void") if a != b]
    counts = j.rollup("variant").agg(
        F.count(F.lit(1)).alias("counted"), F.count_if((F.col("off") == "true") == F.coalesce("ok", F.lit(False))).alias("off_agrees"),
        *[F.count_if(F.col("change") == k).alias(k.replace("->", "_to_")) for k in kinds], F.grouping("variant").alias("_all"))
    return counts.withColumn("variant", F.when(F.col("_all") == 1, "total").otherwise(F.col("variant"))).drop("_all")
