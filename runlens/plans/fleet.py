"""The fleet: status, backlog, missing work, orphans and alerts. Detection
only; nothing here acts on a cell. Fixed values: the texts of states and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.lifecycle import LOOP_CLEARED_BY
from runlens.operators import scan as S

# Phases a loop leaves by itself, and the limits of the alerts
# in seconds.
WAIT_PHASES = ("verify-lock", "limit")
PHASE_ALERT_S = {"setup": 900.0, "agent": 10800.0, "verify-lock": 3600.0}
HANG_S, DEAD_GRACE_S = 600.0, 300.0
VERIFY_HELD_S, VERIFY_SLOW_FACTOR, VERIFY_WEDGED_S = 420.0, 1.5, 14400.0
SLOT_HELD_S, SLOT_STALL_S = 10800.0, 1800.0
GRACE_S, UNKNOWN_GRACE_S = 600.0, 3600.0
# Wording of walls, and of those a person must clear.
LIMIT_HINTS = ("limit", "quota", "not logged in", "overloaded", "please run /login", "authentication")
AUTH_HINTS = ("not logged in", "please run /login", "authentication")
KINDS = ("fresh", "prepared", "interrupted", "paused", "flagged", "running", "done")


def mentions(x: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(x), F.lit(w))
    return F.coalesce(hit, F.lit(False))


def status(folded: DataFrame, cells: DataFrame, gate_n: int = 6) -> DataFrame:
    """One row per cell: cancel, then outcome, then pause, then liveness.
    ``cells`` has cell, cancelled, pause (reason or null), phase (of a live
    heartbeat, else null), wait_reason, looping, queued."""
    j = cells.join(folded, "cell", "left")
    hb = F.col("phase")
    live = (F.when(hb.isin(*WAIT_PHASES), F.struct(F.lit("WAITING").alias("state"), hb.alias("why"), F.when(hb == "limit", F.coalesce("wait_reason", F.lit(""))).otherwise("").alias("detail")))
            .when(hb.isNotNull(), F.struct(F.lit("RUNNING").alias("state"), hb.alias("why"), F.lit("").alias("detail")))
            .when(F.col("looping"), F.struct(F.lit("RUNNING").alias("state"), F.lit("idle").alias("why"), F.lit("").alias("detail")))
            .when(F.col("queued"), F.struct(F.lit("CRASHED").alias("state"), F.lit("loop").alias("why"), F.lit("no loop — queued, admission resumes it").alias("detail")))
            .otherwise(F.struct(F.lit("CRASHED").alias("state"), F.lit("loop").alias("why"), F.lit("no loop — resume the cell").alias("detail"))))
    row = lambda s, w, d: F.struct(F.lit(s).alias("state"), w.alias("why"), d.alias("detail"))
    none = F.lit("")
    crashed = F.col("live.state") == "CRASHED"
    paused = F.col("pause").isNotNull()
    verdict = F.col("verdict")
    st = (F.when(F.col("cancelled"), row("DONE", F.lit("cancelled"), none))
          .when(verdict == "green", row("DONE", verdict, none))
          .when(verdict == "revoked", row("DONE", verdict, F.lit(f"green revoked by the {gate_n}-shape gate")))
          .when(verdict == "failed", row("DONE", verdict, none))
          .when(paused & crashed, row("PAUSED", F.col("pause"), none))
          .when((F.col("last_ev") == "HALT") & crashed, row("CRASHED", F.when(F.contains("halt_cause", F.lit("infra")), "infra").otherwise("agent"), F.col("halt_cause")))
          .when(paused, row("RUNNING", none, none).withField("state", F.col("live.state")).withField("why", F.col("live.why"))
                .withField("detail", F.trim(F.concat("live.detail", F.lit("  (pause pending)")))))
          .otherwise(F.col("live")))
    open_att = F.greatest(F.coalesce("att", F.lit(0)) + F.when(F.col("last_ev") == "ITER", 0).otherwise(1), F.lit(1))
    n = F.lit(str(gate_n))
    shape = (F.when((hb == "verify") & ~F.coalesce("reverify_active", F.lit(False)), F.concat(F.coalesce("live_shape_pass", F.lit(0)).cast("string"), F.lit("/"), n, F.lit("*")))
             .when(F.col("reverify_active"), F.concat(F.col("rev_pass").cast("string"), F.lit("/"), n))
             .when(F.col("gate").isNotNull(), F.concat(F.col("gate").cast("string"), F.lit("/"), n)).otherwise("-"))
    s = j.withColumn("live", live).withColumn("st", st)
    done = F.col("st.state") == "DONE"
    never = (F.col("st.state") == "CRASHED") & (F.col("events").isNull() | ((F.col("events") == 1) & F.col("prepared")))
    return s.select("cell", "st.state", "st.why", "st.detail", F.when(done, F.coalesce("att", F.lit(0))).otherwise(open_att).alias("att"),
                    F.when(done & (F.col("st.why") == "green"), F.col("green_at")).alias("green_at"), shape.alias("shape"), never.alias("never_started"),
                    F.coalesce("noedit", F.lit(0)).alias("noedit"), "noedit_last", F.coalesce("alerts_open", F.lit(0)).alias("alerts_open"), "alert_last",
                    "queued", "looping", paused.alias("paused"))


def triage(st: DataFrame) -> DataFrame:
    """Cells that need a person, one row per reason."""
    n = lambda c: F.col(c).cast("string")
    green = (F.col("state") == "DONE") & (F.col("why") == "green")
    reasons = F.filter(F.array(
        F.when((F.col("state") == "CRASHED") & ~F.col("queued"), F.concat(F.lit("CRASHED/"), "why", F.lit(": "), "detail")),
        F.when((F.col("state") == "WAITING") & (F.col("why") == "limit"), F.concat(F.lit("waiting on a limit: "), "detail")),
        F.when((F.col("alerts_open") > 0) & ~F.col("state").isin("DONE", "PAUSED"), F.concat(n("alerts_open"), F.lit("× ALERT — "), "alert_last")),
        F.when((F.col("noedit") > 0) & ~green, F.concat(n("noedit"), F.lit("× NOEDIT — investigate (agent fault or no-op): "), "noedit_last"))),
        lambda t: t.isNotNull())
    return st.select("cell", F.explode(reasons).alias("reason"))


def pending_kind(specs: DataFrame, st: DataFrame, flags: DataFrame) -> DataFrame:
    """What each pending spec waits on: the state its cell is in. ``flags``
    has cell, flagged for cells that have a workspace."""
    j = specs.join(flags.withColumn("_has", F.lit(True)), "cell", "left").join(
        st.select("cell", "state", "paused", "looping", "never_started"), "cell", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = (F.when(~yes("_has"), "fresh").when(yes("flagged"), "flagged").when(yes("paused"), "paused").when(yes("looping"), "running")
            .when(F.col("state") == "DONE", "done").when(yes("never_started"), "prepared").otherwise("interrupted"))
    return j.select(*specs.columns, kind.alias("kind"))


def backlog(kinds: DataFrame) -> DataFrame:
    """Pending specs per lane and kind, and the head of the lane."""
    return kinds.groupBy("lane").agg(
        F.count(F.lit(1)).alias("pending"), F.min_by("cell", F.struct("seq", "cell")).alias("head"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])


def weekly_reading(events: DataFrame, now: Column) -> DataFrame:
    """The newest seven-day limit event per lane: rejected reads as the whole
    cap, and a reading is void once its reset has passed. Events have lane,
    mtime, pos, kind, status, utilization, resets_at."""
    e = events.where("kind = 'seven_day'")
    g = e.groupBy("lane").agg(F.max_by(F.struct("status", "utilization", "resets_at"), F.struct("mtime", "pos")).alias("r"))
    used = F.when(F.col("r.status") == "rejected", 1.0).when(F.col("r.status") == "allowed_warning", F.col("r.utilization"))
    gone = F.coalesce(F.col("r.resets_at") <= now, F.lit(False))
    return g.select("lane", F.when(~gone, used).alias("utilization"), F.col("r.resets_at").alias("resets_at"))


def slow_limits(cells: DataFrame, references: DataFrame) -> DataFrame:
    """Seconds without a mark after which a verify is slow: the floor, or more
    than the longest calibrated arrangement of the variant. ``references`` has
    variant, seconds."""
    longest = references.groupBy("variant").agg(F.max("seconds").alias("_longest"))
    return cells.join(longest, "variant", "left").withColumn(
        "limit_s", F.greatest(F.lit(VERIFY_HELD_S), VERIFY_SLOW_FACTOR * F.coalesce("_longest", F.lit(0.0)))).drop("_longest")


def missing_work(variants: DataFrame, to_rep: int, ran: DataFrame, queued: DataFrame) -> DataFrame:
    """Reps wanted of every variant less those that ran and those queued, in
    admission order: rep first, then the variants' own order."""
    grid = variants.select("variant", "ord", F.explode(F.sequence(F.lit(1), F.lit(to_rep))).alias("rep"))
    key = ["variant", "rep"]
    return grid.join(ran.select(*key), key, "left_anti").join(queued.select(*key), key, "left_anti").select("rep", "ord", "variant")


def orphans(resources: DataFrame, live: DataFrame) -> DataFrame:
    """Resources with no live owner past their grace: the owner's ledger age
    where known, else the resource's own age with the long grace; of unknown
    age they are left alone. Resources have name, owner, iter_age, own_age."""
    grace = F.when(F.col("iter_age").isNotNull(), GRACE_S).otherwise(UNKNOWN_GRACE_S)
    age = F.coalesce("iter_age", "own_age")
    return resources.join(live.select(F.col("cell").alias("owner")), "owner", "left_anti").where(age >= grace).select("name", "owner")


def alerts(cells: DataFrame) -> DataFrame:
    """Every alert the sweep would raise, as (cell, rule, detail). One pass:
    the rules are an array of conditions on each row. Rows have cell, state,
    why, detail, flagged, intent, loop, in_box, out_size, out_age, iter_age,
    last_action, last_age, quiet_s, limit_s, phase, phase_age, slot_age, flat."""
    c = F.col
    done, hands_off = c("state") == "DONE", c("flagged") | (c("intent") != "run")
    active = c("state").isin("RUNNING", "WAITING")
    verifying = ~done & (c("last_action") == "AcquireVerify")
    slow = F.coalesce("quiet_s", "last_age")
    secs = lambda x: F.floor(x).cast("string")
    phase_limit = F.lit(None).cast("double")
    for name, limit in PHASE_ALERT_S.items():
        phase_limit = F.when(c("phase") == name, limit).otherwise(phase_limit)
    waits = c("phase").isin(*WAIT_PHASES)
    silent = F.when((c("phase") == "agent") | F.coalesce(waits, F.lit(False)), 0.0).otherwise(F.coalesce("phase_age", F.lit(SLOT_STALL_S + 1)))
    dead = (~c("loop") & ~c("in_box") & ~done & c("last_action").isNotNull() & ~c("last_action").isin(*LOOP_CLEARED_BY)
            & F.coalesce(c("out_age") >= DEAD_GRACE_S, F.lit(True)) & F.coalesce(c("last_age") >= DEAD_GRACE_S, F.lit(True)))
    hung = (~done & c("in_box") & (F.coalesce(c("out_size"), F.lit(0)) == 0) | ~done & c("in_box") & (c("out_age") > HANG_S)) & (c("iter_age") > HANG_S) & (c("flat") >= 2)
    wall = (c("state") == "WAITING") & (c("why") == "limit") & mentions(c("detail"), LIMIT_HINTS)
    rules = [
        ("dead-loop", dead, F.concat(F.lit("last="), "last_action")),
        ("verify-quiet", ~hands_off & verifying & (slow > c("limit_s")), F.concat(F.lit("no progress for "), secs(slow), F.lit("s > "), secs(c("limit_s")), F.lit("s"))),
        ("verify-wedged", ~hands_off & verifying & (c("last_age") > VERIFY_WEDGED_S), F.concat(F.lit("held "), secs(c("last_age")), F.lit("s"))),
        ("wait-long", ~hands_off & active & waits & (c("phase_age") > phase_limit), F.concat("phase", F.lit(" unchanged "), secs(c("phase_age")), F.lit("s"))),
        ("phase-stalled", ~hands_off & active & ~waits & (c("phase_age") > phase_limit), F.concat("phase", F.lit(" unchanged "), secs(c("phase_age")), F.lit("s"))),
        ("slot-stuck", ~hands_off & active & (c("slot_age") > SLOT_HELD_S) & (silent > SLOT_STALL_S), F.concat(F.lit("slot held "), secs(c("slot_age")), F.lit("s"))),
        ("silent-hang", ~hands_off & hung, F.concat(F.lit("flat "), c("flat").cast("string"), F.lit(" sweeps"))),
        ("limit-wall", ~hands_off & wall, F.concat(F.when(mentions(c("detail"), AUTH_HINTS), "AUTH ").otherwise("limit "), "detail")),
        ("orphan-loop", ~hands_off & done & c("loop") & (c("iter_age") >= HANG_S), F.concat(F.lit("alive "), secs(c("iter_age")), F.lit("s past the end"))),
    ]
    raised = F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(n).alias("rule"), detail.alias("detail"))) for n, when, detail in rules]),
                      lambda x: x.isNotNull())
    return cells.select("cell", F.inline(raised))


def alert_edges(readings: DataFrame) -> DataFrame:
    """Each alert episode of a cell and rule, as an ``opened`` row and, once lifted, a
    ``lifted`` row (seq, episode, key). An episode opens at a reading that is on after
    one that was not, that has another key (another verify, phase or attempt), or that
    a reset (a lifted stand-down) precedes; so an alert that lifts and returns is told
    twice, and one that stays is told once. Readings have cell, rule, seq, chunk, on,
    key, reset."""
    s = S.scan(readings.select("cell", "rule", "seq", "chunk", "on", "key", "reset"), ["cell", "rule"], ["seq"], {"_was": S.prev(F.struct("on", "key"))})
    was = F.coalesce("_was.on", F.lit(False))
    s = s.withColumn("_opens", F.col("on") & (~was | F.col("reset") | ~F.col("_was.key").eqNullSafe(F.col("key")))).withColumn("_ends", was & (F.col("_opens") | ~F.col("on")))
    s = S.scan(s.withColumn("_old", F.col("_was.key")).drop("_was"), ["cell", "rule"], ["seq"], {"_n": S.total(F.col("_opens").cast("long"))})
    opened, lifted = F.col("_opens"), F.col("_ends")
    edges = F.array(F.when(lifted, F.struct((F.col("_n") - opened.cast("long")).alias("episode"), F.col("_old").alias("key"), F.lit("lifted").alias("edge"))),
                    F.when(opened, F.struct(F.col("_n").alias("episode"), F.col("key").alias("key"), F.lit("opened").alias("edge"))))
    return s.select("cell", "rule", "seq", F.inline(F.filter(edges, lambda x: x.isNotNull())))


def memory_edges(levels: DataFrame) -> DataFrame:
    """Rising edges of a host's memory pressure, and its return to normal.
    Levels have host, seq, chunk, level."""
    s = S.scan(levels, ["host"], ["seq"], {"_before": S.prev(F.col("level"))})
    was, now = F.coalesce("_before", F.lit(0)), F.col("level")
    edge = F.when((now >= 2) & (now != was), "pressure").when((now < 2) & (was >= 2), "normal")
    return s.select("host", "seq", "level", edge.alias("edge")).where("edge IS NOT NULL")


def flat_sweeps(readings: DataFrame) -> DataFrame:
    """How many sweeps in a row each cell's received bytes stood still, up to
    each reading. A working CPU or a first reading starts the count again.
    Readings have cell, seq, chunk, rx, cpu."""
    s = S.scan(readings, ["cell"], ["seq"], {"_rx": S.prev(F.col("rx")), "_n": S.total(F.lit(1).cast("long"))})
    moving = (F.col("cpu") > 0.5) | F.col("_rx").isNull() | (F.col("rx") > F.col("_rx"))
    s = s.withColumn("_moved", F.when(moving, F.col("_n"))).drop("_rx")
    t = S.scan(s, ["cell"], ["seq"], {"_last": S.highest(F.col("_moved"))})
    return t.withColumn("flat", F.col("_n") - F.coalesce("_last", F.lit(0))).drop("_n", "_moved", "_last")


def first_seals(attempts: DataFrame, sealed: DataFrame | None = None) -> DataFrame:
    """The seals to add: a cell's first verdict wins, and a cell sealed before
    keeps its own. Rows have cell, sealed, verdict, attempts, by, seq."""
    first = attempts.groupBy("cell").agg(F.min_by(F.struct("sealed", "verdict", "attempts", "by"), F.struct("sealed", "seq")).alias("s")).select("cell", "s.*")
    return first if sealed is None else first.join(sealed.select("cell"), "cell", "left_anti")
