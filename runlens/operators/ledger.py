"""Ledger folds. A ledger frame has cell, line_no, ts, chunk, event, fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text
from runlens.operators import scan as S

# Ledger vocabulary.
ENDINGS = ("END", "HALT", "VERIFY_NOSTART")
SETTLED = ("END", "HALT", "ITER", "START", "VERIFY_NOSTART")
AFTER_END = ("SHAPE", "REVERIFY", "REVERIFY_END", "PAUSED", "ALERT", "END")
PROGRESS_MARKS = ("VERIFY_READY", "SHAPE", "WAKE")
VERIFY_EVENTS = ("ALERT", "VERIFY_READY")
ITER_RESULTS = ("fail", "green", "budget")
RULES = {
    1: "attempt numbers on ITER lines increase by exactly 1",
    2: "no attempt beyond the cell's ATTEMPT_BUDGET",
    3: "after the END, only bookkeeping (SHAPE, REVERIFY, REVERIFY_END, PAUSED, ALERT)",
    4: "at most one END, and a green END needs a green ITER",
    5: "an ITER needs a START for its attempt",
}


def _payload() -> Column:
    """The fields after the first (the cell, or an ITER's result)."""
    return F.array_join(F.slice("fields", F.lit(2), F.size("fields")), "\t")


def _last_field(n: int) -> Column:
    return F.left(F.element_at("fields", -1), F.lit(n))


def is_(*names: str) -> Column:
    return F.col("event").isin(*names)


def green_end() -> Column:
    return is_("END") & F.contains(_payload(), F.lit("green=true"))


def shape_passed() -> Column:
    return is_("SHAPE") & F.endswith(F.rtrim(_payload()), F.lit("pass"))


def in_reverify() -> Column:
    return F.contains(_payload(), F.lit("reverify"))


def passes_by_attempt(ledger: DataFrame) -> DataFrame:
    """Arrangements each attempt passed, reverifies left out."""
    return (ledger.where(shape_passed() & ~in_reverify())
            .select("cell", text.attempt_of(_payload()).alias("attempt"))
            .where("attempt IS NOT NULL").groupBy("cell", "attempt").agg(F.count(F.lit(1)).alias("passed")))


def fold(ledger: DataFrame, gate_n: int = 6) -> DataFrame:
    """One row per cell: its outcome and everything its lines say."""
    starts_gate = is_("REVERIFY") & F.contains(_payload(), F.lit("start"))
    ends_gate = is_("REVERIFY_END", *ENDINGS) | (is_("REVERIFY") & _payload().rlike("PASS|REVOKED|ERROR"))
    line = F.col("line_no")
    rows = S.scan(ledger, ["cell"], ["line_no"], {
        "nth_iter": S.total(is_("ITER").cast("long")),
        "start_after": S.next_seen(F.when(is_("START"), line)),
        "gate_after": S.next_seen(F.when(starts_gate, line)),
        "gate_line": S.last_seen(F.when(starts_gate, line)),
        "ended_line": S.last_before(F.when(ends_gate, line)),
    })
    in_gate = F.col("gate_line").isNotNull() & F.col("gate_after").isNull() & (line > F.col("gate_line"))
    still_open = F.coalesce(F.col("ended_line") <= F.col("gate_line"), F.lit(True))
    at = lambda value, when: F.max_by(F.when(when, value), F.when(when, line))
    note = F.coalesce(F.try_element_at("fields", F.lit(2)), F.lit(""))
    ending = is_(*ENDINGS)
    f = rows.groupBy("cell").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_("ITER")).alias("att"),
        F.max_by("event", line).alias("_last"),
        F.max_by(green_end(), line).alias("_last_green"),
        at(F.col("event"), ending).alias("_end"),
        at(green_end(), ending).alias("_end_green"),
        at(green_end(), is_("END")).alias("last_end_green"),
        F.coalesce(F.bool_or(green_end()), F.lit(False)).alias("green_seen"),
        F.bool_or(is_("REVERIFY")).alias("reverified"),
        F.bool_or(is_("PREPARED")).alias("prepared"),
        (F.max("gate_line").isNotNull() & ~F.coalesce(F.bool_or(in_gate & ends_gate), F.lit(False))).alias("reverify_active"),
        F.count_if(in_gate & still_open & shape_passed() & in_reverify()).alias("rev_pass"),
        F.min(F.when(is_("ITER") & (F.col("fields")[0] == "green"), F.col("nth_iter"))).alias("_green_iter"),
        at(_last_field(70), is_("HALT", "VERIFY_NOSTART")).alias("halt_cause"),
        F.count_if(is_("NOEDIT")).alias("noedit"),
        at(_last_field(110), is_("NOEDIT")).alias("noedit_last"),
        F.count_if(is_("ALERT")).alias("alerts"),
        F.count_if(is_("ALERT") & F.col("start_after").isNull()).alias("alerts_open"),
        at(_last_field(110), is_("ALERT")).alias("alert_last"),
        at(note, is_("ITER")).alias("last_note"),
        F.coalesce(F.bool_or(is_("ITER") & (F.col("fields")[0] == "budget")), F.lit(False)).alias("budget_exhausted"),
    )
    stays = F.col("_last").isin(*SETTLED) | F.col("_end").isNull()
    last_green = F.when(stays, F.col("_last_green")).otherwise(F.col("_end_green"))
    f = f.withColumn("last_ev", F.when(stays, F.col("_last")).otherwise(F.col("_end"))).withColumn(
        "verdict", F.when(F.col("last_ev") == "END", F.when(last_green, "green").when(
            F.col("green_seen") & F.col("reverified"), "revoked").otherwise("failed")))
    f = f.withColumn("green_at", F.when(F.col("verdict") == "green", F.col("att")).otherwise(F.col("_green_iter")))
    f = (f.withColumn("_judged", F.coalesce(text.attempt_of(F.col("last_note")), F.col("att")))
         .withColumn("_open", F.col("att") + 1))
    p = passes_by_attempt(ledger)
    for key, name in (("_judged", "_judged_pass"), ("_open", "live_shape_pass")):
        side = p.select("cell", F.col("attempt").alias(key), F.col("passed").alias(name))
        f = f.join(side, ["cell", key], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    n = F.col("last_note")
    gate = (F.when(F.contains(n, F.lit("shapes=all")), F.lit(gate_n).cast("long"))
            .when(F.contains(n, F.lit("shape-gate=")), F.col("_judged_pass") + 1)
            .when(F.contains(n, F.lit("stage=")), F.lit(0).cast("long")))
    return f.withColumn("gate", gate).select(
        "cell", "events", "att", "last_ev", "last_end_green", "green_seen", "reverified", "reverify_active",
        "rev_pass", "prepared", "verdict", "green_at", "halt_cause", "noedit", "noedit_last", "alerts",
        "alerts_open", "alert_last", "gate", "live_shape_pass", "budget_exhausted", "last_note")


def attempts_to_green(folded: DataFrame) -> DataFrame:
    green = F.coalesce(F.col("verdict") == "green", F.lit(False))
    return folded.select("cell", F.when(green, F.col("green_at")).alias("iterations_to_green"), green.alias("green"),
                         F.coalesce(F.col("verdict") == "revoked", F.lit(False)).alias("revoked"), "budget_exhausted")


def history(ledger: DataFrame) -> DataFrame:
    """The last group of equal attempt tokens per cell, with its length."""
    token = text.stage_token(F.col("fields")[0], F.coalesce(F.try_element_at("fields", F.lit(2)), F.lit("")))
    iters = ledger.where(is_("ITER")).withColumn("token", token)
    rows = S.scan(iters, ["cell"], ["line_no"], {"nth": S.total(F.lit(1).cast("long")),
                                                 "after": S.following(F.col("token"))})
    g = rows.groupBy("cell").agg(
        F.max_by("token", "line_no").alias("token"), F.max("nth").alias("n"),
        F.max(F.when(F.col("after").isNotNull() & (F.col("after") != F.col("token")), F.col("nth"))).alias("cut"))
    run = F.col("n") - F.coalesce("cut", F.lit(0))
    return g.select("cell", F.when(run > 1, F.concat(F.col("token"), F.lit(" ×"), run.cast("string")))
                    .otherwise(F.col("token")).alias("history"))


def rule_breaks(ledger: DataFrame, budget: int | None = None) -> DataFrame:
    """The first line of each cell that breaks a rule, and the rule."""
    att = text.attempt_of(F.concat_ws("\t", "fields"))
    rows = ledger.withColumn("attempt", att)
    line = F.col("line_no")
    numbered = is_("ITER") & F.col("attempt").isNotNull()
    started = is_("START") & F.col("attempt").isNotNull()
    seen = S.scan(rows, ["cell"], ["line_no"], {
        "ends": S.total_before(is_("END").cast("long")),
        "greens": S.total_before((is_("ITER") & (F.col("fields")[0] == "green")).cast("long")),
        "starts": S.total_before(started.cast("long")),
        "prev_att": S.last_before(F.when(numbered, F.col("attempt"))),
    })
    first = (rows.where(started).groupBy("cell", "attempt").agg(F.min("line_no").alias("start_line")))
    seen = seen.join(first, ["cell", "attempt"], "left")
    ended = F.col("ends") > 0
    no_start = (F.col("starts") > 0) & ~F.coalesce(F.col("start_line") < line, F.lit(False))
    over = F.lit(False) if not budget else F.col("attempt") > budget
    rule = (F.when(ended & ~is_(*AFTER_END), 3)
            .when(is_("END") & (ended | (green_end() & (F.col("greens") == 0))), 4)
            .when(numbered & (F.col("attempt") != F.coalesce("prev_att", F.lit(0)) + 1), 1)
            .when(numbered & over, 2)
            .when(numbered & no_start, 5))
    return (seen.withColumn("rule", rule).where("rule IS NOT NULL").groupBy("cell")
            .agg(F.min_by("rule", "line_no").alias("rule"), F.min("line_no").alias("line_no"),
                 F.min_by(line_text(ledger), "line_no").alias("line")))


def line_text(ledger: DataFrame) -> Column:
    """A ledger line as written, or put together from its event and fields."""
    return F.col("line") if "line" in ledger.columns else F.concat_ws("\t", "event", "fields")


def agent_lines(ledger: DataFrame) -> DataFrame:
    """The last AGENT line per cell and attempt: seconds, those of its last
    run, and the client."""
    note = F.concat_ws(" ", F.slice("fields", F.lit(2), F.size("fields")))
    digits = lambda k: F.when(text.kv(note, k).rlike(r"^\d+$"), text.kv(note, k).cast("long"))
    rows = ledger.where(is_("AGENT")).select(
        "cell", "line_no", digits("attempt").alias("attempt"), digits("s").alias("s"),
        digits("last_s").alias("last_s"), F.split_part(F.coalesce(text.kv(note, "client"), F.lit("-")), F.lit(":"), F.lit(1)).alias("client"))
    return (rows.where("attempt IS NOT NULL AND s IS NOT NULL").groupBy("cell", "attempt")
            .agg(F.max_by("s", "line_no").alias("s"),
                 F.max_by("last_s", F.when(F.col("last_s").isNotNull(), F.col("line_no"))).alias("last_s"),
                 F.max_by("client", "line_no").alias("client")))


def charged(ledger: DataFrame) -> DataFrame:
    """Charged attempts with the number of their ITER lines, and whether they
    count: up to the attempt of the first green line."""
    note = F.coalesce(F.try_element_at("fields", F.lit(2)), F.lit(""))
    it = ledger.where(is_("ITER")).select("cell", "line_no", F.col("fields")[0].alias("result"),
                                          F.regexp_extract(note, r"\battempt=(\d+)", 1).try_cast("long").alias("attempt"))
    per = it.where("attempt IS NOT NULL").groupBy("cell", "attempt").agg(
        F.count(F.lit(1)).alias("lines"), F.min(F.when(F.col("result") == "green", F.col("line_no"))).alias("_green"))
    first = per.groupBy("cell").agg(F.min_by("attempt", "_green").alias("_at"))
    return (per.join(first, "cell").select(
        "cell", "attempt", "lines",
        F.coalesce(F.col("attempt") <= F.col("_at"), F.lit(True)).alias("counted")))


def agent_time(ledger: DataFrame) -> DataFrame:
    """Agent seconds per cell over its counted attempts; null unless every one
    of them has a time."""
    j = charged(ledger).join(agent_lines(ledger), ["cell", "attempt"], "left")
    n = F.sum(F.when(F.col("counted"), F.col("lines")))
    have = F.sum(F.when(F.col("counted") & F.col("s").isNotNull(), F.col("lines")))
    total = F.sum(F.when(F.col("counted"), F.col("s") * F.col("lines")))
    return j.groupBy("cell").agg(F.sum("lines").alias("charged"), n.alias("counted"),
                                 F.when(n == have, total).alias("agent_s_total")).withColumn(
        "agent_s_per_attempt", F.round(F.try_divide(F.col("agent_s_total"), F.col("counted")), 1))


def gates(ledger: DataFrame) -> DataFrame:
    """Per attempt: the arrangements it passed and the first it failed."""
    rows = (ledger.where(is_("SHAPE") & ~in_reverify())
            .select("cell", "line_no", text.attempt_of(_payload()).alias("attempt"), shape_passed().alias("ok"),
                    F.regexp_extract(_payload(), r"\b([BS]{3})\b", 1).alias("shape")).where("attempt IS NOT NULL"))
    fail = ~F.col("ok")
    return rows.groupBy("cell", "attempt").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(F.col("ok")).alias("n_passed"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("shape")))), " ").alias("passed"),
        F.min_by(F.when(fail, F.col("shape")), F.when(fail, F.col("line_no"))).alias("failed"))


def attempt_verdict(gate: DataFrame, required: int, budget: int) -> DataFrame:
    """Green iff every required arrangement passed; over budget is its own
    verdict. ``gate`` comes from ``gates``."""
    ok = (F.col("n_passed") == F.col("results")) & (F.col("results") >= required)
    return gate.select("cell", "attempt", F.when(~ok, "fail").when(F.col("attempt") <= budget, "green")
                       .otherwise("budget").alias("verdict"))


def verify_progress(ledger: DataFrame, since: DataFrame) -> DataFrame:
    """The newest progress mark at or after ``since`` (cell, since)."""
    return (ledger.where(is_(*PROGRESS_MARKS)).join(since, "cell").where(F.col("ts") >= F.col("since"))
            .groupBy("cell").agg(F.max("ts").alias("mark")))


def current_attempt(ledger: DataFrame) -> DataFrame:
    """The attempt of each cell's last START, and when it was."""
    line = F.col("line_no")
    return ledger.where(is_("START")).groupBy("cell").agg(
        F.max_by(text.attempt_of(_payload()), line).alias("attempt"), F.max_by("ts", line).alias("since"))


def rig_output(ledger: DataFrame) -> DataFrame:
    """RIG-OUTPUT alerts: a warning when the attempt was judged later, a taint
    when it never was."""
    what = F.element_at("fields", -1)
    alerts = ledger.where(is_("ALERT") & F.startswith(what, F.lit("RIG-OUTPUT "))).select(
        "cell", "line_no", text.attempt_of(_payload()).alias("attempt"),
        F.left(F.substr(what, F.lit(12)), F.lit(100)).alias("what"))
    judged = (ledger.where(is_("ITER")).select("cell", "line_no", text.attempt_of(_payload()).alias("attempt"))
              .groupBy("cell", "attempt").agg(F.max("line_no").alias("judged_line")))
    j = alerts.where("attempt IS NOT NULL").join(judged, ["cell", "attempt"], "left")
    later = F.coalesce(F.col("judged_line") > F.col("line_no"), F.lit(False))
    n = F.col("attempt").cast("string")
    return j.select("cell", "line_no", F.when(later, "warn").otherwise("taint").alias("severity"),
                    F.when(later, F.concat(F.lit("attempt "), n, F.lit(" re-verified after a verify halted on a rig defect: "), "what"))
                    .otherwise(F.concat(F.lit("attempt "), n, F.lit(" was never re-verified after a verify halted on a rig defect: "), "what"))
                    .alias("text"))
