"""Structured Streaming jobs over run evidence as it is written.

Every function maps a streaming frame to a streaming frame, so the caller
picks source and sink. Event time replaces the arrival clock: a late point is
counted in the second it belongs to while the watermark still holds it, and
the batch jobs stay authoritative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.traces import status_bucket
from runlens.streaming.ordered import in_event_order

LATE = "5 seconds"
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
ACCURACY = 10000


def trace_seconds(points: DataFrame, late: str = LATE, window: str = "1 second") -> DataFrame:
    """One row per run and second: requests fired, answers by status bucket,
    high percentiles of the latencies (approximate to 1/10000 of the rank; the
    batch job computes them exactly). Points have run, time, metric, value,
    status."""
    is_ = lambda m: F.col("metric") == m
    bucket = status_bucket(F.coalesce("status", F.lit("0")))
    latency = F.when(is_("http_req_duration"), F.col("value"))
    w = points.withWatermark("time", late).groupBy("run", F.window("time", window).alias("w")).agg(
        F.coalesce(F.sum(F.when(is_("fired"), F.col("value"))), F.lit(0.0)).alias("fired"),
        F.coalesce(F.sum(F.when(is_("dropped_iterations"), F.col("value"))), F.lit(0.0)).alias("dropped"),
        *[F.count_if(is_("http_reqs") & (bucket == b)).alias(b) for b in ("http_2xx", "http_404", "http_429", "http_5xx", "err")],
        F.percentile_approx(latency, 0.9, ACCURACY).alias("p90"), F.percentile_approx(latency, 0.99, ACCURACY).alias("p99"))
    return w.select("run", F.col("w.start").alias("second"), *[c for c in w.columns if c not in ("run", "w")])


def seconds_of(late: str) -> float:
    """Seconds of a delay such as ``5 seconds``."""
    n, unit = late.split()
    return float(n) * UNITS[unit.removesuffix("s")]


def sliding_latency(points: DataFrame, late: str = LATE, window: str = "1 second", slide: str = "500 milliseconds") -> DataFrame:
    """The trailing latency percentile, on event time."""
    p = points.where("metric = 'http_req_duration'").withWatermark("time", late)
    w = p.groupBy("run", F.window("time", window, slide).alias("w")).agg(F.percentile_approx("value", 0.99, ACCURACY).alias("p99"))
    return w.select("run", F.col("w.end").alias("at"), "p99")


def first_moments(ticks: DataFrame, sat_p99: float, duration_s: float, late: str = LATE, forget_s: float = 86400.0) -> DataFrame:
    """Per run, each one-shot moment when it is first known: decision, mount,
    release, saturation, and ``over`` at the end of the traffic window:
    ``duration_s`` after the first request, or after the first tick of a run that
    has not sent by then. The end is told when the watermark passes it, ticks or not. Ticks
    have run, ts (seconds), fired, decided, claimed, probed, p99."""
    def step(own: dict, t: dict) -> list[tuple]:
        own.setdefault("begun", t["ts"])
        if t["fired"] > 0:
            own.setdefault("started", t["ts"])
        both, gone = t["claimed"] and t["probed"], not t["claimed"] and not t["probed"]
        now = {"decision": t["decided"], "mount": both, "release": gone and own.get("mount", t["ts"]) < t["ts"], "saturation": t["p99"] >= sat_p99}
        fresh = [m for m, yes in now.items() if yes and m not in own]
        own.update({m: t["ts"] for m in fresh})
        return [(m, float(t["ts"])) for m in fresh]

    def due(own: dict) -> float | None:
        return None if "over" in own or "begun" not in own else own.get("started", own["begun"]) + duration_s

    def ring(own: dict) -> list[tuple]:
        own["over"] = due(own)
        return [("over", float(own["over"]))]

    own = ", ".join(f"{m} double" for m in ("begun", "started", "decision", "mount", "release", "saturation", "over"))
    return in_event_order(ticks, ["run"], F.timestamp_micros((F.col("ts") * 1e6).cast("long")), "ts", late, seconds_of(late), forget_s, step,
                          own, "moment string, ts double", due, ring)


def sleep_seconds(ticks: DataFrame, late: str = LATE, forget_s: float = 86400.0) -> DataFrame:
    """Running host sleep per run: wall less monotonic over successive ticks
    (run, seq, wall, mono), jitter left out. Told for each tick."""
    def step(own: dict, t: dict) -> list[tuple]:
        if "wall" in own and (gap := (t["wall"] - own["wall"]) - (t["mono"] - own["mono"])) > 30.0:
            own["slept"] = own.get("slept", 0.0) + gap
        own.update(wall=float(t["wall"]), mono=float(t["mono"]))
        return [(int(t["seq"]), own.get("slept", 0.0))]

    return in_event_order(ticks, ["run"], F.timestamp_micros((F.col("wall") * 1e6).cast("long")), "seq", late, seconds_of(late), forget_s, step,
                          "slept double, wall double, mono double", "seq long, slept double")


def verify_sessions(samples: DataFrame, gap: str = "1 minute", late: str = LATE) -> DataFrame:
    """A session per verify: samples of one cell and attempt with no longer
    pause than ``gap``. Samples have cell, attempt, time, cpu_pct, mem_mb."""
    s = samples.withWatermark("time", late).groupBy("cell", "attempt", F.session_window("time", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("cpu_pct").alias("cpu_max"), F.avg("cpu_pct").alias("cpu_mean"), F.max("mem_mb").alias("mem_max"))
    return s.select("cell", "attempt", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "samples", "cpu_max", "cpu_mean", "mem_max")


def over_limit_once(load: DataFrame, limits: dict[str, float], late: str = "1 hour") -> DataFrame:
    """The first sample over its limit per verify and resource. Load has cell,
    attempt, time, resource, pct."""
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[F.col("resource")]
    return (load.where(F.col("pct") >= limit).withWatermark("time", late)
            .dropDuplicatesWithinWatermark(["cell", "attempt", "resource"]))


def denied_tools(lines: DataFrame, allowed: DataFrame) -> DataFrame:
    """Tool calls outside the allow-list (column ``tool``). Lines have cell
    and line, one transcript step each; a torn line is no call."""
    step = F.from_json(F.col("line"), "event string, step_update struct<tool_name:string>")
    calls = lines.select("cell", F.when(step["event"] == "step_update", step["step_update"]["tool_name"]).alias("tool")).where("tool IS NOT NULL")
    return calls.join(allowed.select("tool"), "tool", "left_anti").select("cell", "tool")


def alerts_once(alerts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each alert of a cell, rule and episode once. Alerts have cell, rule,
    episode, time."""
    return alerts.withWatermark("time", late).dropDuplicatesWithinWatermark(["cell", "rule", "episode"])


def two_sweeps(readings: DataFrame, late: str = LATE, forget_s: float = 86400.0) -> DataFrame:
    """Cells whose received bytes stood still for two sweeps in a row, told
    once per standstill; a working CPU or growth starts over. Readings have
    cell, seq, time, rx, cpu."""
    def step(own: dict, r: dict) -> list[tuple]:
        moving = r["cpu"] > 0.5 or "rx" not in own or r["rx"] > own["rx"]
        own.update(rx=int(r["rx"]), flat=0 if moving else own.get("flat", 0) + 1)
        return [(int(r["seq"]),)] if own["flat"] == 2 else []

    return in_event_order(readings, ["cell"], F.col("time"), "seq", late, seconds_of(late), forget_s, step, "rx long, flat int", "seq long")


def alert_edges(readings: DataFrame, late: str = LATE, forget_s: float = 86400.0) -> DataFrame:
    """Each alert episode of a cell and rule told once when it opens and once when it is
    lifted; ``plans.fleet.alert_edges`` says the same of a table. Readings have cell,
    rule, seq, time, on, key, reset; they are kept by (cell, rule)."""
    def step(own: dict, r: dict) -> list[tuple]:
        was, told = own.get("on", False), []
        opens = r["on"] and (not was or r["reset"] or own.get("key") != r["key"])
        if was and (opens or not r["on"]):
            told.append((int(r["seq"]), own["episode"], own.get("key"), "lifted"))
        if opens:
            own["episode"] = own.get("episode", 0) + 1
            told.append((int(r["seq"]), own["episode"], r["key"], "opened"))
        own["on"] = bool(r["on"])
        own.pop("key", None)
        if r["on"] and r["key"] is not None:
            own["key"] = r["key"]
        return told

    return in_event_order(readings, ["cell", "rule"], F.col("time"), "seq", late, seconds_of(late), forget_s, step,
                          "on boolean, key string, episode long", "seq long, episode long, key string, edge string")


def gate_progress(ledger: DataFrame) -> DataFrame:
    """Arrangements passed so far per cell and attempt (update mode)."""
    from runlens.operators.ledger import passes_by_attempt
    return passes_by_attempt(ledger)


