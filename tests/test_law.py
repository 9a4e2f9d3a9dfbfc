from pyspark.sql import functions as F

from runlens.operators import traces
from runlens.operators.scan import chunk_of
from runlens.plans import law

TICK = "run string, seq long, ts double, p99 double, up boolean, sent long, done long, offered_rps long"


def ticks(run, n, hot, up, late=0, rps=lambda t: 100 + t):
    out = []
    for t in range(n):
        out.append((run, t, float(t), 200.0 if any(a <= t < b for a, b in hot) else 20.0, any(a <= t < b for a, b in up), t * 10, max(0, t - late) * 10, rps(t)))
    return out


def trace(spark, *runs):
    return spark.createDataFrame([r for run in runs for r in run], TICK).withColumn("chunk", chunk_of("seq", 16))


def spikes(spark, windows):
    return spark.createDataFrame([(run, i, float(a), float(b)) for run, ws in windows.items() for i, (a, b) in enumerate(ws, 1)], "run string, i int, t0 double, t1 double")


def runs(spark, **errors):
    return spark.createDataFrame([(k, 0.0 if e is not None else None, None, 10000, e or 0) for k, e in errors.items()], "run string, started double, release double, total long, errors long")


def judged(spark, t, w, r, limits=law.Limits(), settings=(law.Setting("plain"),)):
    return {(x.run, x.setting): (x.verdict, x.reasons) for x in law.judge(t, spikes(spark, w), r, limits, 32.0, settings).collect()}


def test_single_spike_verdicts(spark):
    one = [(8, 61)]
    t = trace(spark, ticks("ok", 90, [(14, 24)], [(22, 70)]), ticks("late", 90, [(14, 50)], [(45, 70)]), ticks("cold", 90, [], []),
              ticks("broken", 90, [], []), ticks("lost", 90, [(14, 20)], [(22, 70)]), ticks("stuck", 90, [(14, 20)], [(22, 90)]))
    got = judged(spark, t, {k: one for k in ("ok", "late", "cold", "broken", "lost", "stuck")}, runs(spark, ok=0, late=0, cold=0, broken=2400, lost=None, stuck=0))
    assert got[("ok", "plain")] == ("true", "")
    v, why = got[("late", "plain")]
    assert v == "false" and why == "mount 1 at ts=45 outside spike 1's window [5..44] (saturated at ts=14, deadline 30s after it)"
    assert got[("cold", "plain")][0] == "void"
    v, why = got[("broken", "plain")]
    assert v == "false" and len(why.split("; ")) == 2 and "load errors 2400/10000 = 24.0% > 0%" in why
    assert got[("lost", "plain")][0] == "void" and "start was not recorded" in got[("lost", "plain")][1]
    assert got[("stuck", "plain")][0] == "false" and "never released after the tail" in got[("stuck", "plain")][1]


def test_two_spikes_pair_with_episodes(spark):
    two = [(10, 30), (40, 60)]
    t = trace(spark, ticks("ok", 90, [(16, 20), (46, 50)], [(22, 35), (52, 64)]), ticks("mid", 90, [(16, 20), (46, 50)], [(18, 24), (52, 64)]),
              ticks("held", 90, [(16, 20)], [(22, 80)]), ticks("one", 90, [(16, 20), (46, 50)], [(22, 35)]))
    got = judged(spark, t, {k: two for k in ("ok", "mid", "held", "one")}, runs(spark, ok=0, mid=0, held=0, one=0))
    assert got[("ok", "plain")][0] == "true"
    assert "episode 1 released MID-spike (ts=24 < spike end 30)" in got[("mid", "plain")][1]
    assert got[("held", "plain")][1].startswith("episode 1 never released before spike 2 (its cache absorbed")
    assert "expected 2 mount episode(s) (one per spike), saw 1" in got[("one", "plain")][1]


def test_premount_is_charged_only_when_asked(spark):
    t = trace(spark, ticks("pre", 90, [], [(9, 70)]))
    ways = (law.Setting("off"), law.Setting("on", 0.0, True))
    got = judged(spark, t, {"pre": [(8, 61)]}, runs(spark, pre=0), settings=ways)
    assert got[("pre", "off")][0] == "void" and got[("pre", "on")][0] == "false" and "mounted before spike 1" in got[("pre", "on")][1]


def test_tolerance_widens_and_zero_changes_nothing(spark):
    t = trace(spark, ticks("late", 120, [(14, 60)], [(46, 70)]))
    s = spikes(spark, {"late": [(8, 61)]}).withColumn("mount_spread", F.lit(2.0)).withColumn("release_spread", F.lit(0.0))
    ways = (law.Setting("plain"), law.Setting("zero", 0.0), law.Setting("wide", 2.0))
    got = {x.setting: (x.verdict, x.reasons) for x in law.judge(t, s, runs(spark, late=0), law.Limits(), 32.0, ways).collect()}
    assert got["plain"] == got["zero"] and got["plain"][0] == "false" and got["wide"][0] == "true"


def test_calibration_values_pins(spark):
    w = {"a": [(10, 30), (40, 60)]}
    t = trace(spark, ticks("a", 90, [(16, 20), (46, 50)], [(22, 35), (52, 64)]))
    facts = traces.spike_facts(t, spikes(spark, w), 150.0, 20.0, 32.0)
    got = {r.name: r.value for r in traces.calibration_values(facts, traces.episodes(t), 32.0).collect()}
    assert got == {"spike1_sat_s": 6.0, "spike2_sat_s": 6.0, "spike1_mount_s": 6.0, "spike2_mount_s": 6.0, "spike1_release_s": 5.0, "spike2_release_s": 4.0,
                   "spike1_sat_rps": 116.0, "spike2_sat_rps": 146.0, "spike1_lag_s": 0.0, "spike2_lag_s": 0.0}
    late = trace(spark, ticks("a", 90, [(16, 20), (46, 50)], [(22, 35), (52, 64)], late=4))
    facts = traces.spike_facts(late, spikes(spark, w), 150.0, 20.0, 32.0)
    got = {r.name: r.value for r in traces.calibration_values(facts, traces.episodes(late), 32.0).collect()}
    assert got["spike1_lag_s"] == 4.0 and got["spike1_release_s"] == 1.0


def test_busy_spikes(spark):
    rows = [("a", i, float(i), b) for i, b in enumerate([.1, .5, .6, .9, .5, .5, .1])] + [("b", i, float(i), b) for i, b in enumerate([.5, .5, .5, .5, .4, .5])]
    df = spark.createDataFrame(rows, "run string, seq long, ts double, busy double").withColumn("chunk", chunk_of("seq", 2))
    assert [tuple(r) for r in traces.busy_spike(df, F.lit(0.4)).collect()] == [("a", 5, 0.9)]


def test_unscheduled(spark):
    t = trace(spark, ticks("ok", 60, [(10, 20)], [(15, 40)]), ticks("flap", 60, [(10, 20)], [(15, 20), (30, 40)]), ticks("early", 60, [(20, 30)], [(5, 40)]))
    got = {r.run: (r.verdict, r.reasons) for r in law.judge_unscheduled(t, runs(spark, ok=0, flap=0, early=0), law.Limits()).collect()}
    assert got["ok"] == ("true", "") and got["flap"][1].startswith("cache flapped (2 mount") and "BEFORE saturation (ts=5" in got["early"][1]


def test_replay_counts(spark):
    v = spark.createDataFrame([("a", "off", "false"), ("a", "on", "true"), ("b", "off", "true"), ("b", "on", "true")], "run string, setting string, verdict string")
    rec = spark.createDataFrame([("a", "v1", False), ("b", "v1", True)], "run string, variant string, ok boolean")
    got = {r.variant: (r.counted, r.off_agrees, r.false_to_true) for r in law.replay_changes(v, rec).collect()}
    assert got == {"v1": (2, 2, 1), "total": (2, 2, 1)}
