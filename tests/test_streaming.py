import json
import random

from pyspark.sql import functions as F

from runlens import hooks
from runlens.operators import usage
from runlens.sources import sinks
from runlens.streaming import live, run


def stream(spark, tmp_path, df, name, parts=1):
    out = str(tmp_path / name)
    df.coalesce(parts).write.parquet(out)
    return spark.readStream.schema(df.schema).parquet(out)


def test_trace_seconds_count_late_points_in_their_second(spark, tmp_path):
    rows = [("r", 0.2, "fired", 2.0, None), ("r", 1.1, "http_reqs", 1.0, "200"), ("r", 0.9, "http_reqs", 1.0, "0"), ("r", 0.4, "http_req_duration", 30.0, None), ("r", 30.0, "fired", 1.0, None)]
    df = spark.createDataFrame(rows, "run string, s double, metric string, value double, status string").withColumn("time", F.timestamp_millis((F.col("s") * 1000).cast("long"))).drop("s")
    got = {r.second.second: (r.fired, r.http_2xx, r.err, r.p99) for r in run.to_end(live.trace_seconds(stream(spark, tmp_path, df, "p"))).collect()}
    assert got == {0: (2.0, 0, 1, 30.0), 1: (0.0, 1, 0, None)}
    s = run.to_end(live.sliding_latency(stream(spark, tmp_path, df, "p2"))).collect()
    assert {r.p99 for r in s} <= {30.0}


def test_first_moments_in_event_order(spark, tmp_path):
    t = lambda ts, fired=0, dec=False, claim=False, probe=False, p99=10.0, run="r": (run, float(ts), fired, dec, claim, probe, p99)
    end = t(1000, run="other")  # moves the watermark; no tick of the run itself comes after its window
    df = spark.createDataFrame([end, t(7, 5), t(5, 5, False, True, True), t(1), t(4, 5, False, True), t(3, 5, True, p99=200.0), t(2, 5), t(6, 5, False, False, True)],
                               "run string, ts double, fired long, decided boolean, claimed boolean, probed boolean, p99 double")
    got = {r.moment: r.ts for r in run.to_end(live.first_moments(stream(spark, tmp_path, df, "t", 3), 150.0, 10.0)).where("run = 'r'").collect()}
    assert got == {"decision": 3.0, "saturation": 3.0, "mount": 5.0, "release": 7.0, "over": 12.0}
    never = df.where("ts IN (1, 1000)").withColumn("fired", F.lit(0).cast("long"))
    got = run.to_end(live.first_moments(stream(spark, tmp_path, never, "n"), 150.0, 10.0)).where("run = 'r'").collect()
    assert [(r.moment, r.ts) for r in got] == [("over", 11.0)]


def test_many_batches_without_order_give_the_ordered_result(spark, tmp_path):
    rows = [("c", i, i // 3, 0.0) for i in range(1000)]
    want = [i for i in range(1000) if i % 3 == 2]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([*rows, ("z", 9999, 0, 0.0)], "cell string, seq long, rx long, cpu double").withColumn("time", F.timestamp_seconds(F.col("seq") + 1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = run.to_end(live.two_sweeps(stream(spark, tmp_path, df, "u", 4), late="1000 seconds")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.seq for r in got if r.cell == "c") == want


def test_sleep_sessions_and_alerts(spark, tmp_path):
    clocks = spark.createDataFrame([("r", 3, 1120.0, 29.0), ("r", 1, 1000.0, 0.0), ("r", 2, 1100.0, 10.0), ("z", 1, 1900.0, 0.0)], "run string, seq long, wall double, mono double")
    out = run.to_end(live.sleep_seconds(stream(spark, tmp_path, clocks, "c")))
    assert sorted((r.seq, r.slept) for r in out.where("run = 'r'").collect()) == [(1, 0.0), (2, 90.0), (3, 90.0)]
    at = lambda df: df.withColumn("time", F.timestamp_seconds("s")).drop("s")
    smp = at(spark.createDataFrame([("c", 1, 0, 50.0, 1.0), ("c", 1, 10, 70.0, 1.0), ("c", 1, 500, 5.0, 1.0), ("d", 1, 9000, 1.0, 1.0)], "cell string, attempt int, s long, cpu_pct double, mem_mb double"))
    got = {(r.samples, r.cpu_max) for r in run.to_end(live.verify_sessions(stream(spark, tmp_path, smp, "s"))).collect()}
    assert got == {(2, 70.0), (1, 5.0)}
    load = at(spark.createDataFrame([("c", 1, 0, "cpu", 50.0), ("c", 1, 1, "cpu", 65.0), ("c", 1, 2, "cpu", 99.0), ("c", 1, 2, "mem", 95.0), ("c", 2, 3, "cpu", 61.0)], "cell string, attempt int, s long, resource string, pct double"))
    once = run.to_end(live.over_limit_once(stream(spark, tmp_path, load, "l"), {"cpu": 60.0, "mem": 90.0})).collect()
    assert sorted((r.attempt, r.resource) for r in once) == [(1, "cpu"), (1, "mem"), (2, "cpu")]


def test_two_sweeps_and_denied_tools(spark, tmp_path):
    r = lambda seq, rx, cpu=0.0: ("c", seq, rx, cpu)
    df = spark.createDataFrame([r(1, 5), r(2, 5), r(3, 5), r(4, 5), r(5, 6), r(6, 6), r(7, 6, 2.0), r(8, 6), r(9, 6), ("z", 90, 1, 0.0)], "cell string, seq long, rx long, cpu double").withColumn("time", F.timestamp_seconds("seq"))
    assert sorted(x.seq for x in run.to_end(live.two_sweeps(stream(spark, tmp_path, df, "r"))).collect()) == [3, 9]
    ln = lambda t: ("c", json.dumps({"event": "step_update", "step_update": {"tool_name": t}}))
    steps = spark.createDataFrame([ln("read"), ln("shell"), ("c", '{"event": "init"}'), ("c", "{torn")], "cell string, line string")
    ok = spark.createDataFrame([("read",)], "tool string")
    assert [x.tool for x in run.to_end(live.denied_tools(stream(spark, tmp_path, steps, "d"), ok)).collect()] == ["shell"]


def test_weekly_batches_are_idempotent(spark, tmp_path):
    from runlens.plans.fleet import weekly_reading
    e = spark.createDataFrame([("l", 1.0, 1, "seven_day", "allowed_warning", 0.7, 99.0), ("l", 1.0, 2, "five_hour", "rejected", None, 99.0), ("l", 0.5, 9, "seven_day", "rejected", None, 99.0)],
                              "lane string, mtime double, pos long, kind string, status string, utilization double, resets_at double")
    out = str(tmp_path / "weekly")
    keep = sinks.weekly_batches(out)
    keep(e, 0)
    keep(e, 0)
    book = spark.read.parquet(out)
    assert book.count() == 1 and weekly_reading(book, F.lit(50.0)).first().utilization == 0.7
    assert weekly_reading(book, F.lit(100.0)).first().utilization is None


def test_hooks(spark):
    x = hooks.Experiment()
    x.register_client("mine", usage.client_a)
    x.register_rule(lambda ev: ev["ledger"])
    x.register_summary("gap", lambda scores, metrics: metrics(scores))
    x.register_values("base", lambda t: t)
    x.register_text("report", spark.range(1))
    assert set(x.clients) == {"A", "B", "mine"} and set(x.evidence(ledger=1)) == {"ledger", "report"}
    assert x.report(spark.range(3), lambda s: s.count()) == {"gap": 3} and len(x.rules) == 1 and list(x.values) == ["base"]


def readings(spark, n=400):
    rnd = random.Random(4)
    rows = [(rnd.choice(["c", "c", "d"]), rnd.choice(["quiet", "stuck"]), i, rnd.random() < 0.5, rnd.choice([None, "a1", "a2"]), rnd.random() < 0.1) for i in range(n)]
    df = spark.createDataFrame(rows, "cell string, rule string, seq long, on boolean, key string, reset boolean")
    return rows, df.withColumn("time", F.timestamp_seconds(F.col("seq") + 100)).withColumn("chunk", F.floor(F.col("seq") / 37))


def test_an_alert_that_lifts_and_returns_is_told_twice_in_table_and_stream(spark, tmp_path):
    from runlens.plans import fleet
    rows, df = readings(spark)
    want, state = [], {}
    for cell, rule, seq, on, key, reset in rows:
        was, old, n = state.get((cell, rule), (False, None, 0))
        opens = on and (not was or reset or old != key)
        if was and (opens or not on):
            want.append((cell, rule, seq, n, old, "lifted"))
        if opens:
            n += 1
            want.append((cell, rule, seq, n, key, "opened"))
        state[cell, rule] = (on, key, n)
    pick = lambda df: sorted(tuple(r) for r in df.select("cell", "rule", "seq", "episode", "key", "edge").fillna("-").collect())
    want = sorted(tuple("-" if x is None else x for x in w) for w in want)
    assert pick(fleet.alert_edges(df.drop("time"))) == want
    path = str(tmp_path / "alerts")
    df.drop("chunk").repartition(4).write.parquet(path)
    table = spark.read.parquet(path)
    source = run.Bounded(table, spark.readStream.schema(table.schema).parquet(path), "time")
    assert pick(run.to_end(live.alert_edges(source.frame), source=source)) == want


def test_a_closed_input_tells_what_still_waits(spark, tmp_path):
    df = spark.createDataFrame([("c", i, 1, 0.0) for i in range(6)], "cell string, seq long, rx long, cpu double").withColumn("time", F.timestamp_seconds(F.col("seq") + 100))
    path = str(tmp_path / "tail")
    df.write.parquet(path)
    open_end = run.to_end(live.two_sweeps(spark.readStream.schema(df.schema).parquet(path), late="1 hour"))
    assert open_end.count() == 0
    source = run.Bounded(df, spark.readStream.schema(df.schema).parquet(path), "time")
    assert [r.seq for r in run.to_end(live.two_sweeps(source.frame, late="1 hour"), source=source).collect()] == [2]


def test_rows_of_a_key_wait_under_one_timer():
    """However many spans of time an arrival covers: one timer, and one pass when the watermark has gone by."""
    import pandas as pd
    from types import SimpleNamespace
    from runlens.streaming.ordered import InEventOrder

    class Kept:
        def __init__(self):
            self.it, self.calls = [], 0

        def get(self):
            self.calls += 1
            return iter(self.it)

        def appendList(self, more):
            self.calls += 1
            self.it = self.it + more

        def put(self, now):
            self.calls += 1
            self.it = now

        def clear(self):
            self.calls += 1
            self.it = []

    class Value(Kept):
        def get(self):
            return self.it or None

        def update(self, now):
            self.it = now

    waiting, value, timers = Kept(), Value(), []
    handle = SimpleNamespace(getListState=lambda *a: waiting, getValueState=lambda *a: value, registerTimer=timers.append)
    job = InEventOrder(["run"], [("seq", "bigint"), ("x", "bigint")], "seq", "n long", lambda own, r: own.update(n=own.get("n", 0) + 1) or [(r["seq"], r["x"], own["n"])],
                       ["seq", "x", "n"], 1000, 10 ** 9, None, None)
    job.init(handle)
    seq = list(range(200))[::-1]
    pdf = pd.DataFrame({"event_at": pd.to_datetime([s * 5000 + 1 for s in seq], unit="ms"), "seq": seq, "x": [None if s == 7 else s for s in seq]})
    assert list(job.handleInputRows(("r",), iter([pdf]), None)) == [] and timers == [1000] and waiting.calls == 1
    at = lambda ms: (SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), SimpleNamespace(getExpiryTimeInMs=lambda: 1000))
    first = [tuple(r) for t in job.handleExpiredTimer(("r",), *at(500_000)) for r in t.itertuples(index=False)]
    assert [r[1] for r in first] == list(range(100)) and [r[3] for r in first] == list(range(1, 101)) and 501_000 in timers and waiting.calls == 3
    rest = [tuple(r) for t in job.handleExpiredTimer(("r",), *at(2_000_000)) for r in t.itertuples(index=False)]
    assert [(r[1], r[3]) for r in rest] == [(i, i + 1) for i in range(100, 200)] and waiting.it == []
