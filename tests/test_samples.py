from pyspark.sql import functions as F

from runlens.functions import units
from runlens.operators import lifecycle as C
from runlens.operators import samples, surface
from runlens.operators.scan import chunk_of


def test_units_differ_on_purpose(spark):
    cases = {"123.4MiB": (123.4, 123.4, 123.4 * 2**20), "1.2GiB": (1228.8, 1228.8, 1.2 * 2**30), "59.8MB": (59.8, 59.8, 59.8e6), "512Ki": (0.5, None, 0.0), "5x": (5.0, None, 0.0), "": (0.0, None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: (r.a, r.b, r.c) for r in df.select("s", units.sample_mem_mb(F.col("s")).alias("a"), units.host_mem_mib(F.col("s")).alias("b"), units.size_bytes(F.col("s")).alias("c")).collect()}
    assert got == cases
    cpu = spark.createDataFrame([(s,) for s in ("12.3%", "15m", "7", "x", "%")], "s string").select(units.cpu_pct(F.col("s")).alias("c"))
    assert [r.c for r in cpu.collect()] == [12.3, 1.5, 7.0, 0.0, 0.0]


def test_owners(spark):
    cid, longer = "ag_high_v_T1_r1", "ag_high_v_T1_r12"
    ns = {f"agent-{cid}": (cid, "agent"), f"dind-{longer}": (longer, "dind"), f"x-{cid}-store": (cid, "x"), cid: (cid, "cell"), "grid-control-plane": (cid, "kind"),
          "other-worker2": ("", "kind"), "postgres": ("", "other")}
    names = spark.createDataFrame([(n,) for n in ns], "name string")
    cells = spark.createDataFrame([(cid,), (longer,)], "cid string")
    clusters = spark.createDataFrame([("grid", cid)], "cluster string, cid string")
    assert {r.name: (r.owner, r.role) for r in samples.container_owners(names, cells, clusters).collect()} == ns


def test_second_reading(spark):
    row = lambda ts, name, mb, other, again=None, plane="docker": ("c", ts, plane, name, "app", 0.0, mb, other, again)
    df = spark.createDataFrame([row(1.0, "a", 300.0, 600.0), row(2.0, "a", 25.0, 31.0), row(3.0, "a", 300.0, 600.0, 650.0), row(4.0, "a", 5.0, None),
                                row(5.0, "n-worker", 100.0, 100.0), row(5.0, "p", 300.0, None, plane="k8s")],
                               "cell string, ts double, plane string, name string, tag string, cpu_pct double, mem_mb double, other_mb double, again_mb double")
    got = {r.ts: (r.disagree, r.unchecked) for r in samples.cross_check(df).collect()}
    assert got == {1.0: (1, 0), 2.0: (0, 0), 3.0: (0, 0), 4.0: (0, 1), 5.0: (1, 0)}


def test_docker_load_pin(spark):
    df = spark.createDataFrame([(1, 0.0, "host", "docker_cpus", 5.0, None), (1, 0.0, "host", "docker_mem_mb", None, 5924.7), (1, 0.0, "container", "a", 150.0, 2000.0),
                                (1, 0.0, "container", "b", 49.0, 956.4), (1, 1.0, "container", "a", 1.0, 1.0), (2, 0.0, "container", "a", 9.0, 9.0)], "host long, ts double, scope string, name string, cpu_pct double, mem_mb double")
    assert {r.resource: r.pct for r in samples.docker_load(df).collect()} == {"cpu": 39.8, "mem": 49.9}


def test_host_summary_pins(spark):
    led = spark.createDataFrame([("7", 1, 0.0, "VERIFY_READY", ["7"]), ("7", 2, 20.0, "SHAPE", ["7", "attempt=1", "BBS pass"]), ("7", 3, 30.0, "SHAPE", ["7", "attempt=1", "BSB pass"])],
                                "cell string, line_no long, ts double, event string, fields array<string>").withColumn("chunk", chunk_of("line_no", 1))
    s = lambda ts, scope, name, owner, cpu, host=1: (host, ts, scope, name, owner, "agent" if owner else "", cpu, None)
    rows = [s(5.0, "host", "cpu_idle", "", 70.0), s(15.0, "host", "cpu_idle", "", 80.0), s(5.0, "host", "load1", "", 4.0), s(5.0, "container", "a", "7", 100.0), s(15.0, "container", "a", "7", 100.0),
            s(5.0, "container", "b", "8", 160.0), s(15.0, "container", "b", "8", 160.0), s(5.0, "container", "c", "", 50.0), s(15.0, "container", "c", "", 50.0), s(25.0, "host", "cpu_idle", "", 1.0), s(6.0, "container", "b", "8", 999.0, 2), s(7.0, "host", "cpu_idle", "", 3.0, 2)]
    df = spark.createDataFrame(rows, "host long, ts double, scope string, name string, owner string, role string, cpu_pct double, mem_mb double")
    out = samples.host_summary(samples.verify_windows(led).withColumn("host", F.lit(1).cast("long")), df, 10.0).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.arrangement, r.outcome, r.samples, r.idle_min, r.idle_median, r.load1_max) == ("BBS", "pass", 2, 70.0, 75.0, 4.0)
    assert (r.own_cpu_median, r.other_cells_cpu_median, r.unowned_cpu_median, r.top_other) == (100.0, 160.0, 50.0, "agent:8=160")


def test_host_summary_equals_every_sample_of_every_window(spark):
    """Random windows and samples of several hosts, one of them busy, against plain lists."""
    import random
    import statistics
    r = random.Random(3)
    samples_, windows = {}, []
    for _ in range(1500):
        host = 0 if r.random() < 0.5 else r.randrange(1, 4)
        ts = float(r.randrange(300))
        kind = r.random()
        if kind < 0.3:
            key = (host, ts, "host", r.choice(["cpu_idle", "load1", "mem_used_gb"]), "", "")
        else:
            owner = r.choice(["", *[str(c) for c in range(6)]])
            key = (host, ts, "container", f"box{r.randrange(4)}", owner, r.choice(["agent", "sut"]) if owner else "other")
        samples_[key] = None if r.random() < 0.1 else float(r.randrange(100))
    for n in range(80):
        a = float(r.randrange(320))
        windows.append((str(n % 6), n, r.randrange(5), a, a + r.choice([0, 3, 40, 200]), "BBS", "pass"))
    df = spark.createDataFrame([(*k, v, None) for k, v in samples_.items()], "host long, ts double, scope string, name string, owner string, role string, cpu_pct double, mem_mb double")
    w = spark.createDataFrame(windows, "cell string, line_no long, host long, ready double, closed double, arrangement string, outcome string")
    got = {x.line_no: x for x in samples.host_summary(w, df, 16.0).collect()}
    mid = lambda xs: round(statistics.median(xs) + 1e-9, 1) if xs else None
    for cell, n, host, ready, closed, _, _ in windows:
        own = {k: v for k, v in samples_.items() if k[0] == host}
        times = [k[1] for k in own]
        if not times or closed < min(times) or ready > max(times):
            assert n not in got
            continue
        inside = sorted({t for t in times if ready <= t <= closed})
        read = lambda name: [v for k, v in own.items() if k[3] == name and k[1] in inside and v is not None]
        total = lambda pick, t: sum(v for k, v in own.items() if k[1] == t and k[2] == "container" and v is not None and pick(k[4]))
        per = lambda pick: mid([total(pick, t) for t in inside])
        used = {}
        for k, v in own.items():
            if k[2] == "container" and k[1] in inside and v is not None and k[4] not in ("", cell):
                used[k[5], k[4]] = used.get((k[5], k[4]), 0.0) + v
        x = got[n]
        assert (x.samples, x.idle_min, x.load1_max, x.mem_used_gb_max) == (len(inside), min(read("cpu_idle"), default=None), max(read("load1"), default=None), max(read("mem_used_gb"), default=None))
        assert (x.idle_median, x.own_cpu_median, x.unowned_cpu_median) == (mid(read("cpu_idle")), per(lambda o, c=cell: o == c), per(lambda o: o == ""))
        assert x.other_cells_cpu_median == per(lambda o, c=cell: o not in ("", c))
        if used:
            (role, owner), most = max(used.items(), key=lambda kv: (kv[1], kv[0]))
            assert x.top_other == f"{role}:{owner}={most / len(inside):.0f}"
        else:
            assert x.top_other is None


def test_the_fleet_is_one_machine(spark, tmp_path):
    """Owners far apart by number meet in a window, and one of ten clocks ticks for all runs with its last digit."""
    from runlens.catalog import hosts
    at = lambda s: f"2024-01-01 {s // 3600:02}:{s % 3600 // 60:02}:00"
    rows = [(1, 1, at(0), "view", 1.0, 10), (2, 1, at(7200), "view", 1.0, 3), (3, 700, at(3600), "purchase", 50.0, 1), (4, 41, at(3600), "purchase", 9.0, 2), (5, 41, at(18000), "purchase", 9.0, 2),
            (6, 700, at(3600), "error", 60.0, 1)]
    e = spark.createDataFrame([(i, u, t, k, v, f'{{"k": {n}}}') for i, u, t, k, v, n in rows], "event_id long, user_id long, ts string, event_type string, value double, props string")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    r = hosts.host_load_summary(spark, str(tmp_path)).collect()
    assert [(x.cell, x.samples, x.own_cpu_median, x.other_cells_cpu_median, x.top_other) for x in r] == [("1", 3, 1.0, 0.0, "error:700=20")]
    ages = {x.seq: (x.host, x.age) for x in hosts.awake_ages(spark, str(tmp_path)).collect()}
    # between 1:00 and 5:00 the clock of run 41's host, which is run 1's too, stood for two hours; run 4's age ends at 3:00
    assert ages[4] == (1, 0.0) and ages[5] == (1, 7200.0) and ages[3] == (0, 3600.0)


def test_most_used_over_tiles(monkeypatch):
    """Sums of spans in tiles of any width, with ties and sums of zero, against plain dicts."""
    import random
    import numpy as np
    r = random.Random(5)
    for tile in (1, 60, 1 << 22):
        monkeypatch.setattr(samples, "TILE", tile)
        used = {(float(r.randrange(30)), str(r.randrange(9)), r.choice("ab")): float(r.choice([0, 0, 0, 1, 2])) for _ in range(60)}
        spans = {(float(a), float(a + r.randrange(6))) for a in (r.randrange(30) for _ in range(90))}
        ts, owner, role = zip(*used, strict=True)
        lo, hi = np.array(sorted(spans)).T
        got = samples._two_most({"ts": np.array(ts), "owner": owner, "role": role, "cpu": np.array(list(used.values()))}, {"lo": lo, "hi": hi})
        told = {}
        for a, b, *x in zip(got["lo"].tolist(), got["hi"].tolist(), got["cpu"].tolist(), got["role"], got["owner"], strict=True):
            told.setdefault((a, b), []).append(tuple(x))
        for lo, hi in spans:
            sums = {}
            for (t, o, role), v in used.items():
                if lo <= t <= hi:
                    sums[role, o] = sums.get((role, o), 0.0) + v
            ranked = sorted(((v, *k) for k, v in sums.items()), reverse=True)
            want = ranked[:1] + [x for x in ranked if x[2] != ranked[0][2]][:1]
            assert sorted(told.get((lo, hi), []), reverse=True) == want


def test_a_window_meets_spans_of_time_not_samples(spark):
    """Twice the samples of a host make no more rows before the aggregate, and every join has a key."""
    df = spark.range(4000).selectExpr("id % 2 AS host", "cast(id div 2 AS double) AS ts", "'container' AS scope", "concat('b', id % 3) AS name", "cast(id % 3 AS string) AS owner",
                                      "'agent' AS role", "cast(id % 7 AS double) AS cpu_pct", "cast(null AS double) AS mem_mb")
    w = spark.range(20).selectExpr("cast(id % 3 AS string) AS cell", "id AS line_no", "id % 2 AS host", "cast(id * 10 AS double) AS ready", "cast(id * 10 + 1000 AS double) AS closed", "'BBS' AS arrangement", "'pass' AS outcome")
    out = samples.host_summary(w, df, 500.0)
    assert out.where("samples = 1001").count() == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_footprint_integrates_real_time(spark):
    row = lambda ts, plane, name, cpu, mem, tag="app": ("c", ts, plane, name, tag, cpu, mem)
    df = spark.createDataFrame([row(0.0, "docker", "n-control-plane", 100.0, 1000.0), row(0.0, "k8s", "p", 50.0, 400.0), row(0.0, "host", "h", 20.0, 100.0), row(7.0, "docker", "n-control-plane", 200.0, 1000.0), row(7.0, "host", "h", 0.0, 100.0)],
                               "cell string, ts double, plane string, name string, tag string, cpu_pct double, mem_mb double")
    r = samples.footprint(df, 5.0, 3.0).first()
    assert (r.cpu_core_seconds, r.mem_mb_seconds, r.max_cpu_pct, r.max_components, r.peak_ts, r.window_s) == (1.2 * 5 + 2 * 7, 1100.0 * 12, 200.0, 2, 0.0, 12.0)


def test_sleep_and_awake_age(spark):
    rd = spark.createDataFrame([("h", 1, 0.0, 0.0), ("h", 2, 100.0, 50.0), ("h", 3, 110.0, 40.0 + 20.0), ("h", 4, 400.0, 200.0)], "host string, seq long, wall double, mono double").withColumn("chunk", chunk_of("seq", 2))
    gaps = samples.sleep_gaps(rd)
    assert {(r.start, r.s) for r in gaps.collect()} == {(0.0, 50.0), (110.0, 150.0)}
    ages = spark.createDataFrame([("h", 1, 20.0, 60.0), ("h", 2, 60.0, 105.0), ("h", 3, 30.0, 500.0), ("g", 4, 1.0, 3.0)], "host string, id int, since double, now double")
    assert {r.id: r.age for r in samples.awake_age(ages, gaps, 64.0).collect()} == {1: 10.0, 2: 45.0, 3: 300.0, 4: 2.0}


def test_surface_rules(spark):
    files = spark.createDataFrame([("c", "src/a.py", b"import x\n\n# note\n  # more\nx = 1  # keep"), ("c", "src/Dockerfile", b"FROM a\n"), ("c", "src/b.rs", b"fn\n"), ("c", "src/seed.py", b"same\n"),
                                   ("c", "node_modules/x.py", b"x"), ("c", "a/pic.PNG", b"x"), ("c", "bin/tool", b"\x00elf"), ("c", "bad.txt", b"\xff\xfe"), ("c", "README", b"")], "cell string, rel string, content binary")
    import hashlib
    skel = spark.createDataFrame([("c", "src/seed.py", hashlib.sha256(b"same\n").hexdigest()), ("c", "src/b.rs", "other")], "cell string, rel string, sha string")
    rows = surface.per_file(files, skel)
    got = {r.rel: (r.language, r.lines, r.sloc, r.authored) for r in rows.collect()}
    assert got == {"src/a.py": ("Python", 5, 2, True), "src/Dockerfile": ("Dockerfile", 1, 1, True), "src/b.rs": (".rs", 1, 1, True), "src/seed.py": ("Python", 1, 1, False), "README": ("other", 0, 0, True)}
    s = surface.author_surface(rows).first()
    assert (s.files, s.languages, s.lines, s.sloc, s.total_files, s.total_lines) == (4, ".rs,Dockerfile,Python,other", 7, 4, 5, 8)


def test_chunked_replay_equals_a_plain_fold(spark):
    import random
    from runlens.functions import lifecycle as M
    r = random.Random(5)
    weights = ["Admit", "AcquireVerify", "VerifyFail", "Crash"] * 4 + list(M.ACTIONS) + ["Unknown"]
    log = [(f"c{r.choice([0, 0, 0, 1, 2])}", i, float(i), r.choice(weights)) for i in range(400)]
    want, states = {}, {}
    for cid, i, _, a in log:
        if a not in M.ACTIONS:
            continue
        s, n, bad = states.get(cid, (M.State(), 0, False))
        to = M.step(s, a)
        ok = to is not None
        cascade = bad and not ok
        if ok:
            s, more = to
            n += more
        states[cid] = (s, n, bad or not ok)
        want[i] = (ok, n, cascade)
    for rows in (3, 1000):
        df = spark.createDataFrame(log, "cid string, seq long, ts double, action string").withColumn("chunk", chunk_of("seq", rows)).repartition(4)
        got = {x.seq: (x.applied, x.attempts, x.cascade) for x in C.replay(df).collect()}
        assert got == want


def test_replay_from_a_recorded_state(spark):
    df = spark.createDataFrame([("c", 1, 1.0, "Resume"), ("c", 2, 2.0, "Admit")], "cid string, seq long, ts double, action string").withColumn("chunk", F.lit(0).cast("long"))
    code = C.state_code(F.lit("none"), F.lit("paused"), F.lit(False), F.lit(False), F.lit(False), F.lit(False))
    start = spark.range(1).select(F.lit("c").alias("cid"), code.alias("state"), F.lit(4).cast("long").alias("attempts"))
    assert [(x.applied, x.attempts) for x in C.replay(df, start).orderBy("seq").collect()] == [(True, 4), (True, 5)]
    assert [x.applied for x in C.replay(df).orderBy("seq").collect()] == [False, True]
