import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from runlens.operators import ledger as L
from runlens.operators import surface, traces
from runlens.plans import fleet, scoring, validation
from runlens.sources import dimensions, files, sinks, versioned


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("cells")
    for cid, model in (("ag_high_v_T1_r1", "m1"), ("ag_high_v_T1_r2", "m2")):
        write(r / cid / "cell.env", f"AGENT_MODEL={model}\nVARIANT=v\nnonsense\nVARIANT=w=1\n")
        write(r / cid / "iterations.log", b"# v2\n2026-01-01T00:00:00Z\tSTART\tc\tattempt=1\n2026-01-01T00:00:01Z\tITER\tgreen\tattempt=1 \xff\n")
        write(r / cid / "agent.attempt-2.log", 'noise\n{"type":"result"}\n')
        write(r / cid / "metrics.json", '{"e2e_pass": "3", "load_total": 7.0, "own": "x"}')
        write(r / cid / "skeleton_manifest", "a.py\t3\tabc\nbroken line\n")
        write(r / cid / "artifacts" / "src" / "a.py", "x = 1\n")
        write(r / cid / "arrangements" / "01-a1-BBS-green" / "verdict.json", '{"ok": true, "stage": null}')
        write(r / cid / "arrangements" / "02-BSB" / "verdict.json", "torn")
    write(r / "stray" / "notes.txt", "x")
    write(r / "no-cell" / "cell.env", "AGENT_MODEL=m1\n")
    return r


def test_cell_directories(spark, root):
    p = str(root)
    assert sorted(r.cid for r in files.cells(spark, p).collect()) == ["ag_high_v_T1_r1", "ag_high_v_T1_r2"]
    e = {(r.cell[-2:], r.name): r.value for r in files.env(spark, p).collect()}
    assert e[("r1", "AGENT_MODEL")] == "m1" and e[("r2", "VARIANT")] == "w=1"
    led = files.ledger(spark, p)
    assert {r.att for r in L.fold(led).collect()} == {1}
    assert [(r.attempt, r.line_no) for r in files.transcripts(spark, p).where("line LIKE '{%'").collect()] == [(2, 2), (2, 2)]
    m = scoring.read_metrics(files.metrics(spark, p)).first()
    assert (m.e2e_pass, m.load_total, m.rest) == (3.0, 7.0, {"own": "x"})
    assert [(r.rel, r.lines) for r in files.manifests(spark, p).collect()] == [("a.py", 3)] * 2
    assert {(r.rel, r.size) for r in files.artifacts(spark, p).collect()} == {("src/a.py", 6)}
    runs = {(r.name, r.attempt, r.shape, r.end_state, r.ok) for r in validation.archived_runs(files.archive(spark, p)).collect()}
    assert runs == {("01-a1-BBS-green", 1, "BBS", "green", True), ("02-BSB", None, "BSB", None, None)}


def test_trace_points_and_samples(spark, tmp_path):
    write(tmp_path / "t" / "run1" / "trace.csv", "epoch,offered_rps,p99_ms,infra_cache_up,k6_sent,k6_done\n".replace("\n", "") + "\n105.0,9,,True,4,\n")
    write(tmp_path / "p" / "a.json", "\n".join(json.dumps(x) for x in (
        {"type": "Point", "metric": "http_reqs", "data": {"time": "2026-01-01T00:00:00.5Z", "value": 1, "tags": {"status": "404"}}}, {"type": "Metric", "metric": "http_reqs"},
        {"type": "Point", "metric": "other", "data": {"time": "2026-01-01T00:00:00Z", "value": 1}})) + "\n{torn\n")
    pts = files.points(spark.read, str(tmp_path / "p")).collect()
    assert [(r.run, r.metric, r.status, r.value) for r in pts] == [("p", "http_reqs", "404", 1.0)]
    write(tmp_path / "busy.csv", "1.0,0.25\n2.0,0.5\n3.")
    assert [r.busy for r in files.host_busy(spark, str(tmp_path / "busy.csv")).collect()] == [0.25, 0.5]
    write(tmp_path / "host.csv", "ts,scope,name,owner,role,cpu_pct,mem_mb\n2026-01-01T00:00:00Z,container,a,,other,1.5,\n")
    r = files.host_samples(spark, str(tmp_path / "host.csv")).first()
    assert (r.owner, r.cpu_pct, r.mem_mb) == ("", 1.5, None)
    write(tmp_path / "log", "t2\tAdmit\tc\nt1\tPause\td\tk=v\n# x\nt1\tKill\te\n")
    assert [r.action for r in files.transitions(spark, str(tmp_path / "log")).orderBy("seq").collect()] == ["Pause", "Kill", "Admit"]


def test_a_trace_on_disk_goes_straight_into_episodes(spark, tmp_path):
    names = [c.split()[0] for c in files.TRACE.split(", ")]
    for run in ("run1", "run2"):
        ticks = [{"epoch": 100.0 + i, "ts_s": i, "infra_cache_up": 3 <= i < 6} for i in range(10)]
        rows = [",".join(str(t.get(n, 0)) for n in names) for t in ticks]
        write(tmp_path / "t" / run / "trace.csv", "\n".join([",".join(names), *rows]) + "\n")
    starts = spark.createDataFrame([("run1", 100.0), ("run2", 98.0)], "run string, k6_start_epoch double")
    trace = files.trace(spark, str(tmp_path / "t" / "*"), starts)
    assert {tuple(r) for r in traces.episodes(trace).collect()} == {("run1", 1, 3.0, 6.0), ("run2", 1, 5.0, 8.0)}


def test_sinks_write_once(spark, tmp_path):
    out = str(tmp_path / "summary")
    rows = spark.createDataFrame([("a", 1, "t1"), ("a", 1, "t1"), ("b", 1, "t1")], "cell string, attempt int, ts string")
    sinks.append_once(rows, out, ("cell", "attempt", "ts"))
    sinks.append_once(rows.unionByName(spark.createDataFrame([("c", 1, "t1")], rows.schema)), out, ("cell", "attempt", "ts"))
    assert sorted(r.cell for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    ev = spark.sql("SELECT timestamp'2026-01-01 00:00:00' AS ts, 'ITER' AS event, array('green', 'a\tb') AS fields")
    assert sinks.ledger_lines(ev).first().value == "2026-01-01T00:00:00Z\tITER\tgreen\ta b"
    with pytest.raises(Exception, match="ITER result"):
        sinks.ledger_lines(ev.withColumn("fields", F.array(F.lit("won")))).collect()
    scores = spark.createDataFrame([("a", 1), ("b", 2)], "cell_id string, v int")
    sinks.write_scores(scores, str(tmp_path / "scores"))
    sinks.write_scores(scores.where("cell_id = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "scores"))
    assert {(r.cell_id, r.v) for r in spark.read.parquet(str(tmp_path / "scores")).collect()} == {("a", 9), ("b", 2)}


def test_scoring_some_cells_again_keeps_the_others(spark, tmp_path):
    out = str(tmp_path / "scores")
    cells = spark.range(1000).select(F.concat(F.lit("c"), "id").alias("cell_id"), F.lit(1).alias("v"))
    sinks.write_scores(cells, out)
    sinks.write_scores(cells.where("cell_id IN ('c7', 'c8')").withColumn("v", F.lit(2)), out)
    sinks.write_scores(cells.limit(0), out)
    assert dict(map(tuple, spark.read.parquet(out).groupBy("v").count().collect())) == {1: 998, 2: 2}
    with pytest.raises(ValueError, match="batches"):
        sinks.write_scores(cells, out, batches=32)


def test_a_sweep_scores_what_changed_and_keeps_going(spark, tmp_path):
    cells = spark.createDataFrame([(i, "sealed", "k2") for i in range(6)], "cell long, sealed string, key string")
    stored = spark.createDataFrame([(0, "k2"), (1, "k1")], "cell long, key string")
    out = str(tmp_path / "sweep")
    record = lambda i, v: (str(i), None if i == 4 else "m", "t", v)
    schema = "cell_id string, model string, task string, v int"
    sinks.write_scores(spark.createDataFrame([record(i, 1) for i in (0, 1, 2, 3)], schema), out)
    new = lambda todo: spark.createDataFrame([record(r.cell, 2) for r in todo.collect() if r.cell != 3], schema)
    table, errors = scoring.sweep(cells, stored, new, out)
    assert {(r.cell_id, r.v) for r in table.collect()} == {("0", 1), ("1", 2), ("2", 2), ("3", 1), ("5", 2)}
    assert {tuple(r) for r in errors.collect()} == {("3", "no record"), ("4", "no model or task")}


def test_dimensions_refuse_what_they_do_not_know(spark, tmp_path):
    v = dimensions.variants(spark, [("a", 'label = "A"\n[factors]\ntech = "alpha"\n')]).first()
    assert (v.label, v.retired, v.factors) == ("A", False, {"tech": "alpha"})
    with pytest.raises(dimensions.DeclarationError, match="colour"):
        dimensions.variants(spark, [("a", 'colour = "red"')])
    with pytest.raises(dimensions.DeclarationError, match="ghost"):
        dimensions.models(spark, '[agents.x]\nclient = "A"\n[[models]]\ntag = "t"\nagent = "ghost"\n')
    m, a = dimensions.models(spark, '[agents.x]\nclient = "A"\n[[models]]\ntag = "t"\nagent = "x"\nmodel = "id"\n')
    assert m.join(a, "agent").first().client == "A" and dimensions.dangling(m, a).count() == 0
    for name in ("pending/l1/000002.b.json", "pending/l1/99999.a.json", "pending/l1/x.json"):
        write(tmp_path / name, '{"task": "T1", "variant": "v", "rep": 1}')
    s = dimensions.work_specs(spark, str(tmp_path)).orderBy("seq", "cid").collect()
    assert [(r.state, r.lane, r.cid) for r in s] == [("pending", "l1", "b"), ("pending", "l1", "a"), ("pending", "l1", "x")]
    write(tmp_path / "regimes.jsonl", '{"ts": "2026-01-01T00:00:00Z", "event": "run-start", "cap": 3}\n\n')
    r = dimensions.regimes(spark, str(tmp_path / "regimes.jsonl")).first()
    assert (r.event, r.rest) == ("run-start", {"cap": "3"})


def test_archive_warnings(spark):
    run = lambda cell, att, end, stage=None: (cell, att, end, stage)
    runs = spark.createDataFrame([run("a", 1, "refunded", "deploy"), run("a", 1, "refunded", "deploy"), run("a", 1, "charged"), run("b", 1, "interrupted"), run("b", 2, "refunded", "x"), run("c", 2, "green")],
                                 "cell string, attempt long, end_state string, stage string")
    led = spark.createDataFrame([("a", 1, "ITER", ["fail", "attempt=1 stage=e2e"]), ("c", 1, "ITER", ["fail", "attempt=1 stage=e2e"]), ("c", 2, "ITER", ["green", "attempt=2"]), ("c", 3, "ITER", ["fail", "attempt=3 stage=e2e"])],
                                "cell string, line_no long, event string, fields array<string>")
    assert {r.cell: r.text for r in validation.refunds(runs).collect()} == {"a": "2 verify run(s) not charged (deployx2)"}
    assert {(r.cell, r.text) for r in validation.archive_mismatches(runs, led).collect()} == {("c", "archive/ledger mismatch at attempt 3: ledger charged, archive no judged run")}


def test_first_seal_wins(spark):
    a = spark.createDataFrame([("a", 5, "failed", 1, "x", 2), ("a", 3, "green", 1, "x", 9), ("b", 1, "green", 1, "x", 1)], "cell string, sealed long, verdict string, attempts int, by string, seq long")
    assert {(r.cell, r.verdict) for r in fleet.first_seals(a).collect()} == {("a", "green"), ("b", "green")}
    assert {r.cell for r in fleet.first_seals(a, spark.createDataFrame([("b",)], "cell string")).collect()} == {"a"}


def test_results_files(spark, tmp_path):
    from runlens.operators.metrics import RESULT_COLUMNS
    from runlens.plans import scoreboard
    from runlens.sources import tables
    s = tables.scores(spark, "/root/testdata/sf0.001")
    out = [str(tmp_path / n) for n in ("csv", "rows", "board")]
    sinks.write_results(scoreboard.flat_rows(s), scoreboard.board(s), *out)
    flat = spark.read.option("header", "true").csv(out[0])
    assert tuple(flat.columns) == RESULT_COLUMNS and flat.count() == s.count() == spark.read.json(out[1]).count()
    assert spark.read.json(out[2]).agg(F.sum("n_cells")).first()[0] == s.count()


def small_blocks(spark):
    """Settings under which a file of some kilobytes falls into several blocks."""
    return {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}


def test_lines_of_files_in_several_blocks_are_numbered_as_in_the_file(spark, tmp_path):
    texts = {name: [f"{name} {i} " + "x" * (i % 90) for i in range(n)] for name, n in (("a", 400), ("b", 1), ("c", 233))}
    for name, rows in texts.items():
        write(tmp_path / "t" / name, "\n".join(rows) + ("\n" if name != "c" else ""))
    old = {k: spark.conf.get(k) for k in small_blocks(spark)}
    try:
        for k, v in small_blocks(spark).items():
            spark.conf.set(k, v)
        assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 5
        got = {(r.file[-1], r.line_no): r.line for r in files.block_lines(spark, str(tmp_path / "t")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {(name, i): line for name, rows in texts.items() for i, line in enumerate(rows, 1)}


def test_a_lifecycle_log_goes_straight_into_the_replay(spark, tmp_path):
    from runlens.operators import lifecycle
    acts = ["Admit", "AcquireVerify", "VerifyFail", "AcquireVerify", "VerifyGreen", "Admit"]
    rows = [f"2026-01-01T00:{i:02d}:00Z\t{a}\tc{k}\tvoid=1" for k in range(40) for i, a in enumerate(acts)]
    write(tmp_path / "logs" / "host1.log", "# v1\n" + "\n".join(reversed(rows)) + "\n")
    log = files.transitions(spark, str(tmp_path / "logs"))
    assert {"log", "seq", "chunk", "line_no", "note"} <= set(log.columns)
    got = lifecycle.replay(log)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.applied, r.attempts) for r in got.where("cid = 'c7'").collect()) == [(False, 1)] + [(True, 1)] * 5
    assert lifecycle.from_last_epoch(log).count() == 240


def test_only_new_and_changed_files_are_opened(spark, tmp_path):
    a = tmp_path / "c1" / "artifacts"
    for rel, text in (("keep.py", "x = 1\n"), ("grow.py", "a\n"), ("touch me.py", "b\n"), ("gone.py", "g\n"), ("bin.dat", b"\0\1"), ("node_modules/x.js", "n\n"),
                      ("app/node_modules/y.js", "n\n"), ("my_node_modules/z.py", "z\n"), ("pic.png", b"\0")):
        write(a / rel, text)
    all_files = files.artifacts(spark, str(tmp_path))
    (a / "node_modules" / "x.js").unlink()
    (a / "app" / "node_modules" / "y.js").unlink()  # a scan that opened them would fail
    assert {r.rel for r in all_files.select("rel", "content").collect()} == {"keep.py", "grow.py", "touch me.py", "gone.py", "bin.dat", "my_node_modules/z.py", "pic.png"}

    empty = surface.measured(all_files.limit(0))
    first = files.refreshed_surface(spark, str(tmp_path), empty)
    cache = spark.createDataFrame(first.collect(), first.schema)
    assert {(r.rel, r.skip, r.lines) for r in cache.collect()} == {
        ("keep.py", False, 1), ("grow.py", False, 1), ("touch me.py", False, 1), ("gone.py", False, 1), ("bin.dat", True, None), ("my_node_modules/z.py", False, 1)}

    write(a / "grow.py", "a\nb\n")
    os.utime(a / "touch me.py", (1, 1))
    (a / "gone.py").unlink()
    write(a / "new.py", "n\n")
    opened = []
    listed = files.artifact_signatures(spark, str(tmp_path))
    now = spark.createDataFrame(listed.collect(), listed.schema)
    for rel in ("keep.py", "bin.dat"):
        (a / rel).unlink()  # gone behind the listing: rows that stay were not read
    second = surface.refreshed(now, cache, lambda named: opened.extend(r.rel for r in named.collect()) or files.contents(named))
    assert {(r.rel, r.lines) for r in second.collect()} == {("keep.py", 1), ("grow.py", 2), ("touch me.py", 1), ("bin.dat", None), ("my_node_modules/z.py", 1), ("new.py", 1)}
    assert set(opened) == {"grow.py", "touch me.py", "new.py"}

    skeleton = spark.createDataFrame([("c1", "keep.py", hashlib.sha256(b"x = 1\n").hexdigest())], "cell string, rel string, sha string")
    assert {r.rel: r.authored for r in surface.with_authored(cache, skeleton).collect()}["keep.py"] is False


def test_versions_of_a_table_survive_lost_writes_and_read_only_their_buckets(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "scores")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v int")
    held = lambda: {r.id: r.v for r in versioned.read(spark, out).collect()}
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, out)
    versioned.merge(rows([], 0), out, ["id"], buckets=8)
    assert held() == {}
    versioned.merge(rows(range(100), 1), out, ["id"], buckets=8)
    versioned.merge(rows([3, 3, 200], 2), out, ["id"], buckets=8)
    assert held() == {i: 2 if i in (3, 200) else 1 for i in [*range(100), 200]}
    versioned.merge(rows([4, 300], 3), out, ["id"], buckets=8, replace=False)
    assert held()[4] == 1 and held()[300] == 3

    was = held()
    with monkeypatch.context() as m:
        m.setattr(versioned, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            versioned.merge(rows(range(50), 9), out, ["id"], buckets=8)
    (tmp_path / "scores" / "commits" / "000000000099").write_text('{"buck')  # a commit that was cut off
    assert held() == was
    versioned.merge(rows([5], 4), out, ["id"], buckets=8)  # goes on above it
    assert held() == was | {5: 4}
    with pytest.raises(ValueError, match="8 buckets"):
        versioned.merge(rows([1], 1), out, ["id"], buckets=16)

    mine = {r[0] for r in rows([5], 0).select(F.pmod(F.xxhash64("id"), F.lit(8))).collect()}
    for file in versioned.read(spark, out, [b for b in range(8) if b not in mine]).inputFiles():
        os.remove(file.removeprefix("file://"))
    versioned.merge(rows([5], 6), out, ["id"], buckets=8)
    assert {r.v for r in versioned.read(spark, out, mine).where("id = 5").collect()} == {6}
    assert versioned.clean(spark, out) > 0 and versioned.clean(spark, out) == 0
    assert {r.v for r in versioned.read(spark, out, mine).where("id = 5").collect()} == {6}


def test_a_stream_merges_its_batches_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out, batch = str(tmp_path / "out"), versioned.merged_batches(str(tmp_path / "out"), ["id"], buckets=4)
    spark.createDataFrame([(i % 30, 1) for i in range(60)], "id long, v int").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v int").parquet(str(tmp_path / "in"))
    for check in ("a", "b"):  # the second query has lost its progress and tells all rows again
        stream.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / check)).start().awaitTermination()
    assert sorted(r.id for r in versioned.read(spark, out).collect()) == list(range(30))
