from runlens.operators import ledger as L
from runlens.operators.scan import chunk_of
from runlens.sources import lines


def frame(spark, texts, chunk=2):
    df = spark.createDataFrame(list(texts.items()), "cell string, text string")
    return lines.ledger_lines(lines.numbered(df, "text", "cell"), "cell").withColumn("chunk", chunk_of("line_no", chunk))


def text(*events):
    return "\n".join("\t".join(("2026-01-01T00:00:00Z", *e)) for e in events)


def test_rules(spark):
    start = lambda n: ("START", "c", f"attempt={n}")
    it = lambda n, r="fail": ("ITER", r, f"attempt={n} stage=e2e")
    led = frame(spark, {
        "skip": text(start(1), it(1), start(3), it(3)), "over": text(start(1), it(1), start(2), it(2), start(3), it(3)),
        "after": text(start(1), it(1, "green"), ("END", "c", "green=true"), start(2)), "two": text(("END", "c", "green=false"), ("END", "c", "green=false")),
        "fake": text(("END", "c", "green=true")), "nostart": text(start(2), it(1)), "old": text(it(1), it(2, "green"), ("END", "c", "green=true"))})
    got = {r.cell: (r.rule, r.line_no) for r in L.rule_breaks(led, budget=2).collect()}
    assert got == {"skip": (1, 4), "over": (2, 6), "after": (3, 4), "two": (4, 2), "fake": (4, 1), "nostart": (5, 2)}


def test_outcomes(spark):
    note = lambda n, more="": f"attempt={n} stage=scaling e2e=8/8{more}"
    led = frame(spark, {
        "green": text(("PREPARED", "c", "x"), ("ITER", "fail", note(1)), ("ITER", "green", "attempt=2 shapes=all"), ("END", "c", "green=true"), ("SHAPE", "c", "attempt=2", "BBS pass")),
        "revoked": text(("ITER", "green", "attempt=1 shapes=all"), ("END", "c", "green=true"), ("REVERIFY", "c", "start"), ("SHAPE", "c", "reverify BBS pass"),
                        ("REVERIFY", "c", "REVOKED"), ("END", "c", "green=false")),
        "gate": text(("SHAPE", "c", "attempt=1", "BBS pass"), ("SHAPE", "c", "attempt=1", "BSB pass"), ("ITER", "fail", note(1, " shape-gate=SBB")), ("SHAPE", "c", "attempt=2", "BBS pass")),
        "open": text(("ITER", "green", "attempt=1 shapes=all"), ("END", "c", "green=true"), ("REVERIFY", "c", "start"), ("SHAPE", "c", "reverify BBS pass")),
        "halt": text(("START", "c", "attempt=1"), ("ALERT", "c", "a"), ("START", "c", "attempt=1"), ("ALERT", "c", "b"), ("HALT", "c", "infra gone"), ("NOEDIT", "c", "none"))})
    f = {r.cell: r for r in L.fold(led).collect()}
    assert (f["green"].verdict, f["green"].green_at, f["green"].gate, f["green"].prepared) == ("green", 2, 6, True)
    assert (f["revoked"].verdict, f["revoked"].green_at, f["revoked"].reverify_active) == ("revoked", 1, False)
    assert (f["gate"].verdict, f["gate"].gate, f["gate"].live_shape_pass) == (None, 3, 1)
    assert (f["open"].verdict, f["open"].reverify_active, f["open"].rev_pass) == ("green", True, 1)
    assert (f["halt"].last_ev, f["halt"].halt_cause, f["halt"].alerts, f["halt"].alerts_open, f["halt"].noedit) == ("HALT", "infra gone", 2, 1, 1)


def test_history_collapses_the_last_group(spark):
    it = lambda n, s, e: ("ITER", "fail", f"attempt={n} stage={s} e2e={e}")
    led = frame(spark, {"a": text(it(1, "e2e", "3/8"), it(2, "scaling", "8/8"), it(3, "scaling", "8/8")), "b": text(it(1, "e2e", "3/8")),
                        "c": text(it(1, "x", "8/8"), ("ITER", "green", "attempt=2"))})
    assert {r.cell: r.history for r in L.history(led).collect()} == {"a": "scaling ×2", "b": "e2e e2e NOK:3/8", "c": "green"}


def test_agent_time_needs_every_counted_attempt(spark):
    ag = lambda n, s: ("AGENT", "c", f"attempt={n}", f"s={s}", "last_s=5", "client=A:1")
    it = lambda n, r: ("ITER", r, f"attempt={n} stage=e2e")
    led = frame(spark, {"all": text(ag(1, 100), it(1, "fail"), ag(2, 7), ag(2, 200), it(2, "green"), it(3, "fail")), "gap": text(it(1, "fail"), ag(2, 9), it(2, "green"))})
    got = {r.cell: (r.agent_s_total, r.agent_s_per_attempt) for r in L.agent_time(led).collect()}
    assert got == {"all": (300, 150.0), "gap": (None, None)}


def test_rig_output_is_answered_by_a_later_verdict(spark):
    al = lambda n: ("ALERT", "c", f"attempt={n}", "RIG-OUTPUT trace.csv missing")
    led = frame(spark, {"never": text(("ITER", "fail", "attempt=2 stage=x"), al(2)), "later": text(al(2), ("ITER", "fail", "attempt=2 stage=x"))})
    assert {r.cell: r.severity for r in L.rig_output(led).collect()} == {"never": "taint", "later": "warn"}


def test_ledger_source_drops_comments_and_short_lines(spark):
    df = spark.createDataFrame([("c", "# header\n2026-01-01T00:00:00Z\tSTART\tc\tattempt=1\nshort\tline\r\nbad\tITER\tgreen\n")], "cell string, text string")
    got = [(r.line_no, r.event, r.fields, r.ts is None) for r in lines.ledger_lines(lines.numbered(df, "text", "cell"), "cell").collect()]
    assert got == [(2, "START", ["c", "attempt=1"], False), (4, "ITER", ["green"], True)]


def test_findings_put_the_ledger_and_the_runs_together_once(spark):
    from pyspark.sql import functions as F

    from runlens.plans import validation

    made = {name: spark.sparkContext.accumulator(0) for name in ("ledger", "runs")}

    def counted(df, name, column):
        count = made[name]

        def seen(value):
            count.add(1)
            return value

        return df.withColumn(column, F.udf(seen, "string").asNondeterministic()(column))

    led = frame(spark, {"a": text(("START", "a", "attempt=1"), ("ALERT", "a", "attempt=1", "INTEGRITY x"), ("ITER", "fail", "attempt=1 stage=e2e"), ("PAUSED", "a", "x"))})
    runs = spark.createDataFrame([("a", 1, "green", "load"), ("a", 2, "refunded", "load"), ("a", 3, "refunded", "load")], "cell string, attempt long, end_state string, stage string")
    paused = lambda evidence: evidence["ledger"].where("event = 'PAUSED'").select("cell", F.lit("warn").alias("severity"), F.lit("9").alias("rule"), "line_no", F.lit("paused").alias("text"))
    found = validation.findings({"ledger": counted(led, "ledger", "event"), "runs": counted(runs, "runs", "end_state")}, budget=3, rules=(paused,)).collect()
    assert sorted((r.rule, r.severity, r.line_no) for r in found) == [
        ("2-integrity", "taint", 2), ("7-refunds", "warn", 0), ("8-archive", "warn", 1), ("9", "warn", 4)]
    assert {name: count.value for name, count in made.items()} == {"ledger": 4, "runs": 3}
