"""The engine's tables derived from a star schema: orders stand for scored
cells, one user's events for one run, conversations for transcripts and
documents for authored files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.operators.scan import chunk_of


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double, whatever the timestamp's kind."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored cell per order: its lines are the attempts, their sums the
    work they took."""
    flag = F.col("l_returnflag")
    qty = F.col("l_quantity").cast("long")
    lines = (read(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(flag == "A").alias("n_a"),
                  F.count_if(flag == "R").alias("n_r"),
                  F.count_if(flag == "N").alias("n_n"),
                  F.sum(qty).alias("qty"),
                  F.sum(F.when(flag == "R", qty)).alias("errs"),
                  F.sum(F.col("l_linenumber").cast("long")).alias("calls"),
                  F.sum(F.floor("l_extendedprice").cast("long")).alias("ext")))
    o = (read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
         .join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"),
               F.col("o_custkey") == F.col("c_custkey"), "left"))
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    green = status == "F"
    half = lambda e, by: F.floor(e / by).cast("long")
    return o.select(
        key.cast("string").alias("cell_id"),
        F.coalesce("c_mktsegment", F.lit("unknown")).alias("model"),
        F.concat(F.lit("T"), (key % 3 + 1).cast("string")).alias("task"),
        F.col("o_orderpriority").alias("variant"),
        F.create_map(F.lit("quarter"), F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string")),
                     F.lit("home"), F.coalesce(F.col("c_nationkey").cast("string"), F.lit("-"))).alias("factors"),
        F.when(F.year("o_orderdate") % 2 == 0, "py").otherwise("bash").alias("impl"),
        (key % 5 + 1).alias("repeat"),
        F.when(key % 7 != 0, F.col("n") == 1).alias("first_pass_correct"),
        F.lit(None).cast("string").alias("correctness_tier"),
        F.when(key % 11 != 0, F.lit(True)).otherwise(F.lit(False)).alias("deploy_ok"),
        F.col("n_a").alias("e2e_pass"),
        F.col("n").alias("e2e_total"),
        (F.col("n_a") * 2 >= F.col("n")).alias("e2e_green"),
        F.col("errs").alias("load_errors"),
        F.col("qty").alias("load_total"),
        (key % 13 != 0).alias("k6_available"),
        F.when(status == "O", F.when(key % 2 == 0, "e2e").otherwise("scaling")).alias("verify_stage_failed"),
        F.when(green, F.col("n")).alias("iterations_to_green"),
        green.alias("green"),
        (status == "P").alias("revoked"),
        ((F.col("n") >= 6) & ~green).alias("budget_exhausted"),
        F.col("o_totalprice").alias("agent_s_total"),
        F.try_divide(F.col("o_totalprice"), F.col("n")).alias("agent_s_per_attempt"),
        F.when(key % 5 != 0, half(F.col("o_totalprice"), 2).cast("double")).alias("api_s_total"),
        F.when(key % 5 != 0, F.col("o_totalprice") - half(F.col("o_totalprice"), 2)).alias("tool_s_total"),
        F.col("qty").alias("turns_total"),
        F.when(key % 3 != 0, F.col("calls")).alias("tool_calls_total"),
        F.col("ext").alias("out_tok_total"),
        half(F.col("ext"), 3).alias("think_tok_total"),
        (F.col("ext") * 2).alias("in_tok_total"),
        (F.col("ext") / 10000.0).alias("cost_usd_total"),
        F.col("n_r").alias("retries_total"),
        F.col("errs").cast("double").alias("retry_wait_s_total"),
        F.col("n_n").alias("limited_total"),
        F.lit(None).cast("long").alias("sandbox_fails_total"),
        F.try_divide(F.col("qty") * 1000.0, F.col("ext")).alias("api_ms_per_out_tok"),
        F.col("n").alias("files"),
        ((F.col("n_a") > 0).cast("long") + (F.col("n_r") > 0).cast("long")
         + (F.col("n_n") > 0).cast("long")).alias("language_count"),
        half(F.col("ext"), 100).alias("lines"),
        half(F.col("ext"), 150).alias("sloc"),
        half(F.col("ext"), 80).alias("total_lines"),
        F.lit(None).cast("string").alias("grader"),
        F.lit(None).cast("string").alias("grading_missing"),
    )


START_EPOCH = 1704067200.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their second on the clock, the number in their properties
    and the chunk of the scan order. ``event_id`` follows time."""
    return (read(spark, sf_dir, "events")
            .select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"),
                    epoch(F.col("ts")).alias("ts"), F.col("event_type").alias("kind"), "value",
                    F.get_json_object("props", "$.k").cast("long").alias("k"))
            .withColumn("chunk", chunk_of("seq")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_of(events(spark, sf_dir))


def ledger_of(e: DataFrame) -> DataFrame:
    """One ledger event per row: ``fields`` starts with the cell, but for ITER
    lines, whose first field is the result."""
    k = F.col("k")
    kind = F.col("kind")
    ten = k % 10
    name = (F.when(kind == "signup",
                   F.when(ten == 0, "END").when(ten == 1, "END").when(ten == 2, "REVERIFY").when(ten == 3, "HALT")
                   .when(ten == 4, "PREPARED").when(ten == 5, "REVERIFY_END").when(ten == 6, "VERIFY_NOSTART")
                   .otherwise("START"))
            .when(kind == "error", F.when(ten == 0, "NOEDIT").otherwise("ITER"))
            .when(kind == "purchase", F.lit("ITER"))
            .when(kind == "view", F.when(ten == 0, "VERIFY_READY").otherwise("SHAPE"))
            .otherwise(F.when(ten == 0, "ALERT").when(ten <= 4, "AGENT").when(ten == 5, "REVERIFY")
                       .when(ten == 6, "PAUSED").when(ten == 7, "WAKE").otherwise("START")))
    # the name is a column of its own below: many fields depend on it
    e, name = e.withColumn("event", name), F.col("event")
    att = (F.floor(k / 25) + 1).cast("string")
    attempt = F.concat(F.lit("attempt="), att)
    cell = F.col("run").cast("string")
    stage = F.when(ten <= 3, "e2e").when(ten <= 5, "scaling").when(ten == 6, "no-edit").otherwise("load")
    fail_note = F.concat(attempt, F.lit(" stage="), stage, F.lit(" e2e="), ten.cast("string"), F.lit("/8"),
                         F.when(stage == "scaling", F.lit(" shape-gate=BSB")).otherwise(F.lit("")))
    shape = F.when(k % 3 == 0, "BBS").when(k % 3 == 1, "BSB").otherwise("SSB")
    shape_text = F.concat(F.when(ten == 9, F.lit("reverify ")).otherwise(F.lit("")), shape,
                          F.when(ten <= 2, F.lit(" FAIL")).otherwise(F.lit(" pass")))
    secs = F.floor("value").cast("long").cast("string")
    agent = F.array(cell, attempt, F.concat(F.lit("s="), secs), F.concat(F.lit("last_s="), secs),
                    F.concat(F.lit("client="), F.when(k % 2 == 0, "A:1.0").otherwise("B:2.1")))
    fields = (F.when(name == "ITER", F.when(kind == "purchase",
                                            F.array(F.when(ten == 0, F.lit("budget")).otherwise(F.lit("green")),
                                                    F.concat(attempt, F.lit(" shapes=all"))))
                     .otherwise(F.array(F.lit("fail"), fail_note)))
              .when(name == "END", F.array(cell, F.when(ten == 0, F.lit("green=true")).otherwise(F.lit("green=false"))))
              .when(name == "REVERIFY", F.array(cell, F.when(ten == 2, F.lit("start"))
                                                .otherwise(F.when(k % 4 == 1, F.lit("PASS")).otherwise(F.lit("queued")))))
              .when(name == "HALT", F.array(cell, attempt, F.when(k % 4 == 3, F.lit("infra gone")).otherwise(F.lit("agent-fault"))))
              .when(name == "ALERT", F.array(cell, attempt, F.when(k % 20 == 0, F.lit("RIG-OUTPUT trace missing"))
                                             .otherwise(F.lit("INTEGRITY verify wrote the ledger"))))
              .when(name == "AGENT", agent)
              .when(name == "SHAPE", F.array(cell, attempt, shape_text))
              .when(name == "NOEDIT", F.array(cell, attempt, F.lit("no file changed")))
              .otherwise(F.array(cell, attempt)))
    return e.select(F.col("run").alias("cell"), F.col("seq").alias("line_no"), "ts", "chunk",
                    "event", fields.alias("fields"), "k", "value")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick per event: its latency, whether the cache was up, and the
    counters of requests sent and answered (events so far, over all runs)."""
    kind = F.col("kind")
    return events(spark, sf_dir).select(
        "run", "seq", "ts", "chunk", F.col("value").alias("p99"), (F.col("value") > 60).alias("up"),
        F.col("seq").alias("sent"), (F.col("seq") - F.col("k") % 3 * 300).alias("done"),
        (kind == "error").alias("failed"), F.col("k").alias("offered_rps"), F.col("kind"))


#: Runs that share a host; hosts grow in number with the runs.
RUNS_PER_HOST = 16


def host_of(run: Column | str) -> Column:
    return F.floor((F.col(run) if isinstance(run, str) else run) / RUNS_PER_HOST)


def samples(spark: SparkSession, sf_dir: str, machine: Column | None = None) -> DataFrame:
    """Host samples: one sample per host and hour, one row per name and role in it.
    ``machine`` says on which host an event's run is, if not on that of ``host_of``."""
    host = F.col("kind") == "signup"
    rows = events(spark, sf_dir).select(
        (host_of("run") if machine is None else machine).alias("host"),
        (F.floor(F.col("ts") / 3600) * 3600).cast("double").alias("ts"),
        F.when(host, "host").otherwise("container").alias("scope"),
        F.when(host, F.when(F.col("k") % 3 == 0, "cpu_idle").when(F.col("k") % 3 == 1, "load1").otherwise("mem_used_gb"))
        .otherwise(F.concat(F.lit("box-"), F.col("run").cast("string"))).alias("name"),
        F.when(host | (F.col("k") % 9 == 0), F.lit("")).otherwise(F.col("run").cast("string")).alias("owner"),
        F.when(host, F.lit("")).otherwise(F.col("kind")).alias("role"),
        F.when(F.col("k") != 17, F.floor("value")).cast("double").alias("cpu_pct"),
        F.when(F.col("k") % 5 != 0, F.col("k") * 4).cast("double").alias("mem_mb"))
    return rows.groupBy("host", "ts", "scope", "name", "owner", "role").agg(F.max("cpu_pct").alias("cpu_pct"), F.max("mem_mb").alias("mem_mb"))


def resource_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component samples of a cell's footprint: one sample per day and cell."""
    kind = F.col("kind")
    return events(spark, sf_dir).select(
        F.col("run").alias("cell"), (F.floor(F.col("ts") / 86400) * 86400).cast("double").alias("ts"), "seq",
        F.when(kind.isin("view", "click"), "docker").when(kind == "signup", "host").otherwise("k8s").alias("plane"),
        F.when(kind == "view", F.concat(F.lit("grid-"), F.when(F.col("k") % 2 == 0, "worker").otherwise("control-plane")))
        .otherwise(F.concat(kind, F.lit("-"), (F.col("k") % 4).cast("string"))).alias("name"),
        F.when(F.col("k") % 3 == 0, "infra").otherwise("app").alias("tag"),
        F.floor("value").cast("double").alias("cpu_pct"), (F.col("k") * 8).cast("double").alias("mem_mb"),
        F.when(F.col("k") % 7 != 0, F.col("k") * 8 + F.floor("value")).cast("double").alias("other_mb"),
        F.when(F.col("k") % 4 != 0, F.col("k") * 8 + F.floor(F.col("value") / 2)).cast("double").alias("again_mb"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authored files: a document per file, its source the cell, its language
    the extension."""
    ext = (F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".YAML")
           .when(F.col("lang") == "fr", ".md").otherwise(".rs"))
    dirname = F.when(F.col("doc_id") % 17 == 0, "node_modules").when(F.col("doc_id") % 5 == 0, "lib").otherwise("src")
    base = F.when(F.col("doc_id") % 23 == 0, F.lit("Dockerfile")).otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext))
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("cell"), "doc_id",
        F.concat(dirname, F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), base).alias("rel"),
        F.col("text").alias("content"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace on the schedule's clock."""
    return trace(spark, sf_dir).withColumn("ts", F.round(F.col("ts") - F.lit(START_EPOCH), 3))


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day spikes on the days of a run that end in 2, and the spread
    calibration recorded for each."""
    day = F.floor((F.col("ts") - F.lit(START_EPOCH)) / 86400).cast("long")
    d = events(spark, sf_dir).select("run", day.alias("day")).where("day % 10 = 2").distinct()
    i = F.row_number().over(Window.partitionBy("run").orderBy("day"))
    return d.select("run", i.alias("i"), (F.col("day") * 86400.0).alias("t0"), ((F.col("day") + 2) * 86400.0).alias("t1"),
                    (F.col("day") * 600.0).alias("mount_spread"), (F.col("day") * 300.0).alias("release_spread"))


def law_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run recorded beside its trace."""
    return events(spark, sf_dir).groupBy("run").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "error").alias("errors")).select(
        "run", F.when(F.col("run") % 25 != 0, F.lit(START_EPOCH)).alias("started"), F.lit(None).cast("double").alias("release"),
        "total", "errors")


def transcripts_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client A's transcript: a conversation per attempt, a turn per line."""
    n, four = F.length("text"), F.col("turn") % 4
    tool = lambda i: F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), i.cast("string")).alias("id"))
    say = F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("id"))
    result = four == 3
    doc = F.to_json(F.struct(
        F.when(four == 0, "system").when(four == 1, "assistant").when(four == 2, "rate_limit_event").otherwise("result").alias("type"),
        F.when(four == 0, "api_retry").alias("subtype"),
        F.when(four == 1, F.struct(F.array(tool(n % 5), say, tool(n % 3)).alias("content"))).alias("message"),
        F.when(four == 0, n).alias("retry_delay_ms"),
        F.when(four == 2, F.struct(F.when(n % 2 == 0, "allowed").otherwise("allowed_warning").alias("status"))).alias("rate_limit_info"),
        F.when(result, n * 100).alias("duration_ms"), F.when(result, n * 40).alias("duration_api_ms"),
        F.when(result, F.col("turn")).alias("num_turns"), F.when(result, n / F.lit(64.0)).alias("total_cost_usd"),
        F.when(result, F.struct(n.alias("input_tokens"), (n * 2).alias("cache_creation_input_tokens"),
                                F.when(n % 10 != 0, n * 3).alias("cache_read_input_tokens"), (n % 997).alias("output_tokens"),
                                F.struct((n % 89).alias("thinking_tokens")).alias("output_tokens_details"))).alias("usage")))
    c = read(spark, sf_dir, "conversations")
    return c.select(F.floor(F.col("conv_id") / 4).cast("long").alias("cell"), (F.col("conv_id") % 4 + 1).alias("attempt"),
                    F.col("turn").alias("line_no"), F.when(F.col("turn") % 16 == 15, F.lit("{torn")).otherwise(doc).alias("line"))


def transcripts_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts_b_of(read(spark, sf_dir, "conversations"))


def transcripts_b_of(c: DataFrame) -> DataFrame:
    """Client B's transcript of the same conversations."""
    n, four = F.length("text"), F.col("turn") % 4
    step = F.struct(F.floor(n / 100).alias("step_index"), F.lit("DONE").alias("state"),
                    F.when(four == 1, "tool").otherwise("agent_response").alias("step_type"),
                    F.when(four == 1, F.concat(F.lit("tool_"), (n % 6).cast("string"))).alias("tool_name"),
                    F.struct(F.when(n % 7 == 0, "fork: operation not permitted").otherwise("ok").alias("output")).alias("tool_info"))
    doc = F.to_json(F.struct(
        F.when(four == 3, "result").otherwise("step_update").alias("event"), F.when(four != 3, step).alias("step_update"),
        F.when(four == 3, F.struct((n / F.lit(8.0)).alias("duration_seconds"), F.struct(
            n.alias("input_tokens"), (n * 5).alias("output_tokens"), F.when(n % 11 != 0, n).alias("thinking_tokens"),
            (n * 7).alias("cache_read_tokens")).alias("usage"))).alias("result")))
    return c.select(F.floor(F.col("conv_id") / 4).cast("long").alias("cell"), (F.col("conv_id") % 4 + 1).alias("attempt"),
                    F.col("turn").alias("line_no"), doc.alias("line"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent logs: a document's lines, some ending in a provider's message or
    a structured result."""
    d = F.col("doc_id")
    tails = ("Error: you hit your weekly limit, resets in 3 hours", "quota exceeded for this plan", "please run /login now",
             "API Error: overloaded_error", "all tests passed",
             '{"type": "result", "is_error": false, "result": "done"}',
             '{"type": "result", "is_error": true, "result": "Bad gateway from provider"}',
             '{"type": "result", "api_error_status": 401, "is_error": true, "result": "denied"}',
             '{"type": "result", "api_error_status": 429, "is_error": true, "result": "rate limit"}',
             '{"type": "result", broken')
    tail = F.array(*[F.lit(t) for t in tails])[(d % len(tails)).cast("int")]
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), tail, F.lit("\n  \n")).alias("log"),
                                                   (d % 3).alias("rc"))


# One lifecycle action per kind of event and digit of its number.
ACTION_OF = {
    "signup": ("Admit", "Admit", "Admit", "Resume", "Admit", "Admit", "Resume", "Admit", "Admit", "EPOCH"),
    "click": ("AcquireVerify",) * 8 + ("AcquireRig", "ReleaseRig"),
    "view": ("AcquireVerify", "Pause", "Resume", "AcquireVerify", "AcquireRig", "Admit", "Admit", "Kill", "ReleaseRig", "Noted"),
    "purchase": ("VerifyGreen", "VerifyGreen", "VerifyFail", "VerifyFail", "Retire", "Admit", "VerifyGreen", "Retire", "VerifyFail", "Retire"),
    "error": ("Crash", "VerifyFail", "VerifyFail", "ReleaseSlot", "StandDown", "Crash", "VerifyFail", "Pause", "StandDown", "Crash"),
}


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lifecycle event per event; the cells of one host share its log."""
    e = events(spark, sf_dir)
    action = F.lit(None).cast("string")
    for kind, names in ACTION_OF.items():
        action = F.when(F.col("kind") == kind, F.array(*[F.lit(n) for n in names])[(F.col("k") % 10).cast("int")]).otherwise(action)
    return e.select(F.col("run").cast("string").alias("cid"), host_of("run").alias("log"), "seq", "ts", "chunk", action.alias("action"),
                    (F.col("k") % 4 == 0).alias("void"), F.when(F.col("k") % 2 == 0, "loop=none").otherwise("loop=agent").alias("note"))


def archive_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of archived runs, named after their run, and the stage each
    verdict gives."""
    k = F.col("k")
    nn = F.lpad((F.col("seq") % 100).cast("string"), 2, "0")
    shape = F.when(k % 3 == 0, "BBS").when(k % 3 == 1, "BSB").otherwise("SSB")
    end = F.array(*[F.lit(e) for e in ("green", "charged", "refunded", "interrupted")])[(k % 4).cast("int")]
    name = (F.when(k % 13 == 0, F.concat(nn, F.lit("-"), shape)).when(k % 29 == 0, F.lit("scratch"))
            .otherwise(F.concat(nn, F.lit("-a"), (F.floor(k / 25) + 1).cast("string"), F.lit("-"), shape, F.lit("-"), end)))
    return events(spark, sf_dir).select(F.col("run").alias("cell"), "seq", name.alias("name"),
                                        F.when(k % 5 != 0, F.when(k % 2 == 0, "deploy").otherwise("load")).alias("stage"))


def cell_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's declaration as KEY=VALUE text."""
    c = F.col("c_custkey")
    line = lambda k, v: F.concat(F.lit(k + "="), v, F.lit("\n"))
    return read(spark, sf_dir, "customer").select(c.alias("cell"), F.concat(
        line("AGENT_MODEL", F.col("c_mktsegment")), line("TASK", F.concat(F.lit("T"), (c % 3 + 1).cast("string"))),
        line("VARIANT", F.concat(F.lit("v"), (c % 4).cast("string"))), F.when(c % 6 != 0, line("IMPL", F.when(c % 2 == 0, "py").otherwise("bash"))).otherwise(F.lit("")),
        line("REPEAT", (c % 5 + 1).cast("string"))).alias("text"))


def metrics_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's metrics as JSON text: some numbers are strings, some
    documents torn."""
    p, n = F.col("p_partkey"), F.col("p_size")
    doc = F.to_json(F.struct(
        (n % 9).cast("string").alias("e2e_pass"), F.lit(8).alias("e2e_total"), (n % 9 == 8).alias("e2e_green"),
        F.concat(F.lit(" "), (n * 100).cast("string")).alias("load_total"), F.when(p % 4 != 0, n).alias("load_errors"),
        (p % 3 != 0).alias("k6_available"), F.lit(True).alias("deploy_ok"), (p % 5 != 0).alias("scaling_ok"),
        F.when(n % 9 != 8, F.array(*[F.lit(s) for s in ("deploy", "nostart", "e2e", "k6", "other")])[(p % 5).cast("int")]).alias("stage_failed"),
        F.col("p_brand").alias("brand")))
    return read(spark, sf_dir, "part").select(p.alias("cell"), F.when(p % 20 == 7, F.lit("{torn")).otherwise(doc).alias("doc"))
