import json
from datetime import datetime

from pyspark.sql import functions as F

from runlens.functions import faults, text
from runlens.operators import usage
from runlens.sources import lines


# The figures that accounts of known transcripts must give.


def transcript(spark, *attempts):
    return spark.createDataFrame([("c", n, i, e if isinstance(e, str) else json.dumps(e)) for n, es in attempts for i, e in enumerate(es)],
                                 "cell string, attempt long, line_no long, line string")


def tool(i):
    return {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": i}, {"type": "text"}]}}


def result(api, turns, cost, out, think=1, **u):
    return {"type": "result", "duration_ms": api * 2, "duration_api_ms": api, "num_turns": turns, "total_cost_usd": cost,
            "usage": {"input_tokens": 10, "cache_creation_input_tokens": 100, "cache_read_input_tokens": 1000, "output_tokens": out, "output_tokens_details": {"thinking_tokens": think}, **u}}


def test_client_a_pins(spark):
    retry = lambda ms: {"type": "system", "subtype": "api_retry", "retry_delay_ms": ms}
    limit = lambda s: {"type": "rate_limit_event", "rate_limit_info": {"status": s}}
    t = transcript(spark, (1, [tool("a"), tool("b"), tool("a"), "{broken", "plain", tool("c"), result(400000, 50, 0.4, 9000, 6000)]),
                   (2, [retry(542), retry(39776), limit("allowed"), limit("allowed_warning"), result(1000, 1, 0.1, 1)]),
                   (3, [result(400000, 50, 0.4, 9000, 6000), result(446000, 20, 0.56, 100, 40, input_tokens=6, cache_creation_input_tokens=0, cache_read_input_tokens=0)]),
                   (4, [tool("a")]), (5, [result(1000, 1, 0.1, None)]))
    got = {r.attempt: r for r in usage.client_a(t).collect()}
    assert set(got) == {1, 2, 3, 5}
    a = got[1]
    assert (a.api_s, a.turns, a.tool_calls, a.out_tok, a.think_tok, a.in_tok, a.cost_usd) == (400.0, 50, 3, 9000, 6000, 1110, 0.4)
    assert (got[2].retries, got[2].retry_wait_s, got[2].limited) == (2, 40.3, 1)
    assert (got[3].api_s, got[3].turns, got[3].out_tok, got[3].think_tok, got[3].in_tok, got[3].cost_usd) == (446.0, 70, 9100, 6040, 1116, 0.56)
    assert got[5].out_tok is None and (got[3].client_s, got[3].closings) == (1692.0, 2)


def test_client_b_counts_a_step_once(spark):
    step = lambda i, kind, state, out="": {"event": "step_update", "step_update": {"step_index": i, "state": state, "step_type": kind, "tool_info": {"output": out}}}
    steps = [step(i, k, s) for i, k in ((1, "agent_response"), (2, "tool"), (3, "agent_response"), (4, "tool"), (5, "agent_response"), (6, "other")) for s in ("RUNNING", "DONE")]
    done = {"event": "result", "result": {"duration_seconds": 5.5, "usage": {"input_tokens": 386010, "output_tokens": 7, "thinking_tokens": 2, "cache_read_tokens": 6996400}}}
    r = usage.client_b(transcript(spark, (1, [*steps, step(7, "tool", "DONE", usage.SANDBOX_REFUSED), done]))).first()
    assert (r.turns, r.tool_calls, r.in_tok, r.out_tok, r.sandbox_fails, r.client_s, r.retries) == (3, 3, 386010 + 6996400, 7, 1, 5.5, None)


def test_totals_need_every_counted_attempt(spark):
    cols = "cell string, attempt long, lines long, counted boolean, " + ", ".join(f"{f} double" for f in usage.USAGE_FIELDS)
    full = lambda cell, n, counted, turns, tool_s: (cell, n, 1, counted, *[{"turns": turns, "tool_s": tool_s, "api_s": 2.0, "out_tok": 10.0}.get(f) for f in usage.USAGE_FIELDS])
    df = spark.createDataFrame([full("a", 1, True, 25.0, 200.0), full("a", 2, True, 35.0, 400.0), full("a", 3, False, 1.0, 1.0), full("b", 1, True, 5.0, None), full("b", 2, True, None, 1.0)], cols)
    got = {r.cell: r for r in usage.totals(df).collect()}
    assert (got["a"].turns_total, got["a"].tool_s_total, got["a"].api_ms_per_out_tok) == (60.0, 600.0, 200.0)
    assert got["b"].turns_total is None and got["b"].tool_s_total is None


def test_faults(spark):
    logs = {"plain-limit": "working\nyou hit your weekly limit\n", "task-words": "too many requests handled, 429 tested", "auth": "Please run /login\n",
            "result-ok": 'rate limit\n{"type":"result","is_error":false,"result":"fine"}', "result-401": '{"type":"result","api_error_status":401,"result":"no"}',
            "result-529": '{"type":"result","api_error_status":529,"is_error":true,"result":"Overloaded"}', "last-wins": '{"type":"result","api_error_status":500,"result":"x"}\n{"type":"result","result":"ok"}\n{"type":"result" torn',
            "transport": '{"type":"result","is_error":true,"result":"socket hang up"}', "quiet": "\n  \nlast words\n\n"}
    df = lines.numbered(spark.createDataFrame(list(logs.items()), "k string, t string"), "t", "k")
    read = faults.read_logs(df, ("k",))
    got = {r.k: (r.f, r.why) for r in read.select("k", faults.classify(F.lit(1)).alias("f"), faults.reason().alias("why")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"plain-limit": "limit", "task-words": None, "auth": "auth", "result-ok": None, "result-401": "auth", "result-529": "limit",
                                                "last-wins": None, "transport": "limit", "quiet": None}
    assert got["plain-limit"][1] == "you hit your weekly limit" and got["quiet"][1] == "last words" and got["result-ok"][1] == "fine"
    assert read.where("k = 'auth'").select(faults.classify(F.lit(0)).alias("f")).first().f is None


def test_reset_hints(spark):
    now = datetime(2026, 8, 25, 20, 2, 17)
    cases = {"Resets in 3 hours": 10800, "resets in 1h12m15s": 4335, "resets 12am (UTC)": 14263, "retry after 21 days": 21 * 86400, "resets 7:40pm (UTC)": 86400 - 22 * 60 - 17,
             "resets Aug 29, 12am (UTC)": int((datetime(2026, 8, 29) - now).total_seconds()), "resets Jul 29, 12am (UTC)": int((datetime(2027, 7, 29) - now).total_seconds()),
             "resets Feb 30, 1am utc": None, "resets in 0 minutes": None, "try again in 5 secs": 5, "nothing": None, "resets Xyz 3, 1am utc": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", faults.reset_hint_s(F.col("t"), F.lit(now)).alias("s")).collect()}
    assert got == cases


def test_clock_labels(spark):
    cases = [(620.0, 600.0, 1, "agree"), (3300.0, 3000.0, 1, "agree"), (700.0, 600.0, 1, "disagree"), (1101.0, 743.0, 6, "resumed"), (5.0, None, None, "-")]
    df = spark.createDataFrame([c[:3] for c in cases], "e double, c double, n int")
    assert [r.x for r in df.select(faults.clock_label(F.col("e"), F.col("c"), F.col("n")).alias("x")).collect()] == [c[3] for c in cases]


def test_notes_and_fields(spark):
    df = spark.createDataFrame([("attempt=2 stage=a  stage=b x e=1=2",)], "n string")
    r = df.select(text.kv(F.col("n"), "stage").alias("s"), text.kv_map(F.col("n")).alias("m"), text.clean_field(F.lit("a\tb\nc")).alias("c"),
                  text.warning_kind(F.lit("3 verify run(s) not charged (deployx3)")).alias("k")).first()
    assert (r.s, r.m, r.c, r.k) == ("b", {"attempt": "2", "stage": "b", "e": "1=2"}, "a b c", "verify run(s) not charged")
