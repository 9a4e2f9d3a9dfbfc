"""Transcript accounts. A transcript frame has cell, attempt, line_no, line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import ledger as L
from runlens.operators.metrics import USAGE_FIELDS

KEYS = ("cell", "attempt")
CLIENT_A = ("type string, subtype string, message struct<content:array<struct<type:string,id:string>>>, "
            "retry_delay_ms double, rate_limit_info struct<status:string>, duration_ms double, duration_api_ms double, "
            "num_turns bigint, total_cost_usd double, usage struct<input_tokens:bigint,cache_creation_input_tokens:bigint,"
            "cache_read_input_tokens:bigint,output_tokens:bigint,output_tokens_details:struct<thinking_tokens:bigint>>")
CLIENT_B = ("event string, step_update struct<step_index:bigint,state:string,step_type:string,tool_name:string,"
            "tool_info:struct<name:string,output:string>>, result struct<status:string,duration_seconds:double,num_turns:bigint,"
            "usage:struct<input_tokens:bigint,output_tokens:bigint,thinking_tokens:bigint,cache_read_tokens:bigint>>")
# Fixed value: what a tool prints when the client's sandbox refuses it.
SANDBOX_REFUSED = "operation not permitted"


def parsed(lines: DataFrame, schema: str) -> DataFrame:
    """The JSON objects among the lines, as typed columns."""
    doc = F.from_json(F.when(F.startswith(F.col("line"), F.lit("{")), F.col("line")), schema)
    return lines.select(*KEYS, "line_no", doc.alias("d")).where("d IS NOT NULL").select(*KEYS, "line_no", "d.*")


def client_a(lines: DataFrame) -> DataFrame:
    """One row per attempt with a result line: last result for API time and
    cost, sums over results for turns and tokens."""
    e = parsed(lines, CLIENT_A)
    result = F.col("type") == "result"
    u = F.col("usage")
    retry = (F.col("type") == "system") & (F.col("subtype") == "api_retry")
    status = F.col("rate_limit_info.status")
    limited = (F.col("type") == "rate_limit_event") & status.isNotNull() & (status != "allowed")
    only = lambda c: F.sum(F.when(result, c))
    strict = lambda c: F.when(F.count(F.when(result, c)) == F.count_if(result), only(c))
    tokens_in = u["input_tokens"] + u["cache_creation_input_tokens"] + u["cache_read_input_tokens"]
    last = lambda c: F.max_by(F.col(c), F.when(result, F.col("line_no")))
    base = e.groupBy(*KEYS).agg(
        F.count_if(result).alias("closings"),
        F.round(last("duration_api_ms") / 1000, 1).alias("api_s"), strict(F.col("num_turns")).alias("turns"),
        strict(u["output_tokens"]).alias("out_tok"), strict(u["output_tokens_details"]["thinking_tokens"]).alias("think_tok"),
        strict(tokens_in).alias("in_tok"), last("total_cost_usd").alias("cost_usd"),
        F.count_if(retry).alias("retries"),
        F.round(F.coalesce(F.sum(F.when(retry, F.col("retry_delay_ms"))), F.lit(0.0)) / 1000, 1).alias("retry_wait_s"),
        F.count_if(limited).alias("limited"),
        (strict(F.col("duration_ms")) / 1000).alias("client_s")).where("closings > 0")
    tools = (e.where("type = 'assistant'").select(*KEYS, F.explode(F.filter(
        F.col("message.content"), lambda b: b["type"] == "tool_use")).alias("b"))
        .groupBy(*KEYS).agg(F.count_distinct(F.coalesce("b.id", F.lit(""))).alias("tool_calls")))
    return (base.join(tools, list(KEYS), "left").withColumn("tool_calls", F.coalesce("tool_calls", F.lit(0)))
            .withColumn("sandbox_fails", F.lit(None).cast("long")))


def client_b(lines: DataFrame) -> DataFrame:
    """One row per attempt with a result: steps count once whatever their
    states; time, cost and retries are not recorded."""
    e = parsed(lines, CLIENT_B)
    result, step = F.col("event") == "result", F.col("step_update")
    u = F.col("result.usage")
    strict = lambda c: F.when(F.count(F.when(result, c)) == F.count_if(result), F.sum(F.when(result, c)))
    kind = F.when(F.col("event") == "step_update", step["step_type"])
    refused = (F.col("event") == "step_update") & F.contains(F.coalesce(step["tool_info"]["output"], F.lit("")), F.lit(SANDBOX_REFUSED))
    base = e.groupBy(*KEYS).agg(
        F.count_if(result).alias("closings"), strict(u["output_tokens"]).alias("out_tok"),
        strict(u["thinking_tokens"]).alias("think_tok"),
        strict(u["input_tokens"] + u["cache_read_tokens"]).alias("in_tok"),
        strict(F.col("result.duration_seconds")).alias("client_s")).where("closings > 0")
    steps = (e.where("event = 'step_update'").groupBy(*KEYS, step["step_index"].alias("i"))
             .agg(F.bool_or(F.coalesce(kind == "agent_response", F.lit(False))).alias("turn"),
                  F.bool_or(F.coalesce(kind == "tool", F.lit(False))).alias("tool"), F.bool_or(refused).alias("refused"))
             .groupBy(*KEYS).agg(*[F.count_if(F.col(c)).alias(n) for c, n in
                                   (("turn", "turns"), ("tool", "tool_calls"), ("refused", "sandbox_fails"))]))
    j = base.join(steps, list(KEYS), "left")
    for c in ("turns", "tool_calls", "sandbox_fails"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)))
    for c, t in (("api_s", "double"), ("cost_usd", "double"), ("retries", "long"), ("retry_wait_s", "double"), ("limited", "long")):
        j = j.withColumn(c, F.lit(None).cast(t))
    return j


READERS = {"A": client_a, "B": client_b}
FIGURES = tuple(f for f in USAGE_FIELDS if f != "tool_s")


def by_attempt(transcripts: DataFrame, ledger: DataFrame, readers=None) -> DataFrame:
    """Usage of every charged attempt by the client its ledger names; an
    unknown client or a missing transcript leaves it null."""
    readers = READERS if readers is None else readers
    who = L.agent_lines(ledger).select(*KEYS, "client", "last_s")
    charged = L.charged(ledger).join(who, list(KEYS), "left")
    accounts = None
    for name, reader in readers.items():
        part = reader(transcripts).select(*KEYS, *FIGURES, F.lit(name).alias("client"))
        accounts = part if accounts is None else accounts.unionByName(part)
    j = charged.join(accounts, [*KEYS, "client"], "left")
    return j.withColumn("tool_s", F.round(F.col("last_s") - F.col("api_s"), 1))


def totals(attempts: DataFrame) -> DataFrame:
    """Each figure over the counted attempts of a cell, null when one of them
    lacks it, and the provider's milliseconds per token."""
    c = attempts.where("counted")

    def total(f):  # an attempt with several ITER lines counts once per line
        x = F.col(f).cast("double")
        whole = F.when(F.count(x) == F.count(F.lit(1)), F.sum(x * F.col("lines")))
        return F.round(whole, 4 if f == "cost_usd" else 1).alias(f"{f}_total")
    g = c.groupBy("cell").agg(*[total(f) for f in USAGE_FIELDS])
    api, out = F.col("api_s_total"), F.col("out_tok_total")
    return g.withColumn("api_ms_per_out_tok", F.round(F.try_divide(1000 * api, out), 2))
