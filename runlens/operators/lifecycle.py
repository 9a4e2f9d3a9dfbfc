"""Lifecycle logs replayed against the state machine, and what they show.

A transition frame has cid, seq (log order), ts, action and chunk.

A disabled event changes nothing, so the replay is a fold. Where a cell stands is one
number: attempts, whether an event was refused, and the state. An event adds what a
table holds for its action and the state, so the replay is SQL over arrays of events:
a short block is folded event by event, a chunk is its blocks, and where a cell has
several chunks, each but the last is also folded from every state it may start in;
those maps are composed in order, and each chunk starts where they lead. A cell of any
length spreads over its chunks, and no table of events is written.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import lifecycle as M
from runlens.operators import scan as S

#: Events of a block; a fold copies its results so far at each event.
BLOCK = 64
#: A standing: attempts * TRIED + refused * REFUSED + state.
STATES, REFUSED, TRIED = 256, 256, 512
NEVER = 1 << 40


@lru_cache(maxsize=1)
def machine() -> tuple[list[int], list[int]]:
    """What each action (row) adds to a standing in each state, NEVER where the
    action may not happen; and the states that the initial one leads to, it first."""
    all_states = M.states()
    index = {s: i for i, s in enumerate(all_states)}
    adds: list[int] = []
    for action in M.ACTIONS:
        to = [M.step(s, action) for s in all_states]
        adds += [index[t[0]] - i + TRIED * t[1] if t else NEVER for i, t in enumerate(to)] + [NEVER] * (STATES - len(all_states))
    reached = [0]
    for i in reached:  # grows as it goes
        leads = [index[t[0]] for action in M.ACTIONS if (t := M.step(all_states[i], action))]
        reached += [j for j in dict.fromkeys(leads) if j not in reached]
    return adds, reached


def _numbers(values: list[int]) -> Column:
    """A list as one constant of the plan, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _fold(codes: Column, start: Column) -> Column:
    """The standing after all of ``codes``."""
    return F.aggregate(codes, start, _after)


def _after(x: Column, code: Column) -> Column:
    adds = F.get(_numbers(machine()[0]), (code * STATES + x.bitwiseAND(STATES - 1)).cast("int"))
    return F.when(adds == NEVER, x.bitwiseOR(REFUSED)).otherwise(x + adds)


def _then(x: Column, leads: Column, place: Column) -> Column:
    """The standing that ``x`` becomes by a map: where each state of the domain leads."""
    m = F.get(leads, F.get(place, x.bitwiseAND(STATES - 1).cast("int")).cast("int"))
    both = lambda v: v - v.bitwiseAND(TRIED - 1)
    return both(x) + both(m) + x.bitwiseOR(m).bitwiseAND(REFUSED) + m.bitwiseAND(STATES - 1)


def _action_code() -> Column:
    code = F.lit(None).cast("int")
    for i, a in enumerate(M.ACTIONS):
        code = F.when(F.col("action") == a, i).otherwise(code)
    return code


def state_code(loop: Column, intent: Column, slot: Column, verify: Column, rig: Column, done: Column) -> Column:
    """The number of a state in the machine's arrays."""
    place = lambda x, names: F.coalesce(F.array_position(F.array(*[F.lit(n) for n in names]), x), F.lit(1)).cast("int") - 1
    bit = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return ((((place(loop, M.LOOPS) * len(M.INTENTS) + place(intent, M.INTENTS)) * 2 + bit(slot)) * 2 + bit(verify)) * 2 + bit(rig)) * 2 + bit(done)


def replay(transitions: DataFrame, start: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """Every modelled event with the state before and after it, whether it
    applied, attempts after it, and whether an earlier event of the cell was
    already refused. ``start`` may give cells a recorded state (cid, state,
    attempts); ``since`` marks the events to judge."""
    events = transitions.withColumn("_a", _action_code().cast("long")).where("_a IS NOT NULL")
    keep = [c for c in events.columns if c != "_a"]
    by_chunk = ["cid", "chunk"]
    # rows travel whole, in an array of one, so that both readings below keep one shuffle
    dealt = events.select(*by_chunk, F.array(F.struct("seq", "_a", F.struct(*keep).alias("row"))).alias("_e")).repartition(*by_chunk)
    dealt = dealt.select(*by_chunk, F.element_at("_e", 1).alias("_e"))
    at = F.row_number().over(Window.partitionBy(*by_chunk).orderBy("_e.seq")) - 1
    blocks = dealt.withColumn("_b", F.floor(at / BLOCK)).groupBy(*by_chunk, "_b").agg(F.sort_array(F.collect_list("_e")).alias("_es"))
    whole = blocks.groupBy(*by_chunk).agg(F.sort_array(F.collect_list(F.struct("_b", "_es"))).alias("_bs"))

    # where each chunk with a later one leads from every state it may start in
    many = dealt.select(*by_chunk).distinct().groupBy("cid").agg(F.max("chunk").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    domain = machine()[1] if start is None else list(range(len(M.states())))
    place = _numbers([domain.index(i) if i in domain else 0 for i in range(STATES)])
    same = _numbers(domain)
    codes = F.flatten(F.transform("_bs", lambda b: b["_es"]["_a"]))
    maps = (whole.join(many, "cid").where("chunk < _last").select(*by_chunk, F.transform(same, lambda s: _fold(codes, s)).alias("_to")))
    leads = maps.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("chunk", "_to"))).alias("_maps"))

    first = F.lit(0).cast("long")
    cells = many.select("cid").join(leads, "cid")
    if start is not None:
        begun = start.select("cid", (F.coalesce("attempts", F.lit(0)).cast("long") * TRIED + F.coalesce("state", F.lit(0))).alias("_x0"))
        cells = cells.join(begun, "cid", "left")
        first = F.coalesce("_x0", first)
    steps = F.aggregate("_maps", F.array(first), lambda xs, m: F.concat(xs, F.array(_then(F.element_at(xs, -1), m["_to"], place))))
    # the chunk after the n-th one of a cell starts where that leads
    later = cells.select("cid", F.posexplode(F.slice(steps, 2, 1 << 30)).alias("_n", "_x"))
    order = F.row_number().over(Window.partitionBy("cid").orderBy("chunk")) - 2
    places = dealt.select(*by_chunk).distinct().join(many.select("cid"), "cid", "left_semi").withColumn("_n", order.cast("int"))
    starts = places.join(later, ["cid", "_n"]).select(*by_chunk, "_x")
    ready = whole.join(starts, by_chunk, "left")
    x = F.coalesce("_x", F.lit(0).cast("long"))
    if start is not None:
        ready = ready.join(begun, "cid", "left")
        x = F.coalesce("_x", "_x0", F.lit(0).cast("long"))

    begins = F.aggregate("_bs", F.array(x), lambda xs, b: F.concat(xs, F.array(_fold(b["_es"]["_a"], F.element_at(xs, -1)))))
    block = ready.select("_bs", begins.alias("_xs")).select(F.explode(F.transform("_bs", lambda b, i: F.struct(b["_es"].alias("es"), F.get("_xs", i).alias("x")))).alias("_b"))
    along = F.aggregate(F.col("_b.es._a"), F.array(F.col("_b.x")), lambda xs, a: F.concat(xs, F.array(_after(F.element_at(xs, -1), a))))
    rows = block.select("_b", along.alias("_xs")).select(F.inline(F.transform("_b.es", lambda e, i: F.struct(
        e["row"].alias("row"), F.get("_xs", i).alias("_was"), F.get("_xs", i + 1).alias("_is"), e["_a"].alias("_a")))))
    was, now = F.col("_was"), F.col("_is")
    applied = F.get(_numbers(machine()[0]), (F.col("_a") * STATES + was.bitwiseAND(STATES - 1)).cast("int")) != NEVER
    return rows.select("row.*", was.bitwiseAND(STATES - 1).cast("int").alias("before"), now.bitwiseAND(STATES - 1).cast("int").alias("after"),
                       applied.alias("applied"), F.shiftright(now, 9).alias("attempts"),
                       (~applied & (was.bitwiseAND(REFUSED) > 0)).alias("cascade")).withColumn("judged", F.lit(True) if since is None else since)


def in_state(state: Column, what: str) -> Column:
    """A yes/no about a state number: in_verify, holds_slot or live."""
    bits = {"holds_slot": 3, "in_verify": 2}
    if what == "live":
        return F.floor(state / (len(M.INTENTS) * 16)) > 0
    return F.floor(state / (1 << bits[what])) % 2 == 1


def from_last_epoch(log: DataFrame) -> DataFrame:
    """The events of each log from its last run of consecutive EPOCH lines on;
    all of them without one. Needs log, seq, action, chunk."""
    epoch = F.col("action") == "EPOCH"
    opens = S.scan(log, ["log"], ["seq"], {"_before": S.prev(F.col("action"))}).where(
        epoch & ~F.coalesce(F.col("_before") == "EPOCH", F.lit(False)))
    cut = opens.groupBy("log").agg(F.max("seq").alias("_cut"))
    return log.join(cut, "log", "left").where(F.col("_cut").isNull() | (F.col("seq") >= F.col("_cut"))).drop("_cut")


def incarnations(log: DataFrame) -> DataFrame:
    """``Retire`` ends the cell under an id; what follows is ``id#n``."""
    s = S.scan(log, ["cid"], ["seq"], {"_gen": S.total_before((F.col("action") == "Retire").cast("long"))})
    return s.where(F.col("action") != "Retire").withColumn(
        "cid", F.when(F.col("_gen") > 0, F.concat("cid", F.lit("#"), F.col("_gen").cast("string"))).otherwise(F.col("cid"))).drop("_gen")


def concurrency(replayed: DataFrame, width: int) -> DataFrame:
    """How many cells hold a slot and the verify after each applied event, in
    the order of the whole log. ``width`` positions make one chunk of it."""
    gain = lambda what: in_state(F.col("after"), what).cast("long") - in_state(F.col("before"), what).cast("long")
    rows = replayed.where("applied").select("log", "seq", "cid", "action", gain("holds_slot").alias("_s"), gain("in_verify").alias("_v"),
                                            F.floor(F.col("seq") / width).alias("chunk"))
    return S.scan(rows, ["log"], ["seq"], {"slots": S.total(F.col("_s")), "verifies": S.total(F.col("_v"))}).drop("_s", "_v", "chunk")


def verify_times(transitions: DataFrame) -> DataFrame:
    """Each verdict with the AcquireVerify it closes: seconds between them. An
    acquire is used once."""
    take = F.col("action") == "AcquireVerify"
    marks = transitions.where(F.col("action").isin("AcquireVerify", "VerifyGreen", "VerifyFail"))
    s = S.scan(marks, ["cid"], ["seq"], {"_before": S.prev(F.struct("action", "ts"))})
    return s.where(~take & (F.col("_before.action") == "AcquireVerify")).withColumn("seconds", F.col("ts") - F.col("_before.ts")).drop("_before")


def short_verifies(times: DataFrame, floor_s: float = 45.0) -> DataFrame:
    """Verdicts reached too fast; a voided fail is exempt. Needs ``void``."""
    return times.where((F.col("seconds") < floor_s) & ~((F.col("action") == "VerifyFail") & F.col("void")))


def last_loop_actions(transitions: DataFrame) -> DataFrame:
    """The latest action of a cell that affects its loop. Needs ``note``."""
    live = (F.col("action") == "EPOCH") & ~F.contains(F.col("note"), F.lit("loop=none"))
    t = transitions.where(~F.col("action").isin(*M.LOOP_UNCHANGED_BY)).withColumn(
        "action", F.when(live, "EPOCH-live").otherwise(F.col("action")))
    return t.groupBy("cid").agg(F.max_by("action", "seq").alias("action"), F.max_by("ts", "seq").alias("ts"))


def loop_of_phase(phase: Column, slot: Column) -> Column:
    return F.when(phase == "verify", "verify").when(~slot, "idle").otherwise("agent")


def observed_epoch(outcomes: DataFrame, markers: DataFrame, loops: DataFrame) -> DataFrame:
    """Each cell's state now in the lifecycle's words. ``outcomes`` has cid,
    verdict, att; ``markers`` cid, cancelled, paused; ``loops`` cid, phase,
    slot, verify for the cells with a live loop."""
    j = outcomes.join(markers, "cid", "left").join(loops.withColumn("_live", F.lit(True)), "cid", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    intent = F.when(yes("cancelled"), "killed").when(yes("paused"), "paused").otherwise("run")
    loop = F.when(yes("_live"), loop_of_phase(F.coalesce("phase", F.lit("")), yes("slot"))).otherwise("none")
    return j.select("cid", F.coalesce("verdict", F.lit("none")).alias("outcome"), intent.alias("intent"), loop.alias("loop"),
                    F.col("att").alias("attempts"), yes("slot").alias("slot"), yes("verify").alias("verify")).withColumn(
        "initial", (F.col("outcome") == "none") & (F.col("intent") == "run") & (F.col("loop") == "none") & (F.col("attempts") == 0)
        & ~F.col("slot") & ~F.col("verify"))

