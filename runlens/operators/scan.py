"""Ordered scans over groups of any size.

A window partitioned by the group alone sends the whole group to one task, so
a run that holds a third of all rows would decide how long the job takes. Here
each group is cut into chunks that follow its order: a window works inside one
chunk, one aggregate summarises each chunk, and a window over the summaries
carries the state from chunk to chunk. The result equals the plain window.

The chunk column must never decrease along the order. ``chunk_of`` makes one
from a row number, which bounds every chunk exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536


def chunk_of(seq: Column | str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a row whose position (unique in its group) is ``seq``."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(seq / F.lit(rows)).cast("long")


@dataclass(frozen=True)
class Spec:
    kind: str
    expr: Column


def prev(expr: Column) -> Spec:
    """The expression on the row before, null on the first."""
    return Spec("prev", expr)


def following(expr: Column) -> Spec:
    """The expression on the row after, null on the last."""
    return Spec("next", expr)


def total_before(expr: Column) -> Spec:
    """Sum over the rows before this one, 0 on the first."""
    return Spec("before", expr)


def total(expr: Column) -> Spec:
    """Sum up to and including this row."""
    return Spec("sum", expr)


def last_seen(expr: Column) -> Spec:
    """The latest non-null value up to and including this row."""
    return Spec("last", expr)


def last_before(expr: Column) -> Spec:
    """The latest non-null value on the rows before this one."""
    return Spec("lastbefore", expr)


def highest(expr: Column) -> Spec:
    """Largest value up to and including this row."""
    return Spec("max", expr)


def next_seen(expr: Column) -> Spec:
    """The earliest non-null value on the rows after this one."""
    return Spec("nextseen", expr)


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: dict[str, Spec],
         chunk: str = "chunk") -> DataFrame:
    """``df`` with one column per entry of ``specs``, computed along ``order``
    inside each group of ``keys``. ``order`` must be unique within a group."""
    by = [*keys, chunk]
    up = Window.partitionBy(*by).orderBy(*order)
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    later = up.rowsBetween(1, Window.unboundedFollowing)
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    chunks_before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    chunks_after = chunks.rowsBetween(1, Window.unboundedFollowing)
    at = F.struct(*[F.col(c) for c in order])

    local, summary, carry, merged = {}, {}, {}, {}
    edge = {"_first": F.lag(F.lit(1)).over(up).isNull(), "_last": F.lead(F.lit(1)).over(up).isNull()}
    kinds = {s.kind for s in specs.values()}
    if "prev" in kinds:
        local["_first"] = edge["_first"]
    if "next" in kinds:
        local["_last"] = edge["_last"]
    for name, spec in specs.items():
        e, lo, su, ca = spec.expr, f"_l_{name}", f"_s_{name}", f"_c_{name}"
        if spec.kind == "prev":
            local[lo] = F.lag(e).over(up)
            summary[su] = F.max_by(e, at)
            carry[ca] = F.lag(su).over(chunks)
            merged[name] = F.when(F.col("_first"), F.col(ca)).otherwise(F.col(lo))
        elif spec.kind == "next":
            local[lo] = F.lead(e).over(up)
            summary[su] = F.min_by(e, at)
            carry[ca] = F.lead(su).over(chunks)
            merged[name] = F.when(F.col("_last"), F.col(ca)).otherwise(F.col(lo))
        elif spec.kind in ("sum", "before"):
            zero = F.lit(0)
            local[lo] = F.sum(e).over(so_far if spec.kind == "sum" else earlier)
            summary[su] = F.sum(e)
            carry[ca] = F.sum(su).over(chunks_before)
            merged[name] = F.coalesce(F.col(ca), zero) + F.coalesce(F.col(lo), zero)
        elif spec.kind == "max":
            local[lo] = F.max(e).over(so_far)
            summary[su] = F.max(e)
            carry[ca] = F.max(su).over(chunks_before)
            merged[name] = F.greatest(F.col(ca), F.col(lo))
        elif spec.kind in ("last", "lastbefore"):
            local[lo] = F.last(e, ignorenulls=True).over(so_far if spec.kind == "last" else earlier)
            summary[su] = F.max_by(e, F.when(e.isNotNull(), at))
            carry[ca] = F.last(su, ignorenulls=True).over(chunks_before)
            merged[name] = F.coalesce(F.col(lo), F.col(ca))
        elif spec.kind == "nextseen":
            local[lo] = F.first(e, ignorenulls=True).over(later)
            summary[su] = F.min_by(e, F.when(e.isNotNull(), at))
            carry[ca] = F.first(su, ignorenulls=True).over(chunks_after)
            merged[name] = F.coalesce(F.col(lo), F.col(ca))
        else:
            raise ValueError(f"unknown scan kind {spec.kind!r}")

    kept = [c for c in df.columns if c not in specs]
    # Rows and summaries both start from this one shuffle. A row travels whole, in
    # an array of one, so no column can be pruned on one side only and both sides
    # keep the same exchange, which Spark then runs once. Callers select what they need.
    others = [c for c in df.columns if c not in by]
    dealt = (df.select(*by, F.array(F.struct(*others)).alias("_row")).repartition(*by)
             .select(*by, F.element_at("_row", 1).alias("_row")).select(*by, "_row.*"))
    rows = dealt.select("*", *[c.alias(n) for n, c in local.items()])
    carries = dealt.groupBy(*by).agg(*[c.alias(n) for n, c in summary.items()])
    carries = carries.select(*by, *[c.alias(n) for n, c in carry.items()])
    return (rows.join(carries, by, "left")
            .select(*kept, *[c.alias(n) for n, c in merged.items()]))
