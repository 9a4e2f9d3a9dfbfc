"""As-of joins as one ordered scan over both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import scan as S
from runlens.operators.intervals import bucket


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str,
         values: Sequence[str], width: float, forward: bool = False, strict: bool = False,
         tie: str | None = None) -> DataFrame:
    """Every row of ``left`` with ``values`` of the nearest ``right`` row of
    the same keys: the latest at or before it, or the earliest at or after it
    with ``forward``. ``strict`` leaves out an equal time; ``tie`` orders right
    rows of one time. ``width`` seconds of both sides make one chunk."""
    keys = list(keys)
    left_first = strict != forward
    payload = F.struct(*[F.col(v) for v in values])
    row = F.struct(*[F.col(c) for c in left.columns])
    order = F.lit(0).cast("long") if tie is None else F.col(tie).cast("long")
    shape = lambda df, at, kind, tie_col, l, r: df.select(
        *keys, F.col(at).cast("double").alias("_t"), F.lit(kind).alias("_k"), tie_col.alias("_tie"), l.alias("_row"), r.alias("_hit"))
    lefts = shape(left, left_at, 0 if left_first else 1, F.lit(0).cast("long"), row, F.lit(None).cast(_type(right, payload)))
    rights = shape(right, right_at, 1 if left_first else 0, order, F.lit(None).cast(_type(left, row)), payload)
    both = lefts.unionByName(rights).withColumn("chunk", bucket(F.col("_t"), width))
    spec = S.next_seen(F.col("_hit")) if forward else S.last_before(F.col("_hit"))
    out = S.scan(both, keys, ["_t", "_k", "_tie"], {"_near": spec})
    return out.where("_row IS NOT NULL").select("_row.*", *[F.col(f"_near.{v}").alias(v) for v in values])


def _type(df: DataFrame, expr):
    return df.select(expr.alias("x")).schema["x"].dataType
