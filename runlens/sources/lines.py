"""Line-oriented evidence: whole files to numbered lines and typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per line of ``text`` with its 1-based number."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\r\n|\n|\r")).alias("_i", "line")).select(
        *keys, (F.col("_i") + 1).cast("long").alias("line_no"), "line")


def ledger_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """``<ts> TAB <EVENT> TAB <fields...>`` lines as events; comments and short
    lines are dropped."""
    f = F.split("line", "\t")
    kept = lines.where(~F.startswith(F.col("line"), F.lit("#")) & (F.size(f) >= 3))
    return kept.select(*keys, "line_no", f[0].alias("stamp"), F.to_timestamp(
        F.try_to_timestamp(f[0], F.lit("yyyy-MM-dd'T'HH:mm:ssX"))).alias("ts"), f[1].alias("event"),
        F.slice(f, F.lit(3), F.size(f)).alias("fields"))


def json_lines(lines: DataFrame) -> DataFrame:
    """The lines that are JSON objects, as variants."""
    doc = F.when(F.startswith(F.col("line"), F.lit("{")), F.try_parse_json("line"))
    return lines.select(*[c for c in lines.columns if c != "line"], "line", doc.alias("doc")).where("doc IS NOT NULL")


def env_map(lines: DataFrame, key: str) -> DataFrame:
    """``KEY=VALUE`` lines of each ``key`` as (key, name, value); the last line
    of a name wins."""
    at = F.locate("=", F.col("line"))
    rows = lines.where(at > 1).select(key, "line_no", F.trim(F.substring(F.col("line"), F.lit(1), at - 1)).alias("name"),
                                      F.substr(F.col("line"), at + 1).alias("value"))
    return rows.groupBy(key, "name").agg(F.max_by("value", "line_no").alias("value"))


def manifest(lines: DataFrame, *keys: str) -> DataFrame:
    """``rel TAB lines TAB sha`` rows; any other line is left out."""
    f = F.split("line", "\t")
    return lines.where(F.size(f) == 3).select(*keys, "line_no", f[0].alias("rel"),
                                              f[1].try_cast("long").alias("lines"), f[2].alias("sha"))


def transitions(lines: DataFrame, *keys: str) -> DataFrame:
    """``<ts> TAB <ACTION> TAB <cid> [TAB k=v ...]`` lines."""
    f = F.split("line", "\t")
    kept = lines.where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")) & (F.size(f) >= 3))
    return kept.select(*keys, "line_no", f[0].alias("ts"), f[1].alias("action"), f[2].alias("cid"),
                       F.coalesce(F.try_element_at(f, F.lit(4)), F.lit("")).alias("note"))


def busy(lines: DataFrame, *keys: str) -> DataFrame:
    """``epoch,busy`` lines; a torn line is skipped."""
    f = F.split("line", ",")
    rows = lines.where(F.size(f) == 2).select(*keys, "line_no", F.trim(f[0]).try_cast("double").alias("epoch"),
                                              F.trim(f[1]).try_cast("double").alias("busy"))
    return rows.where("epoch IS NOT NULL AND busy IS NOT NULL")
