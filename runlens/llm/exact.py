"""Exact dedup: groups of equal texts by 128-bit hash, bytes compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.shared import SPACE, whole


def normal(text: Column) -> Column:
    """A text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(whole(text), SPACE, " ")


def _groups(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each distinct text: its hashes, smallest id and row count.

    Grouping takes the 128-bit hash first and then the bytes themselves, so a
    collision makes two groups. Copies in one task fold before the shuffle.
    ``sha`` tells colliding texts apart later on; should both hashes collide,
    the job stops instead of merging texts that differ."""
    text_rows = docs.select(F.col(doc_id).alias("id"), normal(F.col(text)).alias("norm"))
    by_bytes = (text_rows.groupBy(F.unhex(F.md5("norm")).alias("hash"), "norm")
                .agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size")))
    light = by_bytes.select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "size")
    unique = light.groupBy("hash", "sha").agg(F.min("keep").alias("keep"), F.max("size").alias("size"), F.count(F.lit(1)).alias("texts"))
    safe = F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long"))
    return unique.select("hash", "sha", "keep", safe.alias("size"))


def label(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null texts are empty and equal each other. Of equal texts the smallest id
    stays; a null id stays only where all ids of the group are null. Rows that
    repeat both id and text are counted, and one of them stays. Other columns
    of ``docs`` are not read."""
    norm = normal(F.col(text))
    rows = docs.select(F.col(doc_id).alias("id"), F.unhex(F.md5(norm)).alias("hash"), F.unhex(F.sha2(norm, 256)).alias("sha"))
    same = rows.groupBy("hash", "sha", "id").agg(F.count(F.lit(1)).alias("rows"))
    joined = same.join(_groups(docs, doc_id, text), ["hash", "sha"])
    each = joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
                       (F.col("id").eqNullSafe(F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def unique(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, whole, one for each distinct text, in the columns of ``docs``.

    The groups are made with their first row in one aggregate, so the texts are
    shuffled once; of rows that tie on the id, any one stays."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    cells = docs.select(row.alias("row"), F.col(doc_id).alias("id"), normal(F.col(text)).alias("norm"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    firsts = cells.groupBy(F.unhex(F.md5("norm")).alias("hash"), "norm").agg(F.min_by("row", order).alias("row"))
    return firsts.select("row.*")
