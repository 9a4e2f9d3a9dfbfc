"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.shared import whole, written

#: Rows that one window group orders, about.
BUCKET_ROWS = 50_000


def _hex_bits(rows: int) -> int:
    """Hex digits of the shuffle key that make buckets of about ``BUCKET_ROWS`` rows."""
    digits = 0
    while rows > BUCKET_ROWS << (4 * digits):
        digits += 1
    return digits


def assign(docs: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, source, size, text_crc32, rank, fraction, shard, slot``.

    Rows are shuffled by a seeded hash of the id and ranked within their
    source; sorted by (rank - 1/2) / rows of the source, all sources are spread
    evenly, and equal cuts give each shard the mixture. Shards differ by one row
    at most. Null sources are a source of their own, null texts are empty, and
    rows that repeat an id each get a place. A source of any size is ranked in
    buckets of its shuffle key, and a bucket's offset is a sum of counts, so no
    source and no shard is sorted in one task."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    body = whole(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("key"),
                       (F.octet_length(body) + F.lit(16)).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    total = docs.count()
    digits = _hex_bits(total)
    rows = rows.withColumn("bucket", F.substring("key", 1, digits) if digits else F.lit(""))
    counts = rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("source")
    before = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce(before, F.lit(0)).alias("before"),
                            F.sum("n").over(group).alias("of_source"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_crc32")
    ranked = (rows.withColumn("nth", F.row_number().over(within))
              .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in")))
              .withColumn("rank", F.col("before") + F.col("nth"))
              .withColumn("fraction", (F.col("rank") - 0.5) / F.col("of_source")))
    ranked = written(ranked.select("doc_id", "source", "key", "size", "text_crc32", "rank", "fraction"))
    parts = max(1, total // BUCKET_ROWS)
    ranked = ranked.withColumn("part", F.floor(F.col("fraction") * parts))
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    starts = (ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .select(F.col("part").alias("at"), F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("start")))
    place = Window.partitionBy("part").orderBy("fraction", "source", "key", "doc_id", "size", "text_crc32")
    placed = (ranked.withColumn("nth", F.row_number().over(place)).join(starts, F.col("part") == F.col("at"))
              .withColumn("pos", F.col("start") + F.col("nth") - 1)
              .withColumn("shard", F.expr(f"cast(pos * {shards} div {max(total, 1)} as int)")))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "rank", "fraction", "shard", (F.col("pos") - first).alias("slot"))
