"""Where derived tables go. Every sink can be run again after a lost job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.text import clean_field
from runlens.operators.ledger import ITER_RESULTS
from runlens.operators.metrics import RESULT_COLUMNS


def write_scores(scores: DataFrame, path: str, batches: int = 64) -> None:
    """Score records partitioned by cell batch. The batches that ``scores``
    touches are written anew, from their old records of other cells and the new
    ones; the rest stays as it is. ``batches`` belongs to the table: it sets how
    much is rewritten for one cell, and must not change while the table stands."""
    batch = F.pmod(F.xxhash64("cell_id"), F.lit(batches)).cast("int")
    new = scores.withColumn("batch", batch)
    old = _existing(scores.sparkSession, path, new)
    if old.where((F.col("batch") != batch) | (F.col("batch") >= batches)).limit(1).count():
        raise ValueError(f"the table at {path} was written with another number of batches")
    touched = [r["batch"] for r in new.select("batch").distinct().collect()]  # at most ``batches``
    kept = old.where(F.col("batch").isin(touched)).join(new.select("cell_id"), "cell_id", "left_anti")
    (new.unionByName(kept.select(*new.columns))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))


def write_results(rows: DataFrame, board: DataFrame, csv: str, rows_json: str, board_json: str) -> None:
    """The flat results as CSV with a header and as JSON lines, and the
    scoreboard as JSON lines."""
    flat = rows.select(*RESULT_COLUMNS)
    flat.write.mode("overwrite").option("header", "true").csv(csv)
    flat.write.mode("overwrite").json(rows_json)
    board.write.mode("overwrite").json(board_json)


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(like.schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], like.schema)


def append_once(rows: DataFrame, path: str, key: Sequence[str]) -> None:
    """Append the rows whose key the target does not hold yet, each key once.
    Which of two equal keys is kept does not matter to the caller."""
    fresh = rows.dropDuplicates(list(key))
    have = _existing(rows.sparkSession, path, rows).select(*key)
    fresh.join(have, list(key), "left_anti").select(*rows.columns).write.mode("append").parquet(path)


def append_once_batches(path: str, key: Sequence[str]):
    """The same as a ``foreachBatch`` function: a batch written again after a
    failure adds nothing."""
    return lambda batch, _id: append_once(batch, path, key)


def weekly_batches(path: str):
    """``foreachBatch`` function keeping the newest seven-day reading per
    lane: each batch appends its newest event, and ``fleet.weekly_reading``
    over the table gives the latest."""
    def keep(batch: DataFrame, _id: int) -> None:
        newest = batch.where("kind = 'seven_day'").groupBy("lane").agg(
            F.max_by(F.struct(*[c for c in batch.columns if c != "lane"]), F.struct("mtime", "pos")).alias("r")).select("lane", "r.*")
        append_once(newest.select(*batch.columns), path, ("lane", "mtime", "pos"))
    return keep


def ledger_lines(events: DataFrame) -> DataFrame:
    """Ledger events (ts, event, fields) as lines fit to append: fields are
    sanitised, and an ITER whose result is no result word stops the job."""
    words = ", ".join(ITER_RESULTS)
    bad = (F.col("event") == "ITER") & ~F.coalesce(F.try_element_at("fields", F.lit(1)).isin(*ITER_RESULTS), F.lit(False))
    result = F.when(bad, F.raise_error(F.lit(f"an ITER result must be one of {words}"))).otherwise(F.lit(""))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat_ws("\t", stamp, clean_field(F.col("event")), F.transform("fields", clean_field))
    return events.select(F.concat(line, F.coalesce(result.cast("string"), F.lit(""))).alias("value"))
