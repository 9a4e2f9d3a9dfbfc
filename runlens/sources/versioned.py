"""Keyed tables in buckets that are replaced as wholes, by versions.

``<path>/data/<id>/bucket=<b>`` holds a bucket as one write left it. A file below
``<path>/commits`` names for each bucket the write that counts; the highest number
is the table. A write puts new buckets beside the old ones and then adds a commit, so a
job lost at any point leaves the table as it was, nothing that is being read is
overwritten, and a write reads and writes only the buckets that its keys fall into. Of two
writers from one version the second to commit fails and may run again. How many buckets
there are belongs to the table: it bounds what a commit lists, and a bucket is the
least that is rewritten."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, path: str) -> list[str]:
    """The names of all commits, the newest first."""
    fs, at = _fs(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((n for n in names if re.fullmatch(r"\d{12}", n)), reverse=True)


def _newest(spark: SparkSession, path: str) -> dict | None:
    """The newest whole commit; one that its writer did not finish does not count."""
    for name in _commits(spark, path):
        rows = spark.read.text(f"{path}/commits/{name}", wholetext=True).head(1)
        if rows and rows[0].value.endswith("}\n"):
            return json.loads(rows[0].value)
    return None


def _commit(spark: SparkSession, path: str, state: dict, after: list[str]) -> None:
    number = int(after[0]) + 1 if after else 1
    fs, at = _fs(spark, f"{path}/commits/{number:012d}")
    out = fs.create(at, False)  # fails where another writer was first
    try:
        out.write(bytearray((json.dumps(state) + "\n").encode()))
    finally:
        out.close()


def read(spark: SparkSession, path: str, only: Sequence[int] | None = None) -> DataFrame:
    """The table, or the buckets ``only`` of it."""
    state = _newest(spark, path)
    if state is None:
        raise FileNotFoundError(f"no version of a table at {path}")
    schema = StructType.fromJson(state["schema"])
    paths = [f"{path}/data/{by}/bucket={b}" for b, by in state["data"].items() if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(rows: DataFrame, path: str, key: Sequence[str], buckets: int = 64, replace: bool = True) -> None:
    """Adds ``rows``, whose keys are not null. Where the table holds a row's key, the new
    row takes the old one's place, or with ``replace=False`` is left out. Of rows with one
    key in ``rows`` any one is kept. The same rows merged again change nothing."""
    spark = rows.sparkSession
    before = _commits(spark, path)
    state = _newest(spark, path) or {"buckets": buckets, "key": list(key), "schema": json.loads(rows.schema.json()), "data": {}}
    if state["buckets"] != buckets or state["key"] != list(key):
        raise ValueError(f"the table at {path} has {state['buckets']} buckets by {', '.join(state['key'])}")
    schema = StructType.fromJson(state["schema"])
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    new = rows.select(*schema.names).dropDuplicates(list(key)).persist(StorageLevel.DISK_ONLY)
    try:
        touched = [r[0] for r in new.select(bucket).distinct().collect()]  # at most ``buckets``
        if not touched and state["data"]:
            return
        old = read(spark, path, touched) if state["data"] else spark.createDataFrame([], schema)
        over, under = (new, old) if replace else (old, new)
        out = over.unionByName(under.join(over.select(*key), list(key), "left_anti").select(*schema.names))
        name = uuid.uuid4().hex
        out.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{path}/data/{name}")
    finally:
        new.unpersist()
    _commit(spark, path, state | {"data": state["data"] | {str(b): name for b in touched}}, before)


def merged_batches(path: str, key: Sequence[str], buckets: int = 64, replace: bool = False) -> Callable[[DataFrame, int], None]:
    """The same as a ``foreachBatch`` function; a batch that comes again changes nothing."""
    return lambda batch, _id: merge(batch, path, key, buckets, replace)


def clean(spark: SparkSession, path: str) -> int:
    """Deletes the writes that no bucket of the newest version comes from, when no
    reader or writer is at work; how many they were."""
    state = _newest(spark, path)
    fs, at = _fs(spark, f"{path}/data")
    if state is None or not fs.exists(at):
        return 0
    spent = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in state["data"].values()]
    for old in spent:
        fs.delete(old, True)
    return len(spent)
