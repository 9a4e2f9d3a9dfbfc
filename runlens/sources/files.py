"""Evidence on disk as typed frames. One directory per cell."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, StructField, StructType

from runlens.operators import ranks, surface
from runlens.operators.scan import chunk_of
from runlens.functions.names import shaped
from runlens.operators.traces import second
from runlens.sources import lines

TRACE = ("epoch double, ts_s double, offered_rps long, p90_ms double, p99_ms double, cache_up string, infra_cache_up string, pressure double, "
         "inflight long, pool_size long, pool_waiting long, http_2xx long, http_404 long, http_429 long, http_5xx long, err long, "
         "dropped long, k6_sent long, k6_done long")
TRACE_EVENTS = ("start_epoch double, k6_start_epoch double, decision_epoch double, mount_epoch double, release_epoch double, "
                "saturation_epoch double, ceiling_qps double, sat_p99_ms double, host_sleep_s double")
SCHEDULE = "shape string, seed string, total_s double, events array<struct<kind:string,t0:double,t1:double>>"
POINT = "type string, metric string, data struct<time:string,value:double,tags:map<string,string>>"
RESOURCES = "ts double, plane string, name string, tag string, cpu_pct double, mem_mb double"
HOST_SAMPLES = "ts string, scope string, name string, owner string, role string, cpu_pct double, mem_mb double"
#: Bytes of a trace that make a chunk; a line is some tens of bytes.
TRACE_CHUNK_BYTES = 1 << 22
POINT_METRICS = ("fired", "dropped_iterations", "http_reqs", "http_req_duration")


def _path() -> Column:
    return F.col("_metadata.file_path")


def cell_of(depth: int = 2) -> Column:
    """The cell a file belongs to: the folder ``depth`` levels above its end."""
    return F.element_at(F.split(_path(), "/"), -depth)


def file_order() -> Column:
    """A number that grows along each file, one for each line: where the line's
    block starts, and how many lines its task has read. A task reads no more
    lines than a block has bytes, so blocks do not run into each other."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)


def cells(spark: SparkSession, root: str) -> DataFrame:
    """Every folder that declares a cell under a name that is a cell id, from listing
    alone: no content is read. Which variants there are is the caller's
    (``names.parse_cell_id``)."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "cell.env").option("recursiveFileLookup", "true").load(root)
             .select(F.element_at(F.split("path", "/"), -2).alias("cid"), "modificationTime"))
    return found.where(shaped(F.col("cid")))


def block_lines(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``file, line_no, line`` of text files of any size, one row per line, numbered
    from 1 in each file. Files are read in blocks, in parallel: lines are counted per
    block, the counts before a block are summed, and a line's number is that sum and
    its place in the block. Both start from one shuffle by block, so no file is
    read whole in one task and nothing is sorted across blocks."""
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    by = ["file", "_block"]
    raw = reader.text(root).select(_path().alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.array(F.struct(
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))).alias("_l"))
    dealt = raw.repartition(*by).select(*by, F.element_at("_l", 1).alias("_l")).select(*by, "_l.*")
    rows = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("at")))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    starts = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return rows.join(starts, by).select("file", (F.col("_start") + F.col("_nth")).alias("line_no"), "line")


def _part(depth: int) -> Column:
    """A part of a line's path, counted from its end."""
    return F.element_at(F.split("file", "/"), -depth)


def _whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(root, wholetext=True)
            .select(cell_of().alias("cell"), F.element_at(F.split(_path(), "/"), -1).alias("file"), F.col("value").alias("text")))


def env(spark: SparkSession, root: str) -> DataFrame:
    return lines.env_map(lines.numbered(_whole(spark, root, "cell.env"), "text", "cell"), "cell")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Ledger events per cell, with the chunk that the folds work in."""
    rows = block_lines(spark, root, "iterations.log").withColumn("cell", _part(2))
    return lines.ledger_lines(rows, "cell").withColumn("chunk", chunk_of("line_no"))


def transcripts(spark: SparkSession, root: str) -> DataFrame:
    """Transcript lines per cell and attempt, numbered in file order."""
    rows = block_lines(spark, root, "agent.attempt-*.log")
    return rows.select(_part(2).alias("cell"), F.regexp_extract(_part(1), r"attempt-(\d+)", 1).try_cast("long").alias("attempt"), "line_no", "line")


def transitions(spark: SparkSession, path: str) -> DataFrame:
    """Lifecycle logs of any size, ready for the replay: ``log`` is the file, ``line_no``
    the line in it, ``seq`` the place by log, time and line (writers append out of
    order, so time decides and lines break its ties), ``chunk`` a run of such places."""
    rows = block_lines(spark, path)
    kept = lines.transitions(rows, "file").withColumnRenamed("file", "log")
    return ranks.positions(kept, ["log", "ts", "line_no"], "seq").withColumn("chunk", chunk_of("seq"))


def _artifacts(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """Where paths run through an ignored folder the scan's list of files leaves them out."""
    parts = "|".join(re.escape(p) for p in surface.IGNORE_PARTS)
    return (spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(f"{root}/*/artifacts")
            .where(~F.col("_metadata.file_path").rlike(f"/artifacts/(.*/)?({parts})/")))


def _artifact_columns() -> list[Column]:
    return [F.regexp_extract("path", r"/([^/]+)/artifacts/", 1).alias("cell"), F.regexp_extract("path", r"/artifacts/(.*)$", 1).alias("rel"),
            F.col("modificationTime").alias("mtime"), F.col("length").alias("size")]


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Files below each cell's ``artifacts`` folder with their content, ignored folders left unread."""
    return _artifacts(spark, root).select(*_artifact_columns(), "content")


def artifact_signatures(spark: SparkSession, root: str) -> DataFrame:
    """``cell, rel, mtime, size, path`` of the files whose path counts. No content is
    read; a file that goes meanwhile has no row."""
    found = _artifacts(spark, root, ignoreMissingFiles="true").select(*_artifact_columns(), "path")
    return found.where(surface.path_counts(F.col("rel")))


def contents(named: DataFrame) -> DataFrame:
    """``named`` (with ``path``) and the content of just these files, read where their
    rows are, one at a time. Files that are gone give no row."""
    schema = StructType([*named.schema.fields, StructField("content", BinaryType())])
    arrow = to_arrow_schema(schema)
    at = named.columns.index("path")

    def read(batches):
        stores = {}
        for batch in batches:
            for i in range(batch.num_rows):
                url = re.match(r"(?:(\w[\w+.-]*):)?(?://([^/]*))?(/.*)$", batch.column(at)[i].as_py(), re.DOTALL)
                scheme, host, path = url[1] or "file", url[2] or "", url[3]
                if (scheme, host) not in stores:
                    stores[scheme, host] = fs.FileSystem.from_uri(f"{scheme}://{host}/")
                store, base = stores[scheme, host]
                try:
                    with store.open_input_stream(base.rstrip("/") + path) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                row = batch.slice(i, 1).columns
                yield pa.RecordBatch.from_arrays([*row, pa.array([content], pa.binary())], schema=arrow)

    return named.mapInArrow(read, schema)


def refreshed_surface(spark: SparkSession, root: str, cached: DataFrame) -> DataFrame:
    """``surface.refreshed`` over the files below ``root``; what it gives is the next run's ``cached``."""
    return surface.refreshed(artifact_signatures(spark, root), cached, contents)


def manifests(spark: SparkSession, root: str, name: str = "skeleton_manifest") -> DataFrame:
    """Seeded files per cell. Spark lists no hidden files, so whoever collects
    the evidence stores a dotted manifest under a visible ``name``."""
    return lines.manifest(lines.numbered(_whole(spark, root, name), "text", "cell"), "cell")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    return _whole(spark, root, "metrics.json").select("cell", F.col("text").alias("doc"))


def archive(spark: SparkSession, root: str) -> DataFrame:
    """Archived runs by their verdict file: cell, folder name, verdict."""
    v = (spark.read.option("pathGlobFilter", "verdict.json").option("recursiveFileLookup", "true")
         .text(f"{root}/*/arrangements", wholetext=True))
    parts = F.split(_path(), "/")
    doc = F.from_json("value", "ok boolean, charge boolean, stage string, started string, ended string")
    return v.select(F.element_at(parts, -4).alias("cell"), F.element_at(parts, -2).alias("name"), doc.alias("d")).select("cell", "name", "d.*")


def trace(spark: SparkSession, csv: str, events: DataFrame) -> DataFrame:
    """Trace ticks on the schedule's clock. ``events`` has run and
    k6_start_epoch; a run is the folder of its trace."""
    t = spark.read.schema(TRACE).option("header", "true").option("enforceSchema", "false").csv(csv)
    t = t.select(F.element_at(F.split(_path(), "/"), -2).alias("run"), file_order().alias("seq"), *[c for c in t.columns])
    j = t.join(events.select("run", "k6_start_epoch"), "run", "left")
    return j.select("run", "seq", chunk_of("seq", TRACE_CHUNK_BYTES).alias("chunk"), second(F.col("epoch"), F.col("k6_start_epoch"), F.col("ts_s")).alias("ts"), F.coalesce("p99_ms", F.lit(0.0)).alias("p99"),
                    F.coalesce(F.trim("infra_cache_up") == "True", F.lit(False)).alias("up"), F.col("k6_sent").alias("sent"), F.col("k6_done").alias("done"),
                    "offered_rps")


def points(reader, path: str) -> DataFrame:
    """Generator points, batch (``spark.read``) or live (``spark.readStream``);
    a run is the folder of its points."""
    p = reader.schema(POINT).json(path).where((F.col("type") == "Point") & F.col("metric").isin(*POINT_METRICS))
    return p.select(F.element_at(F.split(_path(), "/"), -2).alias("run"), "metric", F.to_timestamp("data.time").alias("time"), F.col("data.value").alias("value"), F.col("data.tags")["status"].alias("status"))


def resource_samples(spark: SparkSession, csv: str) -> DataFrame:
    return spark.read.schema(RESOURCES).option("header", "true").csv(csv)


def host_samples(spark: SparkSession, csv: str) -> DataFrame:
    """Host samples; an empty figure is null, an empty owner stays empty."""
    s = spark.read.schema(HOST_SAMPLES).option("header", "true").csv(csv)
    return s.fillna("", ["owner", "role"])


def host_busy(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("epoch double, busy double").option("mode", "DROPMALFORMED").csv(path)
            .where("epoch IS NOT NULL AND busy IS NOT NULL"))
