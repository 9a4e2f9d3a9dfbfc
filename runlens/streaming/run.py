"""Running a stream to the end of its input and reading what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import shared_folder

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far past the last event a bounded input is closed: beyond every delay and every key's memory.
CLOSING_S = 400 * 86400


def read_table(spark: SparkSession, folder: str, name: str, per_trigger: int | None = 1) -> DataFrame:
    """One parquet table of a folder, a file or a folder of files, as a stream;
    ``per_trigger`` files at a time, or all that are there."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


class Bounded:
    """A table as a stream with an end. After its last file ``close`` adds a row that is
    null but for the column ``time``, which lies far ahead: it moves the watermark past
    everything that still waits, so nothing of the table's tail is left untold. Its own
    key is null and its own time is never passed. The table is one batch of any number
    of files, so no row of it is late."""

    def __init__(self, table: DataFrame, stream: DataFrame, time: str) -> None:
        spark = table.sparkSession
        self.table, self.time, self.folder = table, time, f"{shared_folder(spark)}/closing"
        target = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
        self.frame = stream.unionByName(spark.readStream.schema(stream.schema).parquet(self.folder))

    def close(self) -> None:
        last = self.table.agg((F.max(self.time).cast("timestamp") + F.expr(f"INTERVAL {CLOSING_S} SECONDS")).alias("at"))
        kind = self.table.schema[self.time].dataType
        row = last.select(*[(F.col("at") if f.name == self.time else F.lit(None)).cast(kind if f.name == self.time else f.dataType).alias(f.name)
                            for f in self.table.schema.fields])
        row.where(F.col(self.time).isNotNull()).write.mode("append").parquet(self.folder)


def bounded(spark: SparkSession, folder: str, name: str, time: str) -> Bounded:
    return Bounded(spark.read.parquet(f"{folder}/{name}.parquet"), read_table(spark, folder, name, None), time)


def to_end(stream: DataFrame, mode: str = "append", source: Bounded | None = None) -> DataFrame:
    """Run a stream over what is there and return what it emitted, as a table
    on disk. Update and complete modes write each batch with its number. With
    ``source``, the input is closed then and what waited is told too."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    out = f"{folder}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def once() -> None:
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        query = writer.format("parquet").outputMode("append").start(out) if mode == "append" else writer.outputMode(mode).foreachBatch(keep).start()
        query.awaitTermination()

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        once()
        if source is not None:
            source.close()
            once()
    finally:
        spark.conf.set(_STORE, before)
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    return spark.read.option("basePath", out).parquet(out)
