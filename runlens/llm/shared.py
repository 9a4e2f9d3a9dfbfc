"""Folders that driver and executors share, and small helpers of all operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, the separator of words throughout this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def folder(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, or below the warehouse
    where that is unset; both are shared by all executors. It goes when the
    session's process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/runlens-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a shared folder: computed once, and safe from lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store behind ``path`` as Python tasks see it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_sorting(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts both sides, however small they seem.

    For rows that grow with the corpus and whose size is a guess: a row that is exploded
    counts as one, and a table of files as its files, which may hold many times their size.
    Taken for less than the limit, such rows would be broadcast, through the driver."""
    return df.hint("merge")


def whole(text: Column) -> Column:
    """A text where null counts as empty."""
    return F.coalesce(text, F.lit(""))


def by_batch(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict]], schema: StructType, rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows; ``make`` yields dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in make(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
