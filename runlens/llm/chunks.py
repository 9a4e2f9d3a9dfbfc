"""Documents as chunks with a dictionary each, so that what is known of a word
anywhere in the corpus can be brought to every text that holds it.

A chunk is about ``CHUNK_BYTES`` of whole texts. Its dictionary is dealt out over
buckets by a hash of the word; one bucket's part is one row. A bucket meets the
same words of all chunks in one place, gives each a value, and the values go back
to the chunk. A word takes part once per chunk, not once per document or
occurrence, so a word that stands in every text is no hot key."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from runlens.llm.shared import raw_texts

CHUNK_BYTES = 8 << 20
#: Rows of a chunk: the body has bucket BODY; a bucket's dictionary, in the joins by bucket, has chunk DICTIONARY.
BODY = DICTIONARY = -1
ROW = StructType([StructField("chunk", LongType()), StructField("bucket", IntegerType()), StructField("payload", BinaryType())])
_ARROW = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])


def buckets(df: DataFrame) -> int:
    """Some per shuffle partition, which are set for the size of the corpus."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _planes(a: np.ndarray) -> tuple[str, bytes]:
    """An array of numbers, the first bytes of all together and so on: it compresses better."""
    return a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def dump(value: dict) -> bytes:
    """A small dict of arrays and lists of bytes, compressed; for rows between tasks of one job."""
    plain = {}
    for k, v in value.items():
        if isinstance(v, np.ndarray):
            plain[k] = _planes(v)
        elif isinstance(v, list):
            plain[k] = [_planes(np.array([len(x) for x in v], dtype="<u4")), b"".join(v)]
        else:
            plain[k] = v
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(plain))


def load(payload: bytes) -> dict:
    def array(kind: str, data: bytes) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)

    out = {}
    for k, v in pickle.loads(zstandard.ZstdDecompressor().decompress(payload)).items():
        if isinstance(v, tuple):
            out[k] = array(*v)
        elif isinstance(v, list):
            ends = np.cumsum(array(*v[0]), dtype=np.int64).tolist()
            out[k] = [v[1][a:b] for a, b in zip([0, *ends], ends, strict=False)]
        else:
            out[k] = v
    return out


def deal(words: list[bytes], most: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The dictionary's order by bucket, and each bucket's part of it."""
    of = np.array([xxhash.xxh64_intdigest(w) % most for w in words], dtype=np.int64)
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return order, [(int(of[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def store(docs: DataFrame, make: Callable[[list, list[bytes]], tuple[dict, list[bytes], dict[str, np.ndarray]]]) -> DataFrame:
    """Rows of all chunks of ``docs`` (columns doc_id, text). ``make(ids, texts)``
    gives a chunk's body, its dictionary, and arrays beside the dictionary; the
    body's ``order`` is added here. To be written, not computed twice: a chunk's
    number comes from the task that made it."""
    most = buckets(docs)

    def run(batches):
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def chunk() -> Iterator[pa.RecordBatch]:
            body, words, beside = make(ids, texts)
            order, parts = deal(words, most)
            body["order"] = order.astype("<u4")
            rows = [(BODY, dump(body))]
            rows += [(b, dump({"words": [words[i] for i in part], **{k: v[part] for k, v in beside.items()}})) for b, part in parts]
            yield pa.RecordBatch.from_arrays([pa.array([base + made] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()),
                                              pa.array([p for _, p in rows], pa.binary())], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                ids.append(doc)
                texts.append(text)
                held += len(text) + 16
                if held >= CHUNK_BYTES:
                    yield from chunk()
                    made, held, ids, texts = made + 1, 0, [], []
        if ids:
            yield from chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROW)


def _groups(batches, key: int) -> Iterator[tuple[int, Iterator[tuple[int, int, bytes]]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=itemgetter(key))


def by_bucket(rows: DataFrame, make: Callable[[Iterator[tuple[int, int, bytes]]], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """``make`` over the rows of each bucket, by ascending chunk: a dictionary comes first.
    It gets them one after another and holds what it keeps of the words, not the rows."""
    def run(batches):
        for _, group in _groups(batches, 1):
            for row in make(group):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW, strict=True)], schema=_ARROW)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, ROW)


def by_chunk(bodies: DataFrame, values: DataFrame, make: Callable[[int, dict, list[dict]], Iterator[dict]], schema: StructType) -> DataFrame:
    """``make(chunk, body, values)`` over each chunk, the values of its buckets in
    the order of the dictionary. ``make`` yields columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for chunk, group in _groups(batches, 0):
            body = load(next(group)[2])
            for out in make(chunk, body, [load(row[2]) for row in group]):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return bodies.union(values).repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, schema)


def in_order(body: dict, values: list[dict], name: str) -> np.ndarray:
    """What the buckets gave, by the chunk's own numbers of its words."""
    dealt = np.concatenate([v[name] for v in values]) if values else np.zeros(0)
    out = np.empty(len(dealt), dtype=dealt.dtype)
    out[body["order"]] = dealt
    return out
