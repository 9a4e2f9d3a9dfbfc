"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from runlens.llm.shared import by_batch, raw_texts, written
from runlens.llm.tokens import encoder

#: Length classes of the fit, and documents in a pattern at most.
CLASSES, PATTERN_DOCS = 64, 4
FIT_STEPS = 400
#: Pieces that one window group ranks, about.
BUCKET_ROWS = 50_000

_PIECE = StructType([StructField("doc_id", LongType()), StructField("piece", IntegerType()), StructField("start", LongType()),
                     StructField("length", LongType()), StructField("ids_crc32", LongType())])


def pieces(docs: DataFrame, tokenizer: str, room: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of at most ``room`` ids: ``doc_id, piece, start,
    length, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32-bit).

    Each document is its ids and then ``end_id``; only documents longer than
    ``room`` are cut. Null texts are empty, and rows that repeat an id are
    documents of their own."""
    end = struct.pack("<I", end_id)

    def make(batch):
        out: dict[str, list] = {f.name: [] for f in schema.fields}
        for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).ids(raw_texts(batch)), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * room)):
                part = ids[at:at + 4 * room]
                row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)
                for column, value in zip(out.values(), row, strict=False):
                    column.append(value)
        yield out

    schema = StructType([*_PIECE.fields, StructField("ids", BinaryType())] if keep_ids else _PIECE.fields)
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), make, schema)


def patterns(total: int, most: int) -> list[tuple[int, ...]]:
    """All ways to write ``total`` as at most ``most`` positive numbers, largest first."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, top: int, so_far: tuple[int, ...]) -> None:
        if not left:
            out.append(so_far)
        elif len(so_far) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(so_far)) < left:
                    break
                grow(left - x, x, (*so_far, x))

    grow(total, total, ())
    return out


def fit(histogram: np.ndarray, ways: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts of ``ways``, not negative, whose class counts come closest to
    ``histogram`` by least squares: accelerated projected gradient."""
    a = np.zeros((len(histogram), len(ways)))
    for j, way in enumerate(ways):
        for c, n in Counter(way).items():
            a[c - 1, j] = n
    scale = max(1.0, float(histogram.max()))
    h = histogram / scale
    step = 1 / np.linalg.norm(a @ a.T, 2)
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(0, y - step * (a.T @ (a @ y - h)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x * scale


Pattern = tuple[tuple[int, int], ...]  # (length, times), in the order of their places


def _take(left: np.ndarray, room: int, way: tuple[int, ...], times: int, width: int, bins: list[tuple[Counter, int, int]]) -> None:
    """Fills up to ``times`` sequences by one class pattern with lengths that are
    left: the longest of each class first, the best fit last."""
    while times > 0:
        used: Counter = Counter()
        space = room
        for k, c in enumerate(way):
            low, high = (c - 1) * width, min(c * width, space) if k < len(way) - 1 else space
            window = left[low + 1:high + 1].copy()
            for x, n in used.items():
                if low < x <= high:
                    window[x - low - 1] -= n
            found = np.flatnonzero(window > 0)
            if not len(found):
                return
            x = low + 1 + int(found[-1])
            used[x] += 1
            space -= x
        n = min(times, *(int(left[x]) // k for x, k in used.items()))
        for x, k in used.items():
            left[x] -= n * k
        bins.append((used, n, space))
        times -= n


def plan(histogram: np.ndarray, room: int) -> list[tuple[Pattern, int]]:
    """How to fill sequences of ``room``: patterns of exact lengths and how often
    each repeats, from ``histogram[length]`` alone.

    The fit is made on ``CLASSES`` classes of lengths; its rounded counts are
    filled with exact lengths. What is left is packed longest first into the
    fullest sequence with space. The work depends on ``room``, not on how many
    documents there are."""
    left = histogram.astype(np.int64).copy()
    width = -(-room // CLASSES)
    bins: list[tuple[Counter, int, int]] = []
    if left.sum():
        ways = patterns(room // width, PATTERN_DOCS)
        classes = np.array([left[c * width + 1:(c + 1) * width + 1].sum() for c in range(room // width)], dtype=float)
        counts = np.floor(fit(classes, ways)).astype(np.int64)
        for j in sorted(np.flatnonzero(counts), key=lambda j: ways[j], reverse=True):
            _take(left, room, ways[j], int(counts[j]), width, bins)
    by_space: dict[int, list[tuple[Counter, int]]] = {}
    spaces: list[int] = []

    def put(used: Counter, n: int, space: int) -> None:
        if space not in by_space:
            by_space[space] = []
            insort(spaces, space)
        by_space[space].append((used, n))

    for used, n, space in bins:
        put(used, n, space)
    for x in range(room, 0, -1):
        n = int(left[x])
        while n:
            at = bisect_left(spaces, x)
            if at == len(spaces):
                fits = room // x
                for k, m in ((fits, n // fits), (n % fits, 1)):
                    if k and m:
                        put(Counter({x: k}), m, room - k * x)
                n = 0
                continue
            space = spaces[at]
            used, m = by_space[space].pop()
            if not by_space[space]:
                del by_space[space], spaces[at]
            k = min(space // x, n)
            done = min(m, n // k)
            if done < m:
                put(used, m - done, space)
            put(used + Counter({x: k}), done, space - k * x)
            n -= done * k
    merged: Counter = Counter()
    for groups in by_space.values():
        for used, n in groups:
            merged[tuple(sorted(used.items(), reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def _slots(planned: list[tuple[Pattern, int]], room: int) -> dict[str, np.ndarray]:
    """For each pattern and length in it: the first rank (of the pieces of that
    length) that goes there, how many go into one sequence, the number of the
    first sequence, and the place of the first piece."""
    next_rank = np.zeros(room + 1, dtype=np.int64)
    rows, sequence = [], 0
    for pattern, repeats in planned:
        offset = 0
        for x, times in pattern:
            rows.append((x, next_rank[x], times, sequence, offset))
            next_rank[x] += times * repeats
            offset += x * times
        sequence += repeats
    table = np.array(rows or [(0, 0, 1, 0, 0)], dtype=np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "first", "times", "sequence", "offset"), table.T, strict=True))


def pack(parts: DataFrame, room: int) -> DataFrame:
    """``parts`` (with ``doc_id, piece, length, ids_crc32``; read more than once,
    so a written table) and, for each, ``sequence_id`` and ``offset``.

    Pieces of one length are ranked in buckets of a hash, with a sum of counts
    before each, so a length that a third of all pieces share is no single task;
    rank and length then tell the place. Only the histogram (at most ``room``
    counts) comes to the driver, and the table of slots that goes out depends on
    ``room`` alone."""
    counted = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    histogram = np.zeros(room + 1, dtype=np.int64)
    for row in counted:
        histogram[row["length"]] = row["n"]
    slots = _slots(plan(histogram, room), room)
    buckets = max(1, int(histogram.sum()) // BUCKET_ROWS)
    mixed = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("_length").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = (mixed.groupBy(F.col("length").alias("_length"), F.col("_bucket").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
              .select("_length", "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (mixed.withColumn("_nth", F.row_number().over(within))
              .join(starts, (F.col("length") == F.col("_length")) & (F.col("_bucket") == F.col("_at")))
              .select(*parts.columns, (F.col("_before") + F.col("_nth") - 1).alias("_rank")))
    keys = slots["length"] * (1 << 40) + slots["first"]

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(keys, length * (1 << 40) + rank, side="right") - 1
            nth, times = rank - slots["first"][at], slots["times"][at]
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "_rank"]
            columns += [pa.array(slots["sequence"][at] + nth // times), pa.array(slots["offset"][at] + nth % times * length)]
            yield pa.RecordBatch.from_arrays(columns, [*(n for n in batch.schema.names if n != "_rank"), "sequence_id", "offset"])

    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer: str, room: int, end_id: int) -> DataFrame:
    """Documents cut into pieces and packed."""
    return pack(written(pieces(docs, tokenizer, room, end_id)), room)
