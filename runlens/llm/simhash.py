"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runlens.llm import components
from runlens.llm.shared import by_batch, by_sorting, raw_texts, whole, written

WORDS, TOLERANCE, SEGMENTS, SEED = 3, 3, 4, 42
#: Bits of a fingerprint and of a segment.
BITS, WIDTH = 64, 64 // SEGMENTS
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a text: of the XXH64 of each shingle, the bits that over half have set.

    A-Z become lower case; words are separated by ASCII white space. With fewer
    words the whole sequence is the one shingle; without any the fingerprint is zero."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate([len(w) + 1 for w in found]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], ends[words - 1:], strict=False)]
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[at:at + _BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_hash, fp`` (a signed long) for each row; a null text is empty."""
    schema = StructType([StructField(name, LongType()) for name in ("doc_id", "text_hash", "fp")])

    def make(batch):
        yield {"doc_id": batch.column(0), "text_hash": batch.column(1), "fp": [fingerprint(t, words) for t in raw_texts(batch)]}

    body = whole(F.col(text))
    return by_batch(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text")), make, schema)


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND((1 << WIDTH) - 1)


def _chain(i: int, a: str, b: str) -> Column:
    """Whether the chain of segments from ``i`` on, around the ring, keeps each of
    its budgets: the first k segments differ in at most k * TOLERANCE / SEGMENTS bits."""
    total, ok = F.lit(0), F.lit(True)
    for k in range(1, SEGMENTS + 1):
        total = total + F.bit_count(_segment(F.col(a), i + k - 1).bitwiseXOR(_segment(F.col(b), i + k - 1)))
        ok = ok & (total <= k * TOLERANCE // SEGMENTS)
    return ok


def links(prints: DataFrame) -> DataFrame:
    """All pairs ``u < v`` of distinct fingerprints (column fp) that differ in at most TOLERANCE bits.

    Pigeonring principle: if all segments together differ in TOLERANCE bits, some
    chain of consecutive segments stays within its proportional budget at every
    length. So for one start the first segment is equal and the second differs in
    at most one bit: those two make the key of the join, and each fingerprint is
    looked up under the second segment and its one-bit neighbours. Pairs that meet
    must pass the whole chain before the full distance is taken. The sides hold
    4 and 68 rows for each fingerprint, so neither is broadcast."""
    assert TOLERANCE < SEGMENTS and 2 * TOLERANCE // SEGMENTS == 1

    def keys(df: DataFrame, name: str, flips: list[int]) -> DataFrame:
        starts = [F.struct(F.lit(i).alias("i"), F.shiftleft(_segment(F.col("fp"), i), WIDTH).bitwiseOR(_segment(F.col("fp"), i + 1)).alias("key"))
                  for i in range(SEGMENTS)]
        each = df.select(F.col("fp").alias(name), F.inline(F.array(*starts)))
        if len(flips) > 1:
            each = each.select(name, "i", F.explode(F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.col("key").bitwiseXOR(x))).alias("key"))
        return each

    left = by_sorting(keys(prints, "u", [0]))
    right = by_sorting(keys(prints, "v", [0, *[1 << b for b in range(WIDTH)]]))
    chain = F.lit(False)
    for i in range(SEGMENTS):
        chain = chain | ((F.col("left.i") == i) & _chain(i, "u", "v"))
    met = left.alias("left").join(right.alias("right"), (F.col("left.i") == F.col("right.i")) & (F.col("left.key") == F.col("right.key"))
                                  & (F.col("u") < F.col("v")) & chain)
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= TOLERANCE).select("u", "v").distinct()


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, text_hash, fp, component_id``.

    Only distinct fingerprints are joined, so copies make no pairs. A component's
    id is its smallest document id, null if it has none; rows that repeat an id
    each have a row. The last join finds each row's fingerprint; a left join cannot
    broadcast the rows."""
    rows = written(fingerprints(docs, words))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components.roots(links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(linked, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(of_print, "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
