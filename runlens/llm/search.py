"""Ranked lexical search by pipelined term partitioning.

The terms of the corpus are dealt out over owners, and each owner holds the postings
of its terms. Items travel in bundles: for each block of documents (a chunk) a bundle
has one row with sparse accumulators, the scores so far of the documents that hold a
term of an item. The row visits one owner after another, rare terms first, meets that
owner's postings for its chunk in a cogroup, adds their contributions, and is passed
on; after the last owner each item's best documents of the chunk are told. All scores
are whole numbers, so the order of owners does not matter."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from runlens.llm import chunks
from runlens.llm.shared import folder, raw_texts, whole, written

#: Owners that a bundle visits, and items of a bundle.
OWNERS, BUNDLE = 3, 256
#: Documents of a chunk at most; their numbers fit two bytes.
CHUNK_DOCS = 1 << 14
TOP = 10

#: Digits and ASCII letters, these in lower case, bytes of other characters as they are, all else blank.
TABLE = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else 0x20 for c in range(256))

_STORED = StructType([StructField("chunk", LongType()), StructField("bucket", IntegerType()), StructField("payload", BinaryType()),
                      StructField("docs", LongType()), StructField("terms", LongType())])
_POSTINGS = StructType([StructField("chunk", LongType()), StructField("term", LongType()), StructField("docs", LongType()),
                        StructField("payload", BinaryType())])
_STATE = StructType([StructField("bundle", IntegerType()), StructField("chunk", LongType()), StructField("payload", BinaryType())])
_BEST = StructType([StructField("no", LongType()), StructField("doc_id", LongType()), StructField("score", LongType())])
_WORD = StructType([StructField("no", LongType()), StructField("word", StringType())])


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _nothing() -> dict[str, np.ndarray]:
    """The accumulators of a bundle that has seen no owner yet."""
    return {"no": np.zeros(0, "<i8"), "size": np.zeros(0, "<u4"), "doc": np.zeros(0, "<u2"), "score": np.zeros(0, "<i8")}


def index(docs: DataFrame) -> DataFrame:
    """Documents in chunks: a body row with ids and lengths, and a row of words with
    their postings for each bucket of words. To be written, not computed twice: a
    chunk's number comes from the task that made it."""
    most, schema = chunks.buckets(docs), _arrow(_STORED)

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, 0
        texts: list[tuple[int | None, bytes]] = []

        def chunk() -> Iterator[pa.RecordBatch]:
            texts.sort(key=lambda x: (x[0] is None, x[0] or 0))
            number: dict[bytes, int] = {}
            word, times, lengths, sizes = [], [], [], []
            for _, text in texts:
                found = Counter(terms(text))
                lengths.append(found.total())
                sizes.append(len(found))
                word += [number.setdefault(w, len(number)) for w in found]
                times += found.values()
            doc = np.repeat(np.arange(len(texts)), sizes)
            word, times = np.array(word, dtype=np.int64), np.array(times, dtype=np.int64)
            by_word = np.argsort(word, kind="stable")
            doc, times = doc[by_word], times[by_word]
            starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(number)))])
            words = list(number)
            yield row(chunks.BODY, {"doc_id": np.array([i or 0 for i, _ in texts], dtype="<i8"), "null": np.array([i is None for i, _ in texts], dtype="u1"),
                                    "length": np.array(lengths, dtype="<i8"), **_nothing()}, sum(n > 0 for n in lengths), sum(lengths))
            for bucket, part in chunks.deal(words, most)[1] if words else []:
                size = starts[part + 1] - starts[part]
                at = np.repeat(starts[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
                yield row(bucket, {"words": [words[i] for i in part], "size": size.astype("<u4"), "doc": doc[at].astype("<u2"), "times": times[at].astype("<u4")})

        def row(bucket: int, payload: dict, n: int = 0, total: int = 0) -> pa.RecordBatch:
            cells = (base + made, bucket, chunks.dump(payload), n, total)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                texts.append((doc, text))
                held += len(text) + 16
                if held >= chunks.CHUNK_BYTES or len(texts) == CHUNK_DOCS:
                    yield from chunk()
                    made, held, texts = made + 1, 0, []
        if texts:
            yield from chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(run, _STORED)


def _words(items: DataFrame) -> DataFrame:
    """``no, word``: each item's distinct terms."""
    schema = _arrow(_WORD)

    def run(batches):
        for batch in batches:
            for no, text in zip(batch.column(0).to_pylist(), raw_texts(batch), strict=True):
                found = sorted(set(terms(text)))
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(found), pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], schema=schema)

    return items.select("no", whole(F.col("text")).alias("text")).mapInArrow(run, _WORD)


def _postings(stored: DataFrame, vocabulary: DataFrame, most: int) -> DataFrame:
    """``chunk, term, docs, payload`` for the terms (columns term, word) that items ask
    for: in each bucket the asked words come first, then the chunks' parts one by one."""
    schema, put = _arrow(_POSTINGS), _arrow(_STORED)

    def dealt(batches):
        for batch in batches:
            for no, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = word.encode()
                cells = (chunks.DICTIONARY, xxhash.xxh64_intdigest(raw) % most, raw, no, 0)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(cells, put, strict=True)], schema=put)

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for _, group in groupby(rows, key=itemgetter(1)):
            asked: dict[bytes, int] = {}
            for chunk, _, payload, no, _ in group:
                if chunk == chunks.DICTIONARY:
                    asked[payload] = no
                    continue
                if not asked:
                    continue
                part = chunks.load(payload)
                ends = np.cumsum(part["size"], dtype=np.int64).tolist()
                hits = [(asked[w], a, b) for w, a, b in zip(part["words"], [0, *ends], ends, strict=False) if w in asked]
                packed = [part["doc"][a:b].tobytes() + part["times"][a:b].tobytes() for _, a, b in hits]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(hits), pa.int64()), pa.array([t for t, _, _ in hits], pa.int64()),
                                                  pa.array([b - a for _, a, b in hits], pa.int64()), pa.array(packed, pa.binary())], schema=schema)

    parts = stored.where(F.col("bucket") != chunks.BODY).union(vocabulary.select("term", "word").mapInArrow(dealt, _STORED))
    return parts.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, _POSTINGS)


def _owned(terms: DataFrame, owners: int) -> DataFrame:
    """``terms`` (docs, items) with an owner each: fewer documents first, about equal work.
    Terms whose documents need equally many bits stay together, so the driver sees 64 sums."""
    bits = F.length(F.bin("docs"))
    work = sorted((r.bits, int(r.work)) for r in terms.groupBy(bits.alias("bits")).agg(F.sum(F.col("docs").cast("decimal(30,0)") * F.col("items")).alias("work")).collect())
    total, before, owner = sum(w for _, w in work), 0, F.lit(0)
    for size, w in work:
        owner = F.when(bits == size, min(owners - 1, owners * (2 * before + w) // (2 * total))).otherwise(owner)
        before += w
    return terms.withColumn("owner", owner)


def _visit(documents: int, total: int, top: int | None):
    """What an owner does with a bundle's row for a chunk. ``top`` is given to the last
    owner, which tells the best instead of passing the row on."""
    state, best = _arrow(_STATE), _arrow(_BEST)

    def visit(key: tuple, row: pa.Table, found: pa.Table) -> pa.Table:
        if not row.num_rows:
            return (state if top is None else best).empty_table()
        held = chunks.load(row.column("payload")[0].as_py())
        length = held["length"]
        norm = 10 + np.array([90 * n * documents // total for n in length.tolist()], dtype=np.int64)
        asks: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for weight, items, raw in zip(*(found.column(c).to_pylist() for c in ("weight", "items", "payload")), strict=True):
            n = len(raw) // 6
            doc, times = np.frombuffer(raw, "<u2", n), np.frombuffer(raw, "<u4", n, 2 * n).astype(np.int64)
            value = 1_000_000_000 * times // (1000 * times + 8 * norm[doc])
            for no in items:
                asks.setdefault(no, []).append((weight, doc, value))
        ends = np.cumsum(held["size"], dtype=np.int64).tolist()
        before = {no: (a, b) for no, a, b in zip(held["no"].tolist(), [0, *ends], ends, strict=False)}
        names, sizes, docs, scores = [], [], [], []
        for no in sorted(before.keys() | asks.keys()):
            sums = np.zeros(len(length), dtype=np.int64)
            a, b = before.get(no, (0, 0))
            sums[held["doc"][a:b]] = held["score"][a:b]
            for weight, doc, value in asks.get(no, ()):
                sums[doc] += weight * value
            at = np.flatnonzero(sums)
            if top is not None and len(at) > top:
                # chunks are in order of ids, so of equal scores the first ones stay
                at = at[np.argsort(-sums[at], kind="stable")[:top]]
            names.append(no)
            sizes.append(len(at))
            docs.append(at)
            scores.append(sums[at])
        none = np.zeros(0, dtype=np.int64)
        at, score = np.concatenate([none, *docs]), np.concatenate([none, *scores])
        if top is not None:
            ids = pa.array(held["doc_id"][at], pa.int64(), mask=held["null"][at].astype(bool))
            return pa.table([pa.array(np.repeat(np.array(names, dtype=np.int64), sizes)), ids, pa.array(score)], schema=best)
        held |= {"no": np.array(names, dtype="<i8"), "size": np.array(sizes, dtype="<u4"), "doc": at.astype("<u2"), "score": score.astype("<i8")}
        return pa.table([pa.array([x.as_py()], f.type) for x, f in zip(key, state, strict=False)] + [pa.array([chunks.dump(held)], pa.binary())], schema=state)

    return visit


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, bundle: int = BUNDLE) -> DataFrame:
    """``item_id, rank, doc_id, score``: for each row of ``items`` (item_id, text) the
    ``top`` documents of the highest score above zero, the smaller id first of equal scores.

    Null texts have no terms, and an item without terms or hits no rows. Rows are
    documents, whatever their ids; a row without an id comes last among equal
    scores. Of other columns none is read. A text of any length is one document of its chunk."""
    spark = docs.sparkSession
    most = chunks.buckets(docs)
    stored = written(index(docs))
    sums = stored.where(F.col("bucket") == chunks.BODY).agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    documents, total = sums.docs or 0, sums.terms or 0
    items = written(items.select("item_id", "text").withColumn("no", F.monotonically_increasing_id()))
    bundles = max(1, -(-items.count() // bundle))
    asked = written(_words(items))
    vocabulary = written(asked.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    postings = written(_postings(stored, vocabulary, most))
    known = postings.groupBy("term").agg(F.sum("docs").alias("docs")).join(vocabulary, "term")
    weight = F.floor(1000 * F.ln((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("docs") + 1))).cast("long")
    by_bundle = asked.withColumn("bundle", F.pmod(F.xxhash64("no"), F.lit(bundles)).cast("int"))
    uses = by_bundle.groupBy("word").agg(F.count(F.lit(1)).alias("items"))
    owned = written(_owned(known.join(uses, "word").select("term", "word", "docs", "items"), owners))
    asks = by_bundle.groupBy("bundle", "word").agg(F.collect_list("no").alias("items"))
    routes = asks.join(owned.select("word", "term", "owner", weight.alias("weight")), "word").select("owner", "bundle", "term", "weight", "items")
    routed = folder(spark)
    postings.drop("docs").join(routes, "term").select("owner", "bundle", "chunk", "weight", "items", "payload").write.partitionBy("owner").parquet(routed)
    held = spark.read.schema("bundle int, chunk long, weight long, items array<long>, payload binary, owner int").parquet(routed)

    state = (stored.where(F.col("bucket") == chunks.BODY)
             .select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "chunk", "payload"))
    for owner in range(owners):
        last = owner == owners - 1
        state = (state.groupBy("bundle", "chunk").cogroup(held.where(F.col("owner") == owner).drop("owner").groupBy("bundle", "chunk"))
                 .applyInArrow(_visit(documents, max(1, total), top if last else None), _BEST if last else _STATE))
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = state.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")
