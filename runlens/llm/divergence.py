"""Source divergence audit: how the words of each source differ from those of the
other sources of its language, in exact integers.

A translate table lowers A-Z and blanks what separates terms in one pass over the
bytes; a Counter per document gives occurrences and the document's one vote. A task
adds documents of one language and source up before anything is shuffled. A term
that most sources lack is never written out for them: what two sources have in
common when neither holds a term is one product, what only one holds comes from a
histogram of its shares, and only terms that both hold are taken pair by pair."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from runlens.llm.shared import raw_texts, whole, written

LEAST_DOCUMENTS, TOP = 3, 200
UNIT = 1_000_000_000
#: Terms that a task adds up before it passes them on.
HELD_TERMS = 400_000
#: Pairs of sources that a task holds sums of, and pairs that are worked at once.
HELD_PAIRS, AT_ONCE = 1_000_000, 2_000_000
#: A document's vote, above any number of occurrences in one task.
_VOTE = 1 << 44

#: ASCII letters in lower case, bytes of other characters as they are, all else blank.
TABLE = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

_COUNTS = StructType([StructField("lang", StringType()), StructField("source", StringType()), StructField("term", StringType()),
                      StructField("n", LongType()), StructField("docs", LongType())])
_SUMS = StructType([StructField("gid", LongType()), StructField("other", LongType()), StructField("value", LongType())])


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` summed within parts of tasks; ``docs`` has lang, source and text, none null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_COUNTS)

    def run(batches):
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def passed_on():
            for (lang, source), sums in held.items():
                found = sorted(sums)
                packed = np.fromiter((sums[t] for t in found), dtype=np.int64, count=len(found))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([source] * len(found), pa.string()),
                                                  pa.array(found, pa.binary()).cast(pa.string()), pa.array(packed % _VOTE), pa.array(packed // _VOTE)],
                                                 schema=arrow)

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch), strict=True):
                sums = held.setdefault((lang, source), {})
                size -= len(sums)
                get = sums.get
                for term, n in Counter(terms(text)).items():
                    sums[term] = get(term, 0) + n + _VOTE
                size += len(sums)
                if size > HELD_TERMS:
                    yield from passed_on()
                    held, size = {}, 0
        yield from passed_on()

    return docs.select("lang", "source", "text").mapInArrow(run, _COUNTS)


def share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share in billionths, by whole numbers of any size."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT) * (n.cast("decimal(24,0)") + 1), (total + terms).cast("decimal(24,0)"))).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_sums(cells: DataFrame) -> DataFrame:
    """``gid, other, value``: what terms that both hold add to the sum, beyond what each
    one's part already says. ``cells`` has tid, gid, share and none (the share of a term
    without occurrences); a term's cells come to one task, which holds one term of many
    sources or a batch of small ones at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_SUMS)

    def f(p, q):
        return (p - q) ** 2 // q

    def add(sums: dict[int, int], names: np.ndarray, gid, p, none) -> None:
        """Rows of equally many sources each: matrices of one row a term."""
        n, k = gid.shape
        some = max(1, AT_ONCE // k)
        for at in range(0, n * k, some):
            row, col = np.divmod(np.arange(at, min(n * k, at + some)), k)
            a, pa_, na = gid[row, col][:, None], p[row, col][:, None], none[row, col][:, None]
            b, q, nb = gid[row], p[row], none[row]
            value = f(pa_, q) - f(pa_, nb) - f(na, q) + f(na, nb)
            key, where = np.unique(a * len(names) + b, return_inverse=True)
            total = np.zeros(len(key), dtype=np.int64)
            np.add.at(total, where.reshape(-1), value.reshape(-1))
            for x, v in zip(key.tolist(), total.tolist(), strict=True):
                i, j = divmod(x, len(names))
                if i != j:
                    pair = (int(names[i]), int(names[j]))
                    sums[pair] = sums.get(pair, 0) + v

    def told(sums):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in sums], pa.int64()), pa.array([b for _, b in sums], pa.int64()),
                                           pa.array(list(sums.values()), pa.int64())], schema=arrow)

    def run(batches):
        sums: dict = {}
        rest = None
        for batch in batches:
            now = np.stack([c.to_numpy() for c in batch.columns])
            now = now if rest is None else np.concatenate([rest, now], axis=1)
            cut = np.searchsorted(now[0], now[0, -1]) if now.shape[1] else 0
            rest = now[:, cut:]
            work(sums, now[:, :cut])
            if len(sums) > HELD_PAIRS:
                yield told(sums)
                sums = {}
        if rest is not None:
            work(sums, rest)
        if sums:
            yield told(sums)

    def work(sums, part):
        if not part.shape[1]:
            return
        tid, gid, p, none = part
        names, gid = np.unique(gid, return_inverse=True)
        first = np.flatnonzero(np.diff(tid, prepend=-1))
        size = np.diff(first, append=len(tid))
        for k in np.unique(size[size > 1]):
            at = first[size == k][:, None] + np.arange(k)
            add(sums, names, gid[at], p[at], none[at])

    placed = cells.select("tid", "gid", "share", "none").repartition("tid").sortWithinPartitions("tid")
    return placed.mapInArrow(run, _SUMS)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int | None = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group of a language and a source.

    Part ``pair`` ranks all other sources of the language by their divergence from
    the group, part ``term`` the group's terms by how far their share exceeds the
    language's (the first ``top``, all if None). A language keeps the terms of at
    least ``least`` documents. Null lang, source and text count as empty; a group
    without terms has its pairs; rows are documents, whatever their ids; ties are
    ranked by the item's bytes; other columns are not read. A language's cells of one
    term come together, so a task holds as many numbers as there are sources."""
    docs = docs.select(whole(F.col("lang")).alias("lang"), whole(F.col("source")).alias("source"), whole(F.col("text")).alias("text"))
    each = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = (each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("cells"))
            .where(F.col("docs") >= least).select("lang", "term", "lang_n", "cells"))
    # numbers are written with their rows, so that they are the same at each reading
    kept = written(kept.withColumn("tid", F.monotonically_increasing_id()))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    flat = kept.select("tid", "lang", "term", "lang_n", F.inline("cells"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(known.select("lang", "source", "total", "terms", "lang_total",
                                  F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1).alias("none")).withColumn("gid", F.monotonically_increasing_id()))
    cells = written(flat.join(groups, ["lang", "source"]).select(
        "tid", "lang", "gid", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("share"), "none",
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("all")))

    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = cells.groupBy("lang", "gid", "share", "none").agg(F.count(F.lit(1)).alias("m"))
    alone = alone.select("lang", "gid", "share", "none", "m", F.lit(False).alias("base"))
    base = groups.select("lang", "gid", F.col("none").alias("share"), "none", F.col("terms").alias("m"), F.lit(True).alias("base"))
    left = alone.union(base).withColumn("salt", F.pmod(F.xxhash64("gid", "share"), F.lit(salts)).cast("int"))
    right = groups.select("lang", F.col("gid").alias("other"), F.col("none").alias("theirs"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    both = left.join(right, ["lang", "salt"]).where("gid <> other")
    p, none, q = F.col("share"), F.col("none"), F.col("theirs")
    ways = F.array(F.struct("gid", "other", (F.col("m") * (apart(p, q) - F.when(F.col("base"), 0).otherwise(apart(none, q)))).alias("value")),
                   F.struct(F.col("other").alias("gid"), F.col("gid").alias("other"),
                            F.when(F.col("base"), 0).otherwise(F.col("m") * (apart(q, p) - apart(q, none))).alias("value")))
    sums = both.select(F.inline(ways)).union(_pair_sums(cells)).groupBy("gid", "other").agg(F.sum("value").alias("value"))
    names = groups.select("gid", "lang", "source")
    items = names.select(F.col("gid").alias("other"), F.col("source").alias("item"))
    pairs = sums.join(names, "gid").join(items, "other").select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    marked = cells.where(F.col("share") > F.col("all")).select("gid", F.col("term").alias("item"), apart(F.col("share"), F.col("all")).alias("value"))
    by_group = Window.partitionBy("gid").orderBy(F.col("value").desc(), "item")
    marked = marked.withColumn("rank", F.row_number().over(by_group))
    if top is not None:
        marked = marked.where(F.col("rank") <= top)
    told = marked.join(names, "gid").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).union(told)
