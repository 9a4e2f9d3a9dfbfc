"""Near dedup: groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come first from SimHash: fingerprints of the same shingles that differ in few
bits, found by pigeonring chains as in ``simhash``. Most pairs at the bound differ in more
bits, and come from minima of hashes (MinHash): pairs that agree on one of BANDS keys
of ROWS minima meet, and must then differ in at most TOLERANCE of BITS one-bit minima.
Of pairs at the bound, 3 in a million meet in no band and about as many fail the bits;
above it fewer. What passes is verified on the exact sets of shingles."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from runlens.llm import components, simhash
from runlens.llm.shared import by_batch, by_sorting, raw_texts, whole, written

WORDS, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 32, 5
#: One-bit minima, and how many may differ: at the bound 51.2 do on average, with a deviation of 6.8.
BITS, TOLERANCE = 512, 82
#: Bits of the parity sketch: each shingle flips one, so two sketches differ in no more bits than the sets have different shingles.
PARITY = 1024
#: Heads that the first step holds a text against; the later steps find what it leaves.
HEADS = 4
#: Shingles whose hashes are permuted at once.
_BLOCK = 128

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 1 << 32, BITS, dtype="u4") | np.uint32(1)
_TERMS = _rng.integers(0, 1 << 32, BITS, dtype="u4")


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The XXH64 of each distinct shingle, in order. A-Z become lower case; words are
    separated by ASCII white space. With fewer words the whole sequence is the one
    shingle; without any there is none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype="u8")
    joined = b" ".join(found)
    ends = list(accumulate([len(w) + 1 for w in found]))
    digest = xxhash.xxh64_intdigest
    last = ends[words - 1:] or ends[-1:]
    return np.unique(np.array([digest(joined[a:b - 1], SEED) for a, b in zip([0, *ends], last, strict=False)], dtype="u8"))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and both >= least * (len(a) + len(b) - both) - 1e-9


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each of BITS permutations the least value of the hashes' upper halves."""
    upper = (hashes >> np.uint64(32)).astype("u4")
    out = np.full(BITS, 0xFFFFFFFF, dtype="u4")
    for at in range(0, len(upper), _BLOCK):
        np.minimum(out, (upper[at:at + _BLOCK, None] * _FACTORS + _TERMS).min(axis=0), out=out)
    return out


def _bits(least: np.ndarray) -> np.ndarray:
    mixed = (least ^ (least >> np.uint32(16))) * np.uint32(0x7FEB352D)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x846CA68B)
    return np.packbits((mixed >> np.uint32(31)).astype(bool), bitorder="little").view("<i8")


def parity(hashes: np.ndarray) -> np.ndarray:
    return np.packbits((np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).astype(bool), bitorder="little").view("<i8")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_PRINTS = StructType([StructField("doc_id", LongType()), StructField("text_hash", LongType()), StructField("words", BinaryType()), StructField("n", LongType()),
                      StructField("fp", LongType()), StructField("keys", ArrayType(LongType())), StructField("bits", ArrayType(LongType())), StructField("odd", ArrayType(LongType()))])
_PAIR = StructType([StructField("u", LongType()), StructField("v", LongType())])
_SHINGLE = StructType([StructField("node", LongType()), StructField("shingle", LongType())])


def prints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, words, n, fp, keys, bits, odd`` for each row: ``words`` is a 128-bit hash
    of the words in order, ``n`` the number of distinct shingles, ``fp`` their SimHash."""
    def make(batch):
        words, n, fp, keys, bits, odd = [], [], [], [], [], []
        for text in raw_texts(batch):
            words.append(xxhash.xxh3_128_digest(b" ".join(text.lower().split())))
            found = shingles(text)
            least = minima(found)
            n.append(len(found))
            fp.append(simhash.fingerprint(text, WORDS))
            keys.append([_signed(xxhash.xxh3_64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i)) for i in range(BANDS)] if len(found) else [])
            bits.append(_bits(least).tolist())
            odd.append(parity(found).tolist())
        yield {"doc_id": batch.column(0), "text_hash": batch.column(1), "words": words, "n": n, "fp": fp, "keys": keys, "bits": bits, "odd": odd}

    body = whole(F.col("text"))
    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("text_hash"), body.alias("text")), make, _PRINTS)


def _apart(a: str, b: str, size: int) -> Column:
    each = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(size // 64)]
    return sum(each[1:], each[0])


def _close(a: str, b: str) -> Column:
    return _apart(a, b, BITS) <= TOLERANCE


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, text``, written, for each row of ``nodes`` (node, text_hash). Rows of one text become one before they meet its node."""
    body = whole(F.col("text"))
    held = docs.select(F.xxhash64(body).alias("text_hash"), body.alias("text")).join(nodes.select("text_hash").distinct(), "text_hash", "left_semi")
    return written(held.groupBy("text_hash").agg(F.any_value("text").alias("text")).join(by_sorting(nodes.select("node", "text_hash")), "text_hash").select("node", "text"))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``u, v`` whose exact similarity reaches the bound; each node's text is any of its rows'."""
    pairs = written(pairs)
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    texts = by_sorting(_texts(nodes.join(ends, "node", "left_semi"), docs))

    def make(batch):
        sets: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in sets:
                sets[text] = shingles(text)
            return sets[text]

        ok = [similar(of(a), of(b)) for a, b in zip(raw_texts(batch, "a"), raw_texts(batch, "b"), strict=True)]
        at = pa.array([i for i, x in enumerate(ok) if x], pa.int64())
        yield {"u": batch.column(0).take(at), "v": batch.column(1).take(at)}

    both = (pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u")
            .join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v").select("u", "v", "a", "b"))
    return written(by_batch(both, make, _PAIR, rows=64))


def _alone(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, alone``: how many shingles of each of ``nodes`` no other of them has."""
    def make(batch):
        found = [shingles(t) for t in raw_texts(batch)]
        sizes = [len(x) for x in found]
        yield {"node": np.repeat(batch.column(0).to_numpy(), sizes), "shingle": np.concatenate([np.empty(0, "u8"), *found]).view("<i8")}

    each = by_batch(_texts(nodes, docs), make, _SHINGLE, rows=64)
    once = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).where("n = 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def _bound(n: str, alone: str, other: str) -> Column:
    """Whether what only each of two texts has leaves room for a similarity that reaches the bound."""
    return F.col(n) - F.col(alone) >= SIMILARITY * (F.col(n) + F.col(other)) - 1e-9


def _open(members: DataFrame) -> DataFrame:
    """The rows (key, node, root, ...) of keys whose nodes are in several groups."""
    mixed = members.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    return members.join(mixed, "key", "left_semi")


def _side(members: DataFrame, node: str) -> DataFrame:
    """Members as one side of a join by key, the columns named for ``node``."""
    return by_sorting(members.select("key", F.col("node").alias(node), *[F.col(c).alias(f"{c}_{node}") for c in ("root", "n", "alone", "bits", "odd")]))


def _possible() -> Column:
    """Whether ``u`` and ``v`` may be linked and are not in one group yet."""
    different = (F.col("n_u") + F.col("n_v")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-9
    return ((F.col("root_u") != F.col("root_v")) & _bound("n_u", "alone_u", "alone_v") & _bound("n_v", "alone_v", "alone_u")
            & (_apart("odd_u", "odd_v", PARITY) <= different) & _close("bits_u", "bits_v"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _simhashed(nodes: DataFrame) -> DataFrame:
    """Pairs ``u, v`` of nodes by SimHash: one node stands for each fingerprint; it meets the
    nodes of its own and those that stand for fingerprints within simhash.TOLERANCE bits."""
    some = nodes.where("n > 0").select("node", "fp")
    heads = written(some.groupBy("fp").agg(F.min("node").alias("head")))
    near = simhash.links(heads.select("fp"))
    of = lambda end: by_sorting(heads.select(F.col("fp").alias(end), F.col("head").alias(f"head_{end}")))
    linked = near.join(of("u"), "u").join(of("v"), "v").select(F.col("head_u").alias("u"), F.col("head_v").alias("v"))
    return linked.union(some.join(by_sorting(heads), "fp").where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v")))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, text_hash, root``; documents of one root are
    linked by pairs whose similarity reaches the bound.

    Only distinct texts are paired, in three steps, each on what the one before left
    in several groups. First every text is held against those that SimHash links it with
    and some of its keys' heads. Then
    shingles that only one of the remaining texts has are counted: they bound every
    similarity, so texts with many of them drop out, and each key's head is now the
    text with the smallest share of them. Last, texts outside a key's largest group
    meet the texts that they may still be linked with: of two linked texts one has a
    small share of own shingles, and their parity sketches differ in few bits. So copies
    that each differ in their own way from one text, but are no copies of each other,
    make no pairs. Both bounds lose no link."""
    rows = written(prints(docs))
    nodes = written(rows.groupBy("words").agg(*[F.any_value(c).alias(c) for c in ("text_hash", "n", "fp", "keys", "bits", "odd")])
                    .withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("head")).where("times > 1").drop("times")
    met = written(by_sorting(keyed).join(shared, "key"))
    heads = met.where("head <> node").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("head")), 1, HEADS).alias("heads"))
    stars = _ordered(heads.select(F.explode("heads").alias("u"), F.col("node").alias("v")))
    bits = by_sorting(nodes.select("node", "bits"))
    stars = (stars.join(bits.select(F.col("node").alias("u"), F.col("bits").alias("a")), "u")
             .join(bits.select(F.col("node").alias("v"), F.col("bits").alias("b")), "v").where(_close("a", "b")).select("u", "v"))
    found = _verified(_ordered(stars.union(_simhashed(nodes))), nodes, docs)

    def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
        return _open(members.drop("root").join(components.roots(links), "node", "left").withColumn("root", F.coalesce("root", "node")))

    members = written(grouped(met.drop("head"), found))
    left = nodes.join(members.select("node").distinct(), "node", "left_semi")
    alone = left.join(_alone(left, docs), "node", "left").select("node", "n", F.coalesce("alone", F.lit(0)).alias("alone"), "bits", "odd")
    members = by_sorting(members).join(alone.where(F.col("n") - F.col("alone") >= SIMILARITY * F.col("n") - 1e-9), "node")
    members = written(_open(members))
    share = F.col("alone") / F.col("n")
    heads = _side(members.groupBy("key").agg(F.min_by(F.struct(*[c for c in members.columns if c != "key"]), F.struct(share, "node")).alias("head")).select("key", "head.*"), "u")
    found = found.union(_verified(_ordered(heads.join(_side(members, "v"), "key").where(_possible())), nodes, docs))

    members = written(grouped(members, found))
    largest = (members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("key")
               .agg(F.max_by("root", F.struct("size", "root")).alias("largest")))
    members = written(members.join(largest, "key", "left").withColumn("outside", F.col("root") != F.col("largest"))
                      .withColumn("low", F.col("alone") * (1 + SIMILARITY) <= F.col("n") * (1 - SIMILARITY) + 1e-9).drop("largest"))
    outside, low = members.where("outside"), members.where("low")
    pairs = (_side(outside.where("low"), "u").join(_side(members, "v"), "key").where(_possible()).select("u", "v")
             .union(_side(outside.where("not low"), "u").join(_side(low, "v"), "key").where(_possible()).select("u", "v")))
    linked = components.roots(found.union(_verified(_ordered(pairs), nodes, docs)))
    rooted = nodes.select("words", "node").join(linked, "node", "left").select("words", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "text_hash", "words").join(rooted, "words", "left").select("doc_id", "text_hash", "root")


def unique(docs: DataFrame) -> DataFrame:
    """One row of each group, whole, in the columns of ``docs``: the one with the smallest id.

    Of a group's rows that tie on that id, the one with the least hash of the text
    stays, and of equal texts any one. Groups that hold the same id each keep a
    row. Rows without an id belong to nobody and stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    heads = groups(docs).where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).select("head.*")
    cells = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole(F.col("text"))).alias("hash"))
    kept = cells.join(by_sorting(written(heads)), (F.col("id") == F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    again = F.count(F.lit(1)).alias("rows")
    tied = by_sorting(written(kept.groupBy("id", "hash").agg(again).where("rows > 1").select("id", "hash")))
    single = kept.select("row", "id", "hash").join(tied, ["id", "hash"], "left_anti").select("row")
    first = kept.select("row", "id", "hash").join(tied, ["id", "hash"], "left_semi").groupBy("id", "hash").agg(F.any_value("row").alias("row")).select("row")
    return single.union(first).union(cells.where("id is null").select("row")).select("row.*")
