"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from runlens.llm.shared import raw_texts, whole

#: Labelled documents that the trees are fitted on at most, those with the least hashes of their ids.
LABELLED_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 80, 3, 64, 0.2, 5.0
#: Of labelled good documents, the part that the threshold may reject; folds of the rows it is measured on.
REJECT, FOLDS = 0.001, 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "distinct", "line_words", "top_word", "wide")
#: A document is never better for more of these.
FALLING = tuple(FEATURES.index(f) for f in ("symbols", "dup_lines", "repeats"))

_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_BLANK = b" \t\n\r\x0b\x0c"


def _repeated(ids: np.ndarray, distinct: int) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(ids) < 4:
        return 0
    code = ids[:-1] * distinct + ids[1:]
    if distinct > 1 << 20:
        code, distinct_pairs = np.unique(code, return_inverse=True)[1], len(code)
        assert distinct_pairs * distinct < 1 << 63
    code = code[:-1] * distinct + ids[2:]
    _, of, n = np.unique(code, return_inverse=True, return_counts=True)
    twice = n[of] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k:k + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``FEATURES`` of a text in UTF-8."""
    words = text.split()
    n, size = len(words), sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - (len(text) - size)
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    repeats = _repeated(ids, max(1, len(number)))

    def share(of: bytes) -> float:
        return (len(text) - len(text.translate(None, of))) / max(1, size)

    some = max(1, n)
    features = [np.log1p(n), chars / some, symbols / some, dup_lines / max(1, len(lines)), repeats / some, share(_UPPER), share(_DIGITS),
                share(b"!?|;"), len(number) / some, n / max(1, len(lines)), float(np.bincount(ids).max() / some) if n else 0.0, (size - chars) / max(1, size)]
    return [n, chars, symbols, dup_lines, repeats], features


@dataclass
class Trees:
    """Perfect binary trees as arrays (tree, node): a row goes right where its
    feature is above the threshold; leaves hold log-odds."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float
    cut: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of being good, for the rows of ``x``, all trees at once."""
        out = np.full(len(x), self.start)
        tree = np.arange(len(self.leaf))
        for at in range(0, len(x), 4096):
            some = x[at:at + 4096]
            node = np.zeros((len(some), len(tree)), dtype=np.int64)
            row = np.arange(len(some))[:, None]
            for _ in range(DEPTH):
                right = some[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out[at:at + 4096] += self.leaf[tree, node - (2 ** DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees for log-loss on histograms of the features. A split on a
    falling feature must not raise the value to its right, and what grows below
    it stays on its side of the middle, so scores never rise with the feature."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    start = float(np.log((y.sum() + 1) / (rows - y.sum() + 1)))
    trees = Trees(np.zeros((TREES, inner), dtype=np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), start)
    total = np.full(rows, start)
    falling = np.zeros(width, dtype=bool)
    falling[list(FALLING)] = True
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        low, high = np.full(2 * leaves - 1, -np.inf), np.full(2 * leaves - 1, np.inf)
        for level in range(DEPTH):
            first, count = 2 ** level - 1, 2 ** level
            key = ((node - first)[:, None] * width + np.arange(width)) * BINS + binned
            shape = (count, width, BINS)
            sums = [np.bincount(key.reshape(-1), np.repeat(v, width), count * width * BINS).reshape(shape).cumsum(axis=2) for v in (g, h)]
            left_g, left_h = sums
            right_g, right_h = left_g[:, :, -1:] - left_g, left_h[:, :, -1:] - left_h
            lo, hi = low[first:first + count, None, None], high[first:first + count, None, None]
            left = np.clip(-left_g / (left_h + RIDGE), lo, hi)
            right = np.clip(-right_g / (right_h + RIDGE), lo, hi)
            gain = -(left_g * left + (left_h + RIDGE) * left ** 2 / 2) - (right_g * right + (right_h + RIDGE) * right ** 2 / 2)
            gain[(left_h < 1) | (right_h < 1)] = -np.inf
            gain[falling[None, :, None] & (left < right)] = -np.inf
            for k in range(count):
                at = first + k
                j, b = np.unravel_index(np.argmax(gain[k]), gain[k].shape)
                down = (2 * at + 1, 2 * at + 2)
                low[list(down)], high[list(down)] = low[at], high[at]
                if np.isfinite(gain[k, j, b]) and b < len(edges[j]):
                    trees.feature[t, at], trees.threshold[t, at] = j, edges[j][b]
                    if falling[j]:
                        low[down[0]] = high[down[1]] = (left[k, j, b] + right[k, j, b]) / 2
            node = 2 * node + 1 + (x[np.arange(rows), trees.feature[t, node]] > trees.threshold[t, node])
        sums_g, sums_h = (np.bincount(node - inner, v, leaves) for v in (g, h))
        trees.leaf[t] = RATE * np.clip(-sums_g / (sums_h + RIDGE), low[inner:], high[inner:])
        total += trees.leaf[t][node - inner]
    return trees


def fit(x: np.ndarray, y: np.ndarray) -> Trees | None:
    """Trees with a threshold below which REJECT of the good rows lie when they are
    scored by trees that did not see them; nothing if only one class is there."""
    if len(x) < 2 * FOLDS or y.min() == y.max():
        return None
    fold, unseen = np.arange(len(x)) % FOLDS, np.zeros(len(x))
    for k in range(FOLDS):
        unseen[fold == k] = grow(x[fold != k], y[fold != k]).score(x[fold == k])
    trees = grow(x, y)
    trees.cut = min(0.5, float(np.quantile(unseen[y == 1], REJECT)))
    return trees


def _measured(docs: DataFrame, names: list[str], make) -> DataFrame:
    """``docs`` through ``make(statistics of the texts)``, which gives more columns ``names``."""
    schema = StructType([*docs.schema.fields, *[StructField(n, BooleanType() if n in ("base_failed", "kept") else LongType() if n in COUNTS else DoubleType())
                                                for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                pairs = [statistics(t) for t in raw_texts(some, "_text")]
                counts, features = np.array([c for c, _ in pairs], dtype=np.int64), np.array([f for _, f in pairs])
                columns = make(counts, features)
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(columns[n]) for n in names]], schema=arrow)

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Trees | None:
    """Fits the trees on at most LABELLED_ROWS documents that ``labels`` (doc_id,
    quality 0 or 1) names; rows without id or quality, and ids that repeat, count once at most."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").alias("_good"))
    some = good.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(LABELLED_ROWS)
    named = docs.select(F.col("doc_id").cast("long").alias("_id"), whole(F.col("text")).alias("_text")).join(F.broadcast(some), "_id")
    rows = _measured(named, list(FEATURES), lambda counts, features: dict(zip(FEATURES, features.T, strict=True)))
    kept = rows.groupBy("_id").agg(F.min(F.struct("_good", *FEATURES)).alias("r")).select("_id", "r.*").orderBy("_id").toPandas()
    return fit(kept[list(FEATURES)].to_numpy(float), (kept["_good"] > 0).to_numpy(float))


def judge(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """``docs`` as they are in a struct ``row``, with COUNTS, ``base_failed``,
    ``good`` (the probability) and ``kept``.

    The base rule fails texts under 50 words or with over half of the words in
    repeated windows. A null text has no words and fails. Without trees the
    base rule alone decides."""
    def verdict(counts, features):
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        good = trees.score(features) if trees else np.ones(len(failed))
        cut = trees.cut if trees else 0.0
        return dict(zip(COUNTS, counts.T, strict=True)) | {"base_failed": failed, "good": good, "kept": ~failed & (good >= cut)}

    cells = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(F.col("text")).alias("_text"))
    return _measured(cells, [*COUNTS, "base_failed", "good", "kept"], verdict).drop("_text")
