"""Language-model scores: a log-bilinear model with noise-contrastive estimation, in numpy."""

from __future__ import annotations

import bisect
import copy
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from runlens.llm import chunks
from runlens.llm.shared import written

#: The end of a document, a word that no text can hold.
END = b" "
#: Words that the top level tells apart, and the fewest groups that share the others.
HEADS, GROUPS = 128, 64
#: Words with a row of their own inside a group: this many for each unit of the cube root of the tokens.
ROWS = 16
CONTEXT, WIDTH = 2, 32
#: Tokens of a training step, noise samples that its tokens share at the top and in each group, rounds over disjoint parts of the corpus.
STEP, NOISE, GROUP_NOISE, ROUNDS = 2048, 64, 8, 2
#: Tokens of a group that share their noise.
BLOCK = 32
RATE = 0.15
#: Scores that are normalised at once.
SCORES = 1 << 16
#: Products of a query and a row up to this size have an exponential, and sums of them, as they are.
SAFE = 60
#: Tokens that are looked up at once in scoring, few enough to stay in a core's cache.
TAKEN = 1 << 12
#: Partial sums of the model, added up once more before the driver sees it.
FOLDS = 16
#: Steps of the histogram of counts: this many for a doubling.
FINE = 8

OUT = StructType([StructField("doc_id", LongType()), StructField("held_out", BooleanType()), StructField("n_tokens", LongType()),
                  StructField("n_known", LongType()), StructField("train_tokens", LongType()), StructField("base_score", DoubleType()),
                  StructField("score", DoubleType())])


def held_out(doc_id: int | None) -> bool:
    """One document in five is not learned from, by a hash of its id; one without an id is learned from."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class Vocabulary:
    """What the model tells apart: its units, which grow with the corpus.

    Units 0 to ``heads - 1`` are the most frequent words. The words with a row come
    next, in the order of their bytes, cut into groups of equal size; each group ends
    with a unit that all other words share whose bytes fall into its range."""

    def __init__(self, counted: list[tuple[bytes, int]]) -> None:
        ranked = sorted(counted, key=lambda wn: (-wn[1], wn[0]))
        top, rows = ranked[:HEADS], sorted(ranked[HEADS:])
        self.heads = len(top)
        self.groups = max(1, min(max(GROUPS, math.isqrt(len(rows))), len(rows)))
        ends = [len(rows) * (g + 1) // self.groups for g in range(self.groups)]
        self.bounds = [rows[e][0] for e in ends[:-1]]
        #: Where each group's units start, and where the last ends.
        self.starts = np.array([self.heads, *(self.heads + e + g + 1 for g, e in enumerate(ends))], dtype=np.int64)
        self.units = int(self.starts[-1])
        self.shared = self.starts[1:] - 1
        self.counts = np.zeros(self.units, dtype=np.int64)
        self.words_of = np.zeros(self.units, dtype=np.int64)
        self.number = {w: i for i, (w, _) in enumerate(top)}
        for i, (w, _) in enumerate(rows):
            self.number[w] = self.heads + i + bisect.bisect_right(self.bounds, w)
        for w, n in counted:
            self.counts[self.number[w]] = n

    def unit(self, word: bytes) -> int:
        """A word's own unit, or the one that it shares."""
        own = self.number.get(word)
        return int(self.shared[bisect.bisect_right(self.bounds, word)]) if own is None else own


def _chunk(ids: list, texts: list[bytes]) -> tuple[dict, list[bytes], dict]:
    """The token stream of each document as numbers of the chunk's dictionary."""
    lower = pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    split = pc.ascii_split_whitespace(lower)  # white space at a text's ends leaves an empty piece there
    pieces = split.values.dictionary_encode()
    number, words = pieces.indices.to_numpy(), pieces.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    if b"" in words:
        end = words.index(b"")
        words[end] = END
    else:
        end = len(words)
        words.append(END)
    told = number != end
    before = np.concatenate([[0], np.cumsum(told)])[split.offsets.to_numpy()]
    lengths = (np.diff(before) + 1).astype("<i8")
    inside = np.ones(int(lengths.sum()), dtype=bool)
    inside[np.cumsum(lengths) - 1] = False
    stream = np.full(len(inside), end, dtype="<u4")
    stream[inside] = number[told]
    held = np.array([held_out(i) for i in ids], dtype=bool)
    order = np.argsort(-np.bincount(stream, minlength=len(words)), kind="stable")  # frequent words get low numbers
    rank = np.empty(len(order), dtype="<u4")
    rank[order] = np.arange(len(order))
    stream = rank[stream]
    learned = np.bincount(stream[np.repeat(~held, lengths)], minlength=len(words)).astype("<i8")
    body = {"doc_id": np.array([i or 0 for i in ids], dtype="<i8"), "null": np.array([i is None for i in ids], dtype="u1"),
            "held": held.astype("u1"), "lengths": lengths, "stream": stream.astype("<u4")}
    return body, [words[i] for i in order], {"learned": learned}


def _dictionary(group: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """A bucket's words and how often each is learned from, summed over the chunks."""
    total: dict[bytes, int] = {}
    bucket = None
    for _, bucket, payload in group:
        part = chunks.load(payload)
        for word, n in zip(part["words"], part["learned"].tolist(), strict=True):
            total[word] = total.get(word, 0) + n
    yield chunks.DICTIONARY, bucket, chunks.dump({"words": list(total), "count": np.array(list(total.values()), dtype="<i8")})


_BINS = StructType([StructField("bin", IntegerType()), StructField("tokens", LongType()), StructField("words", LongType())])
_WORDS = StructType([StructField("word", BinaryType()), StructField("n", LongType())])


def _bins(count: np.ndarray) -> np.ndarray:
    return np.floor(FINE * np.log2(count)).astype(np.int64)


def _over(dictionary: DataFrame, make: Callable[[list[bytes], np.ndarray], dict], schema: StructType) -> DataFrame:
    """``make`` over the words of each bucket that are learned from and their counts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for payload in batch.column(2).to_pylist():
                part = chunks.load(payload)
                some = np.flatnonzero(part["count"] > 0)
                yield pa.RecordBatch.from_pydict(make([part["words"][i] for i in some], part["count"][some]), schema=arrow)

    return dictionary.mapInArrow(run, schema)


def _vocabulary(dictionary: DataFrame) -> tuple[int, int, Vocabulary]:
    """Tokens and distinct words that are learned from, and the vocabulary. How many
    words get a row grows with the tokens; a histogram of the counts tells from which
    count on words fit in, so no more than these reach the driver."""
    def histogram(words, count):
        at = _bins(count)
        n, v = np.bincount(at, count).astype("i8"), np.bincount(at)
        some = np.flatnonzero(v)
        return {"bin": some, "tokens": n[some], "words": v[some]}

    found = _over(dictionary, histogram, _BINS).groupBy("bin").agg(F.sum("tokens"), F.sum("words")).orderBy(F.desc("bin")).collect()
    tokens, distinct = sum(r[1] for r in found), sum(r[2] for r in found)
    room, least = HEADS + int(ROWS * tokens ** (1 / 3)), None
    for at, _, n in found:
        room -= n
        if room < 0:
            break
        least = at

    def frequent(words, count):
        some = np.flatnonzero(_bins(count) >= least)
        return {"word": [words[i] for i in some], "n": count[some]}

    counted = [] if least is None else [(bytes(w), n) for w, n in _over(dictionary, frequent, _WORDS).collect()]
    vocabulary = Vocabulary(counted)

    def rest(words, count):
        some = np.array([i for i, w in enumerate(words) if w not in vocabulary.number], dtype=np.int64)
        at = np.array([vocabulary.unit(words[i]) for i in some], dtype=np.int64)
        n, v = np.bincount(at, count[some], vocabulary.units).astype("i8"), np.bincount(at, minlength=vocabulary.units)
        held = np.flatnonzero(v)
        return {"bin": held, "tokens": n[held], "words": v[held]}

    for unit, n, v in _over(dictionary, rest, _BINS).groupBy("bin").agg(F.sum("tokens"), F.sum("words")).collect():
        vocabulary.counts[unit], vocabulary.words_of[unit] = n, v
    return tokens, distinct, vocabulary


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)) in the place of ``x``."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.divide(1, x, out=x)


def _order(numbers: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on; short ones sort faster."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


def _sums_by_row(rows: np.ndarray, *grads: np.ndarray) -> list[np.ndarray]:
    """The distinct rows, in any order, and each gradient's sums. Most rows are met once
    or twice; these are added all at once, the others one after another."""
    order = _order(rows)
    at = rows.take(order)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    length = np.diff(np.append(starts, len(at)))
    one, two, more = starts[length == 1], starts[length == 2], length > 2
    some, ends = order[np.repeat(more, length)], np.cumsum(length[more])
    out = [at.take(np.concatenate([one, two, starts[more]]))]
    for grad in grads:
        total = np.empty((len(starts), *grad.shape[1:]), dtype=grad.dtype)
        total[:len(one)] = grad.take(order.take(one), axis=0)
        np.add(grad.take(order.take(two), axis=0), grad.take(order.take(two + 1), axis=0), out=total[len(one):len(one) + len(two)])
        if len(ends):
            np.add.reduceat(grad.take(some, axis=0), ends - length[more], axis=0, out=total[len(one) + len(two):])
        out.append(total)
    return out


class Model:
    """P(word | context) = P(symbol | context) P(word's unit | group, context), each
    proportional to exp((sum of weight_i * inner[context_i]) . outer[row] + bias[row]).

    Symbols of the top level are the heads and the groups; the second factor is over a
    group's units, and is one for heads. Rows of ``outer``: heads, groups, units of the
    groups. Contexts are units. Work per token is with the top's rows and one group's."""

    NAMES = ("inner", "outer", "weight", "bias")

    def __init__(self, vocabulary: Vocabulary) -> None:
        rng = np.random.default_rng(7)
        h, g, u = vocabulary.heads, vocabulary.groups, vocabulary.units
        self.heads, self.groups, self.units, self.tops = h, g, u, h + g
        self.starts = vocabulary.starts + g  # rows of the groups' units
        of = np.searchsorted(vocabulary.starts, np.arange(u), side="right") - 1
        self.top = np.where(np.arange(u) < h, np.arange(u), h + of)
        mass = vocabulary.counts + 0.5
        by_top = np.bincount(self.top, mass, self.tops)
        #: Noise by row: the share among the top's symbols, or in the group.
        self.noise = np.concatenate([by_top / by_top.sum(), mass[h:] / by_top[self.top[h:]]])
        self.summed = np.cumsum(np.concatenate([by_top / by_top.sum(), mass[h:] / mass.sum()]))
        self.inner = rng.normal(0, 0.1, (u + 1, WIDTH)).astype("f4")  # the last stands before a text
        self.outer = rng.normal(0, 0.1, (u + g, WIDTH)).astype("f4")
        self.weight = np.ones((CONTEXT, WIDTH), dtype="f4")
        self.log_noise = np.log(self.noise).astype("f4")
        self.bias = self.log_noise.copy()
        self.seen = {name: np.full(getattr(self, name).shape, 1e-2, dtype="f4") for name in self.NAMES}

    def query(self, contexts: np.ndarray) -> np.ndarray:
        return self._sum([self.inner.take(contexts[:, i], axis=0) for i in range(CONTEXT)])

    def _sum(self, inner: list[np.ndarray]) -> np.ndarray:
        q = inner[0] * self.weight[0]
        for i in range(1, CONTEXT):
            q += inner[i] * self.weight[i]
        return q

    def _draw(self, low: np.ndarray, high: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        """``n`` rows of noise in each range of rows [low, high)."""
        below = np.where(low > 0, self.summed[low - 1], 0.0)[:, None]
        at = below + rng.random((len(low), n)) * (self.summed[high - 1][:, None] - below)
        return np.clip(np.searchsorted(self.summed, at, side="right"), low[:, None], high[:, None] - 1)

    def _move(self, name: str, rows, grad: np.ndarray) -> None:
        """``grad`` is used up."""
        all_seen, number = self.seen[name], getattr(self, name)
        step = RATE * grad
        seen = np.multiply(grad, grad, out=grad)
        seen += all_seen.take(rows, axis=0)
        all_seen[rows] = seen
        step /= np.sqrt(seen, out=seen)
        number[rows] = np.subtract(number.take(rows, axis=0), step, out=step)

    def step(self, contexts: np.ndarray, targets: np.ndarray, rng: np.random.Generator) -> None:
        """Noise-contrastive estimation: tell each token's symbol from noise that a step's
        tokens share, and its unit from noise of its group that a block of the group's
        tokens share. Blocks have BLOCK places, the last of a group may have empty ones."""
        top = self.top.take(targets)
        order = _order(top)  # tokens of a group stand together
        contexts, targets, top = contexts.take(order, axis=0), targets.take(order), top.take(order)
        n = len(targets)
        inner = [self.inner.take(contexts[:, i], axis=0) for i in range(CONTEXT)]
        q = self._sum(inner)
        outer, shift = self.outer, self.bias - self.log_noise
        sampled = self._draw(np.array([0]), np.array([self.tops]), NOISE, rng)[0]
        own, noise = outer.take(top, axis=0), outer.take(sampled, axis=0)
        d_real = -_sigmoid_of_negative(np.einsum("ij,ij->i", q, own) - np.float32(np.log(NOISE)) + shift.take(top))
        d_fake = q @ -noise.T
        d_fake += np.float32(np.log(NOISE)) - shift.take(sampled)
        d_fake = _sigmoid_of_negative(d_fake)
        own *= d_real[:, None]
        d_q = d_fake @ noise
        d_q += own
        inside = int(np.searchsorted(top, self.heads))
        rows, lifts, moves = [top, sampled], [d_real, d_fake.sum(axis=0)], [np.multiply(d_real[:, None], q, out=own), d_fake.T @ q]
        if inside < n:
            unit, q_in, group = targets[inside:] + self.groups, q[inside:], top[inside:] - self.heads
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            length = np.diff(np.append(first, len(group)))
            blocks = -(-length // BLOCK)
            within = np.arange(len(group)) - np.repeat(first, length)
            place = np.repeat(np.cumsum(blocks) - blocks, length) * BLOCK + within
            of = np.repeat(group[first], blocks)
            drawn = self._draw(self.starts[of], self.starts[of + 1], GROUP_NOISE, rng)
            dealt, used = np.zeros((len(of) * BLOCK, WIDTH), dtype="f4"), np.zeros(len(of) * BLOCK, dtype="f4")
            dealt[place], used[place] = q_in, 1
            dealt, noise, own = dealt.reshape(len(of), BLOCK, WIDTH), outer.take(drawn, axis=0), outer.take(unit, axis=0)
            d_real = -_sigmoid_of_negative(np.einsum("ij,ij->i", q_in, own) - np.float32(np.log(GROUP_NOISE)) + shift.take(unit))
            d_fake = dealt @ -noise.transpose(0, 2, 1)
            d_fake += (np.float32(np.log(GROUP_NOISE)) - shift.take(drawn))[:, None, :]
            d_fake = _sigmoid_of_negative(d_fake)
            d_fake *= used.reshape(len(of), BLOCK, 1)
            own *= d_real[:, None]
            own += (d_fake @ noise).reshape(-1, WIDTH).take(place, axis=0)
            d_q[inside:] += own
            rows += [unit, drawn.reshape(-1)]
            moves += [np.multiply(d_real[:, None], q_in, out=own), (d_fake.transpose(0, 2, 1) @ dealt).reshape(-1, WIDTH)]
            lifts += [d_real, d_fake.sum(axis=1).reshape(-1)]
        at, move, lift = _sums_by_row(np.concatenate(rows), np.concatenate(moves), np.concatenate(lifts))
        for_inner = np.empty((CONTEXT, n, WIDTH), dtype="f4")
        for i in range(CONTEXT):
            np.multiply(d_q, self.weight[i], out=for_inner[i])
        at_in, move_in = _sums_by_row(contexts.T.reshape(-1), for_inner.reshape(-1, WIDTH))
        for_weight = np.stack([np.multiply(d_q, inner[i], out=inner[i]).sum(axis=0) for i in range(CONTEXT)])
        size = np.float32(1 / n ** 0.5)
        self._move("outer", at, np.multiply(move, size, out=move))
        self._move("bias", at, np.multiply(lift, size, out=lift))
        self._move("inner", at_in, np.multiply(move_in, size, out=move_in))
        self._move("weight", np.arange(CONTEXT), for_weight * size)

    def _log_z(self, q: np.ndarray, low: int, high: int) -> np.ndarray:
        """The log of the sum over the rows [low, high), a block of queries at a time."""
        out = np.empty(len(q), dtype="f4")
        outer, bias = np.ascontiguousarray(self.outer[low:high].T), self.bias[low:high]
        most = bias.max()
        factor = np.exp(bias - most)
        far = np.sqrt(np.einsum("ij,ij->j", outer, outer).max())
        rows = max(64, SCORES // (high - low))  # few enough to stay in a core's cache
        for at in range(0, len(q), rows):
            some = q[at:at + rows]
            scores = some @ outer
            if far * np.sqrt(np.einsum("ij,ij->i", some, some).max()) < SAFE:  # no score is beyond this
                out[at:at + rows] = most + np.log(np.exp(scores, out=scores) @ factor)
            else:
                scores += bias
                top = scores.max(axis=1)
                scores -= top[:, None]
                out[at:at + rows] = top + np.log(np.exp(scores, out=scores).sum(axis=1))
        return out

    def log_probs(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of units, normalised over all: at the top one row
        of the product for each distinct context, in the groups one for each token."""
        weighted = [self.inner * self.weight[i] for i in range(CONTEXT)]

        def query(some: np.ndarray) -> np.ndarray:
            at = contexts.take(some, axis=0)
            q = weighted[0].take(at[:, 0], axis=0)
            for i in range(1, CONTEXT):
                q += weighted[i].take(at[:, i], axis=0)
            return q

        code = np.zeros(len(contexts), dtype=np.int64)
        for i in range(CONTEXT):
            code = code * (self.units + 1) + contexts[:, i]
        order = np.argsort(code)
        ranked = code.take(order)
        new = np.concatenate([np.ones(len(code[:1]), dtype=bool), ranked[1:] != ranked[:-1]])
        first, of = order[new], np.empty(len(code), dtype=np.int64)
        of[order] = np.cumsum(new) - 1
        log_z = np.empty(len(first), dtype="f4")
        for at in range(0, len(first), TAKEN):
            log_z[at:at + TAKEN] = self._log_z(query(first[at:at + TAKEN]), 0, self.tops)
        top = self.top.take(targets)
        order = _order(top)
        out = np.empty(len(targets), dtype="f8")
        ranked = top.take(order)
        inside = int(np.searchsorted(ranked, self.heads))
        ends = [0, *(inside + np.searchsorted(ranked[inside:], self.heads + np.arange(self.groups))).tolist(), len(order)]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            for at in range(a, b, TAKEN):
                some = order[at:min(b, at + TAKEN)]
                q, row = query(some), ranked[at:at + len(some)]
                got = np.einsum("ij,ij->i", q, self.outer.take(row, axis=0)) + self.bias.take(row) - log_z.take(of.take(some))
                if row[0] >= self.heads:
                    group, unit = int(row[0]) - self.heads, targets.take(some) + self.groups
                    got += np.einsum("ij,ij->i", q, self.outer.take(unit, axis=0)) + self.bias.take(unit) - self._log_z(q, int(self.starts[group]), int(self.starts[group + 1]))
                out[some] = got
        return out

    def state(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (*(getattr(self, n) for n in self.NAMES), *(self.seen[n] for n in self.NAMES))])

    def put(self, state: np.ndarray) -> None:
        at = 0
        for target in (*(getattr(self, n) for n in self.NAMES), *(self.seen[n] for n in self.NAMES)):
            target[...] = state[at:at + target.size].reshape(target.shape)
            at += target.size


def contexts_of(units: np.ndarray, lengths: np.ndarray, before: int) -> np.ndarray:
    """The CONTEXT units before each token, the last first; ``before`` stands before a text."""
    first = np.cumsum(lengths) - lengths
    out = np.full((len(units), CONTEXT), before, dtype=np.int64)
    for i in range(CONTEXT):
        out[i + 1:, i] = units[:max(0, len(units) - i - 1)]
        for k in range(i + 1):
            out[first[lengths > k] + k, i] = before
    return out


_PART = StructType([StructField("fold", IntegerType()), StructField("tasks", LongType()), StructField("state", BinaryType())])
_CODED = StructType([StructField("chunk", LongType()), StructField("payload", BinaryType())])


def _train(coded: DataFrame, model: Model, turn: int) -> Model:
    """One round: each task trains on the chunks of its turn from the same start. Each
    number is averaged over the tasks by how far its gradients took it there, so a word
    that few tasks meet keeps what these learned; sums are made in FOLDS parts."""
    start = model.state()
    half = len(start) // 2

    def learn(batches):
        task = TaskContext.get().partitionId()
        rng, own, met = np.random.default_rng([turn, task]), copy.deepcopy(model), False
        for batch in batches:
            for chunk, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (chunk + (chunk >> 32)) % ROUNDS != turn:
                    continue
                body = chunks.load(payload)
                units = body["units"].astype(np.int64)
                use = np.flatnonzero(np.repeat(body["held"] == 0, body["lengths"]))
                contexts = contexts_of(units, body["lengths"], own.units)
                use = rng.permutation(use)
                for at in range(0, len(use), STEP):
                    some = use[at:at + STEP]
                    own.step(contexts.take(some, axis=0), units.take(some), rng)
                met = met or len(use) > 0
        if met:
            end = own.state()
            moved = end[half:] - start[half:]
            yield pa.RecordBatch.from_arrays([pa.array([task % FOLDS], pa.int32()), pa.array([1]),
                                              pa.array([np.concatenate([moved * (end[:half] - start[:half]), moved]).tobytes()], pa.binary())], _PART.names)

    def add(batches):
        sums, total, fold = None, 0, 0
        for batch in batches:
            for f, n, state in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(state, "f4").astype("f8")
                sums, total, fold = part if sums is None else sums + part, total + n, f
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([total]), pa.array([sums.astype("f4").tobytes()], pa.binary())], _PART.names)

    whole = coded.mapInArrow(learn, _PART).repartition(FOLDS, "fold").mapInArrow(add, _PART).repartition(1).mapInArrow(add, _PART).first()
    if whole:
        sums = np.frombuffer(bytes(whole["state"]), "f4")
        step, moved = sums[:half], sums[half:]
        model.put(np.concatenate([start[:half] + np.divide(step, moved, out=np.zeros(half, "f4"), where=moved > 0), start[half:] + moved / whole["tasks"]]))
    return model


def fit(docs: DataFrame) -> tuple[DataFrame, Model, Vocabulary, int, int]:
    """The documents as chunks of units, the model, its vocabulary, and the tokens
    and distinct words that it has learned from."""
    rows = written(chunks.store(docs, _chunk))
    words, bodies = rows.where(F.col("bucket") != chunks.BODY), rows.where(F.col("bucket") == chunks.BODY)
    dictionary = written(chunks.by_bucket(words, _dictionary))
    tokens, distinct, vocabulary = _vocabulary(dictionary)

    def look_up(group):
        number: dict[bytes, int] = {}
        count = unit = np.zeros(0, dtype="<i8")
        for chunk, bucket, payload in group:
            part = chunks.load(payload)
            if chunk == chunks.DICTIONARY:
                number = {w: i for i, w in enumerate(part["words"])}
                count, unit = part["count"], np.array([vocabulary.unit(w) for w in part["words"]], dtype="<u4")
                continue
            at = np.array([number[w] for w in part["words"]], dtype=np.int64)
            yield chunk, bucket, chunks.dump({"count": count[at].astype("<i8"), "unit": unit[at].astype("<u4")})

    shares = np.zeros(vocabulary.units, dtype=bool)
    shares[vocabulary.shared] = True

    def code(chunk, body, values):
        count, unit = chunks.in_order(body, values, "count"), chunks.in_order(body, values, "unit")
        base = np.log10((count + 0.5) / (tokens + 0.5 * (distinct + 1)))
        inner = np.where(shares[unit], np.log10((count + 0.5) / (vocabulary.counts[unit] + 0.5 * (vocabulary.words_of[unit] + 1))), 0.0)
        stream = body["stream"]
        first = np.cumsum(body["lengths"]) - body["lengths"]
        kept = {k: body[k] for k in ("doc_id", "null", "held", "lengths")}
        kept |= {"units": unit[stream].astype("<u4"), "known": np.add.reduceat((count > 0)[stream], first, dtype="i8"),
                 "base": np.add.reduceat(base[stream], first), "inner": np.add.reduceat(inner[stream], first)}
        yield {"chunk": [chunk], "payload": [chunks.dump(kept)]}

    values = chunks.by_bucket(dictionary.union(words), look_up)
    coded = written(chunks.by_chunk(bodies, values, code, _CODED))
    model = Model(vocabulary)
    for turn in range(ROUNDS):
        model = _train(coded, model, turn)
    return coded, model, vocabulary, tokens, distinct


def judged(coded: DataFrame, model: Model, tokens: int) -> DataFrame:
    """The scores of documents that ``fit`` has coded."""
    def judge(batches):
        for batch in batches:
            for payload in batch.column(1).to_pylist():
                body = chunks.load(payload)
                units = body["units"].astype(np.int64)
                logs = model.log_probs(contexts_of(units, body["lengths"], model.units), units) / np.log(10)
                first = np.cumsum(body["lengths"]) - body["lengths"]
                ids = [None if x else int(i) for i, x in zip(body["doc_id"], body["null"], strict=True)]
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(body["held"].astype(bool)), pa.array(body["lengths"]),
                                                  pa.array(body["known"]), pa.array([tokens] * n, pa.int64()), pa.array(body["base"]),
                                                  pa.array(np.add.reduceat(logs, first) + body["inner"])], OUT.names)

    return coded.mapInArrow(judge, OUT)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Tokens are words in lower case (A-Z) and one end for each document; a null
    text is empty and has the end alone. The model tells units apart: frequent words,
    the more the larger the corpus, and for the rest of the words ranges of their order.
    A word's probability is its unit's, normalised over all units, times its share in
    a unit that words share, where words never seen have half a count. All tokens that
    may be learned from are learned from, once, and counted. Rows that repeat an id
    each have a row."""
    coded, model, _, tokens, _ = fit(docs)
    return judged(coded, model, tokens)
