"""SentencePiece encoding and decoding by vectorised merge rounds.

A text falls into pre-tokens that no piece reaches across. Of those that a task has
not met yet, all symbols stand in one flat array. A round finds the least rank of a
pair in each word, merges the leftmost pairs of that rank in all words at once, and
closes the gaps; it ends when no word has a pair left. A merge may make a pair of no
higher rank, which must then go first: where the piece can do so (``Model.early``),
a word's round merges its leftmost pair only. Words with pairs left after ``ROUNDS``
rounds (runs of thousands of equal signs, long words of a script without spaces) take
the remaining merges, in the same order, from a heap."""

from __future__ import annotations

import heapq
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from runlens.llm.counts import PIECE_BPE, pre_tokens
from runlens.llm.shared import by_batch, raw_texts, whole

ROUNDS = 256
#: Words that one Python worker keeps the ids of.
KEPT_WORDS = 500_000
#: Rows that are encoded together; their new words share the rounds.
ROWS = 512
_MARK = "▁"
_NONE = np.iinfo(np.int32).max
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Model:
    """The merges of a byte-pair model with byte fallback and an identity normaliser."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        rules, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or not plain or kinds - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("only byte-pair models with byte fallback and an identity normaliser")
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        if any(_MARK in p.lstrip(_MARK) or "\n" in p for p in ids):
            raise ValueError("pieces reach across spaces or lines")
        self.size = len(proto.pieces)
        scores = np.array([p.score for p in proto.pieces])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        made = {ids[p[:k]] * self.size + ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs = np.array([*sorted(made), np.iinfo(np.int64).max], dtype=np.int64)
        self.merged = np.array([*(made[k] for k in sorted(made)), -1], dtype=np.int64)
        #: Pieces that are part of one of no higher rank.
        self.early = np.zeros(self.size, dtype=bool)
        for side in (self.pairs[:-1] // self.size, self.pairs[:-1] % self.size):
            self.early[side[self.rank[self.merged[:-1]] <= self.rank[side]]] = True
        #: A character's id; one that is no piece has minus one less its code point.
        self.of_char = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = ids[_MARK]
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.of_byte = [byte[b] for b in range(256)]
        self.bytes = {i: bytes([b]) for b, i in byte.items()}
        shown = {_UNKNOWN: proto.trainer_spec.unk_surface, _CONTROL: ""}
        self.surface = [self.bytes.get(i) or shown.get(p.type, p.piece.replace(_MARK, " ")).encode() for i, p in enumerate(proto.pieces)]
        self.silent = [i for i, x in enumerate(self.surface) if not x]
        self.known: dict[bytes, bytes] = {}

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.pairs, keys)
        return np.where(self.pairs[at] == keys, self.merged[at], -1)

    def _heap(self, sym: list[int]) -> list[int]:
        """All merges of one word, least rank first and leftmost of equal ones."""
        after = [*range(1, len(sym)), -1]
        before = [*range(-1, len(sym) - 1)]
        made = dict(zip(self.pairs[:-1].tolist(), self.merged[:-1].tolist(), strict=True))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (m := made.get(sym[i] * self.size + sym[j])) is not None:
                heapq.heappush(queue, (int(self.rank[m]), i, sym[i], sym[j], m))

        gone = [False] * len(sym)
        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while queue:
            _, i, a, b, m = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = m, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s, x in zip(sym, gone, strict=True) if not x]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that are left of all ``words``, and the number of the word of each."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # a pair is kept with its left symbol; the last symbol of a word has none
        made = np.append(np.where(word[1:] == word[:-1], self.joined(sym[:-1], sym[1:]), -1), -1)[:len(sym)]
        rank = np.where(made >= 0, self.rank[made], _NONE)
        for _ in range(ROUNDS):
            if not len(sym):
                break
            first = np.flatnonzero(np.diff(word, prepend=-1))
            length = np.diff(first, append=len(sym))
            least = np.minimum.reduceat(rank, first)
            if (least == _NONE).any():
                live = np.repeat(least != _NONE, length)
                done.append((word[~live], sym[~live]))
                sym, word, made, rank = sym[live], word[live], made[live], rank[live]
                length, least = length[least != _NONE], least[least != _NONE]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, length))
            run = np.diff(at, prepend=-2) != 1
            start = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - start) % 2 == 0]
            of = word[at]
            head = np.diff(of, prepend=-1) != 0
            # one pair that may give way to an earlier one holds the others of its word back
            held = np.logical_or.reduceat(self.early[made[at]], np.flatnonzero(head))
            at = at[head | ~np.repeat(held, np.diff(np.flatnonzero(head), append=len(at)))]
            sym[at] = made[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
            new = place[at]
            new = np.concatenate([new, new[new > 0] - 1])
            right = np.minimum(new + 1, len(sym) - 1)
            made[new] = np.where((word[new] == word[right]) & (right > new), self.joined(sym[new], sym[right]), -1)
            rank[new] = np.where(made[new] >= 0, self.rank[made[new]], _NONE)
        if len(sym):
            for part in np.split(np.arange(len(sym)), np.flatnonzero(np.diff(word)) + 1):
                left = np.array(self._heap(sym[part].tolist()), dtype=np.int64)
                done.append((np.full(len(left), word[part[0]]), left))
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def learn(self, words: set[bytes]) -> None:
        """Puts the ids of all ``words`` into ``known``."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list(words)
        if not new:
            return
        sym, word = self.merge([w.decode("utf-8", "replace") for w in new])
        odd = sym < 0
        if odd.any():
            spread = [[self.of_byte[b] for b in chr(-1 - s).encode("utf-8", "replace")] for s in sym[odd].tolist()]
            sizes = np.ones(len(sym), dtype=np.int64)
            sizes[odd] = [len(x) for x in spread]
            word, sym = np.repeat(word, sizes), np.repeat(sym, sizes)
            sym[np.repeat(odd, sizes)] = [i for x in spread for i in x]
        ids = sym.astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(new)))).tolist()
        self.known.update(zip(new, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers, without begin or end."""
        split = [pre_tokens(t) for t in texts]
        self.learn(set().union(*split))
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        """The text of ids. One space that leads the first piece goes; control pieces are
        empty; bytes that are no UTF-8 become replacement characters, one each."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids])
        first = next((i for i in ids if surface[i]), None)
        strip = first is not None and first not in self.bytes and surface[first].startswith(b" ")
        try:
            whole_text = not any(i in ids for i in self.silent)
            text.decode()
        except UnicodeDecodeError:
            whole_text = False
        if not whole_text:
            parts: list[bytes] = []
            run = b""
            for i in ids:
                if i in self.bytes:
                    run += self.bytes[i]
                else:
                    parts += [_valid(run), surface[i]]
                    run = b""
            text = b"".join([*parts, _valid(run)])
        return text[1:] if strip else text


def _valid(raw: bytes) -> bytes:
    """A run of byte pieces: characters where they are whole, else a mark for each byte."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode().encode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


@lru_cache(maxsize=2)
def model(name: str) -> Model:
    """One for each Python worker; ``name`` is a public tokenizer's or a path."""
    return Model(name if os.sep in name else public_tokenizers.path(name))


def encoded(docs: DataFrame, name: str = PIECE_BPE) -> DataFrame:
    """``doc_id, ids`` (an array of int) for each row of ``docs``, as the library encodes
    its whole text without begin or end.

    A null text is empty and has no ids. Rows that repeat an id, or have none, each
    have a row; other columns are not read. A text of any length is one row."""
    id_type = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), StructField("ids", ArrayType(IntegerType()))])

    def make(batch):
        ids = model(name).encode(raw_texts(batch))
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
        yield {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), values)}

    return by_batch(docs.select("doc_id", whole(F.col("text")).alias("text")), make, schema, rows=ROWS)


def decoded(rows: DataFrame, name: str = PIECE_BPE, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with one more column, the text of their ``ids``; null ids give the empty text."""
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    schema = StructType([StructField("row", rows.schema), StructField("decoded", StringType())])

    def make(batch):
        library = model(name)
        lists = batch.column(1).to_pylist()
        yield {"row": batch.column(0), "decoded": pa.array([library.decode(x or []).decode("utf-8", "replace") for x in lists], pa.string())}

    done = by_batch(rows.select(row.alias("row"), F.col(f"`{ids}`").alias("ids")), make, schema, rows=ROWS)
    return done.select("row.*", F.col("decoded").alias(text))


def digest(ids: Column) -> Column:
    """The hex SHA-256 of the ids in decimal, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
