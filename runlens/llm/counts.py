"""Token counts from pre-tokens: pieces counted once per distinct pre-token."""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from runlens.llm import chunks
from runlens.llm.shared import written

PIECE_BPE = "piece_bpe_32k.model"
#: A run of spaces with what follows, a line end, or what follows a line end.
_PRE = re.compile(rb"\n| +[^ \n]*|[^ \n]+")
_MARK = "▁".encode()

OUT = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()),
                  StructField("over_limit", BooleanType())])


def pre_tokens(text: bytes) -> list[bytes]:
    """Parts of a text that no piece of the model reaches across.

    No piece has a space after another sign or a line end inside, so merges stop
    there. The model puts a space before a text and takes its own space mark in a
    text for a space; both are done here first."""
    if not text:
        return []
    text = b" " + (text.replace(_MARK, b" ") if _MARK in text else text)
    return _PRE.findall(text)


@lru_cache(maxsize=2)
def model(name: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=name if os.sep in name else public_tokenizers.path(name))
    odd = [p for p in (sp.id_to_piece(i) for i in range(sp.get_piece_size())) if "▁" in p.lstrip("▁") or "\n" in p]
    if odd:
        raise ValueError(f"pieces reach across spaces or lines: {odd[:3]}")
    return sp


def count_pieces(name: str, words: list[bytes]) -> list[int]:
    """After a line end a pre-token stands as it does inside a text; that costs two pieces."""
    sp = model(name)
    out: list[int] = []
    for at in range(0, len(words), 4096):
        out += [len(ids) - 2 for ids in sp.encode(["\n" + w.decode("utf-8", "replace") for w in words[at:at + 4096]], num_threads=1)]
    return out


def _chunk(ids: list, texts: list[bytes]) -> tuple[dict, list[bytes], dict]:
    """Pre-token frequencies of each document, by numbers of the chunk's dictionary,
    of which frequent ones are low."""
    each = [Counter(pre_tokens(t)) for t in texts]
    spread: Counter = Counter()
    for found in each:
        spread.update(found.keys())
    number = {w: i for i, (w, _) in enumerate(spread.most_common())}
    where, times = [], []
    for found in each:
        at = np.fromiter((number[w] for w in found), dtype=np.int64, count=len(found))
        n = np.fromiter(found.values(), dtype=np.int64, count=len(found))
        order = np.argsort(at)
        where.append(np.diff(at[order], prepend=0).astype("<u4"))
        times.append(n[order].astype("<u4"))
    none = np.zeros(0, dtype="<u4")
    body = {"doc_id": np.array([i or 0 for i in ids], dtype="<i8"), "null": np.array([i is None for i in ids], dtype="u1"),
            "n_bytes": np.array([len(t) for t in texts], dtype="<i8"), "distinct": np.array([len(x) for x in each], dtype="<i8"),
            "where": np.concatenate([none, *where]), "times": np.concatenate([none, *times])}
    return body, list(number), {}


def count(docs: DataFrame, model_name: str = PIECE_BPE, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Equals the library's count of each whole text without begin or end; a null
    text is empty and has none. Rows that repeat an id each have a row, and other
    columns are not read. A text of any length is one row of its chunk."""
    rows = written(chunks.store(docs, _chunk))

    def pieces(group):
        known: dict[bytes, int] = {}
        for chunk, bucket, payload in group:
            words = chunks.load(payload)["words"]
            new = [w for w in words if w not in known]
            known.update(zip(new, count_pieces(model_name, new), strict=True))
            yield chunk, bucket, chunks.dump({"n": np.array([known[w] for w in words], dtype="<u4")})

    def total(chunk, body, values):
        n = chunks.in_order(body, values, "n").astype(np.int64)
        ends = np.cumsum(body["distinct"])
        starts = ends - body["distinct"]
        # the numbers are written as steps from the one before, anew in each document
        run = np.cumsum(body["where"].astype(np.int64))
        base = np.where(starts > 0, run[np.maximum(starts, 1) - 1] if len(run) else 0, 0)
        at = run - np.repeat(base, body["distinct"])
        sums = np.concatenate([[0], np.cumsum(n[at] * body["times"])])
        tokens = sums[ends] - sums[starts]
        null = body["null"].astype(bool)
        yield {"doc_id": [None if x else int(i) for i, x in zip(body["doc_id"], null, strict=True)], "n_bytes": body["n_bytes"],
               "n_tokens": tokens, "over_limit": tokens > limit}

    values = chunks.by_bucket(rows.where(F.col("bucket") != chunks.BODY), pieces)
    return chunks.by_chunk(rows.where(F.col("bucket") == chunks.BODY), values, total, OUT)
