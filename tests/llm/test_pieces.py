import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from runlens.llm import pieces, queries

MODEL = pieces.PIECE_BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def odd_texts(n=600):
    rnd = random.Random(11)
    signs = [" ", "  ", "\n", "a", "the", "Tree,", "▁", "\r", "\t", "é", "中", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "🙂", "it", "ing", "   ", ");", "　", "x", "=", " ",
             "�", "é", "ſ", "----", "0", "1999", "นี่", "ß", "𠀋"]
    texts = ["".join(rnd.choices(signs, k=rnd.choice([1, 2, 5, 50]))) for _ in range(n)]
    letters = ["".join(rnd.choices("abcdeinrstx", k=rnd.randint(1, 40))) for _ in range(n)]
    runs = [c * k for c in " x=-_a中▁" for k in (2, 3, 5, 7, 16, 17, 31, 64, 333, 1000)]
    return [None, "", " ", "\n", *texts, *letters, *runs, "".join(rnd.choices("abcdefghinrst", k=6000)), "".join(rnd.choices("的一是不了人我在有他", k=3000))]


def test_ids_and_texts_equal_the_library(spark, library):
    texts = odd_texts()
    rows = [(i if i != 7 else None, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = pieces.decoded(pieces.encoded(docs)).collect()
    want = [(i, tuple(ids := library.encode(t or "")), library.decode(ids)) for i, t, _ in rows]
    assert sorted(((r.doc_id, tuple(r.ids), r.text) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_the_heap_takes_up_where_rounds_stop(library, monkeypatch, rounds):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    own = pieces.Model(__import__("public_tokenizers").path(MODEL))
    texts = [t or "" for t in odd_texts(60)]
    import numpy as np
    got = [np.frombuffer(x, "<i4").tolist() for x in own.encode([t.encode() for t in texts])]
    assert got == library.encode(texts)


def test_any_ids_decode_as_the_library_decodes_them(library):
    rnd = random.Random(12)
    own = pieces.model(MODEL)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(195, 240), 1, 2, 259, 28705, 29871]) for _ in range(rnd.randint(0, 7))]
        assert own.decode(ids).decode() == library.decode(ids), ids


def test_a_long_run_and_a_long_word(spark, library):
    rnd = random.Random(13)
    texts = ["x" * 200_000, " " * 100_001, "".join(rnd.choices("ABCDEFGHabcdefgh0123456789+/", k=200_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in pieces.encoded(docs).collect()}
    assert all(got[i] == library.encode(t) for i, t in enumerate(texts))


def test_the_query_on_a_whole_table(spark, library, tmp_path):
    texts = odd_texts(40)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.op11_sentencepiece(spark, str(tmp_path)).collect()}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    ids = [library.encode(t or "") for t in texts]
    assert got == {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for i, x in enumerate(ids)}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.decoded(pieces.encoded(empty)).collect() == []
    assert spark.range(1).select(pieces.digest(F.array().cast("array<int>"))).first()[0] == hashlib.sha256(b"").hexdigest()
