import io
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from runlens.llm import frames, packing
from runlens.llm.shared import folder
from runlens.llm.tokens import WORD_BPE, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, _rank long, length string"


def corpus(spark):
    rnd = random.Random(4)
    words = ["the", "Tree,", "été", "naïve.", "I'm", "日本", "x1", "--", "<|endoftext|>", "\x00"]
    texts = [" ".join(rnd.choices(words, k=rnd.choice([1, 3, 40, 900]))) for _ in range(60)] + ["", None, "a " * 9000, "tie", "tie", "tie"]
    rows = [(i if i != 7 else None, t, "en", "s", 0, "p", 5, "l") for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 0, "p", 5, "l")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids_of(text, end):
    return np.array([*encoder(WORD_BPE).library.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4").tobytes()


def test_words_one_by_one_give_the_ids_of_whole_texts():
    rnd = random.Random(3)
    signs = ["a", "B", "É", "é", "'s", "'LL", " ", "\n", "\x0b", "\x1c", "9", "½", "ß", "İ", "H̱", "<|endoftext|>", "<|", "中", "🙂", ".", ",", "́",
             "\x00", " ", "_", "ǅ", "don't", "K", "ͅ"]
    e = encoder(WORD_BPE)
    for _ in range(3000):
        text = "".join(rnd.choices(signs, k=rnd.randint(0, 12)))
        assert np.frombuffer(e.ids([text.encode()])[0], "<u4").tolist() == e.library.encode(text, add_special_tokens=False).ids, text


def test_files_hold_all_documents_in_order(spark):
    rows, docs = corpus(spark)
    got = [tuple(r) for r in frames.stored(docs, WORD_BPE, end_id=2).orderBy("start").collect()]
    want, start = [], 0
    for doc_id, ids in sorted(((r[0], ids_of(r[1], 2)) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert got == want


def test_a_reader_opens_only_the_frames_of_a_document_and_sees_damage(monkeypatch):
    monkeypatch.setattr(frames, "FRAME_IDS", 100)
    out = io.BytesIO()
    writer = frames.Writer(out)
    docs = [(None, 3), (1, 0), (2, 60), (2, 60), (5, 1000), (9, 1)]
    for k, (doc, n) in enumerate(docs):
        writer.add(doc, struct.pack(f"<{n}I", *range(k, k + n)))
    writer.close()
    reader = frames.Reader(pa.BufferReader(out.getvalue()))
    for k, (_, n) in enumerate(docs):
        assert b"".join(reader.parts(k)) == struct.pack(f"<{n}I", *range(k, k + n))
    assert reader.rows_of(2).tolist() == [2, 3] and reader.rows_of(None).tolist() == [0] and reader.rows_of(4).size == 0
    opened = []
    frame = reader.frame
    reader.frame = lambda i: opened.append(i) or frame(i)
    reader.opened = (-1, b"")
    list(reader.parts(2))
    assert len(opened) == 1
    bad = bytearray(out.getvalue())
    bad[int(reader.place[1]) + 8] ^= 255
    with pytest.raises(Exception, match="damaged|decompress"):
        list(frames.Reader(pa.BufferReader(bytes(bad))).parts(3))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert frames.stored(docs, WORD_BPE, end_id=2).collect() == []
    assert packing.packed(docs, WORD_BPE, 64, 1).collect() == []
    assert frames.write(docs, folder(spark), WORD_BPE).collect() == []


@pytest.mark.parametrize("room", [64, 4096])
def test_packing_places_every_piece_without_gaps(spark, room):
    rows, docs = corpus(spark)
    got = packing.packed(docs, WORD_BPE, room, end_id=1).collect()
    want = []
    for r in rows:
        ids = ids_of(r[1], 1)
        want += [(r[0], k, at // 4, len(ids[at:at + 4 * room]) // 4, zlib.crc32(ids[at:at + 4 * room])) for k, at in enumerate(range(0, len(ids), 4 * room))]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    assert len(sequences) <= 1.05 * sum(r["length"] for r in got) / room + 2


def test_plans_use_each_length_as_often_as_it_occurs():
    rng = np.random.default_rng(5)
    for n, mean in ((1, 100), (500, 3000), (100_000, 700), (100_000, 20)):
        lengths = np.minimum(rng.geometric(1 / mean, n), 4096)
        histogram = np.bincount(lengths, minlength=4097)
        planned = packing.plan(histogram, 4096)
        used = np.zeros(4097, dtype=int)
        for pattern, repeats in planned:
            assert sum(x * k for x, k in pattern) <= 4096
            for x, k in pattern:
                used[x] += k * repeats
        assert (used == histogram).all()
        assert sum(r for _, r in planned) <= 1.01 * lengths.sum() / 4096 + n * (mean > 2048) / 5 + 1
