import random

from runlens.llm import counts


def test_counts_equal_the_library(spark):
    rnd = random.Random(6)
    signs = [" ", "  ", "\n", "a", "the", "Tree,", "▁", "\r", "\t", "é", "中", "<s>", "</s>", "<0x0A>", "\x00", "🙂", "it", "ing", "   ", ");", "　"]
    texts = ["".join(rnd.choices(signs, k=rnd.choice([0, 1, 2, 5, 50]))) for _ in range(400)] + [None, "", " ", "x" * 50_000, "the " * 9000, " \n \n"]
    rows = [(i if i != 5 else None, t, "z") for i, t in enumerate(texts)] + [(3, texts[3], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    sp = counts.model(counts.PIECE_BPE)
    want = [(i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in rows]
    assert sorted(map(tuple, counts.count(docs).collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert counts.count(spark.createDataFrame([], "doc_id long, text string")).collect() == []
