import math
import random
import re
from collections import Counter

import pytest

from runlens.llm import chunks, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text):
    return TERM.findall((text or "").translate(LOWER))


def plainly(docs, items, top=10):
    """Every document for every item."""
    counts = [(i, Counter(found(t))) for i, t in docs]
    lengths = [c.total() for _, c in counts]
    documents, total = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        scored = []
        for (i, c), n in zip(counts, lengths, strict=True):
            m = 10 + 90 * n * documents // max(1, total)
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(found(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdé中019", k=rnd.randint(1, 4))) for _ in range(80)] + ["The", "THE", "rare1", "rare2"]
    docs = [(i, rnd.choice([None, "", " .! "]) if rnd.random() < 0.1 else rnd.choice([" ", "_", "\x00", ". "]).join(rnd.choices(words, k=rnd.choice([1, 5, 40, 300]))))
            for i in range(n)]
    docs += docs[:30] + [(5, "rare1 rare2"), (None, docs[40][1]), (None, "rare1"), (n, "rare1"), (n + 1, "rare1")]
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 20])))) for k in range(40)]
    return docs, items + [(40, None), (41, ""), (42, "nowhere"), (43, "the the THE"), (0, items[0][1])]


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(3),
            spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string"))


@pytest.mark.parametrize(("owners", "bundle", "size", "most"), [(3, 256, 8 << 20, 1 << 14), (1, 7, 2000, 1 << 14), (4, 7, 8 << 20, 9)])
def test_the_best_equal_a_plain_search(spark, monkeypatch, owners, bundle, size, most):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", size)
    monkeypatch.setattr(search, "CHUNK_DOCS", most)
    docs, items = corpus(5)
    got = search.search(*frames(spark, docs, items), owners=owners, bundle=bundle)
    assert sorted(map(tuple, got.collect()), key=str) == plainly(docs, items)


def test_another_top_and_a_very_long_text(spark):
    docs, items = corpus(6, 60)
    docs.append((999, "rare1 the " * 150_000))
    got = search.search(*frames(spark, docs, items), top=3)
    assert sorted(map(tuple, got.collect()), key=str) == plainly(docs, items, 3)


def test_empty_tables(spark):
    docs, items = corpus(7, 50)
    assert search.search(*frames(spark, [], items)).collect() == []
    assert search.search(*frames(spark, docs, [])).collect() == []
