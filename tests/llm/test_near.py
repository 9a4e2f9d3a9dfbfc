import random
from itertools import combinations

import corpus_pipeline
from runlens.llm import near


def sets(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def least_of_groups(texts):
    """The least number of each group of texts that similar pairs link, by brute force."""
    own = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if own[i] == own[j] or len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]) > 0:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {find(i) for i in range(len(texts))}


def copies(rnd, n_base=25):
    words = ["".join(rnd.choices("abcdefgé", k=rnd.randint(2, 6))) for _ in range(3000)]
    texts = [None, "", "one", "Two words", "two  WORDS"]
    for k in range(n_base):
        base = rnd.choices(words, k=rnd.choice([5, 9, 40, 150, 600]))
        texts.append(" ".join(base))
        for _ in range(60 if k == 3 else 8):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 20))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
        texts.append(" ".join(base + ["tail"]))
    return texts


def test_every_similar_pair_is_linked_and_no_other(spark):
    texts = copies(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r[0] for r in got.collect()) == sorted(least_of_groups(texts))


def test_a_near_copy_of_many_differing_bits_goes(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choices("abcdefg", k=5)) for _ in range(200)]
    copy = base[:60] + ["x", "y", "z"] + base[60:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(base[:100]))], "doc_id long, text string")
    assert sorted(r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_empty_table(spark):
    assert near.unique(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_that_share_an_id_each_keep_a_row(spark):
    rnd = random.Random(9)
    a, b = (" ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(100)) for _ in range(2))
    rows = [(5, a), (7, a + " end"), (5, b), (9, b + " end"), (5, b), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str) == sorted([(5, a), (5, b), (None, b)], key=str)


def own_edits(n, words, edits, seed):
    """Copies of one text, each with edits of its own."""
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdefg", k=5)) for _ in range(words)]
    texts = []
    for k in range(n):
        copy = list(base)
        for i, at in enumerate(rnd.sample(range(5, words - 5), edits)):
            copy[at] = f"own{k}x{i}"
        texts.append(" ".join(copy))
    return texts


def joined_rows(spark, texts, monkeypatch):
    """Rows that the joins pass on to be verified, and the groups."""
    sent = []
    verified = near._verified

    def counted(pairs, nodes, docs):
        sent.append(pairs.count())
        return verified(pairs, nodes, docs)

    with monkeypatch.context() as m:
        m.setattr(near, "_verified", counted)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        found = near.groups(docs).select("doc_id", "root").collect()
    return sent, found


def test_a_group_of_copies_with_edits_of_their_own_costs_its_rows(spark, monkeypatch):
    small, _ = joined_rows(spark, own_edits(150, 120, 3, 1), monkeypatch)
    large, found = joined_rows(spark, own_edits(300, 120, 3, 1), monkeypatch)
    assert large[0] <= near.HEADS * 300 and small[0] <= near.HEADS * 150
    assert all(b <= 2 * a + 5 for a, b in zip(small[1:], large[1:], strict=True))
    assert len({r.root for r in found}) == 300  # two copies share 101 of 131 shingles: none is linked


def test_groups_of_copies_with_few_and_many_edits_are_whole(spark, monkeypatch):
    texts = own_edits(120, 80, 1, 2) + own_edits(120, 80, 2, 2) + own_edits(60, 80, 4, 2)
    sent, found = joined_rows(spark, texts, monkeypatch)
    root = {r.doc_id: r.root for r in found}
    assert len(least_of_groups(texts)) == len(set(root.values()))
    assert sum(sent) < 20 * len(texts)


def test_clashing_columns_and_a_very_long_text(spark):
    rnd = random.Random(10)
    long = " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(60_000))
    rows = [(1, long, "a", 1), (2, long + " end", "b", 2), (3, None, "c", 3), (4, "other", "d", 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, root string, node long").withColumnRenamed("root", "keys")
    got = near.unique(docs)
    assert got.columns == ["doc_id", "text", "keys", "node"] and sorted(r[0] for r in got.collect()) == [1, 3, 4]


def test_simhash_chains_make_candidates(spark):
    """Texts whose fingerprints differ in three bits at most are connected by candidate pairs, and no other."""
    from pyspark.sql import functions as F
    from runlens.llm import components, simhash
    rnd = random.Random(8)
    texts = copies(rnd, 12)
    base = [f"w{rnd.randrange(900)}" for _ in range(800)]
    texts += [" ".join(base[:i] + ["new"] + base[i:]) for i in range(0, 800, 60)]
    nodes = near.prints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).withColumn("node", F.col("doc_id"))
    pairs = {(min(r), max(r)) for r in near._simhashed(nodes.where("n > 0")).collect()}
    prints = {i: simhash.fingerprint((t or "").encode(), near.WORDS) for i, t in enumerate(texts) if (t or "").split()}
    close = [(a, b) for a, b in combinations(prints, 2) if ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= simhash.TOLERANCE]
    assert pairs <= set(close) and any(prints[a] != prints[b] for a, b in close)
    root = lambda some: {tuple(r) for r in components.roots(spark.createDataFrame(sorted(some), "u long, v long")).collect()}
    assert root(pairs) == root(close)
