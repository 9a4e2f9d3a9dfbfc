import random
import re

import numpy as np
from runlens.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def corpus():
    rnd = random.Random(9)
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "x\n\nx\nx", "é# 中| \x1c\x85 $$"]
    labels = []
    for i in range(160):
        good = i % 3 > 0
        words = ["ab", "cde", "fghé", "Ij."] if good else ["ab#", "$$", "CD|"]
        texts.append(rnd.choice([" ", "\n"]).join(rnd.choices(words + [str(i)], k=rnd.randint(1, 150))))
        labels.append((len(texts) - 1, int(good)))
    return [(i if i != 9 else None, t, "c", 1) for i, t in enumerate(texts)] + [(4, texts[4], "c", 1)], labels + labels[:3] + [(None, 1), (2, None), (9999, 0)]


def test_counts_equal_brute_force_and_bad_texts_go(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int").repartition(3)
    trees = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.judge(docs, trees).select("row.doc_id", *quality.COUNTS, "base_failed", "kept").collect()
    want = []
    for i, t, _, _ in rows:
        c = plain(t or "")
        want.append((i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted(want, key=str)
    good = dict(labels)
    long_ones = [r for r in got if r["doc_id"] in good and not r["base_failed"]]
    assert long_ones and all(r["kept"] == bool(good[r["doc_id"]]) for r in long_ones)
    assert not any(r["kept"] for r in got if r["base_failed"])


def test_scores_never_rise_with_a_falling_feature():
    rng = np.random.default_rng(3)
    x = rng.random((1500, len(quality.FEATURES)))
    y = ((x[:, quality.FALLING[0]] < 0.5) ^ (rng.random(1500) < 0.2) ^ (x[:, 0] > 0.8)).astype(float)
    trees = quality.grow(x, y)
    for j in quality.FALLING:
        some = np.repeat(x[:50], 30, axis=0)
        some[:, j] = np.tile(np.linspace(0, 1, 30), 50)
        assert (np.diff(trees.score(some).reshape(50, 30), axis=1) <= 1e-12).all()


def test_without_labels_the_base_rule_decides(spark):
    docs = spark.createDataFrame([(1, "w " * 60 + "a b"), (2, " ".join(map(str, range(70))))], "doc_id long, text string")
    trees = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert trees is None
    assert sorted(map(tuple, quality.judge(docs, trees).select("row.doc_id", "kept").collect())) == [(1, False), (2, True)]
    assert quality.judge(docs.limit(0), None).collect() == []


def test_scores_equal_a_walk_from_node_to_node():
    rng = np.random.default_rng(4)
    x = np.round(rng.random((700, len(quality.FEATURES))), 2)  # ties with thresholds
    trees = quality.grow(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    assert len(trees.leaf) == quality.TREES
    got = trees.score(x)
    for i in range(0, 700, 50):
        total = trees.start
        for t in range(quality.TREES):
            node = 0
            while node < 2 ** quality.DEPTH - 1:
                node = 2 * node + (2 if x[i, trees.feature[t, node]] > trees.threshold[t, node] else 1)
            total += trees.leaf[t, node - (2 ** quality.DEPTH - 1)]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-12


def test_a_very_long_text_is_counted_whole(spark):
    lines = [f"w{i} é w{i} #" for i in range(120_000)]
    text = "\n".join(lines + lines[:5] + ["x"])
    got = quality.judge(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string"), None)
    by_id = {r["doc_id"]: tuple(r)[1:] for r in got.select("row.doc_id", *quality.COUNTS).collect()}
    words = [w for line in lines + lines[:5] for w in line.split(" ")] + ["x"]
    seen, twice = {}, set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if w in seen:
            twice |= {i, i + 1, i + 2, seen[w], seen[w] + 1, seen[w] + 2}
        seen.setdefault(w, i)
    assert by_id[1] == (len(words), sum(map(len, words)), 120_005, 5, len(twice)) and by_id[2][0] == 1
