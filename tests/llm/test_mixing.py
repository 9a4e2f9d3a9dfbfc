import math
import random
import re

from runlens.llm import mixing


def corpus():
    rnd = random.Random(10)
    rows = []
    for i in range(900):
        source = rnd.choice(["big", "big", "big", "two", None, "three"])
        words = ["ab", "cd"] if source == "big" else ["émile", "übung\n"]
        rows.append((i if i != 4 else None, rnd.choice([" ", "\t\n"]).join(rnd.choices(words, k=rnd.randint(1, 60))), source, 0, "x"))
    rows[5] = (5, None, "two", 0, "x")
    rows[6] = (6, "", "rare", 0, "x")
    return rows + [rows[3]]


SCHEMA = "doc_id long, text string, source string, tokens int, rate string"


def plain(mixer, source, text):
    """Posterior, then rate, of one document."""
    text = text or ""
    words = len(re.findall(r"[^\x20\x09-\x0D]+", text))
    size = len(text.encode())
    x = [math.log1p(words), len(text) / max(1, words), (size - len(text)) / max(1, size), text.count("\n") / max(1, words)]
    count = len(mixer.names)
    own = mixer.names.index(source or "") if (source or "") in mixer.names else count - 1
    scores = []
    for k in range(count):
        s = math.log(mixer.prior[k]) + math.log(mixing.TRUST if k == own else (1 - mixing.TRUST) / (count - 1))
        s -= sum((v - m) ** 2 / (2 * d) + math.log(2 * math.pi * d) / 2 for v, m, d in zip(x, mixer.mean[k], mixer.spread[k]))
        scores.append(s)
    odds = [math.exp(s - max(scores)) for s in scores]
    p = [o / sum(odds) for o in odds]
    rate = max(1.0, mixer.least)
    for g in mixer.steps:
        rate = max(mixer.least, rate - sum(a * b for a, b in zip(p, g)))
    return words, p, rate


def test_rates_equal_brute_force_and_reach_the_targets(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 900, 2)] + [(2, 0), (None, 1)], "doc_id long, quality int")
    for power, targets, least in ((0.8, None, 1.0), (1.0, {"big": 9000.0, "two": 9000.0, "": 3000.0, "three": 5000.0}, 0.0)):
        mixer = mixing.fit(docs, labels, power, targets, least)
        got = mixing.rates(docs, mixer).select("row.doc_id", "row.text", "source", "tokens", "posterior", "rate", "copies").collect()
        assert len(got) == len(rows)
        sums = [0.0] * len(mixer.names)
        for r in got:
            words, p, rate = plain(mixer, r["source"], r["text"])
            assert r["tokens"] == words and abs(r["rate"] - rate) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(r["posterior"], p))
            assert rate >= least and r["copies"] in (math.floor(rate), math.floor(rate) + 1)
            sums = [s + words * a * rate for s, a in zip(sums, p)]
        for name, s, t in zip(mixer.names, sums, mixer.targets):
            if t and name != "rare":
                assert abs(s - t) <= 0.02 * t + 20, (name, s, t)
        kept = mixing.mixed(docs, mixer)
        assert kept.columns == docs.columns and kept.count() == sum(r["copies"] for r in got)


def test_no_rows_and_no_labels(spark):
    docs, labels = spark.createDataFrame(corpus()[:50], SCHEMA), spark.createDataFrame([], "doc_id long")
    assert mixing.mixed(docs, mixing.fit(docs, labels, 0.8, least=1.0)).count() >= 50
    empty = docs.limit(0)
    assert mixing.mixed(empty, mixing.fit(empty, labels, 0.8)).collect() == []
