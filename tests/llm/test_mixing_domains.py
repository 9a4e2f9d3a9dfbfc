import math
import random

import pytest
from runlens.llm import mixing

from test_mixing import SCHEMA, plain


def held(docs, labels, targets, rows):
    """Fits; each row's posterior and rate must equal plain arithmetic, and the domains' tokens their targets."""
    mixer = mixing.fit(docs, labels, 1.0, targets)
    got = mixing.rates(docs, mixer).select("row.text", "source", "tokens", "posterior", "rate").collect()
    assert len(got) == len(rows)
    sums = [0.0] * len(mixer.names)
    for r in got:
        words, p, rate = plain(mixer, r["source"], r["text"])
        assert r["tokens"] == words and math.isclose(r["rate"], rate, abs_tol=1e-9) and all(abs(a - b) < 1e-9 for a, b in zip(r["posterior"], p))
        sums = [s + words * a * rate for s, a in zip(sums, p)]
    return mixer, dict(zip(mixer.names, sums))


def test_unlabelled_hot_source_is_a_domain_of_its_own(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choices(["ab", "cd"] if i % 3 else ["\u00e9mile"], k=rnd.randint(5, 40))), "ab"[i % 2] if i % 3 else "hot", 0, "x") for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i,) for i in range(600) if i % 3], "doc_id long")
    targets = {"a": 3000.0, "b": 2500.0, "hot": 9000.0}
    mixer, sums = held(docs, labels, targets, rows)
    assert sorted(mixer.names) == ["a", "b", "hot"]
    assert all(abs(sums[k] - t) <= 0.02 * t for k, t in targets.items())
    with pytest.raises(ValueError, match="nowhere"):
        mixing.fit(docs, labels, 1.0, {"nowhere": 1.0})


def test_forty_sources_keep_their_own_domains_and_targets(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["ab", "cdef"], k=rnd.randint(5, 60))), f"s{i % 40}", 0, "x") for i in range(800)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i,) for i in range(800) if i % 40 != 7], "doc_id long")
    targets = {f"s{k}": 700.0 for k in range(40)}
    mixer, sums = held(docs, labels, targets, rows)
    assert sorted(mixer.names) == sorted(targets)
    assert all(abs(sums[k] - 700) <= 0.03 * 700 for k in targets)
