import math
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
from runlens.llm import lm


def corpus(n=300):
    rnd = random.Random(8)
    pairs = [(f"W{i}", f"v{i}é") for i in range(40)]
    texts = [" ".join(f"{a}\t{b}" for a, b in rnd.choices(pairs, k=rnd.randint(0, 120))) for _ in range(n)]
    texts[3:6] = [None, "", "only here"]
    return [(i if i != 8 else None, t, 1.0) for i, t in enumerate(texts)] + [(1, texts[1], 1.0)]


def test_base_scores_equal_brute_force_and_the_model_learns(spark):
    rows = corpus()
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)).collect()
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["<end>"] for _, t, _ in rows]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _, _ in rows]
    count = Counter(w for ws, h in zip(tokens, held) if not h for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = [(i, h, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws), 6))
            for (i, _, _), ws, h in zip(rows, tokens, held)]
    assert sorted([(*tuple(r)[:5], round(r["base_score"], 6)) for r in got], key=str) == sorted(want, key=str)
    new = [r for r in got if r["held_out"]]
    assert new and sum(r["score"] for r in new) > 0.8 * sum(r["base_score"] for r in new)


def vocabulary(n):
    return lm.Vocabulary([(f"w{i * 7919 % 100003:06d}".encode(), 1 + 100000 // (i + 1)) for i in range(n)])


def test_every_word_has_a_unit_and_rows_are_dealt_evenly():
    v = vocabulary(2000)
    assert v.heads == lm.HEADS and v.groups == lm.GROUPS and v.units == 2000 + lm.GROUPS and len(set(v.number.values())) == 2000
    assert not set(v.number.values()) & set(v.shared.tolist())
    sizes = np.diff(v.starts)
    assert sizes.max() - sizes.min() <= 1
    for word in (b"", b"a", b"w0500005", b"zz", b"\xff"):
        assert v.unit(word) in v.shared
        assert sum(w <= word for w in v.bounds) == v.shared.tolist().index(v.unit(word))
    many = vocabulary(20000)
    assert many.groups > lm.GROUPS and many.units == 20000 + many.groups  # both levels grow
    for few in (0, 1, lm.HEADS, lm.HEADS + 1):
        v = vocabulary(few)
        assert (v.groups, v.units) == (1, few + 1) and v.unit(b"other") == v.shared[0]


def test_probabilities_sum_to_one():
    for n in (0, 50, 700):
        v = vocabulary(n)
        model = lm.Model(v)
        rng = np.random.default_rng(1)
        for _ in range(3):
            model.step(rng.integers(0, v.units + 1, (500, lm.CONTEXT)), rng.integers(0, v.units, 500), rng)
        contexts = np.repeat(rng.integers(0, v.units + 1, (5, lm.CONTEXT)), v.units, axis=0)
        p = np.exp(model.log_probs(contexts, np.tile(np.arange(v.units), 5)))
        assert np.allclose(p.reshape(5, -1).sum(axis=1), 1, atol=1e-4)


def test_a_large_step_equals_its_plain_form():
    """The gradients of blocks and sums by row, against a loop over tokens, from the same noise."""
    v = vocabulary(400)
    rng = np.random.default_rng(5)
    contexts, targets = rng.integers(0, v.units + 1, (300, lm.CONTEXT)), rng.integers(0, v.units, 300)
    drawn = []
    fast = lm.Model(v)
    draw = fast._draw
    fast._draw = lambda *a: drawn.append(draw(*a)) or drawn[-1]
    plain = lm.Model(v)
    fast.step(contexts, targets, np.random.default_rng(6))
    order = np.argsort(plain.top[targets], kind="stable")
    outer, inner = np.zeros_like(plain.outer, "f8"), np.zeros_like(plain.inner, "f8")
    seen_in_group, block = Counter(), -1
    for i in order:
        t, c = targets[i], contexts[i]
        q = plain.query(c[None])[0].astype("f8")
        tests = [(plain.top[t], drawn[0][0], lm.NOISE)]
        if t >= v.heads:
            block += seen_in_group[plain.top[t]] % lm.BLOCK == 0
            seen_in_group[plain.top[t]] += 1
            tests.append((t + v.groups, drawn[1][block], lm.GROUP_NOISE))
        d_q = 0
        for row, noise, k in tests:
            for r, real in [(row, 1), *((r, 0) for r in noise)]:
                x = q @ plain.outer[r] + plain.bias[r] - math.log(k * plain.noise[r])
                d = 1 / (1 + math.exp(-x)) - real
                outer[r] += d * q
                d_q = d_q + d * plain.outer[r]
        for at in range(lm.CONTEXT):
            inner[c[at]] += d_q * plain.weight[at]
    for name, grad in (("outer", outer), ("inner", inner)):
        g = grad / math.sqrt(300)
        want = getattr(plain, name) - lm.RATE * g / np.sqrt(1e-2 + g * g)
        assert np.allclose(getattr(fast, name), want, atol=1e-4)


def test_scores_equal_a_plain_recomputation(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEADS", 10)  # so that this small corpus has groups
    rnd = random.Random(3)
    words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(600)]
    texts = [" ".join(rnd.choices(words, weights=[1 / (i + 1) for i in range(600)], k=rnd.randint(0, 60))) for _ in range(150)]
    coded, model, v, tokens, _ = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert v.groups > 1 and v.words_of.sum() > 0
    count = Counter(w for i, t in enumerate(texts) if not lm.held_out(i) for w in [*t.encode().split(), lm.END])
    assert tokens == sum(count.values())
    units = {w: v.unit(w) for w in {w for t in texts for w in [*t.encode().split(), lm.END]}}
    shared = {u: [count[w] for w in count if units[w] == u] for u in v.shared.tolist()}
    got = {r["doc_id"]: r["score"] for r in lm.judged(coded, model, tokens).collect()}

    def log_p(row, low, high, q):
        scores = [float(q @ model.outer[r] + model.bias[r]) for r in range(low, high)]
        return scores[row - low] - math.log(sum(map(math.exp, scores)))

    for i in range(0, 150, 10):
        stream, want = [units[w] for w in [*texts[i].encode().split(), lm.END]], 0.0
        for at, (word, unit) in enumerate(zip([*texts[i].encode().split(), lm.END], stream)):
            before = [stream[at - k - 1] if at > k else model.units for k in range(lm.CONTEXT)]
            q = sum(model.inner[c].astype("f8") * model.weight[k] for k, c in enumerate(before))
            want += log_p(int(model.top[unit]), 0, model.tops, q)
            if unit >= v.heads:
                group = int(model.top[unit]) - v.heads
                want += log_p(unit + v.groups, int(model.starts[group]), int(model.starts[group + 1]), q)
            if unit in shared:
                want += math.log((count[word] + 0.5) / (sum(shared[unit]) + 0.5 * (len(shared[unit]) + 1)))
        assert abs(got[i] - want / math.log(10)) < 1e-3 * max(1, len(stream))


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_very_long_text_and_rows_without_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(0, long, "a"), (2, None, "b"), (3, "w1\x0bW2", "c"), (3, "w1\x0bW2", "c")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(0, 400_001), (2, 1), (3, 3), (3, 3)]
    assert all(math.isfinite(r["score"]) for r in got)
    twice = [r for r in got if r["doc_id"] == 3]
    assert twice[0] == twice[1]


def test_a_step_moves_each_number_by_its_gradient_and_leaves_its_tokens_alone():
    v = vocabulary(400)
    rng = np.random.default_rng(5)
    contexts, targets = rng.integers(0, v.units + 1, (300, lm.CONTEXT)), rng.integers(0, v.units, 300)
    before, model = lm.Model(v), lm.Model(v)
    given = contexts.copy(), targets.copy()
    model.step(contexts, targets, rng)
    assert (contexts == given[0]).all() and (targets == given[1]).all()
    for name in lm.Model.NAMES:
        squares = model.seen[name].astype("f8") - 1e-2
        assert squares.max() > 0 and squares.min() > -1e-7
        moved = np.abs(getattr(model, name) - getattr(before, name))
        assert np.allclose(moved, lm.RATE * np.sqrt(np.maximum(squares, 0) / model.seen[name]), atol=1e-3)


def test_normalising_in_small_blocks_equals_one_block(monkeypatch):
    model = lm.Model(vocabulary(400))
    rng = np.random.default_rng(4)
    q = rng.normal(0, 2, (1000, lm.WIDTH)).astype("f4")
    plain = q.astype("f8") @ model.outer[:model.tops].T + model.bias[:model.tops]
    want = np.log(np.exp(plain - plain.max(axis=1)[:, None]).sum(axis=1)) + plain.max(axis=1)
    for scores in (1, 1 << 16, 1 << 30):
        monkeypatch.setattr(lm, "SCORES", scores)
        assert np.allclose(model._log_z(q, 0, model.tops), want, atol=1e-4)
    for numbers in ([], [3, 1, 3, 0], [70000, 1, 70000, 2]):
        assert lm._order(np.array(numbers, dtype=np.int64)).tolist() == sorted(range(len(numbers)), key=lambda i: numbers[i])


def test_a_chunk_equals_its_plain_form_and_makes_no_object_for_a_token():
    texts = [b" A b\t\tA\x0b", b"", b" \n", b"\xff\xfe q\x00r Q\x1cq \xc2\x85 \xc3\x89\xc2\xa0x", b"b", b"\x0c b a"]
    for some in (texts, texts[1:3], texts[4:5]):
        ids = [None, 7, 3, 3, 11, 12][:len(some)]
        body, words, beside = lm._chunk(ids, some)
        want = [[*t.lower().split(), lm.END] for t in some]
        assert body["lengths"].tolist() == [len(w) for w in want]
        assert [words[i] for i in body["stream"]] == [w for ws in want for w in ws]
        assert len(set(words)) == len(words) and (np.diff(np.bincount(body["stream"])) <= 0).all()
        learned = Counter(w for i, ws in zip(ids, want) if not lm.held_out(i) for w in ws)
        assert dict(zip(words, beside["learned"].tolist())) == {w: learned[w] for w in words}
    text, tokens = b"one two three " * 200_000, 600_001
    before, most = sys.getallocatedblocks(), 0

    def watch(frame, event, arg):
        nonlocal most
        most = max(most, sys.getallocatedblocks() - before)

    sys.setprofile(watch)
    try:
        body, _, _ = lm._chunk([1], [text])
    finally:
        sys.setprofile(None)
    assert len(body["stream"]) == tokens and most < tokens / 10


def test_sums_by_row_equal_a_loop():
    rng = np.random.default_rng(9)
    for rows in ([5], [3, 3], [4, 1, 4, 4], [9, 2, 2, 0, 9, 7, 9, 9], rng.zipf(1.3, 3000).clip(max=70000).tolist()):
        wide, flat = rng.normal(size=(len(rows), 4)).astype("f4"), rng.normal(size=len(rows)).astype("f4")
        at, sums, total = lm._sums_by_row(np.array(rows), wide, flat)
        assert sorted(at.tolist()) == sorted(set(rows))
        for r, s, n in zip(at.tolist(), sums, total):
            own = np.flatnonzero(np.array(rows) == r)
            assert np.allclose(s, wide[own].sum(axis=0, dtype="f8"), atol=1e-3) and abs(n - flat[own].sum(dtype="f8")) < 1e-3


def test_scoring_looks_up_few_tokens_at_once(monkeypatch):
    v = vocabulary(400)
    model, met = lm.Model(v), []
    plain = model._log_z
    monkeypatch.setattr(model, "_log_z", lambda q, low, high: met.append(len(q)) or plain(q, low, high))
    rng = np.random.default_rng(2)
    contexts, targets = rng.integers(0, v.units + 1, (30_000, lm.CONTEXT)), rng.integers(0, v.units, 30_000)
    whole = model.log_probs(contexts, targets)
    assert max(met) <= 4096
    assert np.allclose(whole[:50], model.log_probs(contexts[:50], targets[:50]), atol=1e-4)


def test_normalising_queries_of_any_size_equals_doubles():
    """Small products have their exponentials as they are, others less the largest; a block has either."""
    model = lm.Model(vocabulary(400))
    model.bias[:] = np.linspace(-30, 5, len(model.bias), dtype="f4")
    rng = np.random.default_rng(4)
    for size in (0, 1, 30, 300, 3000):
        q = rng.normal(0, 1, (700, lm.WIDTH)).astype("f4") * np.float32(size)
        for low, high in ((0, model.tops), (int(model.starts[3]), int(model.starts[4]))):
            plain = q.astype("f8") @ model.outer[low:high].T.astype("f8") + model.bias[low:high]
            top = plain.max(axis=1)
            want = np.log(np.exp(plain - top[:, None]).sum(axis=1)) + top
            assert np.allclose(model._log_z(q, low, high), want, rtol=1e-5, atol=1e-4)
    assert lm.SAFE < 80  # an exponential of twice as much is no longer a float
