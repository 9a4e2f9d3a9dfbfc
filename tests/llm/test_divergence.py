import random
import re
from collections import Counter, defaultdict

import pytest

from runlens.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least=3, top=200):
    """All groups, all terms, one pair at a time."""
    counts, votes, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        votes[lang or ""].update(set(found))
        langs[lang or ""].add(source or "")
    out = []
    for lang, sources in langs.items():
        kept = [t for t, d in votes[lang].items() if d >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        own = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (own[s][t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, n=250):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdéÉ中", k=rnd.randint(1, 4))) for _ in range(120)] + ["The", "THE", "the"]
    rows = []
    for _ in range(n):
        lang = rnd.choice(["en", "en", "de", None, ""])
        source = "big" if rnd.random() < 0.4 else rnd.choice([None, "", "a", "b", "é", "z1", "q"])
        text = rnd.choice([None, "", " 12 34 ", "!"]) if rnd.random() < 0.1 else rnd.choice([" ", "1", "_", "\x00", ". "]).join(rnd.choices(words, k=rnd.choice([1, 5, 40])))
        rows.append((lang, source, text))
    rows += [("xx", "only", "alone"), ("yy", "one", "rare"), ("yy", "two", None)]
    return rows + rows[:20]


def frame(spark, rows):
    return spark.createDataFrame([(i // 2, *r, "x", 7) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, value int")


@pytest.mark.parametrize(("held", "pairs", "once"), [(400_000, 1_000_000, 2_000_000), (10, 2, 3)])
def test_the_audit_equals_the_plain_sums(spark, monkeypatch, held, pairs, once):
    for name, value in (("HELD_TERMS", held), ("HELD_PAIRS", pairs), ("AT_ONCE", once)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(3)
    got = divergence.audit(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got)) == plainly(rows)


def test_ranks_beyond_the_top_and_other_limits(spark):
    rows = corpus(4, 120)
    docs = frame(spark, rows)
    assert sorted(map(tuple, divergence.audit(docs, least=1, top=None).collect())) == plainly(rows, 1, None)
    assert sorted(map(tuple, divergence.audit(docs, least=5, top=4).collect())) == plainly(rows, 5, 4)


def test_a_very_long_text_and_counts_beyond_64_bits_of_the_unit(spark):
    rows = [("en", s, "word other " * n) for s in "ab" for n in (1, 200_000, 3)]
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == plainly(rows)
    big = spark.sql("SELECT cast(9000000000000 AS long) AS n, cast(9000000000001 AS long) AS total, cast(5 AS long) AS v")
    assert big.select(divergence.share(big.n, big.total, big.v)).first()[0] == 1 + 1_000_000_000 * 9_000_000_000_001 // 9_000_000_000_006


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
