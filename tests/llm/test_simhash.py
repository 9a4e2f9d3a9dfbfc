import random
import re
from itertools import combinations

import xxhash
from runlens.llm import components, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def test_fingerprints_and_groups_equal_brute_force(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choices("Ab cd éÉ EF, \x1c gh ij kl".split(" "), k=200)) for _ in range(5)]
    texts = [None, "", "one", "Two words", "a\x0bb\tc", " ", "same same same same"]
    for b in base:
        texts += [b, b.upper()]
        for _ in range(8):
            words = b.split(" ")
            words[rnd.randrange(200)] = "zz"
            texts.append(" ".join(words))
    ids = [i * 3 for i in range(len(texts))]
    ids[9] = None
    rows = [(i, t, 1, 2, "x") for i, t in zip(ids, texts)] + [(0, texts[0], 1, 2, "x"), (0, texts[10], 1, 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int, row string").repartition(3)
    prints = [plain(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], prints, least_reachable([r[0] for r in rows], prints)), key=str)
    got = simhash.groups(docs).collect()
    assert sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got], key=str) == want


def test_links_lose_none(spark):
    rnd = random.Random(1)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        p = rnd.getrandbits(64)
        prints.add(p)
        for _ in range(6):
            q = p
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = {(u % 2**64, v % 2**64) for u, v in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert {frozenset(x) for x in got} == {frozenset(x) for x in combinations(prints, 2) if (x[0] ^ x[1]).bit_count() <= 3}


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 120)] + [(300, 200), (250, 300)]
    got = dict(map(tuple, components.roots(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 120)}, 200: 200, 250: 200, 300: 200}
    assert components.roots(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty_table(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
