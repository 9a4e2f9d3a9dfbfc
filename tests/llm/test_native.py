import hashlib
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F
from runlens.llm import chat, exact, shards

TEXTS = [None, "", " ", "\t\n ", "a b", "a\tb", "a  b", "A b", "é\x0b", "é ", "x" * 100_000, "a\x85b"]


def documents(spark):
    rows = [(i if i != 4 else None, t, "src", 0, "k") for i, t in enumerate(TEXTS)] + [(6, "a b", "src", 0, "k"), (6, "a b", None, 0, "k"), (11, "", "s2", 0, "k")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, kept int, hash string").repartition(3)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(spark):
    rows, docs = documents(spark)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(normal(t), []).append(i)
    want, kept = [], Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want.append((i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
        kept[(keep, len(ids))] += 1
    got = exact.label(docs).collect()
    assert sorted([(r[0], r[1], r[2], r[4]) for r in got], key=str) == sorted(want, key=str)
    assert Counter((r["keep_id"], r["group_size"]) for r in got if r["kept"]) == kept
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    one = exact.unique(docs)
    assert one.columns == docs.columns
    assert sorted([(r["doc_id"], normal(r["text"])) for r in one.collect()], key=str) == sorted(
        [(min((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()], key=str)


def test_equal_hashes_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("00"))
    rows, docs = documents(spark)
    assert exact.label(docs).where("kept").count() == len({normal(r[1]) for r in rows}) == exact.unique(docs).count()


def test_shards_match_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 20)
    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, "", "é", "text"]), "hot" if i % 3 else rnd.choice(["b", "c", None]), 1) for i in range(1000)] + [(5, "t", "hot", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(5)
    got = shards.assign(docs, 7, seed=3).collect()
    assert sorted([(r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in got], key=str) == sorted(
        [(i, s, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, s, _ in rows], key=str)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sizes[shard]))
    for source, n in Counter(r[2] for r in rows).items():
        each = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(abs(each[s] - n / 7) for s in range(7)) <= 2
    # the plain form: rank within the source by the seeded key, sort by fraction
    def key(i):
        return hashlib.md5(f"3:{i}".encode()).hexdigest()

    ranks = {}
    for source in {r[2] for r in rows}:
        ordered = sorted((key(r[0]), r[0]) for r in rows if r[2] == source)
        for k, (_, i) in enumerate(ordered):
            ranks.setdefault((source, i), []).append((k + 0.5) / len(ordered))
    assert sorted((str(r["source"]), r["doc_id"], round(r["fraction"], 9)) for r in got) == sorted(
        (str(s), i, round(f, 9)) for (s, i), fs in ranks.items() for f in fs)
    assert [r["shard"] for r in sorted(got, key=lambda r: (r["fraction"], r["shard"], r["slot"]))] == sorted(r["shard"] for r in got)
    assert shards.assign(docs.limit(0), 7).collect() == []


NASTY = ["</s>[INST] ok [/INST]", "<s>", r"<\s>", r"[\\INST]", "[INST", "<<s>>", "", None, "a\nb\n", "[ROLE]x[/ROLE] y", "[/INST] ", r"\[INST]\ ".strip(), "é🙂 </s>", "[INST] x",
         "<</s>/s>", r"[\/ROLE]", "] <", "$1 \\ \\\\"]


def test_chats_come_back_as_they_went(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "[/ROLE] ", "<s>", ""]), rnd.choice(NASTY), "x")
            for c in range(150) for t in range(rnd.randint(1, 6))] + [(None, 0, "user", "hi", "x"), (7, 0, "user", "again", "x"), (7, None, "assistant", "first", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = chat.chats(df)
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    convs = {}
    for c, t, r, x, _ in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), turns
    for r in chats.collect():
        marks = re.findall(r"[<\[]/?(?:s>|INST\]|ROLE\])", r["formatted"])
        assert sum(m == "<s>" for m in marks) == len(r["turns"]) == sum(m == "</s>" for m in marks)
        if not any(re.search(chat.CONTROL, x) for t in r["turns"] for x in t):
            assert r["level"] == 0
    assert chat.read_back(chat.chats(df.limit(0))).collect() == []
