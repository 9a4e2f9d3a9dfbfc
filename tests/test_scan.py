"""Chunked scans, ranks and as-of joins against plain Python."""

import random

from pyspark.sql import functions as F

from runlens.operators import ranks
from runlens.operators import scan as S
from runlens.operators.asof import asof
from runlens.operators.intervals import points_in_intervals


def data(seed, n=300, keys=3):
    r = random.Random(seed)
    # one group holds most rows
    return [(0 if r.random() < 0.6 else r.randrange(keys), i, r.choice([None, *range(6)])) for i in range(n)]


def test_scan_equals_a_plain_pass_whatever_the_chunk(spark):
    rows = data(1)
    for chunk_rows in (1, 7, 100, 10_000):
        df = spark.createDataFrame(rows, "k int, i int, v int").withColumn("chunk", S.chunk_of("i", chunk_rows)).repartition(5)
        out = S.scan(df, ["k"], ["i"], {
            "prev": S.prev(F.col("v")), "next": S.following(F.col("v")), "sum": S.total(F.coalesce("v", F.lit(0))),
            "before": S.total_before(F.coalesce("v", F.lit(0))), "last": S.last_seen(F.col("v")), "lastb": S.last_before(F.col("v")),
            "nexts": S.next_seen(F.col("v")), "max": S.highest(F.col("v"))})
        got = {(r.k, r.i): r for r in out.collect()}
        assert len(got) == len(rows)
        for k in {r[0] for r in rows}:
            g = [r for r in rows if r[0] == k]
            total, last, top = 0, None, None
            for n, (_, i, v) in enumerate(g):
                r = got[(k, i)]
                assert r["before"] == total and r["lastb"] == last
                total += v or 0
                last = v if v is not None else last
                top = v if top is None else top if v is None else max(top, v)
                later = [x[2] for x in g[n + 1:] if x[2] is not None]
                assert r["sum"] == total and r["last"] == last and r["max"] == top
                assert r["prev"] == (g[n - 1][2] if n else None)
                assert r["next"] == (g[n + 1][2] if n + 1 < len(g) else None)
                assert r["nexts"] == (later[0] if later else None)


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (5.0, 1.0, 5.0, 2.0)], "k string, x double")
    assert {(r.x, r["rank"]) for r in ranks.average_ranks(df, ["k"], "x").collect()} == {(5.0, 3.5), (1.0, 1.0), (2.0, 2.0)}


def test_order_statistics_match_sorted_lists(spark):
    r = random.Random(2)
    groups = {k: [round(r.expovariate(0.02) - 5, 2) for _ in range(n)] for k, n in (("one", 1), ("two", 2), ("many", 257))}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    near = {x.k: x.p for x in ranks.nearest_rank(df, ["k"], "v", 0.95, "p").collect()}
    clamp = {x.k: x.p for x in ranks.clamp_index(df, ["k"], "v", 0.9, "p").collect()}
    mid = {x.k: x.p for x in ranks.median(df, ["k"], "v", "p").collect()}
    import math
    import statistics
    for k, vs in groups.items():
        s = sorted(vs)
        assert near[k] == s[max(0, math.ceil(0.95 * len(s)) - 1)]
        assert clamp[k] == s[min(len(s) - 1, int(0.9 * len(s)))]
        assert abs(mid[k] - statistics.median(s)) < 1e-9


def test_pinned_percentile(spark):
    df = spark.createDataFrame([("h", i / 100) for i in range(1, 101)] + [("one", 0.3)], "k string, v double")
    assert {r.k: r.p for r in ranks.nearest_rank(df, ["k"], "v", 0.95, "p").collect()} == {"h": 0.95, "one": 0.3}


def test_asof_in_both_directions(spark):
    left = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 25.0), ("b", 3, 5.0)], "k string, id int, t double")
    right = spark.createDataFrame([("a", 10.0, "x"), ("a", 20.0, "y"), ("a", 30.0, "z")], "k string, at double, v string")
    got = lambda **o: {r.id: r.v for r in asof(left, right, ["k"], "t", "at", ["v"], 7.0, **o).collect()}
    assert got() == {1: "x", 2: "y", 3: None}
    assert got(strict=True) == {1: None, 2: "y", 3: None}
    assert got(forward=True) == {1: "x", 2: "z", 3: None}
    assert got(forward=True, strict=True) == {1: "y", 2: "z", 3: None}


def test_interval_join_equals_brute_force(spark):
    r = random.Random(3)
    pts = [(r.randrange(2), i, r.uniform(0, 100)) for i in range(120)]
    ivs = [(r.randrange(2), j, lo := r.uniform(0, 90), lo + r.uniform(0, 30)) for j in range(20)]
    p, i = spark.createDataFrame(pts, "k int, pid int, t double"), spark.createDataFrame(ivs, "k int, iid int, lo double, hi double")
    got = {(x.pid, x.iid) for x in points_in_intervals(p, i, ["k"], "t", "lo", "hi", 4.0).collect()}
    assert got == {(a[1], b[1]) for a in pts for b in ivs if a[0] == b[0] and b[2] <= a[2] <= b[3]}


def test_sums_in_intervals_equal_the_points_inside(spark):
    from runlens.operators.intervals import sums_in_intervals
    r = random.Random(6)
    points = [(r.choice("aab"), float(r.randrange(200)), r.randrange(10), 1) for _ in range(900)]
    spans = [(r.choice("abc"), i, float(a := r.randrange(220)), float(a + r.choice([0, 5, 150]))) for i in range(120)]
    p = spark.createDataFrame(points, "k string, t double, v long, n long").repartition(3)
    i = spark.createDataFrame(spans, "k string, id int, lo double, hi double")
    for width in (7.0, 1000.0):
        got = {x.id: (x.v, x.n) for x in sums_in_intervals(p, i, ["k"], ["id"], "t", "lo", "hi", ["v", "n"], width).collect()}
        assert got == {n: tuple(sum(q[c] for q in points if q[0] == k and lo <= q[1] <= hi) for c in (2, 3)) for k, n, lo, hi in spans}


def test_only_shaped_names_are_cells(spark):
    from runlens.functions.names import shaped
    names = {"ag_high_v_T1_r1": True, "ag__some_long_v_T3_r12": True, "ag_high_smoke_v_T1_r1": True, "notes": False, "ag_high_T1_r1": False, "ag_high_v_T1_rx": False, "no-cell": False}
    df = spark.createDataFrame(list(names.items()), "cid string, want boolean")
    assert df.where(shaped(F.col("cid")) != F.col("want")).collect() == []
