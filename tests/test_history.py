"""Ordered operators in ranges against brute force: one hot key, null keys, ties."""

import random

import pytest
from pyspark.sql import functions as F

from vellumine.operators import history as H


@pytest.fixture(scope="module")
def rows():
    random.seed(4)
    keys = ["hot"] * 400 + [f"k{i}" for i in range(20)] * 10 + [None] * 50
    return [(k, random.randint(0, 5000), i, random.choice(["a", "b", "c", None]), random.randint(0, 9)) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t bigint, i int, s string, v int").repartition(5)


def ordered(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


@pytest.mark.parametrize("width", [7, 300, 10**9])
def test_neighbour_running_filled(df, rows, width):
    near = {r.i: r._near for r in H.neighbour(df, ["k"], F.col("t"), F.col("s"), width, ("i",)).collect()}
    after = {r.i: r._near for r in H.neighbour(df, ["k"], F.col("t"), F.col("i"), width, ("i",), ahead=True).collect()}
    total = {r.i: r._sum for r in H.running(df, ["k"], F.col("t"), F.col("v"), width, ("i",)).collect()}
    last = {r.i: r._last for r in H.filled(df, ["k"], F.col("t"), F.col("s"), width, ("i",)).collect()}
    for rs in ordered(rows).values():
        run, fill = 0, None
        for n, r in enumerate(rs):
            run += r[4]
            fill = r[3] if r[3] is not None else fill
            assert near[r[2]] == (rs[n - 1][3] if n else None)
            assert after[r[2]] == (rs[n + 1][2] if n + 1 < len(rs) else None)
            assert total[r[2]] == run and last[r[2]] == fill
    assert len(near) == len(after) == len(total) == len(last) == len(rows)


def test_sessions_and_as_of(spark):
    random.seed(5)
    e = [("hot" if i % 3 else f"u{i % 7}", random.randint(0, 40_000)) for i in range(600)]
    df = spark.createDataFrame(e, "u string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r.u, r.started.timestamp(), r.ended.timestamp(), r.n) for r in H.sessions(df, "u", "ts", 300, 3_600_000_000).collect())
    want, by = [], {}
    for u, s in sorted(e):
        by.setdefault(u, []).append(s)
    for u, times in by.items():
        run = [times[0]]
        for s in times[1:]:
            if s - run[-1] >= 300:
                want.append((u, float(run[0]), float(run[-1]), len(run)))
                run = []
            run.append(s)
        want.append((u, float(run[0]), float(run[-1]), len(run)))
    assert got == sorted(want)
    left = df.where("s % 2 = 0").select("u", "ts", F.monotonically_increasing_id().alias("i"))
    right = df.where("s % 2 = 1").groupBy("u", "ts").agg(F.max("s").alias("x"))
    out = H.as_of(left, right, "u", "ts", "x", 600_000_000).collect()
    odd = sorted((s, u) for u, s in e if s % 2)
    assert all(r.last_x == max((s for s, u in odd if u == r.u and s <= r.ts.timestamp()), default=None) for r in out) and len(out) == left.count()


def test_top_shares_and_samples(spark):
    x = [("hot", i, (i * 37) % 101) for i in range(500)] + [("b", 1000, 5), (None, 1001, 1), (None, 1002, 2)]
    df = spark.createDataFrame(x, "g string, i int, score int")
    got = {(r.g, r.i) for r in H.budget(df, "g", "score", "i", 6, 0.25).collect()}
    top = sorted((r for r in x if r[0] == "hot"), key=lambda r: (-r[2], r[1]))[:6]
    assert got == {("hot", r[1]) for r in top} | {("b", 1000), (None, 1002)}
    s = H.spread_sample(df, "g", "i", 5, 60)
    assert sorted(r.i for r in s.where("g = 'hot'").collect()) == [0, 100, 200, 300, 400] and s.where("g is null").count() == 2
    e = H.evict(df.withColumn("at", F.timestamp_seconds("i")).withColumn("n", F.lit(10)), "g", "n", "at", "i", 995, 10_000_000)
    assert e.count() == 401 and e.agg(F.max("i")).first()[0] == 400


def test_latest_upsert_changes_estimate(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (4, "d")], "id int, v string")
    assert sorted(tuple(r) for r in H.upsert(old, new, "id").collect()) == [(1, "a"), (2, "x"), (3, "c"), (4, "d")]
    assert {r.id: r.change for r in H.changes(old, new, "id", ["v"]).collect()} == {1: "removed", 2: "changed", 3: "removed", 4: "added"}
    v = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 9, "n")], "k string, t int, v string")
    assert [tuple(r) for r in H.latest(v, "k", [F.col("t")], ["v"]).collect()] == [("a", "z")]
    f = spark.createDataFrame([("pdf", u, s) for u, s in ((10, 80.0), (20, 200.0), (30, 360.0), (40, 440.0))] + [("md", 10, 5.0), ("md", 0, 9.0)], "f string, u int, s double")
    got = {r.f: (r.samples, r.lower, r.likely, r.upper) for r in H.estimate(f, ["f"], "u", "s", 20.0, 1.0).collect()}
    assert got["pdf"][0] == 4 and got["pdf"][2] == 218.0 and got["pdf"][1] < 218.0 < got["pdf"][3]
    assert got["md"][:1] == (1,) and got["md"][2] == round(8 + (0.5 + 2.0) / 3 * 20)
