import random

from vellumine.llm import packing


def check(spark, sizes, parts, capacity=2048, **options):
    df = spark.createDataFrame([(i, n, "extra") for i, n in enumerate(sizes)], "doc_id bigint, tokens bigint, container string").repartition(parts)
    rows = [tuple(r) for r in packing.pack(df, capacity=capacity, **options).collect()]
    by, used = {}, {}
    for d, piece, c, n in rows:
        by.setdefault(d, []).append((piece, n))
        used[c] = used.get(c, 0) + n
    assert max(used.values(), default=0) <= capacity
    for d, n in enumerate(sizes):
        if n and n > 0:
            pieces = sorted(by[d])
            assert [p for p, _ in pieces] == list(range(len(pieces))) and sum(x for _, x in pieces) == n
            assert len(pieces) == -(-n // capacity)  # split only above the capacity
        else:
            assert d not in by
    return rows, used


def test_random_sizes(spark):
    random.seed(1)
    sizes = [random.choice([1, 5, 40, 300, 900, 1100, 2048, 2049, 5000, 0, None]) for _ in range(3000)]
    rows, used = check(spark, sizes, 6)
    assert len(used) <= 1.15 * sum(filter(None, sizes)) / 2048
    again, _ = check(spark, sizes, 6)
    assert sorted(rows) == sorted(again)


def test_small_items_fill_nearly_all(spark):
    random.seed(2)
    sizes = [random.randint(1, 400) for _ in range(4000)]
    _, used = check(spark, sizes, 5)
    assert len(used) <= -(-sum(sizes) // 2048) + 1


def test_items_that_fit_nothing(spark):
    _, used = check(spark, [1100] * 500, 7)
    assert len(used) == 500


def test_bins_that_only_fit_in_other_partitions(spark):
    groups = [[(i, 1100) for i in range(6)], *[[(i, 900)] for i in range(6, 12)]]  # each group is a partition
    df = spark.createDataFrame(spark.sparkContext.parallelize(groups, len(groups)).flatMap(list), "doc_id bigint, tokens bigint")
    assert packing.pack(df).select("container").distinct().count() == 6


def test_many_leaves_lose_nothing(spark):
    random.seed(5)
    sizes = [random.choice([1100, 1100, 1100, 900, 30, 1500]) for _ in range(4000)]
    _, many = check(spark, sizes, 3, leaf=60, fan_in=3)  # 67 leaves, five rounds
    _, one = check(spark, sizes, 3)
    assert len(many) <= 1.05 * len(one)


def test_large_items_beyond_every_bound(spark):
    df = spark.range(260_000).selectExpr("id as doc_id", "1100L as tokens")
    for parts in (1, 2):
        out = packing.pack(df.repartition(parts))
        assert out.count() == 260_000 and out.select("doc_id").distinct().count() == 260_000


def test_what_stays_behind_could_not_be_filled():
    bins = packing.settle([(1100, [(i, 0, 1100)]) for i in range(20)] + [(30, [(99, 0, 30)])], 2048, 8, 3, False)
    travelling = sorted(s for s, _, full in bins if not full)
    assert travelling == [1100, 1100, 1100, 1130] and len(bins) == 20


def test_one_source_of_equal_sizes(spark):
    sizes = [1100] * 300 + [900] * 300  # in order: partitions of equal sizes
    df = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(sizes)), 4), "doc_id bigint, tokens bigint")
    assert packing.pack(df, leaf=200).select("container").distinct().count() <= 320


def test_repeated_keys_count_once(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (1, 12), (2, 5)], "doc_id bigint, tokens bigint")
    assert sorted((r.doc_id, r.tokens) for r in packing.pack(df).collect()) == [(1, 12), (2, 5)]


def test_edges(spark):
    check(spark, [], 1)
    check(spark, [None, 0], 2)
    check(spark, [2048, 2048 * 3, 1], 3)


def test_best_fit_prefers_the_tightest():
    bins = packing.best_fit([(60, "a"), (50, "b"), (40, "c"), (45, "d")], 100)
    assert sorted((s, b) for s, b in bins) == [(95, ["b", "d"]), (100, ["a", "c"])]


def test_query(spark, tiny, empty):
    from vellumine.llm.queries import QUERIES

    assert QUERIES["p8_containers"](spark, empty).count() == 0
    row = QUERIES["p8_check"](spark, tiny).first()
    assert row.documents_in == row.documents_out > 0 and row.wrong_sizes == row.wrong_pieces == row.overfull == 0
    n = QUERIES["p8_containers"](spark, tiny).groupBy("container").sum("tokens").where("`sum(tokens)` > 2048").count()
    assert n == 0
