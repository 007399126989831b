import random

from pyspark.sql import functions as F

from conftest import rows
from siftlake.operators.heavy import heavy_keys, skew_join
from siftlake.plans.ordered import gap_islands, next_marked, ordered_scan
from siftlake.plans.shared import cut, drop_made, made, row_count_within, sized_join


def hot_groups(n, seed=0):
    """Rows of which one group holds a third, with a null group."""
    r = random.Random(seed)
    return [(r.choice([1, 1, 2, 3, None, 4]), i, r.randrange(100)) for i in r.sample(range(10 * n), n)]


def test_ordered_scan_against_loop(spark):
    data = hot_groups(500)
    df = spark.createDataFrame(data, "g int, o int, v int")
    got = rows(ordered_scan(df, ["g"], ["o"], lag=["v"], sums={"before": F.col("v")}, ranges=7))
    want, last, count, total = [], {}, {}, {}
    for g, o, v in sorted(data, key=lambda x: x[1]):
        count[g] = count.get(g, 0) + 1
        want.append((g, o, v, last.get(g), total.get(g, 0), count[g]))
        last[g], total[g] = v, total.get(g, 0) + v
    assert got == sorted(want, key=repr)


def test_ordered_scan_of_nothing(spark):
    df = spark.createDataFrame([], "g int, o int, v int")
    assert ordered_scan(df, ["g"], ["o"], lag=["v"]).count() == 0


def test_next_marked_against_loop(spark):
    r = random.Random(1)
    data = [(r.choice([1, 1, 1, 2, 3]), i, r.choice([None, None, None, i])) for i in range(400)]
    df = spark.createDataFrame(data, "g int, o int, m int")
    want = []
    for g, o, m in data:
        later = [x for x in data if x[0] == g and x[1] >= o and x[2] is not None]
        want.append((g, o, m, min(later, key=lambda x: x[1])[2] if later else None))
    assert rows(next_marked(df, ["g"], ["o"], "m", ranges=6)) == sorted(want, key=repr)


def test_gap_islands_across_blocks(spark):
    r = random.Random(2)
    data = sorted({(g, r.randrange(120)) for g in (1, 2) for _ in range(150)} | {(1, x) for x in range(40, 90)})
    df = spark.createDataFrame([(*x, x[1] * 10) for x in data], "g int, p int, extra int")
    got = rows(gap_islands(df, ["g"], "p", ranges=9))
    want = []
    for g, p in data:
        if (g, p - 1) not in data:
            e = p
            while (g, e + 1) in data:
                e += 1
            want.append((g, p, e, p * 10))
    assert got == sorted(want, key=repr)


def test_heavy_keys_and_skew_join(spark):
    data = [("hot",)] * 3000 + [("warm",)] * 300 + [(f"k{i}",) for i in range(500)] + [(None,)] * 50
    fact = spark.createDataFrame(data, "k string").withColumn("n", F.monotonically_increasing_id())
    assert heavy_keys(fact, "k", share=0.05)[:2] == ["hot", "warm"]
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3), ("none", 4), (None, 5)], "k string, v int")
    for how in ("inner", "left"):
        assert rows(skew_join(fact, dim, "k", how)) == rows(fact.join(dim, "k", how))
    assert heavy_keys(fact.limit(0), "k") == []
    assert skew_join(fact.limit(0), dim, "k").count() == 0


def test_skew_join_salts_a_large_heavy_side(spark, monkeypatch):
    import siftlake.operators.heavy as heavy

    monkeypatch.setattr(heavy, "BROADCAST_ROWS", 1)
    fact = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 1)], "k string, n int")
    dim = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    for how in ("inner", "left"):
        assert rows(heavy.skew_join(fact, dim, "k", how)) == rows(fact.join(dim, "k", how))


def test_shared_helpers(spark):
    df = spark.range(10)
    assert rows(cut(df)) == rows(df)
    assert row_count_within(df, 10) and not row_count_within(df, 9)
    assert rows(sized_join(df, spark.range(5), "id", limit=2)) == [(i,) for i in range(5)]


def test_scans_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_ordered_scan_against_loop(spark)
        test_next_marked_against_loop(spark)
        test_gap_islands_across_blocks(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folders_can_be_dropped(spark, tmp_path):
    before = made()
    df = cut(spark.range(10))
    file = df.inputFiles()[0].removeprefix("file:")
    import os

    assert os.path.exists(file) and made() == before + 1
    drop_made(before)
    assert not os.path.exists(file) and made() == before
    # broad rows are no small table
    assert not row_count_within(spark.range(10).selectExpr("repeat('x', 1000) s", "array(id) a"), 10, size=5000)
