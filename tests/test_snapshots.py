import random

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from siftlake.functions import bitmaps
from siftlake.operators.snapshots import snapshot_changes, snapshot_ordinals

SCHEMA = "dataset_id bigint, snapshot_no int, delivery_no int, path string, length bigint, modification_time bigint, ordinal int, chunk int"


def listing(spark, data):
    return spark.createDataFrame([(*r, 0, 0) for r in data], SCHEMA)


def brute(data):
    last, best = {}, {}
    for d, s, v, *_ in data:
        last[d, s] = max(last.get((d, s), -1), v)
    for d, s, v, p, n, t in data:
        if v == last[d, s]:
            key, state = (d, s, p), (t if t < 10**11 else t // 1000, -1 if n is None else n)
            best[key] = max(best.get(key, (-1, -1)), state)
    out = []
    for d, s in last:
        before = [x for e, x in last if e == d and x < s]
        if not before:
            continue
        now, was = ({p: x for (e, z, p), x in best.items() if e == d and z == q} for q in (s, max(before)))
        for p in now.keys() | was.keys():
            if p not in was:
                out.append((d, s, p, "added"))
            elif p not in now:
                out.append((d, s, p, "removed"))
            elif now[p][0] != was[p][0] or (-1 not in (now[p][1], was[p][1]) and now[p][1] != was[p][1]):
                out.append((d, s, p, "changed"))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    data = []
    for _ in range(1500):
        t = r.choice([1_600_000_000, 1_600_000_000_123, 1_600_000_001])
        data.append((r.choice([1, 1, 1, 2, 3]), r.choice([1, 2, 4, 7]), r.choice([1, 1, 2]), f"/f{r.randrange(60)}", r.choice([None, 5, 6]), t))
    assert rows(snapshot_changes(listing(spark, data))) == brute(data)
    # many stripes per data set
    import siftlake.operators.snapshots as snapshots

    monkeypatch.setattr(snapshots, "STRIPE_ROWS", 50)
    assert rows(snapshot_changes(listing(spark, data + data))) == brute(data)
    # many batches per stripe, and a dictionary from before
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        known = snapshot_ordinals(listing(spark, data[:400]))
        assert rows(snapshot_changes(listing(spark, data), known)) == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_are_crossed(spark):
    n = bitmaps.CHUNK + 50
    first = [(1, 1, 1, f"/{i:05d}", 1, 10**12) for i in range(n)]
    second = [(1, 2, 1, f"/{i:05d}", 2 if i == n - 2 else 1, 10**12) for i in range(1, n)]
    assert rows(snapshot_changes(listing(spark, first + second))) == [(1, 2, "/00000", "removed"), (1, 2, f"/{n - 2:05d}", "changed")]


def test_spelling_nulls_and_nothing(spark):
    data = [
        (1, 1, 1, "file:/a//b%20c", None, 1_600_000_000), (1, 2, 1, "/a/b c/", 5, 1_600_000_000_999), (1, 2, None, "/late", 1, 1),
        (None, 2, 1, "/x", 1, 1), (1, None, 1, "/x", 1, 1), (1, 2, 1, None, 1, 1), (1, 3, 1, "/a/b c", 5, None),
    ]
    assert rows(snapshot_changes(listing(spark, data))) == [(1, 3, "/a/b c", "changed")]
    assert snapshot_changes(listing(spark, data).limit(0)).count() == 0


def test_ordinals_persist(spark):
    of = lambda paths: listing(spark, [(d, 1, 1, p, 1, 10**12) for d, p in paths])
    pick = lambda df: rows(df.select("dataset_id", "path", "ordinal"))
    first = snapshot_ordinals(of([(1, "b"), (1, "d"), (2, "a"), (1, "b")]))
    assert pick(first) == [(1, "b", 0), (1, "d", 1), (2, "a", 0)]
    more = snapshot_ordinals(of([(1, "a"), (1, "d"), (3, "z")]), first)
    assert pick(more) == [(1, "a", 2), (1, "b", 0), (1, "d", 1), (2, "a", 0), (3, "z", 0)]


def test_bitmaps_against_sets():
    r = np.random.default_rng(4)
    for n, m in ((0, 0), (3, 5), (200, 3000), (4096, 4000), (100, 0)):
        a, b = (r.choice(bitmaps.CHUNK, k, replace=False) for k in (n, m))
        x, y = bitmaps.compress(a), bitmaps.compress(b)
        assert bitmaps.offsets(x).tolist() == sorted(a.tolist())
        assert bitmaps.and_not(x, y).tolist() == sorted({*a.tolist()} - {*b.tolist()})
        assert bitmaps.both(x, y).tolist() == sorted({*a.tolist()} & {*b.tolist()})
        assert len(x) <= bitmaps.CHUNK // 8 + 1
    big = [np.unique(r.integers(0, 100_000, n)) for n in (0, 50, 30_000, 60_000)]
    for a in big:
        for b in big:
            x, y = bitmaps.Bitmap(a), bitmaps.Bitmap(b)
            assert x.and_not(y).tolist() == np.setdiff1d(a, b).tolist() and x.both(y).tolist() == np.intersect1d(a, b).tolist()
