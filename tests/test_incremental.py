import datetime as dt
import random

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.functions.intervals import dyadic, merge, subtract
from siftlake.operators.incremental import IntervalLedger, claimed, ledger_intervals, new_or_changed

spans = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 9)).map(lambda x: (x[0], x[0] + x[1])))
numbers = lambda xs: {n for a, b in xs for n in range(a, b + 1)}


@settings(max_examples=200, deadline=None)
@given(spans, spans)
def test_interval_arithmetic(a, b):
    m, s = merge(a), subtract(a, b)
    assert numbers(m) == numbers(a) and all(x[1] + 1 < y[0] for x, y in zip(m, m[1:]))
    assert numbers(s) == numbers(a) - numbers(b) and all(x[1] < y[0] for x, y in zip(s, s[1:]))


ARRIVALS = "arrival_id bigint, dataset_id bigint, path string, length bigint, modification_time bigint, listed_at timestamp_ntz, loaded_at timestamp_ntz, seq int, run int"
RUNS = "run_id bigint, dataset_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, outcome string"
at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_replay_against_brute_force(spark):
    r = random.Random(5)
    arrivals, runs = [], []
    for i in range(400):
        listed = r.randrange(10_000)
        arrivals.append((i, r.choice([1, 1, 2]), f"/f{r.randrange(25)}", r.choice([1, 2]), r.choice([10**12, 10**9, 10**12 + 1500]), at(listed), at(listed + r.choice([1, 5, 4000])), 0, 0))
    for i in range(40):
        runs.append((i, r.choice([1, 2]), at(i * 300 + r.randrange(200)), None, r.choice(["succeeded", "SUCCEEDED", "failed", None])))
    arrivals += arrivals[:50]
    arrivals += [(None, 1, "/f1", 1, 1, at(1), at(1), 0, 0), (1000, 1, None, 1, 1, at(1), at(1), 0, 0), (1001, 1, "/f1", 1, 1, None, at(1), 0, 0), (1002, 1, "/f1", 1, 1, at(1), None, 0, 0)]
    runs += runs[:5] + [(None, 1, at(1), None, "succeeded"), (99, 1, None, None, "succeeded")]
    secs = lambda t: t if t < 10**11 else t // 1000
    want = []
    for d in (1, 2):
        known = {}
        for run, _, start, _, _ in sorted({x for x in runs if x[1] == d and x[0] is not None and x[2] is not None and (x[4] or "").lower() == "succeeded"}, key=lambda x: x[2]):
            now = {}
            for a, e, p, n, t, listed, loaded, *_ in arrivals:
                if e == d and a is not None and p and listed and loaded and loaded <= start and (p not in now or (listed, a) > now[p][0]):
                    now[p] = (listed, a), (n, secs(t))
            want += [(run, x[0][1]) for p, x in now.items() if p not in known or known[p][1] != x[1]]
            known = now
    a, u = spark.createDataFrame(arrivals, ARRIVALS), spark.createDataFrame(runs, RUNS)
    taken = claimed(a, u)
    assert rows(new_or_changed(taken)) == sorted(want, key=repr)
    # intervals of a data set are disjoint and hold every arrival that was taken
    spans = ledger_intervals(taken).collect()
    for d in (1, 2):
        seqs = sorted(r[0] for r in taken.filter(f"dataset_id = {d}").select("seq").collect())
        assert sorted(n for s in spans if s.dataset_id == d for n in range(s.first_seq, s.last_seq + 1)) == seqs
    assert claimed(a.limit(0), u).count() == claimed(a, u.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(-100, 400), st.integers(0, 300))
def test_dyadic_blocks(lo, n):
    blocks = dyadic(lo, lo + n - 1)
    assert sorted(x for level, k in blocks for x in range(k << level, (k + 1) << level)) == list(range(lo, lo + n))


def test_intervals_do_not_depend_on_ranges(spark):
    arrivals = [(i, 1, f"/f{i % 7}", i % 3, 10**12, at(i), at((i * 37) % 500 if i % 5 == 0 else i), 0, 0) for i in range(300)]
    runs = [(k, 1, at(60 * k), None, "succeeded") for k in range(1, 10)]
    a, u = spark.createDataFrame(arrivals, ARRIVALS), spark.createDataFrame(runs, RUNS)
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append((rows(ledger_intervals(claimed(a, u))), rows(new_or_changed(claimed(a, u)))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] and len(got[0][0]) > 20


def test_of_two_racing_runs_one_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    both = Barrier(2)

    def once(name):
        ledger = IntervalLedger(spark, str(tmp_path / "ledger"))

        def work(df):
            both.wait()
            return df.withColumn("by", F.lit(name))

        try:
            return ledger.run(spark.range(10), "id", work)
        except RuntimeError as e:
            return "again" if "run again" in str(e) else str(e)

    with ThreadPoolExecutor(2) as pool:
        assert sorted(map(str, pool.map(once, "ab"))) == ["10", "again"]
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"))
    assert ledger.output().count() == 10 and ledger.processed() == [(0, 9)] and ledger.run(spark.range(10), "id", lambda df: df) == 0


def test_processed_row_groups_are_not_read(spark, tmp_path):
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"))
    ledger.run(spark.range(100).filter("id != 40"), "id", lambda df: df)
    plan = ledger.unprocessed(spark.range(0).select("id"), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "40" in plan and "99" in plan
    # negative numbers, repeated rows and nulls
    more = spark.createDataFrame([(-5,), (-5,), (40,), (None,), (7,)], "id bigint")
    assert ledger.run(more, "id", lambda df: df) == 3 and ledger.processed() == [(-5, -5), (0, 99)]


def test_ledger_survives_failure(spark, tmp_path):
    ledger = IntervalLedger(spark, str(tmp_path / "ledger"))
    at_first = spark.range(10).withColumn("__lo", F.lit(1))

    def fail(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(at_first, "id", fail)
    assert ledger.processed() == [] and ledger.output() is None
    assert ledger.run(at_first.filter("id != 4"), "id", lambda df: df) == 9
    assert ledger.processed() == [(0, 3), (5, 9)]
    later = spark.range(15).withColumn("__lo", F.lit(1))
    assert ledger.run(later, "id", lambda df: df) == 6  # the late 4 and 10 to 14
    assert ledger.run(later, "id", lambda df: df) == 0
    assert rows(ledger.output().select("id")) == rows(later.select("id"))
    assert IntervalLedger(spark, str(tmp_path / "ledger")).processed() == [(0, 14)]
    scattered = spark.range(15, 600, 3).withColumn("__lo", F.lit(1))
    assert ledger.run(scattered, "id", lambda df: df) == 195
    # more holes than a list of conditions
    assert ledger.run(spark.range(0, 620, 2).withColumn("__lo", F.lit(1)), "id", lambda df: df) == len({*range(0, 620, 2)} - {*range(15), *range(15, 600, 3)})
    assert ledger.run(spark.range(620).withColumn("__lo", F.lit(1)), "id", lambda df: df) == len({*range(620)} - {*range(15), *range(15, 600, 3), *range(0, 620, 2)})
    assert ledger.processed() == [(0, 619)]
