import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftlake.llm.packing import fill_report, pack, pack_documents


def loads(sizes, held):
    out = {}
    for s, k in zip(sizes, held):
        out[int(k)] = out.get(int(k), 0) + int(s)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_no_container_overflows(sizes):
    held = pack(np.array(sizes, np.int64), 100)
    assert len(held) == len(sizes) and max(loads(sizes, held).values(), default=0) <= 100


def test_large_items_are_matched_best():
    # brute force over all matchings of eight items above a third
    r = random.Random(6)

    def most(sizes):
        if len(sizes) < 2:
            return 0
        first, rest = sizes[0], sizes[1:]
        return max(most(rest), *[1 + most(rest[:i] + rest[i + 1 :]) if first + x <= 99 else 0 for i, x in enumerate(rest)])

    for _ in range(60):
        sizes = [r.randrange(34, 90) for _ in range(8)]
        assert len(loads(sizes, pack(np.array(sizes), 99))) == 8 - most(sizes)


def test_little_space_is_left():
    r = np.random.default_rng(7)
    sizes = np.minimum(r.lognormal(6, 1.3, 20_000).astype(np.int64), 16_384)
    n = len(loads(sizes, pack(sizes)))
    assert n <= -(-int(sizes.sum()) // 16_384) * 1.005 + 1


def documents(spark):
    data = [(i, "x" * (i % 97), i) for i in range(400)] + [(1000, "é" * 130, 0), (1001, None, 0), (1002, "", 0), (None, "null id", 0), (5, "x" * 5, 5), (1003, "y" * 100, 1)]
    return spark.createDataFrame(data, "doc_id bigint, text string, container_id int")


def test_documents_are_placed_whole(spark):
    df = documents(spark)
    got = pack_documents(df, capacity=100, shard_tokens=5_000).cache()
    want = rows(df.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n")).groupBy("doc_id").agg(F.sum("n")))
    assert rows(got.groupBy("doc_id").agg(F.sum("n_tokens"))) == want
    assert rows(got.filter("doc_id = 1000").select("piece_no", "start_token", "n_tokens")) == [(0, 0, 100), (1, 100, 100), (2, 200, 60)]
    assert got.filter("piece_no > 0 and doc_id != 1000").count() == 0
    report = fill_report(got, 100).first()
    together = fill_report(pack_documents(df, capacity=100), 100).first()
    assert report.overfull == together.overfull == 0 and together.containers <= report.containers <= together.containers + 2 * 4
    assert got.count() == df.count() + 2


def test_nothing_and_order(spark):
    df = documents(spark)
    assert pack_documents(df.limit(0)).count() == 0
    a = rows(pack_documents(df, capacity=100))
    assert a == rows(pack_documents(df.orderBy(F.desc("doc_id")).repartition(3), capacity=100))


@pytest.mark.parametrize("sizes", [[], [0], [100], [0, 0, 100, 100]])
def test_edges(sizes):
    assert max(loads(sizes, pack(np.array(sizes, np.int64), 100)).values(), default=0) <= 100
