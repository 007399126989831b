from conftest import rows

from siftlake.operators.heavy import busiest, file_sizes, host_load

BLOCKS = "file_id bigint, dataset_id bigint, block_no int, names array<string>, hosts array<string>, length bigint, n int, host_id int"
FILES = "file_id bigint, length bigint, size int"
HOSTS = "host_id int, host_name string, ip string, alias string, placements int"


def tables(spark):
    blocks = [
        (1, 1, 0, None, [" DN1.x ", "dn2.x.:9866", "unknown"], 4, 0, 0), (1, 1, 0, None, [" DN1.x ", "dn2.x.:9866", "unknown"], 4, 0, 0),
        (1, 1, 1, [], ["dn1", "dn1", None], 6, 0, 0), (2, 1, 0, None, ["10.0.0.1:9866", "Elm"], 3, 0, 0), (2, 1, 1, None, [], 2, 0, 0), (2, 1, 2, None, None, 2, 0, 0),
        (None, 1, 0, None, ["dn1"], 1, 0, 0), (3, 1, 0, None, ["dn2.x."], 1, 0, 0),
    ]
    return (
        spark.createDataFrame(blocks, BLOCKS),
        spark.createDataFrame([(1, 10, 0), (1, 10, 0), (2, None, 0), (None, 5, 0)], FILES),
        spark.createDataFrame([(1, "dn1.x", "10.0.0.1", None, 0), (2, "dn2.x", None, "elm", 0), (3, "dn3.x", None, None, 0), (None, "dn9", None, None, 0)], HOSTS),
    )


def test_host_load(spark):
    b, f, h = tables(spark)
    # host 1: twice in file 1 block 1, once in block 0, once in file 2; file 3 has no recorded size
    assert rows(host_load(b, f, h)) == [(1, 4, 17), (2, 3, 17)]
    assert rows(file_sizes(f, b)) == [(1, 10), (2, 7)]
    assert host_load(b.limit(0), f, h).count() == host_load(b, f, h.limit(0)).count() == 0


def test_busiest(spark):
    load = spark.createDataFrame([(1, 50, 1), (2, 1, 0), (3, 49, 0), (4, 0, 99)], "host_id int, placements bigint, bytes bigint")
    assert [r[0] for r in rows(busiest(load))] == [1, 3, 4]
    assert busiest(load.limit(0)).count() == 0
