import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftlake.functions.hilbert import hilbert_codes
from siftlake.operators.compaction import compact_files, compaction_plan, plan_digest, row_digest, small_files

FILES = "file_id bigint, dataset_id bigint, path string, length bigint, is_dir boolean, modification_time bigint, extra int"
GROUPS = "file_id bigint, block_no int, row_count bigint, indexed_columns map<string, struct<value_count: bigint, min_value: string, max_value: string, num_nulls: bigint>>"
BLOCKS = "file_id bigint, block_no int, hosts array<string>, length bigint"


def tables(spark):
    files = [
        (1, 1, "hdfs://n/a/d/x", 10, False, 5, 0), (1, 1, "/a//d/x", 10, None, 5, 0), (2, 1, "/a/d/y", None, False, 6, 0),
        (3, 1, "/a/d/big", 50_000_000, False, 7, 0), (4, 1, "/a/e/alone", 10, False, 8, 0), (5, 1, "/a/d/_SUCCESS", 0, False, 9, 0),
        (6, 1, "/a/d/sub", 0, True, 9, 0), (7, 1, "/a/_bucket=1/p", 5, False, None, 0), (8, 1, "/a/_bucket=1/q", 5, False, 3, 0),
        (9, 1, "/a/d/unknown", None, False, 3, 0), (None, 1, "/a/d/z", 1, False, 3, 0), (11, 1, None, 1, False, 3, 0),
    ]
    one = {"row_id": (3, "7", "9", 0), "name": (3, "a", "b", 0)}
    groups = [(1, 0, 3, one), (1, 0, 3, one), (1, 1, 2, {}), (2, 0, 4, None), (7, 0, 1, one), (None, 0, 1, one), (3, 0, 9, one)]
    blocks = [(2, 0, [], 7), (2, 0, [], 7), (2, 1, None, 5), (3, 0, ["h"], 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(groups, GROUPS), spark.createDataFrame(blocks, BLOCKS)


def test_small_files(spark):
    f, _, b = tables(spark)
    assert rows(small_files(f, b).select("file_id", "directory", "size")) == [(1, "/a/d", 10), (2, "/a/d", 12), (7, "/a/_bucket=1", 5), (8, "/a/_bucket=1", 5)]


def test_plan_places_each_row_once(spark):
    f, g, b = tables(spark)
    plan = compaction_plan(f, g, b)
    at = {r.file_id: r for r in plan.collect()}
    assert sorted(at) == [1, 2, 7, 8]
    spans = sorted((at[i].row_offset, at[i].row_count) for i in (1, 2))
    assert spans in ([(0, 5), (5, 4)], [(0, 4), (4, 5)])
    got = {r.directory: r for r in plan_digest(plan, f, g, b).collect()}
    assert all(r.same_rows and r.outputs == 1 for r in got.values()) and got["/a/d"].row_count == 9
    # a plan that loses a file is found out
    assert not plan_digest(plan.filter("file_id != 2"), f, g, b).filter("directory = '/a/d'").first().same_rows


def test_plan_cuts_evenly(spark):
    f = spark.range(200).select(
        F.col("id").alias("file_id"), F.lit(1).cast("bigint").alias("dataset_id"), F.concat(F.lit("/a/b/"), "id").alias("path"),
        (F.lit(1000) + F.col("id") % 7).alias("length"), F.lit(False).alias("is_dir"), (F.col("id") * 3).alias("modification_time"),
    )
    _, g, b = tables(spark)
    per = compaction_plan(f, g.limit(0), b.limit(0), target=20_000).groupBy("output_no").agg(F.sum("size").alias("s")).collect()
    assert len(per) == 11 and max(r.s for r in per) - min(r.s for r in per) < 2100


def test_nothing_to_do(spark):
    f, g, b = tables(spark)
    assert compaction_plan(f.limit(0), g.limit(0), b.limit(0)).count() == 0


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_hilbert_walks_to_neighbours(dims, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    codes = hilbert_codes(points, bits)
    assert sorted(codes) == list(range(len(points)))
    walk = points[np.argsort(codes)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_compact_files(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "id % 2 = 0 AND id < 4000 AS hot", "cast(if(id < 3000, 7, id) as int) v", "if(id % 10 = 0, null, 's') s", "map('k', id) __code")
    df.unionByName(df.limit(100)).repartition(40).write.parquet(f"{tmp_path}/src")
    got = compact_files(spark, f"{tmp_path}/src", f"{tmp_path}/dst", ["v"], rows_per_file=1000)
    assert got["rows"] == 5100 and got["files"] == 6
    out = spark.read.parquet(f"{tmp_path}/dst")
    assert out.columns == df.columns and row_digest(out) == row_digest(spark.read.parquet(f"{tmp_path}/src"))
    sizes = [r["count"] for r in out.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1.3 * min(sizes)
    with pytest.raises(ValueError, match="no such column"):
        compact_files(spark, f"{tmp_path}/src", f"{tmp_path}/no", ["w"])


def test_compact_files_keeps_columns_of_any_file(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/src/a")
    spark.range(5, 9).selectExpr("id", "id * 2 extra").coalesce(1).write.parquet(f"{tmp_path}/src/b")
    got = compact_files(spark, [f"{tmp_path}/src/a", f"{tmp_path}/src/b"], f"{tmp_path}/dst", ["id"])
    out = spark.read.parquet(f"{tmp_path}/dst")
    assert got["rows"] == 9 and sorted((r["id"], r["extra"]) for r in out.collect()) == [(i, None if i < 5 else i * 2) for i in range(9)]
    spark.range(3).selectExpr("cast(id as string) id").write.parquet(f"{tmp_path}/src/c")
    with pytest.raises(Exception, match="(?i)merge"):
        compact_files(spark, [f"{tmp_path}/src/a", f"{tmp_path}/src/c"], f"{tmp_path}/no", ["id"])


def spans(spark, path, column):
    out = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n")).collect()
    return sorted((r.a, r.b, r.n) for r in out)


def test_files_are_ranges_of_codes_however_skewed(spark, tmp_path):
    """An outlier far away, and a value that a third of the rows have."""
    df = spark.range(6000).selectExpr("if(id = 77, 1000000000000, if(id % 3 = 0, 500, id)) AS k", "id")
    df.repartition(12).write.parquet(f"{tmp_path}/src")
    got = compact_files(spark, f"{tmp_path}/src", f"{tmp_path}/dst", ["k"], rows_per_file=600)
    files = spans(spark, f"{tmp_path}/dst", "k")
    assert got["files"] == len(files) == 10 and max(n for *_, n in files) < 1.3 * 600
    assert all(a[1] <= b[0] for a, b in zip(files, files[1:])) and sum(a <= 500 <= b for a, b, _ in files) >= 3


def test_directories_are_compacted_each_and_large_files_left(spark, tmp_path):
    src, dst = f"{tmp_path}/src", f"{tmp_path}/dst"
    for name, n, parts in (("k=a b", 4000, 9), ("k=c%d+/x", 500, 3), ("alone", 50, 1), ("_hidden", 50, 2)):
        spark.range(n).selectExpr("id", "id % 10 AS v", "cast(null as int) AS dir").repartition(parts).write.parquet(f"{src}/{name}")
    spark.range(200_000).selectExpr("id", "id AS v", "1 AS dir").coalesce(1).write.mode("append").parquet(f"{src}/k=a b")
    got = compact_files(spark, src, dst, ["v", "id"], target_bytes=12_000, small=200_000)
    assert got["rows"] == 4500 and got["directories"] == 2
    for name, n in (("k=a b", 4000), ("k=c%d+/x", 500)):
        assert rows(spark.read.parquet(f"{dst}/{name}").select("id", "v")) == rows(spark.range(n).selectExpr("id", "id % 10 AS v"))
    assert sorted(p.name for p in (tmp_path / "dst").iterdir()) == ["k=a b", "k=c%d+"]
    assert compact_files(spark, f"{src}/alone", f"{tmp_path}/no", ["id"])["files"] == 0


def test_plan_refines_hot_directories(spark, monkeypatch):
    import siftlake.operators.compaction as compaction

    f = spark.range(500).select(
        F.col("id").alias("file_id"), F.lit(1).cast("bigint").alias("dataset_id"), F.concat(F.lit("/a/"), F.when(F.col("id") < 400, "hot").otherwise((F.col("id") % 9).cast("string")), F.lit("/"), "id").alias("path"),
        (F.lit(1000) + F.col("id") % 7).alias("length"), F.lit(False).alias("is_dir"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") * 3).alias("modification_time"),
    )
    _, g, b = tables(spark)
    g = spark.range(500).selectExpr("id file_id", "0 block_no", "id % 11 row_count", "cast(null as map<string, struct<min_value: string>>) indexed_columns")
    monkeypatch.setattr(compaction, "CELL_FILES", 16)
    plan = compaction_plan(f, g, b.limit(0), target=20_000).collect()
    assert len(plan) == 500
    for name in {r.directory for r in plan}:
        line = sorted((r.row_offset, r.row_count, r.code) for r in plan if r.directory == name)
        at = 0
        for offset, n, _ in line:
            assert offset == at
            at += n
        held = sorted((r.output_no, r.code) for r in plan if r.directory == name)
        assert [c for _, c in held] == sorted(c for _, c in held)
