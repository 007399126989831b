import urllib.parse

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftlake.functions.paths import canonical_path, directory, epoch_seconds, is_service_path

PATHS = [
    ("hdfs://nn:8020/a/b", "/a/b"), ("file:/a//b/", "/a/b"), ("file:///a/b", "/a/b"), ("/a/b", "/a/b"), ("s3a://bucket//x///y", "/x/y"),
    ("/a/ds%3D1/Gr%C3%BCn", "/a/ds=1/Grün"), ("/a+b/c%2Bd", "/a+b/c+d"), ("/100%/x", "/100%/x"), ("/a%zz/%41", "/a%zz/A"), ("/%2541", "/%41"), ("", ""), ("/", ""), (None, None),
]


def test_canonical_path(spark):
    df = spark.createDataFrame([(p,) for p, _ in PATHS], "p string")
    assert [r[0] for r in df.select(canonical_path(F.col("p"))).collect()] == [w for _, w in PATHS]
    for p, want in PATHS:
        if p and not p.endswith("/") and "zz" not in p:
            assert urllib.parse.unquote(p).endswith(want.rsplit("/", 1)[-1])


@pytest.mark.parametrize("path, service", [("/a/_SUCCESS", True), ("/a/_bucket=3/x", False), ("/.hid/x", True), ("/a/b_c/d.e", False), ("/_temporary/0/x", True)])
def test_service(spark, path, service):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(is_service_path(F.col("p"))).first()[0] is service


def test_directory_and_seconds(spark):
    df = spark.createDataFrame([("/a/b/c", 1_635_014_515_999), ("/x", 1_635_014_515), (None, None)], "p string, t bigint")
    assert rows(df.select(directory(F.col("p")), epoch_seconds(F.col("t")))) == [("", 1_635_014_515), ("/a/b", 1_635_014_515), (None, None)]
