import __spark_entry__ as entry_points
from conftest import rows


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_index_queries_over_the_whole_table(spark):
    d = "/root/testdata/sf0.001"
    for t in ("lineitem", "orders"):
        spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(t)
    names = "eq_int eq_string not_in is_null is_not_null null_safe_eq projection overwrite join self_join agg window sql".split()
    for name in (f"idx_{n}_whole" if n.endswith("join") or n == "sql" else f"idx_{n}" for n in names):
        want = rows(spark.sql(entry_points.oracle_sql()[name]))
        assert want and rows(entry_points.queries()[name](spark, d)) == want, name
