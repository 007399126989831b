from conftest import rows

from siftlake.operators.incremental import IntervalLedger
from siftlake.streaming.ledger import run_with_ledger


def test_replayed_batches_change_nothing(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "ledger")
    spark.range(10).write.parquet(source)

    def go(checkpoint):
        stream = spark.readStream.schema("id long").parquet(source)
        query = run_with_ledger(stream, root, "id", lambda df: df.selectExpr("id", "id * 2 AS twice"), str(tmp_path / checkpoint))
        query.awaitTermination()
        return IntervalLedger(spark, root)

    assert go("a").processed() == [(0, 9)]
    spark.range(7, 15).write.mode("append").parquet(source)
    assert go("a").processed() == [(0, 14)]
    # a lost checkpoint hands over everything again
    assert rows(go("b").output()) == [(i, 2 * i) for i in sorted(range(15), key=lambda i: repr((i, 2 * i)))]
