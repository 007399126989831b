"""Queries of the general operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.operators.compaction import compact_files, compaction_plan, plan_digest
from siftlake.operators.heavy import busiest, host_load
from siftlake.operators.incremental import claimed, ledger_intervals, new_or_changed
from siftlake.operators.schema_drift import DriftCatalogue
from siftlake.operators.snapshots import snapshot_changes
from siftlake.plans.shared import cut, fresh_dir
from siftlake.queries.tables import table
from siftlake.sources.footers import list_files


def _drift(spark: SparkSession, d: str) -> DriftCatalogue:
    return DriftCatalogue(table(spark, d, "file_status"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).changes()


def p1_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).schema_history()


def p1_casts(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).casts()


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction_plan(table(spark, d, "file_status"), table(spark, d, "block_metadata"), table(spark, d, "block_locations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d).select("file_id")


def p2_plan(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d)


def p2_digest(spark: SparkSession, d: str) -> DataFrame:
    plan = cut(_plan(spark, d), "plan")
    return plan_digest(plan, table(spark, d, "file_status"), table(spark, d, "block_metadata"), table(spark, d, "block_locations"))


def _rewritten(spark: SparkSession, d: str, cluster_by: list[str]) -> DataFrame:
    """``events`` scattered over 64 small files in four directories, rewritten as twelve, and read."""
    source, target = fresh_dir(spark, "scattered"), fresh_dir(spark, "compacted")
    events = table(spark, d, "events")
    events.withColumn("bucket", F.pmod("event_id", F.lit(4))).repartition(16).write.partitionBy("bucket").parquet(source)
    size = list_files(spark, [source]).agg(F.sum("length")).first()[0]
    compact_files(spark, source, target, cluster_by, target_bytes=-(-size // 10))
    return spark.read.parquet(target)


def p2_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return _rewritten(spark, d, ["ts", "user_id", "value"]).drop("bucket")


def p2_layout(spark: SparkSession, d: str) -> DataFrame:
    """Per directory the rewritten files, and how many of them begin before the one before has ended (equal values aside)."""
    spans = _rewritten(spark, d, ["ts"]).groupBy("bucket", F.col("_metadata.file_name").alias("file")).agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    before = F.lag("high").over(Window.partitionBy("bucket").orderBy("low", "high"))
    return spans.withColumn("before", before).groupBy("bucket").agg(F.count("*").alias("files"), F.count_if(F.col("low") < F.col("before")).alias("overlaps"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "snapshot_files"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("dataset_id", "snapshot_no", "change_kind").agg(F.count("*").alias("files"))


def _claimed(spark: SparkSession, d: str) -> DataFrame:
    return claimed(table(spark, d, "file_arrivals"), table(spark, d, "index_runs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return new_or_changed(_claimed(spark, d))


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    return ledger_intervals(_claimed(spark, d))


def p5_hosts(spark: SparkSession, d: str) -> DataFrame:
    return host_load(table(spark, d, "block_locations"), table(spark, d, "file_status"), table(spark, d, "cluster_hosts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # read twice, for the totals and for the rows; one row per host
    return busiest(cut(p5_hosts(spark, d), "host-load")).select("host_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_lifespans, p1_casts, p2_found, p2_plan, p2_digest, p2_rewrite, p2_layout, p3_found, p3_counts,
        p4_found, p4_intervals, p5_found, p5_hosts,
    )
}
