"""Queries through the data-skipping index.

The given tables are single files, so each query first stages a copy of several
files in the shared folder (once per session and table) and indexes that; the
rows are those of the given table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.index import IndexedDataFrame, QueryContext
from siftlake.plans.shared import fresh_dir, shared_dir
from siftlake.queries.tables import table
from siftlake.sources.metastore import METASTORE_LOCATION

_STAGED: dict[tuple[str, str, str], str] = {}
_CONTEXTS: dict[str, QueryContext] = {}
_FILTER_TYPE = "spark.sql.index.parquet.filter.type"
#: Staged files of a clustered table.
FILES = 16


def context(spark: SparkSession) -> QueryContext:
    app = spark.sparkContext.applicationId
    if app not in _CONTEXTS:
        _CONTEXTS[app] = QueryContext(spark)
    spark.conf.set(METASTORE_LOCATION, f"{shared_dir(spark)}/index_metastore")
    return _CONTEXTS[app]


def _stage(spark: SparkSession, d: str, kind: str) -> str:
    """Folder of a staged table: ``orders``, ``lineitem`` and ``events`` in key order,
    ``spread`` is lineitem dealt out by part, ``by_status`` is orders partitioned."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key in _STAGED:
        return _STAGED[key]
    at = fresh_dir(spark, f"staged-{kind}")
    if kind in ("lineitem", "spread"):
        df = table(spark, d, "lineitem").withColumn("line_or_null", F.expr("nullif(l_linenumber, 3)"))
        df = df.repartition(FILES, "l_partkey") if kind == "spread" else df.repartitionByRange(FILES, "l_orderkey").sortWithinPartitions("l_orderkey")
        df.write.parquet(at)
    elif kind == "orders":
        df = table(spark, d, "orders").withColumn("o_date", F.to_date("o_orderdate"))
        df.repartitionByRange(FILES, "o_orderdate").sortWithinPartitions("o_orderdate").write.parquet(at)
    elif kind == "by_status":
        table(spark, d, "orders").repartitionByRange(4, "o_orderkey").write.partitionBy("o_orderstatus").parquet(at)
    else:
        df = table(spark, d, "events")
        df.repartitionByRange(FILES, "ts").sortWithinPartitions("ts").write.parquet(at)
    _STAGED[key] = at
    return at


def indexed(spark: SparkSession, d: str, kind: str, *columns: str, filter_type: str = "bloom") -> IndexedDataFrame:
    """The staged table with an index on ``columns`` (all if none are named), built once per choice."""
    ctx, at = context(spark), _stage(spark, d, kind)
    done = (spark.sparkContext.applicationId, at, f"{columns}{filter_type}")
    if done not in _STAGED or _STAGED.get((*done[:2], "last")) != done[2]:
        old = spark.conf.get(_FILTER_TYPE, None)
        spark.conf.set(_FILTER_TYPE, filter_type)
        try:
            command = ctx.index.create.mode("overwrite")
            (command.indexBy(*columns) if columns else command.indexByAll()).parquet(at)
        finally:
            spark.conf.unset(_FILTER_TYPE) if old is None else spark.conf.set(_FILTER_TYPE, old)
        _STAGED[done] = at
        _STAGED[(*done[:2], "last")] = done[2]
    return ctx.index.parquet(at)


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]
ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_COLUMNS = {"lineitem": LINE, "spread": LINE, "orders": ORDER, "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "by_status": ORDER}
_TABLE = {"spread": "lineitem", "by_status": "orders"}
_SOURCE = {"lineitem": "(SELECT *, nullif(l_linenumber, 3) AS line_or_null FROM lineitem)", "orders": "(SELECT *, CAST(o_orderdate AS DATE) AS o_date FROM orders)"}

#: name -> (staged table, indexed columns, predicate in Spark, the same in SQL if spelled otherwise)
FILTERS: dict[str, tuple] = {
    "idx_eq_long": ("lineitem", (), "l_orderkey = 5"),
    "idx_eq_int": ("lineitem", (), "l_linenumber = 7"),
    "idx_eq_string": ("lineitem", (), "l_returnflag = 'R'"),
    "idx_eq_timestamp": ("orders", (), "o_orderdate = TIMESTAMP_NTZ '1995-03-03 00:00:00'", "o_orderdate = TIMESTAMP '1995-03-03 00:00:00'"),
    "idx_eq_date": ("orders", (), "o_date = DATE '1995-03-03'"),
    "idx_in": ("lineitem", (), "l_orderkey IN (1, 77, 14999, 123456789)"),
    "idx_in_large": ("lineitem", (), "l_orderkey IN (3, 33, 333, 3333, 5, 55, 555, 5555, 7, 77, 777, 7777, 9, 99)"),
    "idx_and": ("lineitem", (), "l_orderkey > 100 AND l_partkey = 155"),
    "idx_or": ("lineitem", (), "l_orderkey = 5 OR l_orderkey = 14000"),
    "idx_or_unindexed": ("lineitem", ("l_orderkey",), "l_orderkey = 5 OR l_quantity > 49"),
    "idx_not_eq": ("lineitem", (), "l_linenumber <> 1"),
    "idx_not_in": ("lineitem", (), "l_returnflag NOT IN ('A', 'N')"),
    "idx_not_nested": ("lineitem", (), "NOT (l_orderkey > 40 OR l_returnflag = 'A')"),
    "idx_is_null": ("lineitem", (), "line_or_null IS NULL"),
    "idx_is_not_null": ("lineitem", (), "line_or_null IS NOT NULL"),
    "idx_gt": ("lineitem", (), "l_orderkey > 14900"),
    "idx_ge": ("orders", (), "o_date >= DATE '1998-06-01'"),
    "idx_lt": ("lineitem", (), "l_orderkey < 60"),
    "idx_le": ("orders", (), "o_orderdate <= TIMESTAMP_NTZ '1995-02-01 00:00:00'", "o_orderdate <= TIMESTAMP '1995-02-01 00:00:00'"),
    "idx_between": ("lineitem", (), "l_orderkey BETWEEN 700 AND 800"),
    "idx_null_safe_eq": ("lineitem", (), "line_or_null <=> NULL", "line_or_null IS NOT DISTINCT FROM NULL"),
    "idx_starts_with": ("events", (), "event_type LIKE 'sig%'"),
    "idx_contains": ("events", (), "event_type LIKE '%lic%'"),
    "idx_no_match": ("lineitem", (), "l_orderkey = -1"),
    "idx_no_index_filter": ("lineitem", ("l_orderkey",), "l_quantity > 49.5"),
    "idx_always_false": ("lineitem", (), "l_orderkey > 5 AND 1 = 2"),
    "idx_bloom_eq": ("spread", ("l_partkey", "l_returnflag"), "l_partkey = 155"),
    "idx_partition_prune": ("by_status", ("o_orderkey",), "o_orderstatus = 'F'"),
    "idx_partition_and_index": ("by_status", ("o_orderkey",), "o_orderstatus = 'O' AND o_orderkey < 400"),
}


def _filtered(kind: str, columns: tuple, predicate: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return indexed(spark, d, kind, *columns).filter(predicate).select(*_COLUMNS[kind]).pruned

    return run


def idx_dict_eq(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "spread", "l_partkey", "l_returnflag", filter_type="dict").filter("l_partkey = 156").select(*LINE).pruned


def idx_bitmap_int(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "spread", "l_linenumber", "l_partkey", filter_type="dict").filter("l_linenumber = 6 AND l_partkey IN (7, 8)").select(*LINE).pruned


def idx_all_columns(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "orders").filter("o_custkey = 370 AND o_orderdate > '1993-01-01'").select(*ORDER).pruned


def idx_catalog_table(spark: SparkSession, d: str) -> DataFrame:
    name = "staged_orders_" + str(abs(hash((d, spark.sparkContext.applicationId))))
    ctx = context(spark)
    if not spark.catalog.tableExists(name):
        table(spark, d, "orders").repartitionByRange(8, "o_orderkey").write.mode("overwrite").option("path", fresh_dir(spark, name)).format("parquet").saveAsTable(name)
    ctx.index.create.mode("ignore").indexBy("o_orderkey", "o_custkey").table(name)
    return ctx.index.table(name).filter("o_orderkey BETWEEN 1000 AND 1100").select(*ORDER).pruned


def idx_create_if_not_exists(spark: SparkSession, d: str) -> DataFrame:
    ctx, at = context(spark), _stage(spark, d, "events")
    ctx.index.delete.parquet(at)
    _STAGED.pop((spark.sparkContext.applicationId, at, "last"), None)
    spark.conf.set("spark.sql.index.createIfNotExists", "true")
    try:
        return ctx.index.parquet(at).filter("event_id < 25").select(*_COLUMNS["events"]).pruned
    finally:
        spark.conf.unset("spark.sql.index.createIfNotExists")


def idx_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Rows, nulls, smallest and largest of a column, from the index alone."""
    index = indexed(spark, d, "lineitem")._index
    i = index.numbers["line_or_null"]
    return index.stats.agg(F.sum("rows").alias("row_count"), F.sum(f"n{i}").alias("nulls"), F.min(f"a{i}").alias("smallest"), F.max(f"b{i}").alias("largest"))


def idx_join(spark: SparkSession, d: str) -> DataFrame:
    lines = indexed(spark, d, "lineitem").filter("l_orderkey BETWEEN 100 AND 400")
    orders = indexed(spark, d, "orders").filter("o_date >= DATE '1996-01-01'")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate")


def idx_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Two scans of one table with different filters in one plan."""
    a = indexed(spark, d, "lineitem").filter("l_orderkey < 200").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("low_order"))
    b = indexed(spark, d, "lineitem").filter("l_orderkey > 14000").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("high_order"))
    return a.join(b, "part").select("part", "low_order", "high_order")


def idx_union(spark: SparkSession, d: str) -> DataFrame:
    a = indexed(spark, d, "lineitem").filter("l_orderkey = 5").select("l_orderkey", "l_partkey")
    b = indexed(spark, d, "lineitem").filter("l_orderkey = 7777").select("l_orderkey", "l_partkey")
    return a.unionByName(b)


def idx_sql(spark: SparkSession, d: str) -> DataFrame:
    indexed(spark, d, "lineitem")
    indexed(spark, d, "orders")
    return context(spark).index.sql(
        "SELECT o_orderpriority, count(*) AS n FROM idx_line JOIN idx_order ON l_orderkey = o_orderkey WHERE l_orderkey < 2500 AND o_date < DATE '1997-01-01' GROUP BY o_orderpriority",
        idx_line=_stage(spark, d, "lineitem"),
        idx_order=_stage(spark, d, "orders"),
    )


def idx_projection(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net")).pruned


def idx_overwrite(spark: SparkSession, d: str) -> DataFrame:
    ctx, at = context(spark), _stage(spark, d, "lineitem")
    ctx.index.create.mode("overwrite").indexBy("l_orderkey").parquet(at)
    ctx.index.create.mode("ignore").indexBy("l_partkey").parquet(at)
    ctx.index.create.mode("overwrite").indexBy("l_suppkey", "l_orderkey").parquet(at)
    _STAGED[spark.sparkContext.applicationId, at, "last"] = "overwritten"
    return ctx.index.parquet(at).filter("l_suppkey = 3").select(*LINE).pruned


def idx_join_whole(spark: SparkSession, d: str) -> DataFrame:
    orders = indexed(spark, d, "orders").filter("o_date >= DATE '1996-01-01'")
    return indexed(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "o_orderdate")


def idx_self_join_whole(spark: SparkSession, d: str) -> DataFrame:
    """Two scans of one whole table with different filters in one plan."""
    a = indexed(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("returned_order"))
    b = indexed(spark, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("long_order"))
    return a.join(b, "part").select("part", "returned_order", "long_order")


def idx_agg(spark: SparkSession, d: str) -> DataFrame:
    df = indexed(spark, d, "lineitem")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("supp"), F.max("l_shipdate").alias("last_ship"))


def idx_window(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey")
    df = indexed(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return df.pruned.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").select("l_orderkey", "l_partkey", "rank")


def idx_sql_whole(spark: SparkSession, d: str) -> DataFrame:
    indexed(spark, d, "lineitem")
    indexed(spark, d, "orders")
    return context(spark).index.sql(
        "SELECT o_orderpriority, count(*) AS n FROM idx_line JOIN idx_order ON l_orderkey = o_orderkey WHERE o_date < DATE '1997-01-01' GROUP BY o_orderpriority",
        idx_line=_stage(spark, d, "lineitem"),
        idx_order=_stage(spark, d, "orders"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _filtered(*spec[:3]) for name, spec in FILTERS.items()},
    **{
        f.__name__: f
        for f in (
            idx_projection, idx_dict_eq, idx_bitmap_int, idx_all_columns, idx_catalog_table, idx_create_if_not_exists, idx_overwrite,
            idx_stats_rollup, idx_join, idx_self_join, idx_agg, idx_window, idx_union, idx_sql,
            idx_join_whole, idx_self_join_whole, idx_sql_whole,
        )
    },
}

_L, _O = ", ".join(LINE), ", ".join(ORDER)
SQL: dict[str, str] = {
    **{
        name: f"SELECT {', '.join(_COLUMNS[spec[0]])} FROM {_SOURCE.get(_TABLE.get(spec[0], spec[0]), _TABLE.get(spec[0], spec[0]))} WHERE {spec[-1]}"
        for name, spec in FILTERS.items()
    },
    "idx_dict_eq": f"SELECT {_L} FROM lineitem WHERE l_partkey = 156",
    "idx_bitmap_int": f"SELECT {_L} FROM lineitem WHERE l_linenumber = 6 AND l_partkey IN (7, 8)",
    "idx_all_columns": f"SELECT {_O} FROM orders WHERE o_custkey = 370 AND o_orderdate > TIMESTAMP '1993-01-01'",
    "idx_catalog_table": f"SELECT {_O} FROM orders WHERE o_orderkey BETWEEN 1000 AND 1100",
    "idx_create_if_not_exists": "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE event_id < 25",
    "idx_stats_rollup": "SELECT count(*) AS row_count, count(*) FILTER (l_linenumber = 3) AS nulls, min(nullif(l_linenumber, 3)) AS smallest, max(nullif(l_linenumber, 3)) AS largest FROM lineitem",
    "idx_join": "SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey BETWEEN 100 AND 400 AND o_orderdate >= TIMESTAMP '1996-01-01'",
    "idx_self_join": "SELECT a.l_partkey AS part, a.l_orderkey AS low_order, b.l_orderkey AS high_order FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey < 200 AND b.l_orderkey > 14000",
    "idx_union": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (5, 7777)",
    "idx_sql": "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey < 2500 AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL",
    "idx_projection": "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    "idx_overwrite": f"SELECT {_L} FROM lineitem WHERE l_suppkey = 3",
    "idx_join_whole": "SELECT l_orderkey, l_linenumber, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01'",
    "idx_self_join_whole": "SELECT a.l_partkey AS part, a.l_orderkey AS returned_order, b.l_orderkey AS long_order FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_linenumber = 7",
    "idx_agg": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS supp, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL",
    "idx_window": "SELECT l_orderkey, l_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 2",
    "idx_sql_whole": "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL",
}
