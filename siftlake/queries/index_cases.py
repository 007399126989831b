"""More queries through the index: awkward files and values, options, and plans above the scan."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.index import IndexedDataFrame, QueryContext
from siftlake.plans.shared import fresh_dir, shared_dir
from siftlake.queries.index import LINE, ORDER, context, indexed
from siftlake.queries.tables import table
from siftlake.sources.metastore import METASTORE_LOCATION, IndexLocation

_STAGED: dict[tuple[str, str, str], str] = {}
_ON, _EAGER, _TASKS = "spark.sql.index.parquet.filter.enabled", "spark.sql.index.parquet.filter.eagerLoading", "spark.sql.index.partitions"
#: Texts whose order by UTF-8 bytes, by UTF-16 units and by letter differ, beside empty and missing ones.
_NOTE = "CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'é' || l_returnflag WHEN 3 THEN '日本' || l_linestatus WHEN 4 THEN '😀' WHEN 5 THEN 'z' WHEN 6 THEN '￮' END"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for a while; ``__`` stands for a dot."""
    named = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in named}
    try:
        for k, v in named.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _staged(spark: SparkSession, d: str, kind: str, write: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _STAGED:
        at = fresh_dir(spark, f"staged-{kind}")
        write(at)
        _STAGED[key] = at
    return _STAGED[key]


def _two_producers(spark: SparkSession, d: str) -> str:
    """``lineitem``, of which one producer writes names in upper case and in another order."""

    def write(at: str) -> None:
        df = table(spark, d, "lineitem").select(*LINE)
        df.filter("l_orderkey % 2 = 1").repartitionByRange(8, "l_orderkey").write.parquet(at)
        shouted = df.filter("l_orderkey % 2 = 0").select(*[F.col(c).alias(c.upper()) for c in reversed(LINE)])
        shouted.repartitionByRange(8, "L_ORDERKEY").write.mode("append").parquet(at)

    return _staged(spark, d, "two-producers", write)


def idx_mixed_case(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in letter case between files, with an index without and one with filters."""
    at, parts = _two_producers(spark, d), []
    for on in ("false", "true"):
        with settings(spark, **{_ON: on}):
            context(spark).index.create.mode("overwrite").indexByAll().parquet(at)
        df = context(spark).index.parquet(at).filter("L_PARTKEY = 155 OR l_orderkey = 102 OR l_suppkey IS NULL")
        parts.append(df.select(*LINE, F.lit(on == "true").alias("filters")).pruned)
    return parts[0].unionByName(parts[1])


def idx_many_files(spark: SparkSession, d: str) -> DataFrame:
    """More than a thousand kept files, a reader option, and columns taken from the indexed DataFrame itself."""
    at = _staged(spark, d, "many-files", lambda at: table(spark, d, "orders").repartitionByRange(1_200, "o_orderkey").write.parquet(at))
    with settings(spark, **{_ON: "false"}):
        context(spark).index.create.mode("ignore").indexBy("o_orderkey").parquet(at)
    df = context(spark).index.option("pathGlobFilter", "*.parquet").parquet(at)
    return df.filter(df["o_orderkey"] >= 1_000).filter(df.o_totalprice > 100).select(*ORDER).pruned


def idx_load_with_options(spark: SparkSession, d: str) -> DataFrame:
    indexed(spark, d, "orders")
    from siftlake.queries.index import _stage

    manager = context(spark).index.format("org.apache.spark.sql.execution.datasources.parquet").option("mergeSchema", True).options({"recursiveFileLookup": "false", "mergeschema": "false"})
    return manager.load(_stage(spark, d, "orders")).filter("o_custkey = 370").select(*ORDER).pruned


def _outcomes(spark: SparkSession, tried: dict[str, Callable[[], object]]) -> DataFrame:
    """(what, outcome): what each action gives, or the class of the error that it raises."""
    rows = []
    for what, action in tried.items():
        try:
            rows.append((what, str(action())))
        except Exception as e:  # noqa: BLE001
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, outcome string")


def _outcome_sql(outcomes: dict[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in outcomes.items()) + ") AS t(what, outcome)"


def idx_modes(spark: SparkSession, d: str) -> DataFrame:
    ctx, at = context(spark), _staged(spark, d, "modes", lambda at: table(spark, d, "nation").write.parquet(at))
    ctx.index.delete.parquet(at)
    create = lambda mode: lambda: ctx.index.create.mode(mode).indexBy("n_nationkey").parquet(at)
    there = lambda: ctx.index.exists.parquet(at)
    return _outcomes(
        spark,
        {
            "1 exists before": there, "2 append to none": create("append"), "3 exists after": there, "4 error on one": create("error"), "5 append to one": create("append"),
            "6 ignore": create("IGNORE"), "7 overwrite": create("Overwrite"), "8 unknown mode": create("replace"), "9 delete": lambda: ctx.index.delete.parquet(at), "a exists": there,
            "b of no path": lambda: ctx.index.exists.parquet(at + "-none"), "c read without index": lambda: ctx.index.parquet(at), "d delete of no path": lambda: ctx.index.delete.parquet(at + "-none"),
        },
    )


def idx_sources(spark: SparkSession, d: str) -> DataFrame:
    """Names of sources, and tables that can't be indexed."""
    ctx, at = context(spark), _staged(spark, d, "sources", lambda at: table(spark, d, "region").write.parquet(at))
    name = "staged_json_" + str(abs(hash((d, spark.sparkContext.applicationId))))
    if not spark.catalog.tableExists(name):
        table(spark, d, "region").write.mode("overwrite").format("json").option("path", fresh_dir(spark, name)).saveAsTable(name)
    ctx.index.create.mode("ignore").indexByAll().parquet(at)
    rows_of = lambda source: lambda: ctx.index.format(source).load(at).filter("r_regionkey = 3").count()
    by = lambda *c: lambda: ctx.index.create.mode("overwrite").indexBy(*c).parquet(at)
    return _outcomes(
        spark,
        {
            "parquet": rows_of("Parquet"), "ParquetFormat": rows_of("ParquetFormat"), "json": rows_of("json"), "unknown": rows_of("nothing"),
            "pattern": lambda: ctx.index.parquet(at + "*"), "json table": lambda: ctx.index.create.indexByAll().table(name), "missing table": lambda: ctx.index.exists.table("no_such_table"),
            "no column": by("r_none"), "no columns": by(), "list of columns": by(["r_regionkey", "r_name"]),
        },
    )


def idx_metastore(spark: SparkSession, d: str) -> DataFrame:
    """Roots, identifiers and caching of the metastore."""
    at = _staged(spark, d, "metastore", lambda at: table(spark, d, "region").write.parquet(at))
    context(spark)
    here = f"{shared_dir(spark)}/{fresh_dir(spark, 'roots').rsplit('/', 1)[1]}"
    with settings(spark, **{METASTORE_LOCATION: here}):
        ctx = QueryContext(spark)
        ctx.index.create.indexByAll().parquet(at)
        load = lambda: ctx.index.parquet(at)._index
        first = load()
        return _outcomes(
            spark,
            {
                "root is made": lambda: ctx._metastore.root == ctx._metastore.files.qualified(here), "second load is the first": lambda: load() is first,
                "another context loads anew": lambda: QueryContext(spark).index.parquet(at)._index is first, "replaced index is loaded anew": lambda: ctx.index.create.mode("overwrite").indexByAll().parquet(at) or load() is first,
                "bad identifier": lambda: IndexLocation(at, "source", "Parquet"), "empty dataspace": lambda: IndexLocation(at, ""), "context of nothing": lambda: QueryContext(None),
            },
        )


def _with(spark: SparkSession, d: str, predicate: str, **values: str) -> DataFrame:
    """lineitem by part, indexed and read under settings of its own."""
    with settings(spark, **values):
        at = _staged(spark, d, "by-part-" + "-".join(values.values()), lambda at: table(spark, d, "lineitem").repartitionByRange(16, "l_partkey").write.parquet(at))
        context(spark).index.create.mode("ignore").indexBy("l_partkey", "l_shipdate").parquet(at)
        return context(spark).index.parquet(at).filter(predicate).select(*LINE).pruned


def idx_filters_off(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d, "l_partkey IN (155, 3, 77)", **{_ON: "false"})


def idx_filters_eager(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d, "l_partkey = 77", **{_EAGER: "true"})


def idx_build_partitions(spark: SparkSession, d: str) -> DataFrame:
    return _with(spark, d, "l_partkey > 190 AND l_partkey <= 195", **{_TASKS: "3"})


def _noted(spark: SparkSession, d: str) -> IndexedDataFrame:
    """Odd texts in clustered files, a column that is null throughout, and a file without rows."""

    def write(at: str) -> None:
        df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_NOTE).alias("note"), F.lit(None).cast("string").alias("nothing"))
        df.repartitionByRange(16, "note", "l_orderkey").write.parquet(at)
        df.limit(0).coalesce(1).write.mode("append").parquet(at)

    at = _staged(spark, d, "noted", write)
    context(spark).index.create.mode("ignore").indexByAll().parquet(at)
    return context(spark).index.parquet(at)


#: name -> predicate over the table with odd texts
NOTES = {
    "idx_non_ascii": "note = 'éR' OR note = '😀'",
    "idx_non_ascii_range": "note > 'z'",
    "idx_non_ascii_order": "note >= '日本' AND note < '😀'",
    "idx_empty_string": "note = ''",
    "idx_not_empty_string": "note <> ''",
    "idx_all_null": "nothing IS NULL AND note = 'z'",
    "idx_all_null_value": "nothing = 'x' OR nothing > 'a' OR nothing <> 'b'",
    "idx_null_text": "note IS NULL",
}


def _noted_query(predicate: str):
    return lambda spark, d: _noted(spark, d).filter(predicate).select("l_orderkey", "l_linenumber", "note").pruned


def idx_empty_table(spark: SparkSession, d: str) -> DataFrame:
    at = _staged(spark, d, "empty", lambda at: table(spark, d, "nation").filter("n_nationkey < 0").repartition(2).write.parquet(at))
    context(spark).index.create.mode("ignore").indexByAll().parquet(at)
    return context(spark).index.parquet(at).filter("n_nationkey = 1").select("n_nationkey", "n_name").pruned


def idx_mixed_types(spark: SparkSession, d: str) -> DataFrame:
    """Literals of another type than the column's; the column is cast or the literal is."""
    return indexed(spark, d, "orders").filter("o_custkey = '370' OR o_date = '1995-03-03' OR o_orderkey = 1.0").select(*ORDER).pruned


def idx_stats_of_types(spark: SparkSession, d: str) -> DataFrame:
    """Smallest and largest of a column of each type, from the index alone."""
    index = indexed(spark, d, "orders")._index
    parts = []
    for c in ("o_orderkey", "o_orderstatus", "o_orderdate", "o_date"):
        i = index.numbers[c]
        parts.append(index.stats.agg(F.min(f"a{i}").cast("string").alias("smallest"), F.max(f"b{i}").cast("string").alias("largest"), F.sum(f"n{i}").alias("nulls")).select(F.lit(c).alias("name"), "*"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def idx_field_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of a field that differs between files, merged."""

    def write(at: str) -> None:
        df = table(spark, d, "nation")
        for folder, told in (("p=1", {"unit": "a", "origin": "x"}), ("p=2", {"unit": "b", "note": "y"})):
            df.select(F.col("n_nationkey").alias("n_nationkey", metadata=told), "n_name").coalesce(1).write.parquet(f"{at}/{folder}")

    at = _staged(spark, d, "metadata", write)
    context(spark).index.create.mode("ignore").indexBy("n_nationkey").parquet(at)
    found = context(spark).index.parquet(at).schema["n_nationkey"].metadata
    return spark.createDataFrame(sorted(found.items()), "key string, value string")


def idx_input_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of a pruned read, beside all files of the table."""
    df = indexed(spark, d, "lineitem").filter("l_orderkey < 60")
    kept, whole = len(df.inputFiles()), df._index.files_total
    return spark.createDataFrame([(0 < kept < whole, whole)], "fewer boolean, files bigint")


def idx_top_k(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "lineitem").filter("l_returnflag = 'R'").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber")


def _parts_of(spark: SparkSession, d: str, flag: str) -> IndexedDataFrame:
    return indexed(spark, d, "lineitem").filter(f"l_returnflag = '{flag}'").select("l_partkey", "l_suppkey")


def idx_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _parts_of(spark, d, "R").intersect(_parts_of(spark, d, "A"))


def idx_except(spark: SparkSession, d: str) -> DataFrame:
    return _parts_of(spark, d, "N").subtract(_parts_of(spark, d, "A"))


def idx_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _parts_of(spark, d, "A").distinct()


def idx_semi_join(spark: SparkSession, d: str) -> DataFrame:
    lines = indexed(spark, d, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return indexed(spark, d, "orders").filter("o_date >= DATE '1996-01-01'").join(lines, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


def idx_anti_join(spark: SparkSession, d: str) -> DataFrame:
    lines = indexed(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return indexed(spark, d, "orders").filter("o_orderstatus = 'F'").join(lines, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


def idx_outer_join(spark: SparkSession, d: str) -> DataFrame:
    lines = indexed(spark, d, "lineitem").filter("l_linenumber = 7").select("l_orderkey", "l_partkey")
    orders = indexed(spark, d, "orders").filter("o_date >= DATE '1997-01-01'").select("o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "full")


def idx_rollup(spark: SparkSession, d: str) -> DataFrame:
    df = indexed(spark, d, "lineitem").filter("l_linenumber <> 1")
    return df.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_suppkey").alias("supp"))


def idx_cube(spark: SparkSession, d: str) -> DataFrame:
    return indexed(spark, d, "orders").filter("o_orderstatus <> 'P'").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


def idx_having(spark: SparkSession, d: str) -> DataFrame:
    df = indexed(spark, d, "lineitem").filter("l_returnflag IN ('A', 'R')")
    return df.groupBy("l_orderkey").agg(F.count("*").alias("n")).filter("n >= 6")


def idx_sql_subquery(spark: SparkSession, d: str) -> DataFrame:
    """The filter of the outer scan must not reach the scan of the subquery."""
    indexed(spark, d, "orders")
    from siftlake.queries.index import _stage

    return context(spark).index.sql(
        "SELECT o_orderkey FROM idx_order WHERE o_orderstatus = 'P' AND o_totalprice > (SELECT avg(o_totalprice) FROM idx_order)", idx_order=_stage(spark, d, "orders")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _noted_query(p) for name, p in NOTES.items()},
    **{
        f.__name__: f
        for f in (
            idx_mixed_case, idx_many_files, idx_load_with_options, idx_modes, idx_sources, idx_metastore, idx_filters_off, idx_filters_eager, idx_build_partitions, idx_empty_table,
            idx_mixed_types, idx_stats_of_types, idx_field_metadata, idx_input_files, idx_top_k, idx_intersect, idx_except, idx_distinct, idx_semi_join, idx_anti_join, idx_outer_join,
            idx_rollup, idx_cube, idx_having, idx_sql_subquery,
        )
    },
}

_L, _O = ", ".join(LINE), ", ".join(ORDER)
_PARTS = "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = '{0}'"
SQL: dict[str, str] = {
    **{name: f"SELECT l_orderkey, l_linenumber, note FROM (SELECT *, {_NOTE} AS note, CAST(NULL AS VARCHAR) AS nothing FROM lineitem) WHERE {p}" for name, p in NOTES.items()},
    "idx_mixed_case": f"SELECT {_L}, filters FROM lineitem, (VALUES (false), (true)) AS f(filters) WHERE l_partkey = 155 OR l_orderkey = 102 OR l_suppkey IS NULL",
    "idx_many_files": f"SELECT {_O} FROM orders WHERE o_orderkey >= 1000 AND o_totalprice > 100",
    "idx_load_with_options": f"SELECT {_O} FROM orders WHERE o_custkey = 370",
    "idx_modes": _outcome_sql(
        {
            "1 exists before": "False", "2 append to none": "None", "3 exists after": "True", "4 error on one": "OSError", "5 append to one": "NotImplementedError", "6 ignore": "None",
            "7 overwrite": "None", "8 unknown mode": "NotImplementedError", "9 delete": "None", "a exists": "False", "b of no path": "False", "c read without index": "FileNotFoundError", "d delete of no path": "FileNotFoundError",
        }
    ),
    "idx_sources": _outcome_sql(
        {
            "parquet": "1", "ParquetFormat": "1", "json": "ValueError", "unknown": "ValueError", "pattern": "ValueError", "json table": "ValueError", "missing table": "AnalysisException",
            "no column": "ValueError", "no columns": "ValueError", "list of columns": "None",
        }
    ),
    "idx_metastore": _outcome_sql(
        {
            "root is made": "True", "second load is the first": "True", "another context loads anew": "False", "replaced index is loaded anew": "False",
            "bad identifier": "ValueError", "empty dataspace": "ValueError", "context of nothing": "AttributeError",
        }
    ),
    "idx_filters_off": f"SELECT {_L} FROM lineitem WHERE l_partkey IN (155, 3, 77)",
    "idx_filters_eager": f"SELECT {_L} FROM lineitem WHERE l_partkey = 77",
    "idx_build_partitions": f"SELECT {_L} FROM lineitem WHERE l_partkey > 190 AND l_partkey <= 195",
    "idx_empty_table": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 0",
    "idx_mixed_types": f"SELECT {_O} FROM orders WHERE o_custkey = 370 OR CAST(o_orderdate AS DATE) = DATE '1995-03-03' OR o_orderkey = 1",
    "idx_stats_of_types": """SELECT 'o_orderkey' AS name, CAST(min(o_orderkey) AS VARCHAR) AS smallest, CAST(max(o_orderkey) AS VARCHAR) AS largest, 0 AS nulls FROM orders
UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus), 0 FROM orders
UNION ALL SELECT 'o_orderdate', CAST(epoch_us(min(o_orderdate)) AS VARCHAR), CAST(epoch_us(max(o_orderdate)) AS VARCHAR), 0 FROM orders
UNION ALL SELECT 'o_date', CAST(min(CAST(o_orderdate AS DATE)) - DATE '1970-01-01' AS VARCHAR), CAST(max(CAST(o_orderdate AS DATE)) - DATE '1970-01-01' AS VARCHAR), 0 FROM orders""",
    "idx_field_metadata": "SELECT * FROM (VALUES ('note', 'y'), ('origin', 'x'), ('unit', 'b')) AS t(key, value)",
    "idx_input_files": "SELECT true AS fewer, 16 AS files",
    "idx_top_k": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25",
    "idx_intersect": f"{_PARTS.format('R')} INTERSECT {_PARTS.format('A')}",
    "idx_except": f"{_PARTS.format('N')} EXCEPT {_PARTS.format('A')}",
    "idx_distinct": _PARTS.format("A").replace("SELECT", "SELECT DISTINCT"),
    "idx_semi_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)",
    "idx_anti_join": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "idx_outer_join": """SELECT l_orderkey, l_partkey, o_orderkey FROM (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 7)
FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01') ON l_orderkey = o_orderkey""",
    "idx_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_suppkey) AS BIGINT) AS supp FROM lineitem WHERE l_linenumber <> 1 GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "idx_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "idx_having": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_orderkey HAVING count(*) >= 6",
    "idx_sql_subquery": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
}
