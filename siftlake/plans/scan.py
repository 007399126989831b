"""Scans of chosen files of a Parquet table, as relations that Catalyst sees as any other.

The scans of one read share their column ids, reader options and schema; only the
files differ. So what a user has built on one of them can be replayed on another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

#: Reader option that tells the scans of one read from all others.
MARK = "siftlake.scan"


def _paths(spark: SparkSession, paths: list[str]):
    """Scala sequence of Hadoop paths; a few calls to the JVM, not one a path."""
    jvm = spark._jvm
    if not paths:
        return jvm.PythonUtils.toSeq([])
    if any("\n" in p for p in paths):
        return jvm.PythonUtils.toSeq([jvm.org.apache.hadoop.fs.Path(p) for p in paths])
    util = jvm.org.apache.hadoop.util.StringUtils
    return jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(util.stringToPath(util.getStrings("\n".join(paths), "\n")))


def scan_of(
    spark: SparkSession,
    schema: T.StructType,
    partitions: list[str],
    paths: list[str],
    base: str | None,
    options: dict[str, str],
    like: DataFrame | None = None,
) -> DataFrame:
    """Scan of the Parquet files or folders ``paths`` of a table with ``schema``.

    Values of the columns ``partitions`` are taken from the folders below ``base``.
    With ``like``, an earlier scan of the same schema, columns keep its ids. Files are
    listed by Spark, in a job where there are many; without paths nothing is listed.
    """
    jvm = spark._jvm
    sources = jvm.org.apache.spark.sql.execution.datasources
    nothing = getattr(getattr(jvm.scala, "None$"), "MODULE$")
    session = spark._jsparkSession
    told = jvm.PythonUtils.toScalaMap({k: str(v) for k, v in options.items()})
    fields = lambda inside: session.parseDataType(T.StructType([f for f in schema.fields if (f.name in partitions) == inside]).json())
    data, part = fields(False), fields(True)
    listed = told.updated("basePath", base) if base else told
    whole = session.parseDataType(schema.json())
    index = sources.InMemoryFileIndex(session, _paths(spark, paths), listed, jvm.scala.Some(whole), getattr(getattr(sources, "NoopCache$"), "MODULE$"), nothing, nothing)
    relation = sources.HadoopFsRelation(index, part, data, nothing, sources.parquet.ParquetFileFormat(), told, session)
    if like is None:
        plan = getattr(getattr(sources, "LogicalRelation$"), "MODULE$").apply(relation, False)
    else:
        plan = sources.LogicalRelation(relation, like._jdf.queryExecution().analyzed().output(), nothing, False, nothing)
    dataset = getattr(getattr(jvm.org.apache.spark.sql.classic, "Dataset$"), "MODULE$")
    return ClassicDataFrame(dataset.ofRows(session, plan), spark)
