"""Footers of Parquet files, read on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key under which Spark keeps a table's schema in the footer.
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, file_path, length, modified): all Parquet files below ``paths``, service
    files left out, listed by Spark without reading one. ``path`` is the plain
    spelling, ``file_path`` that of the hidden metadata column of a scan, which
    escapes some characters."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .select("path", F.col("_metadata.file_path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))
    )


def _schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    for batch in batches:
        texts = []
        for path in batch["path"].to_pylist():
            fs, at = open_path(path)
            with fs.open_input_file(at) as f:
                schema = pq.ParquetFile(f).schema_arrow
            own = (schema.metadata or {}).get(SPARK_SCHEMA)
            if own is None:
                own = from_arrow_schema(schema.remove_metadata(), prefer_timestamp_ntz=True).json().encode()
            texts.append(own.decode())
        yield pa.record_batch([batch["path"], batch["modified"], pa.array(texts, pa.string())], ["path", "modified", "schema"])


def open_path(path: str):
    """Arrow file system and path of a Hadoop path; local paths without the JVM."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def file_schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, modified, schema): the files below ``paths`` with their schemas as Spark JSON."""
    return list_files(spark, paths).select("path", "modified").mapInArrow(_schemas, "path string, modified timestamp, schema string")
