"""Finding the table behind a source name and a path or catalog name."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from siftlake.sources.metastore import Files, IndexLocation

#: Names that mean Parquet.
PARQUET_NAMES = {"parquet", "parquetformat", "org.apache.spark.sql.execution.datasources.parquet", "org.apache.spark.sql.execution.datasources.parquet.parquetfileformat"}
#: Other formats Spark reads, for which there is no index.
OTHER_FORMATS = {"json", "csv", "orc", "text", "avro", "binaryfile", "xml"}


class FormatSupport(Protocol):
    """What a table format must offer to be indexed. Index folders are made, marked and removed by the metastore."""

    #: lower-case letters and digits; a part of the folder of an index
    identifier: str

    def create_index(self, spark: SparkSession, root: str, to: str, columns: list[str] | None, option: str | None, options: dict[str, str], tasks: int) -> None:
        """Write the index of the table at ``root`` into the folder ``to``."""

    def load_index(self, spark: SparkSession, at: str, eager: bool):
        """The index in folder ``at``, as ``plans.pruning.LoadedIndex``."""


class ParquetSupport:
    identifier = "parquet"

    def create_index(self, spark, root, to, columns, option, options, tasks) -> None:
        from siftlake.sources.index_build import build_index

        build_index(spark, root, to, columns, option, options, tasks)

    def load_index(self, spark, at, eager):
        from siftlake.plans.pruning import LoadedIndex

        return LoadedIndex(spark, at, eager)


_SUPPORTED: dict[str, FormatSupport] = {"parquet": ParquetSupport()}
_NAMES: dict[str, str] = dict.fromkeys(PARQUET_NAMES, "parquet")


def register_format(support: FormatSupport, *names: str) -> None:
    """Make a format known by its identifier and ``names``; the last one registered under a name holds."""
    _SUPPORTED[support.identifier] = support
    _NAMES.update(dict.fromkeys([support.identifier, *(n.lower() for n in names)], support.identifier))


def format_of(identifier: str) -> FormatSupport:
    return _SUPPORTED[identifier]


def check_source(name: str) -> str:
    """Identifier of the format of that name (``parquet`` for its spellings); names without support fail."""
    if found := _NAMES.get(name.lower()):
        return found
    raise ValueError(f"Failed to find data source: {name.upper() if name.lower() in OTHER_FORMATS else name}")


def resolve_path(spark: SparkSession, path: str) -> str:
    """Qualified path of a table, which must exist; no patterns."""
    files = Files(spark)
    if any(c in path for c in "*?[{"):
        raise ValueError(f"Expected a single path, found pattern {path}")
    if not files.exists(path):
        raise FileNotFoundError(f"Path {path} does not exist")
    return files.qualified(path)


@dataclass(frozen=True)
class CatalogTable:
    name: str
    path: str
    provider: str


def resolve_table(spark: SparkSession, name: str) -> CatalogTable:
    """A persistent table with its one location; views and missing tables fail."""
    if not spark.catalog.tableExists(name):
        raise AnalysisException(f"Table or view '{name}' not found")
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    if rows.get("Type", "").upper() == "VIEW" or "Location" not in rows:
        raise NotImplementedError(f"Table {name} is not a file table with a single location")
    return CatalogTable(name, rows["Location"], rows.get("Provider", ""))


def spec_for(path: str, catalog: bool, identifier: str = "parquet") -> IndexLocation:
    return IndexLocation(path, "catalog" if catalog else "source", identifier)
