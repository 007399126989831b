"""Query context: create, find, drop and use data-skipping indexes of Parquet tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.classic.dataframe import DataFrame as ClassicDataFrame

from siftlake.functions.filters import KINDS
from siftlake.plans.predicate import TRUE, Node, scan_conditions
from siftlake.plans.pruning import LoadedIndex
from siftlake.plans.scan import MARK
from siftlake.sources.metastore import METASTORE_LOCATION, IndexLocation, Metastore
from siftlake.sources.tables import check_source, format_of, resolve_path, resolve_table, spec_for

MODES = ("append", "overwrite", "error", "ignore")


class Const:
    PARQUET_SOURCE = "parquet"
    METASTORE_LOCATION = METASTORE_LOCATION


class IndexConf:
    """Options of indexes and their defaults, kept in the session."""

    DEFAULTS = {
        METASTORE_LOCATION: "",
        "spark.sql.index.createIfNotExists": "false",
        "spark.sql.index.partitions": "0",
        "spark.sql.index.parquet.filter.enabled": "true",
        "spark.sql.index.parquet.filter.type": "bloom",
        "spark.sql.index.parquet.filter.eagerLoading": "false",
    }

    def __init__(self, spark: SparkSession):
        self._conf = spark.conf

    def get(self, key: str) -> str:
        return self._conf.get(key, self.DEFAULTS[key])

    def flag(self, key: str) -> bool:
        value = self.get(key).lower()
        if value not in ("true", "false"):
            raise ValueError(f"{key} should be boolean, but was {value}")
        return value == "true"

    def set(self, key: str, value) -> None:
        if key not in self.DEFAULTS:
            raise KeyError(key)
        self._conf.set(key, str(value).lower() if isinstance(value, bool) else str(value))

    def unset(self, key: str) -> None:
        self._conf.unset(key)

    @property
    def filter_option(self) -> str | None:
        if not self.flag("spark.sql.index.parquet.filter.enabled"):
            return None
        option = self.get("spark.sql.index.parquet.filter.type")
        if option not in KINDS:
            raise ValueError(f"Unsupported filter statistics type {option}, expected one of {', '.join(KINDS)}")
        return option


class IndexedDataFrame(ClassicDataFrame):
    """A DataFrame over an indexed table that waits with the scan until it is used.

    ``filter``, ``select`` and the like are collected; whatever else is called runs on
    the scan of the files that the index can't rule out, which ``pruned`` gives.
    Filters stay in place, so a row is never wrong, only skipped early. Options of the
    reader and ids of columns are those of an ordinary read, however many files are
    kept. Nothing is shared between two of these, so both sides of a self-join keep
    their own files.
    """

    def __new__(cls, *args, **kwargs):
        return object.__new__(cls)

    def __init__(self, index: LoadedIndex, options: dict[str, str], steps: tuple = (), shape: DataFrame | None = None):
        super().__init__(None, index.spark)
        self._index, self._options, self._steps = index, options, steps
        # a scan of no files: enough to resolve columns and to see which filters reach it
        self._root = index.scan([], options) if shape is None else shape
        self._shape = self._replay(self._root)

    def _replay(self, df: DataFrame) -> DataFrame:
        for name, args, kwargs in self._steps:
            df = getattr(df, name)(*args, **kwargs)
        return df

    @cached_property
    def plain(self) -> DataFrame:
        """The same query over all files."""
        return self._replay(self._index.scan(None, self._options, self._root))

    def kept_files(self) -> list[tuple[str, str]] | None:
        """Files that are read, as ``LoadedIndex.kept_files`` gives them, or None for all of them."""
        return _kept(self._index, self._shape, self._options[MARK])

    @cached_property
    def pruned(self) -> DataFrame:
        kept = self.kept_files()
        return self.plain if kept is None else self._replay(self._index.scan([p for _, p in kept], self._options, self._root))

    @property
    def _jdf(self):
        return self.pruned._jdf

    @_jdf.setter
    def _jdf(self, value) -> None:
        """The constructor of all DataFrames sets it; here it follows from the files."""

    @property
    def schema(self):
        return self._shape.schema

    def __getitem__(self, item):
        if isinstance(item, (list, tuple)):
            return self.select(*item)
        if isinstance(item, Column):
            return self.filter(item)
        return self._shape[item]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._shape, name)

    def __repr__(self) -> str:
        return f"IndexedDataFrame[{', '.join(f'{n}: {t}' for n, t in self.dtypes)}]"


def _replayed(name: str):
    def call(self: IndexedDataFrame, *args, **kwargs):
        return IndexedDataFrame(self._index, self._options, (*self._steps, (name, args, kwargs)), self._root)

    call.__name__ = name
    return call


# methods that give a DataFrame over the same scan again
for _name in ("filter", "where", "select", "selectExpr", "withColumn", "withColumns", "withColumnRenamed", "withColumnsRenamed", "drop", "alias"):
    setattr(IndexedDataFrame, _name, _replayed(_name))


def _kept(index: LoadedIndex, df: DataFrame, mark: str) -> list[tuple[str, str]] | None:
    conditions = scan_conditions(df, mark, list(index.columns))
    if conditions is None or any(_says_nothing(c) for c in conditions):
        return None
    return index.kept_files(Node("or", tuple(conditions)))


def _says_nothing(tree) -> bool:
    if tree == TRUE or tree == Node("unknown"):
        return True
    return isinstance(tree, Node) and tree.op == "and" and all(_says_nothing(k) for k in tree.children)


class CreateIndexCommand:
    """Creates an index; columns and mode are set first, ``parquet`` or ``table`` run it."""

    def __init__(self, manager: DataFrameIndexManager):
        self._manager, self._mode, self._columns = manager, None, None

    def mode(self, value) -> CreateIndexCommand:
        """``error`` (default), ``overwrite``, ``ignore`` or ``append``, in any letter case; checked when the index is created."""
        self._mode = f"{value}"
        return self

    def indexBy(self, *columns) -> CreateIndexCommand:
        """Columns to index, as names, Columns or one list of them."""
        if len(columns) == 1 and isinstance(columns[0], (list, tuple)):
            columns = tuple(columns[0])
        self._columns = [_column_name(c) for c in columns]
        return self

    def indexByAll(self) -> CreateIndexCommand:
        """Index every column of a supported type."""
        self._columns = None
        return self

    def _run(self, path: str, spec: IndexLocation) -> None:
        mode = "error" if self._mode is None else self._mode.lower()
        if mode not in MODES:
            raise NotImplementedError(f"Unsupported mode {self._mode}, must be one of {', '.join(MODES)}")
        if self._columns is not None and not self._columns:
            raise ValueError("At least one column is required, use indexByAll() to index all columns")
        self._manager._build(path, spec, self._columns, mode)

    def _createIndex(self, path: str) -> None:
        kind = check_source(self._manager._source)
        path = resolve_path(self._manager._spark, path)
        self._run(path, spec_for(path, False, kind))

    createIndex = _createIndex

    def parquet(self, path: str) -> None:
        self._manager.format(Const.PARQUET_SOURCE)
        self._createIndex(path)

    def table(self, tableName: str) -> None:
        found, kind = self._manager._table(tableName)
        self._run(found, spec_for(found, True, kind))


class ExistsIndexCommand:
    """Tells whether there is an index."""

    def __init__(self, manager: DataFrameIndexManager):
        self._manager = manager

    def _existsIndex(self, path: str) -> bool:
        try:
            kind = check_source(self._manager._source)
            path = resolve_path(self._manager._spark, path)
            return self._manager._metastore.exists(spec_for(path, False, kind))
        except (OSError, ValueError):
            return False

    existsIndex = _existsIndex

    def parquet(self, path: str) -> bool:
        self._manager.format(Const.PARQUET_SOURCE)
        return self._existsIndex(path)

    def table(self, tableName: str) -> bool:
        found, kind = self._manager._table(tableName)
        return self._manager._metastore.exists(spec_for(found, True, kind))


class DeleteIndexCommand:
    """Drops an index if there is one; the table must exist."""

    def __init__(self, manager: DataFrameIndexManager):
        self._manager = manager

    def _deleteIndex(self, path: str) -> None:
        kind = check_source(self._manager._source)
        self._manager._metastore.delete(spec_for(resolve_path(self._manager._spark, path), False, kind))

    deleteIndex = _deleteIndex

    def parquet(self, path: str) -> None:
        self._manager.format(Const.PARQUET_SOURCE)
        self._deleteIndex(path)

    def table(self, tableName: str) -> None:
        found, kind = self._manager._table(tableName)
        self._manager._metastore.delete(spec_for(found, True, kind))


def _column_name(c) -> str:
    if isinstance(c, Column):
        return c._jc.toString().strip("`") if hasattr(c, "_jc") else str(c)
    return f"{c}"


class DataFrameIndexManager:
    """Builder of indexed reads and index commands of a context."""

    def __init__(self, context: QueryContext):
        if not isinstance(context, QueryContext):
            raise AttributeError(f"Expected <QueryContext> instance, found {context}")
        self._context, self._spark, self._metastore = context, context.spark_session, context._metastore
        self._source = Const.PARQUET_SOURCE
        self._options: dict[str, str] = {}

    def format(self, source) -> DataFrameIndexManager:
        self._source = f"{source}"
        return self

    def option(self, key, value) -> DataFrameIndexManager:
        """Reader option, kept as text; the last value of a key holds."""
        self._options[f"{key}"] = f"{value}"
        return self

    def options(self, opts) -> DataFrameIndexManager:
        if not isinstance(opts, dict):
            raise AttributeError(f"Expected <dict>, found {opts}")
        for key, value in opts.items():
            self.option(key, value)
        return self

    def _table(self, name: str) -> tuple[str, str]:
        found = resolve_table(self._spark, name)
        kind = check_source(found.provider)
        return found.path.rstrip("/"), kind

    def _build(self, path: str, spec: IndexLocation, columns: list[str] | None, mode: str) -> None:
        conf = IndexConf(self._spark)
        option, tasks = conf.filter_option, int(conf.get("spark.sql.index.partitions"))
        root = self._metastore.files.qualified(path).rstrip("/")
        support = format_of(spec.identifier)
        self._metastore.create(spec, mode, lambda at: support.create_index(self._spark, root, at, columns, option, self._options, tasks))

    def _load(self, path: str, spec: IndexLocation) -> IndexedDataFrame:
        conf = IndexConf(self._spark)
        if conf.flag("spark.sql.index.createIfNotExists") and not self._metastore.exists(spec):
            self._build(path, spec, None, "error")
        eager = conf.flag("spark.sql.index.parquet.filter.eagerLoading")
        support = format_of(spec.identifier)
        index = self._metastore.load(spec, lambda at: support.load_index(self._spark, at, eager))
        return IndexedDataFrame(index, {**self._options, MARK: uuid.uuid4().hex})

    def load(self, path: str) -> IndexedDataFrame:
        """The indexed table at ``path``."""
        kind = check_source(self._source)
        path = resolve_path(self._spark, path)
        return self._load(path, spec_for(path, False, kind))

    def parquet(self, path: str) -> IndexedDataFrame:
        return self.format(Const.PARQUET_SOURCE).load(path)

    def table(self, tableName: str) -> IndexedDataFrame:
        """The indexed persistent table."""
        found, kind = self._table(tableName)
        return self._load(found, spec_for(found, True, kind))

    def sql(self, query: str, **paths: str) -> DataFrame:
        """Run ``query`` with each name of ``paths`` as a view of the indexed table there,
        skipping files by the filters that reach its scans."""
        loaded = {name: self.parquet(path) for name, path in paths.items()}
        spark = self._spark
        # temporary views of the same names are the user's and come back afterwards
        views = {x.name.lower() for x in spark.catalog.listTables() if x.isTemporary}
        mine = {name: spark.table(name) if name.lower() in views else None for name in paths}
        try:
            for name, df in loaded.items():
                df._root.createOrReplaceTempView(name)
            shape = spark.sql(query)
            for name, df in loaded.items():
                kept = _kept(df._index, shape, df._options[MARK])
                df._index.scan(None if kept is None else [p for _, p in kept], df._options, df._root).createOrReplaceTempView(name)
            return spark.sql(query)
        finally:
            for name, view in mine.items():
                spark.catalog.dropTempView(name) if view is None else view.createOrReplaceTempView(name)

    @property
    def create(self) -> CreateIndexCommand:
        return CreateIndexCommand(self)

    @property
    def exists(self) -> ExistsIndexCommand:
        return ExistsIndexCommand(self)

    @property
    def delete(self) -> DeleteIndexCommand:
        return DeleteIndexCommand(self)


class QueryContext:
    """Entry point: ``QueryContext(spark).index`` gives the manager of indexes."""

    def __init__(self, session: SparkSession):
        if not isinstance(session, SparkSession):
            raise AttributeError(f"Expected <SparkSession> to initialize query context, found {session}")
        self._spark_session = session
        self._metastore = Metastore(session)

    @property
    def spark_session(self) -> SparkSession:
        return self._spark_session

    @property
    def index(self) -> DataFrameIndexManager:
        return DataFrameIndexManager(self)
