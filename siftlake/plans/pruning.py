"""Evaluating a predicate against an index: which files may hold a match."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.filters import load_filter
from siftlake.plans.predicate import Leaf, Node, can_be, leaves, row_can_be
from siftlake.plans.scan import scan_of
from siftlake.sources.index_build import FILES_SCHEMA, FILTERS_SCHEMA
from siftlake.sources.metastore import Files

#: Row groups up to which a loaded index is kept by the executors.
CACHED_BLOCKS = 200_000
#: Row groups, and bytes of filters, up to which an index is judged on the driver,
#: which saves the start of jobs; beyond either it is judged by jobs.
LOCAL_BLOCKS, LOCAL_FILTER_BYTES = 20_000, 128 << 20


class LoadedIndex:
    """An index as read from its folder; shared between calls, never changed by one."""

    def __init__(self, spark: SparkSession, at: str, eager: bool = False):
        meta = json.loads(Files(spark).read(f"{at}/metadata.json"))
        self.spark, self.at = spark, at
        self.table_path: str = meta["table_path"]
        self.schema = T.StructType.fromJson(json.loads(meta["data_schema"]))
        self.columns: dict[str, str] = {c["name"]: c["type"] for c in meta["columns"]}
        self.numbers = {n: i for i, n in enumerate(self.columns)}
        self.partition_columns: list[str] = meta["partition_columns"]
        self.filter: str | None = meta["filter"]
        self.folder: bool = meta["folder"]
        self.files_total, self.blocks_total = meta["files"], meta["blocks"]
        # with their schemas, so that no footer is read for them
        self.files = spark.read.schema(FILES_SCHEMA).parquet(f"{at}/files")
        self.stats = spark.read.schema(T.StructType.fromJson(json.loads(meta["stats_schema"]))).parquet(f"{at}/stats")
        self.filters = spark.read.schema(FILTERS_SCHEMA).parquet(f"{at}/filters") if self.filter else None
        self.local = self.blocks_total <= LOCAL_BLOCKS and meta["filter_bytes"] <= LOCAL_FILTER_BYTES
        self._rows: list[dict] | None = None
        self._loaded: dict[tuple[int, int, int], object] = {}
        if self.local:
            if eager:
                self._load_filters(range(len(self.columns)))
            return
        if self.blocks_total <= CACHED_BLOCKS:
            self.stats = self.stats.coalesce(max(1, self.blocks_total // 50_000)).cache()
        if eager and self.filters is not None:
            self.filters = self.filters.cache()
            self.filters.count()

    def scan(self, paths: list[str] | None, options: dict[str, str], like: DataFrame | None = None) -> DataFrame:
        """The table from ``paths`` only, or from all its files if None."""
        root = self.table_path if self.folder else None
        return scan_of(self.spark, self.schema, self.partition_columns, [self.table_path] if paths is None else paths, root, options, like)

    def _load_filters(self, columns) -> None:
        """Filters of columns to the driver, each column once; their size was checked when the index was built."""
        if self.filters is None:
            return
        new = [i for i in columns if (i, -1, -1) not in self._loaded]
        if new:
            for r in self.filters.filter(F.col("col").isin(new)).collect():
                self._loaded[r["col"], r["file_key"], r["block"]] = load_filter(r["kind"], bytes(r["data"]))
            self._loaded |= {(i, -1, -1): True for i in new}

    def _kept_locally(self, tree: Leaf | Node) -> list[tuple[str, str]]:
        if self._rows is None:
            self._rows = [r.asDict() for r in self.stats.collect()]
        left = [r for r in self._rows if row_can_be(tree, self.numbers, r, None)[0]]
        asked = sorted({self.numbers[x.column] for x in leaves(tree) if x.op in ("eq", "in", "eqnull")})
        if left and asked and self.filters is not None:
            self._load_filters(asked)

            def maybe(row: dict, i: int, value) -> bool:
                found = self._loaded.get((i, row["file_key"], row["block"]))
                return found is None or found.might_contain(value)

            left = [r for r in left if row_can_be(tree, self.numbers, r, maybe)[0]]
        return sorted({(r["file_path"], r["path"]) for r in left})

    def kept_blocks(self, tree: Leaf | Node) -> DataFrame:
        """Rows of the statistics whose row group may hold a row for which ``tree`` is true.

        Smallest, largest and nulls decide first; only for the row groups that are
        left are the membership filters of the columns in equalities read.
        """
        asked = {(x.column, v) for x in leaves(tree) if x.op in ("eq", "in", "eqnull") for v in x.values}
        left = self.stats.filter(can_be(tree, self.numbers)[0])
        if self.filters is None or not asked:
            return left
        questions = sorted(((self.numbers[c], v) for c, v in asked), key=repr)
        names = list(self.columns)
        probes: dict[int, list[tuple[int, object]]] = {}
        for k, (i, v) in enumerate(questions):
            probes.setdefault(i, []).append((k, v))
        near = F.broadcast(left.select("file_key", "block")) if self.blocks_total <= CACHED_BLOCKS else left.select("file_key", "block")
        held = self.filters.filter(F.col("col").isin(list(probes))).join(near, ["file_key", "block"], "left_semi")
        said = held.mapInArrow(_ask(probes), "file_key bigint, block int, noes array<int>")
        answers = said.groupBy("file_key", "block").agg(F.flatten(F.collect_list("noes")).alias("noes"))
        maybe = {(names[i], v): ~F.coalesce(F.array_contains("noes", k), F.lit(False)) for k, (i, v) in enumerate(questions)}
        return left.join(answers, ["file_key", "block"], "left").filter(can_be(tree, self.numbers, maybe)[0])

    def kept_files(self, tree: Leaf | Node) -> list[tuple[str, str]]:
        """(hidden metadata spelling, plain spelling) of the paths of the files that may hold a match. Files without row groups have none."""
        if self.local:
            return self._kept_locally(tree)
        return sorted((r[0], r[1]) for r in self.kept_blocks(tree).select("file_path", "path").distinct().collect())


def _ask(probes: dict[int, list[tuple[int, object]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            noes = []
            for col, kind, data in zip(batch["col"].to_pylist(), batch["kind"].to_pylist(), batch["data"].to_pylist()):
                found = load_filter(kind, data)
                noes.append([k for k, v in probes[col] if not found.might_contain(v)])
            yield pa.record_batch([batch["file_key"], batch["block"], pa.array(noes, pa.list_(pa.int32()))], ["file_key", "block", "noes"])

    return run
