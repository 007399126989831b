"""Building an index: statistics and filters per row group, without a shuffle of data.

Footers tell where row groups begin and, as a rule, all their statistics; then data
is read for filters only, and for bloom filters just hashes, taken in the JVM, leave
it. One scan by Spark's Parquet reader feeds each row group, which one task reads in
one go, to numpy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.filters import filter_class
from siftlake.plans.predicate import INDEXABLE
from siftlake.plans.shared import cut, fresh_dir
from siftlake.sources.footers import SPARK_SCHEMA, list_files, open_path
from siftlake.sources.metastore import Metastore, dump_json

FORMAT_VERSION = 3
FILES_SCHEMA = "file_path string, path string, file_key bigint, length bigint, modified timestamp, rows bigint, blocks bigint"
FILTERS_SCHEMA = "file_key bigint, block int, col int, kind string, data binary"
STATS_SCHEMA = "file_key bigint, block int, col int, rows bigint, nulls bigint, a_num bigint, b_num bigint, a_str string, b_str string, kind string, data binary"


def physical(value, kind: str):
    """A value of a footer as it is compared: numbers for dates and times, else as it is."""
    import datetime as dt

    if value is None:
        return None
    if kind == "date":
        return (value - dt.date(1970, 1, 1)).days
    if kind in ("timestamp", "timestamp_ntz"):
        if isinstance(value, int):
            return value
        gap = value.replace(tzinfo=None) - dt.datetime(1970, 1, 1)
        return (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds
    if kind == "string":
        return value if isinstance(value, str) else value.decode()
    return int(value)


def _footers(names: list[str], kinds: list[str], exact_case: bool):
    """(file_key, block, first_row, rows, complete, stats, schema) of each row group, one row with block -1 for a file
    without any. Row groups without rows count as none. Names are looked up as Spark does, without letter case
    unless ``exact_case``; where two columns of a file answer to a name, the footer doesn't count."""
    struct = pa.list_(pa.struct([("nulls", pa.int64()), ("a_num", pa.int64()), ("b_num", pa.int64()), ("a_str", pa.string()), ("b_str", pa.string())]))
    spelled = (lambda name: name) if exact_case else str.lower

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            out: list[tuple] = []
            for path, key in zip(batch["path"].to_pylist(), batch["file_key"].to_pylist()):
                fs, at = open_path(path)
                with fs.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                    schema = (meta.metadata or {}).get(SPARK_SCHEMA, b"").decode()
                    places: dict[str, list[int]] = {}
                    for i in range(meta.num_columns):
                        places.setdefault(spelled(meta.schema.column(i).path), []).append(i)
                    first = 0
                    full = [b for b in range(meta.num_row_groups) if meta.row_group(b).num_rows]
                    if not full:
                        out.append((key, -1, 0, 0, True, [], schema))
                    for b in full:
                        group, complete, stats = meta.row_group(b), True, []
                        for name, kind in zip(names, kinds):
                            found = places.get(spelled(name), [])
                            if not found:
                                stats.append({"nulls": group.num_rows})
                                continue
                            chunk = group.column(found[0])
                            s = None if len(found) > 1 or chunk.physical_type == "INT96" else chunk.statistics
                            if s is None or not s.has_null_count or (not s.has_min_max and s.null_count < group.num_rows):
                                complete = False
                                stats.append({})
                                continue
                            low, high = (physical(s.min, kind), physical(s.max, kind)) if s.has_min_max else (None, None)
                            text = kind == "string"
                            stats.append({"nulls": s.null_count, "a_num": None if text else low, "b_num": None if text else high, "a_str": low if text else None, "b_str": high if text else None})
                        out.append((key, b, first, group.num_rows, complete, stats, schema))
                        first += group.num_rows
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), struct, pa.string())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["file_key", "block", "first_row", "rows", "complete", "stats", "schema"])

    return run


def _numbers(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """Dates as days, times as microseconds, integers as they are, all 64 bit."""
    t = column.type
    if pa.types.is_date32(t):
        column = column.cast(pa.int32())
    elif pa.types.is_timestamp(t):
        column = column.cast(pa.timestamp("us")).cast(pa.int64())
    return column.cast(pa.int64())


class _Bounds:
    """First rows and sizes of the row groups of files, read from the shared table as files come up."""

    def __init__(self, at: str):
        self.at, self.table, self.known = at, None, {}

    def learn(self, keys: np.ndarray) -> None:
        new = [k for k in np.unique(keys).tolist() if k not in self.known]
        if not new:
            return
        if self.table is None:
            import pyarrow.dataset as ds

            fs, at = open_path(self.at)
            self.table = ds.dataset(at, filesystem=fs, format="parquet")
        for row in self.table.to_table(filter=pc.field("file_key").isin(new)).to_pylist():
            self.known[row["file_key"]] = np.array([g["first_row"] for g in row["groups"]]), [g["rows"] for g in row["groups"]]


def _summaries(bounds_at: str, kinds: list[str], option: str | None, read_values: bool):
    """Statistics (if ``read_values``) and filters of each row group of the rows of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(bounds_at)
        open_key: tuple[int, int] | None = None
        count, values, hashes = 0, [[] for _ in kinds], [[] for _ in kinds]
        done: list[tuple] = []

        def close() -> None:
            nonlocal count, values, hashes
            if open_key is None:
                return
            want = bounds.known[open_key[0]][1][open_key[1]]
            if want != count:
                raise ValueError(f"row group {open_key[1]} is misaligned: {count} rows read, {want} in the footer")
            for c, kind in enumerate(kinds):
                text, low, high, nulls, distinct = kind == "string", None, None, None, None
                if read_values:
                    whole = pa.chunked_array(values[c])
                    nulls, distinct = whole.null_count, pc.unique(whole.drop_null())
                    if len(distinct):
                        # strings by their UTF-8 bytes, as Spark compares them
                        both = pc.min_max(distinct.cast(pa.binary()) if text else distinct)
                        low, high = both["min"].as_py(), both["max"].as_py()
                        if text:
                            low, high = low.decode(), high.decode()
                data = name = None
                if option:
                    cls = filter_class(option, kind)
                    name = cls.kind
                    if name == "bloom":
                        data = cls.of(pa.chunked_array(hashes[c]).drop_null().to_numpy(), count, kind).dump()
                    else:
                        data = cls.of(distinct.to_pylist() if text else distinct.to_numpy(zero_copy_only=False), count).dump()
                done.append((*open_key, c, count, nulls, None if text else low, None if text else high, low if text else None, high if text else None, name, data))
            count, values, hashes = 0, [[] for _ in kinds], [[] for _ in kinds]

        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ["file_key", "block", "col", "rows", "nulls", "a_num", "b_num", "a_str", "b_str", "kind", "data"]

        def flush() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
            done.clear()
            return out

        for batch in batches:
            keys, rows = batch["file_key"].to_numpy(), batch["row_index"].to_numpy()
            bounds.learn(keys)
            block = np.empty(len(keys), np.int64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                if b > a:
                    block[a:b] = np.searchsorted(bounds.known[int(keys[a])][0], rows[a:b], side="right") - 1
            changes = np.flatnonzero((np.diff(keys) != 0) | (np.diff(block) != 0)) + 1
            plain = [batch[f"c{c}"] if kind == "string" else _numbers(batch[f"c{c}"]) for c, kind in enumerate(kinds)] if read_values else []
            hashed = [batch[f"h{c}"] for c in range(len(kinds))] if option == "bloom" else []
            for a, b in zip([0, *changes], [*changes, len(keys)]):
                if b <= a:
                    continue
                here = (int(keys[a]), int(block[a]))
                if here != open_key:
                    close()
                    open_key = here
                count += int(b - a)
                for into, parts in ((values, plain), (hashes, hashed)):
                    for c, column in enumerate(parts):
                        into[c].append(column.slice(a, b - a))
            if done:
                yield flush()
        close()
        yield flush()

    return run


def choose_columns(schema: T.StructType, partitions: list[str], wanted: list[str] | None) -> list[T.StructField]:
    """Columns to index, in the order of the schema: all supported ones if ``wanted`` is None."""
    names = [f.name for f in schema.fields]
    if len(set(names)) < len(names):
        raise ValueError(f"Schema contains duplicate columns: {', '.join(sorted({n for n in names if names.count(n) > 1}))}")
    data = [f for f in schema.fields if f.name not in partitions]
    if wanted is None:
        chosen = [f for f in data if f.dataType.simpleString() in INDEXABLE]
        if not chosen:
            raise ValueError("Schema has no columns of supported types")
        return chosen
    for name in wanted:
        if name in partitions:
            raise ValueError(f"Found column {name} in partitioning schema. Currently indexing by partitioning columns is not supported")
        if name not in names:
            raise ValueError(f"Failed to select indexed column '{name}', available columns: {', '.join(f.name for f in data)}")
    chosen = [f for f in data if f.name in wanted]
    if bad := [f for f in chosen if f.dataType.simpleString() not in INDEXABLE]:
        raise ValueError(f"Schema contains unsupported type: {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in bad)}")
    return chosen


def _with_metadata(schema: T.StructType, footers: DataFrame) -> T.StructType:
    """``schema`` with the metadata of its fields in all files; where files disagree, the schema that was met last in the order of paths holds."""
    texts = footers.filter("schema != ''").groupBy("schema").agg(F.min("path").alias("path")).orderBy("path")
    told: dict[str, dict] = {}
    for r in texts.toLocalIterator():
        for f in T.StructType.fromJson(json.loads(r["schema"])).fields:
            if f.metadata:
                told.setdefault(f.name, {}).update(f.metadata)
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**(f.metadata or {}), **told.get(f.name, {})}) for f in schema.fields])


def build_index(spark: SparkSession, root: str, to: str, columns: list[str] | None, option: str | None, options: dict[str, str], partitions_conf: int) -> None:
    """Write the index of the table at ``root`` into folder ``to``: ``metadata.json``,
    ``files``, ``stats`` (a row per row group, three columns per indexed column) and,
    with ``option``, ``filters`` (a row per row group and column). ``partitions_conf``
    is the number of tasks that read footers and, as far as row groups can be told
    apart, of those that read data; 0 leaves both to the size of the cluster."""
    files = cut(list_files(spark, [root]).withColumn("file_key", F.xxhash64("file_path")), "files")
    if files.isEmpty():
        raise ValueError(f"Empty partitions provided, no Parquet files in {root}")
    base = spark.read.options(**{"mergeSchema": "true", **options}).parquet(root)
    part_names = partition_columns(base, root)
    chosen = choose_columns(base.schema, part_names, columns)
    names, kinds = [f.name for f in chosen], [f.dataType.simpleString() for f in chosen]
    tasks = partitions_conf if partitions_conf > 0 else min(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    groups = cut(
        files.select("path", "file_key").repartition(tasks).mapInArrow(
            _footers(names, kinds, spark.conf.get("spark.sql.caseSensitive") == "true"),
            "file_key bigint, block int, first_row bigint, rows bigint, complete boolean, stats array<struct<nulls: bigint, a_num: bigint, b_num: bigint, a_str: string, b_str: string>>, schema string",
        ),
        "footers",
    )
    told = groups.agg(F.bool_and("complete").alias("all"), F.count_if(F.col("block") >= 0).alias("blocks")).first()
    stats = groups.filter("block >= 0").select("file_key", "block", "rows", F.posexplode("stats").alias("col", "s")).select("file_key", "block", "col", "rows", "s.*")
    filters = None
    read_values = not told["all"] or option == "dict"
    if option or read_values:
        # workers look up the row groups of the files that they meet
        bounds = fresh_dir(spark, "bounds")
        per_file = groups.filter("block >= 0").groupBy("file_key").agg(F.array_sort(F.collect_list(F.struct("block", "first_row", "rows"))).alias("groups"))
        per_file.repartitionByRange("file_key").sortWithinPartitions("file_key").write.option("parquet.block.size", str(1 << 20)).parquet(bounds)
        scan = spark.read.schema(base.schema).options(**options).parquet(root)
        column = lambda n: F.col(f"`{n}`")
        rows = scan.select(
            F.xxhash64("_metadata.file_path").alias("file_key"),
            F.col("_metadata.row_index").alias("row_index"),
            *([column(n).alias(f"c{i}") for i, n in enumerate(names)] if read_values else []),
            *([F.when(column(n).isNotNull(), F.xxhash64(column(n))).alias(f"h{i}") for i, n in enumerate(names)] if option == "bloom" else []),
        )
        summaries = cut(rows.mapInArrow(_summaries(bounds, kinds, option, read_values), STATS_SCHEMA), "summaries")
        if read_values:
            stats = summaries
        if option:
            filters = summaries.select("file_key", "block", "col", "kind", "data")
    wide = []
    for i, kind in enumerate(kinds):
        suffix = "str" if kind == "string" else "num"
        own = lambda c, i=i: F.max(F.when(F.col("col") == i, F.col(c)))
        wide += [own("nulls").alias(f"n{i}"), own(f"a_{suffix}").alias(f"a{i}"), own(f"b_{suffix}").alias(f"b{i}")]
    where = files.select("file_key", "file_path", "path")
    pieces = max(1, told["blocks"] // 200_000)
    table = stats.groupBy("file_key", "block").agg(F.max("rows").alias("rows"), *wide).join(where, "file_key")
    table = table.select("file_path", "path", "file_key", "block", "rows", *[f"{x}{i}" for i in range(len(kinds)) for x in "nab"])
    table.coalesce(pieces).write.parquet(f"{to}/stats")
    counts = groups.groupBy("file_key").agg(F.sum("rows").alias("rows"), F.count_if(F.col("block") >= 0).alias("blocks"))
    files.join(counts, "file_key", "left").select("file_path", "path", "file_key", "length", "modified", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("blocks", F.lit(0)).alias("blocks")).coalesce(pieces).write.parquet(f"{to}/files")
    if filters is not None:
        filters.coalesce(max(1, tasks // 4)).sortWithinPartitions("col").write.option("parquet.block.size", str(8 << 20)).parquet(f"{to}/filters")
    body = {
        "version": FORMAT_VERSION,
        "table_path": root,
        "folder": Metastore(spark).files.is_dir(root),
        "data_schema": _with_metadata(base.schema, groups.join(where, "file_key")).json(),
        "stats_schema": table.schema.json(),
        "partition_columns": part_names,
        "columns": [{"name": n, "type": k} for n, k in zip(names, kinds)],
        "filter": option,
        "files": files.count(),
        "blocks": told["blocks"],
        "filter_bytes": int(filters.agg(F.sum(F.octet_length("data"))).first()[0] or 0) if filters is not None else 0,
    }
    Metastore(spark).files.write(f"{to}/metadata.json", dump_json(body))


def partition_columns(base: DataFrame, root: str) -> list[str]:
    """Partition columns of a table as Spark inferred them."""
    plan = base._jdf.queryExecution().analyzed()
    while not hasattr(plan, "relation") or plan.getClass().getSimpleName() != "LogicalRelation":
        plan = plan.children().apply(0)
    return list(plan.relation().partitionSchema().fieldNames())
