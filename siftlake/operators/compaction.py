"""Far too many small files: a plan of fewer good ones, and the rewriting itself."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.hilbert import BITS, hilbert_column, quantile_bounds
from siftlake.functions.paths import canonical_path, directory, is_service_path
from siftlake.operators.heavy import distinct_blocks, file_sizes
from siftlake.plans.histogram import CELL, CELL_ROWS, TIE_BITS, cell_offsets, coded_cells, place_in_cells
from siftlake.plans.ordered import ordered_scan
from siftlake.plans.shared import cut, sized_join
from siftlake.sources.footers import list_files
from siftlake.sources.metastore import Files

#: Files below this many bytes are small.
SMALL_BYTES = 16_777_216
#: Good size of a written file.
TARGET_BYTES = 134_217_728
#: Files of a plan that one cell of the code histogram holds at most, and parts of a written file that a cell of rows is at most.
CELL_FILES, CELL_PARTS = 4_096, 16


def small_files(file_status: DataFrame, block_locations: DataFrame, small: int = SMALL_BYTES) -> DataFrame:
    """(file_id, dataset_id, directory, size, modification_time) of small data files
    whose directory holds at least one other such file.

    A data file is no directory and has no path segment that begins with ``_`` or
    ``.`` and holds no ``=``. Files recorded repeatedly count once (smallest canonical
    path); null ``is_dir`` counts as false; rows without ``file_id`` or ``path``, and
    files whose size is unknown, take no part. Directories with a single small file
    are taken out by that file's id, so that no join runs on directories.
    """
    files = (
        file_status.filter("file_id is not null and path is not null")
        .groupBy("file_id")
        .agg(
            F.min("dataset_id").alias("dataset_id"),
            F.min(canonical_path(F.col("path"))).alias("path"),
            F.max(F.coalesce("is_dir", F.lit(False))).alias("is_dir"),
            F.min("modification_time").alias("modification_time"),
        )
        .filter(~F.col("is_dir") & ~is_service_path(F.col("path")))
    )
    sizes = file_sizes(file_status, distinct_blocks(block_locations.filter("file_id is not null and block_no is not null")))
    tiny = files.join(sizes, "file_id").filter(F.col("size") < small)
    tiny = tiny.select("file_id", "dataset_id", directory(F.col("path")).alias("directory"), "size", "modification_time")
    tiny = cut(tiny, "small-files")
    alone = tiny.groupBy("directory").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id")).filter("n = 1").select("file_id")
    return tiny.join(alone, "file_id", "left_anti")


def distinct_row_groups(block_metadata: DataFrame) -> DataFrame:
    """(file_id, block_no, row_count, low): each row group once, with the smallest
    value of its first index column (by name) that holds whole numbers, or null."""
    low = F.expr(
        "array_min(transform(slice(array_sort(map_keys(map_filter(indexed_columns, (k, v) -> try_cast(v.min_value as bigint) is not null))), 1, 1),"
        " k -> try_cast(indexed_columns[k].min_value as bigint)))"
    )
    return (
        block_metadata.filter("file_id is not null and block_no is not null")
        .select("file_id", "block_no", "row_count", low.alias("low"))
        .groupBy("file_id", "block_no")
        .agg(F.max("row_count").alias("row_count"), F.min("low").alias("low"))
    )


def compaction_plan(
    file_status: DataFrame, block_metadata: DataFrame, block_locations: DataFrame, target: int = TARGET_BYTES, small: int = SMALL_BYTES
) -> DataFrame:
    """Which small files of a directory go into which new file, and where:
    (directory, output_no, file_id, size, row_count, row_offset, code).

    Files are points of (modification time, smallest key, row count), put in the
    order of their Hilbert codes, so that a new file holds neighbours in all three.
    The exact histogram of the codes of a directory (``plans.histogram``) gives the
    bytes and rows before each cell, and a cell, of at most ``CELL_FILES`` files, its
    own running sums; the bytes cut a directory into ``ceil(bytes / target)`` outputs of
    even size. ``row_offset`` is the number of the directory's rows before the file:
    rows ``row_offset .. row_offset + row_count - 1`` of the directory are the file's,
    so each row is found exactly once. A file without row groups has no rows.
    """
    tiny = small_files(file_status, block_locations, small)
    per_file = distinct_row_groups(block_metadata).groupBy("file_id").agg(F.sum("row_count").alias("row_count"), F.min("low").alias("low"))
    points = cut(tiny.join(per_file, "file_id", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0))), "points")
    dims = [F.col(c) for c in ("modification_time", "low", "row_count")]
    code = hilbert_column(dims, quantile_bounds(points, dims), BITS)
    tie = F.shiftrightunsigned(F.xxhash64("file_id"), 64 - TIE_BITS)
    coded = cut(points.select("directory", "file_id", "size", "row_count", code.alias("code"), tie.alias("tie")), "codes")
    placed, _ = coded_cells(coded, ["directory"], F.lit(CELL_FILES), 3 * BITS)
    offsets = cell_offsets(placed, ["directory"], {"bytes": F.col("size"), "rows": F.col("row_count")}, 3 * BITS).drop("bytes", "rows", "rows_all")
    earlier = Window.partitionBy("directory", *CELL).orderBy("code", "tie", "file_id").rowsBetween(Window.unboundedPreceding, -1)
    within = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    even = placed.join(offsets, ["directory", *CELL]).select(
        "directory", "file_id", "size", "row_count", "code", "bytes_all", (F.col("bytes_before") + within("size")).alias("bytes_before"), (F.col("rows_before") + within("row_count")).alias("row_offset")
    )
    outputs = F.ceil(F.col("bytes_all") / target)
    number = F.when(F.col("bytes_all") == 0, 0).otherwise(F.floor(F.col("bytes_before") * outputs / F.col("bytes_all")))
    return even.select("directory", number.cast("long").alias("output_no"), "file_id", "size", "row_count", "row_offset", "code")


def plan_digest(plan: DataFrame, file_status: DataFrame, block_metadata: DataFrame, block_locations: DataFrame) -> DataFrame:
    """Source and destination compared per directory: (directory, files, bytes,
    row_count, outputs, same_rows). The source side counts its small files anew from
    the tables; rows are compared by number and by a sum of hashes of their places
    (file, row group, rows in it)."""
    blocks = distinct_row_groups(block_metadata).select("file_id", "block_no", F.col("row_count").alias("n"))

    def side(files: DataFrame) -> DataFrame:
        mark = F.xxhash64("file_id", "block_no", "n").cast("decimal(38,0)")
        return (
            files.join(blocks, "file_id", "left")
            .groupBy("directory", "file_id")
            .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.when(F.col("block_no").isNotNull(), mark).otherwise(0)).alias("digest"), F.min("size").alias("size"))
            .groupBy("directory")
            .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("n").alias("row_count"), F.sum("digest").alias("digest"))
        )

    source = side(small_files(file_status, block_locations).select("directory", "file_id", "size"))
    target = side(plan.select("directory", "file_id", "size")).select(
        "directory", F.col("row_count").alias("planned"), F.col("digest").alias("planned_digest"), F.col("files").alias("planned_files")
    )
    outputs = plan.groupBy("directory").agg(F.countDistinct("output_no").alias("outputs"), F.max(F.col("row_offset") + F.col("row_count")).alias("last_row"))
    return source.join(target, "directory", "left").join(outputs, "directory", "left").select(
        "directory",
        "files",
        "bytes",
        "row_count",
        "outputs",
        F.coalesce(
            (F.col("planned") == F.col("row_count")) & (F.col("planned_digest") == F.col("digest")) & (F.col("planned_files") == F.col("files")) & (F.col("last_row") == F.col("row_count")),
            F.lit(False),
        ).alias("same_rows"),
    )


def _hashable(df: DataFrame) -> list[Column]:
    return [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in df.dtypes]


def row_digest(df: DataFrame) -> tuple[int, int, int]:
    """(rows, sum of row hashes, xor of row hashes): equal for equal multisets of rows, in one pass."""
    mark = F.xxhash64(*_hashable(df))
    r = df.select(mark.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return int(r[0]), int(r[1] or 0), int(r[2] or 0)


def _relative(path: Column, roots: list[str]) -> Column:
    """Directory of a file below its root, as ``./<directory>``, in the spelling of the hidden path column."""
    path = F.regexp_replace(path, "^file:/+", "file:/")
    below = F.coalesce(*[F.when(path.startswith(r + "/"), F.substring(path, F.lit(len(r) + 1), F.length(path))) for r in roots])
    return F.concat(F.lit("."), F.regexp_replace(below, "/[^/]*$", ""), F.lit("/"))


def compact_files(
    spark: SparkSession, source: str | list[str], target: str, cluster_by: list[str], target_bytes: int = TARGET_BYTES, small: int = SMALL_BYTES, rows_per_file: int | None = None
) -> dict:
    """Rewrite the small Parquet files of each directory below ``source`` as ``ceil(bytes / target_bytes)``
    balanced files (or ``ceil(rows / rows_per_file)``) in the same directory below ``target``, rows near
    each other on the Hilbert curve over ``cluster_by`` (numbers, dates or timestamps) together.

    Which files: those that ``compaction_plan`` would take, of less than ``small`` bytes, at least two in a
    directory, no service files; directories of several sources with the same name are one. Rows
    get exact multidimensional codes, equal ones in the order of a tie number. The exact histogram of the codes of
    a directory, refined where a cell holds more than a sixteenth of a written file,
    places each cell in one file, so files are ranges of codes that overlap at most in
    one code, and their rows differ by an eighth at most. Rows go straight to their
    file's partition, which is sorted; no row and no histogram comes to the driver.
    Files may hold different columns; all are kept, null where a file lacks them, and
    schemas that Spark can't merge raise its error.

    The digests of source and target rows must be equal in every directory, else ``RuntimeError`` is
    raised and nothing appears in ``target``; the source is left as it is. Null values
    of ``cluster_by`` come first. Returns numbers of rows, files and directories and the digest of all rows.
    """
    files = Files(spark)
    roots = [files.path(files.qualified(x)).toUri().toString().rstrip("/") for x in ([source] if isinstance(source, str) else source)]
    roots = [re.sub("^file:/+", "file:/", r) for r in roots]
    listed = list_files(spark, [source] if isinstance(source, str) else source)
    tiny = listed.filter(F.col("length") < small).select(_relative(F.col("file_path"), roots).alias("dir"), "length").filter(~is_service_path(F.substring("dir", 2, 1 << 30)))
    named = tiny.groupBy("dir").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).filter("files > 1")
    df = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(*([source] if isinstance(source, str) else source))
    if missing := [c for c in cluster_by if c not in df.columns]:
        raise ValueError(f"no such column: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    value = lambda c: F.unix_micros(F.col(c).cast("timestamp")) if kinds[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c)
    values = [value(c) for c in cluster_by]
    some = df.filter(F.col("_metadata.file_size") < small)
    bits = min(BITS, 60 // len(values)) if len(values) > 1 else 31
    code = hilbert_column(values, quantile_bounds(some, values), bits)
    tie = F.shiftrightunsigned(F.xxhash64("_metadata.file_path", "_metadata.row_index"), 64 - TIE_BITS)
    # the row as one struct, so that no column of it can clash with these
    whole = some.select(F.struct("*").alias("row"), _relative(F.col("_metadata.file_path"), roots).alias("dir"), code.alias("code"), tie.alias("tie"))
    coded = sized_join(whole, named.select("dir"), "dir", "left_semi")
    codes = cut(coded.select("dir", "code", "tie"), "codes")
    per_dir = codes.groupBy("dir").agg(F.count("*").alias("rows")).join(named, "dir")
    outputs = F.ceil(F.col("rows") / rows_per_file) if rows_per_file else F.ceil(F.col("bytes") / target_bytes)
    sizes = per_dir.select("dir", "rows", F.least(outputs, "rows").cast("long").alias("outputs"))
    dirs = cut(ordered_scan(sizes, [], ["dir"], sums={"first": F.col("outputs")}, seq="n").drop("n"), "directories")
    total = dirs.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("outputs"), F.lit(0)), F.count("*")).first()
    if not total[0]:
        return {"rows": 0, "files": 0, "directories": 0, "digest": (0, 0, 0)}
    width = bits * len(values)
    most = F.greatest(F.lit(1), F.floor(F.col("rows") / F.col("outputs") / CELL_PARTS))
    few = dirs.select("dir", F.when(F.col("outputs") > 1, most).otherwise(F.col("rows")).alias("most"))
    placed, hot = coded_cells(sized_join(codes, few, "dir", limit=CELL_ROWS), ["dir"], F.col("most"), width)
    cells = cell_offsets(placed, ["dir"], {"cell": F.lit(1)}, width).join(dirs, "dir")
    middle = F.col("cell_before") + F.floor(F.col("cell") / 2)
    to = cut(cells.select("dir", *CELL, (F.col("first") + F.least(F.col("outputs") - 1, F.floor(middle * F.col("outputs") / F.col("rows")))).cast("int").alias("output")), "outputs")
    routed = sized_join(place_in_cells(coded, ["dir"], hot, width), to, ["dir", *CELL], limit=CELL_ROWS)
    folder, mark = f"{target.rstrip('/')}/_rewriting-{uuid.uuid4().hex}", f"dir-{uuid.uuid4().hex}"
    ordered = routed.repartitionById(int(total[1]), F.col("output")).sortWithinPartitions("output", "code", "tie")
    ordered.select("row.*", F.col("dir").alias(mark)).write.partitionBy(mark).parquet(folder)
    before = _digests(coded.select("row.*", F.col("dir").alias(mark)), mark, df)
    written = spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(folder)
    # a folder's name is an escaped directory, and the hidden column escapes it once more
    decoded = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    after = _digests(written.select("*", decoded(decoded(F.regexp_extract("_metadata.file_path", f"/{mark}=([^/]*)/", 1))).alias(mark)), mark, df)
    unequal = before.join(after.withColumnsRenamed({c: f"_{c}" for c in ("rows", "sum", "xor")}), mark, "full").filter("not (rows <=> _rows and sum <=> _sum and xor <=> _xor)")
    if bad := [r[0] for r in unequal.select(mark).limit(5).collect()]:
        files.delete(folder)
        raise RuntimeError(f"digests differ in {', '.join(map(str, bad))}")
    for status in files.fs(folder).listStatus(files.path(folder)):
        name = status.getPath().getName()
        if name.startswith(f"{mark}="):
            rel = unquote(unquote(name[len(mark) + 1 :]))[2:].rstrip("/")
            into = f"{target.rstrip('/')}/{rel}".rstrip("/")
            files.fs(target).mkdirs(files.path(into))
            for part in files.fs(folder).listStatus(status.getPath()):
                files.rename(part.getPath().toString(), f"{into}/{part.getPath().getName()}")
    files.delete(folder)
    digest = before.agg(F.sum("rows"), F.sum("sum"), F.bit_xor("xor")).first()
    return {"rows": int(total[0]), "files": int(total[1]), "directories": int(total[2]), "digest": (int(digest[0]), int(digest[1]), int(digest[2]))}


def _digests(rows: DataFrame, by: str, like: DataFrame) -> DataFrame:
    """(by, rows, sum, xor): rows of each directory, and sum and xor of their hashes."""
    return rows.select(by, F.xxhash64(*_hashable(like)).alias("h")).groupBy(by).agg(
        F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor")
    )
