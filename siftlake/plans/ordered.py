"""Ordered computations over groups of any size.

A plain window puts a whole group into one task. Here rows are range-partitioned by
(keys, order) and sorted, which is the only shuffle; each range is scanned by itself
in Arrow batches; and what a group carries from one range into the next is added from
the first and last rows of the ranges, two a range, which are broadcast by that bound.

The scanned ranges are written once (``cut``): Spark samples the bounds of ranges
anew whenever a plan runs again, so two readers of the same unwritten ranges could
see different ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.plans.shared import cut

#: Marks of a row that is the first or the last of its range.
FIRST, LAST = 1, 2


def _ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _in_ranges(df: DataFrame, by: list[str], n: int | None, back: bool = False, within: list[str] = ()) -> DataFrame:
    """``df`` in ranges of ``by``, each sorted (backwards with ``back``, then by ``within``), with the number of the range in ``_range``."""
    ranged = df.repartitionByRange(n or _ranges(df), *[F.col(c) for c in by])
    return ranged.sortWithinPartitions(*[F.desc_nulls_last(c) if back else F.asc_nulls_first(c) for c in [*by, *within]]).withColumn("_range", F.spark_partition_id())


def _whole(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the one before; nulls equal nulls."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    unequal = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return unequal | (a.is_valid().to_numpy(zero_copy_only=False) != b.is_valid().to_numpy(zero_copy_only=False))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Batches, each with the last row of the one before in front of it (the first one with a copy of its own first row), and whether it is the last one."""
    before = None
    waiting: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting is not None:
            yield pa.Table.from_batches([before, waiting]), False
            before = waiting.slice(waiting.num_rows - 1)
        else:
            before = batch.slice(0, 1)
        waiting = batch
    if waiting is not None:
        yield pa.Table.from_batches([before, waiting]), True


def _edges(n: int, first: bool, last: bool) -> pa.Array:
    edge = np.zeros(n, np.int8)
    if first:
        edge[0] |= FIRST
    if last:
        edge[-1] |= LAST
    return pa.array(edge)


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields] + [T.StructField(n, t, True) for n, t in fields])


def _scan(keys: list[str], lag: list[str], sums: list[str], seq: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, totals, began = 0, dict.fromkeys(sums, 0), False
        for table, last in _windows(batches):
            n = table.num_rows - 1
            starts = np.zeros(n, bool)
            for k in keys:
                starts |= _differs(_whole(table[k]))
            starts[0] |= not began
            at = np.arange(n)
            begin = np.maximum.accumulate(np.where(starts, at, -1))
            number = np.where(begin < 0, at + rows, at - begin) + 1
            rows = int(number[-1])
            names, columns = [], []
            for c in lag:
                names.append(f"prev_{c}")
                shifted = _whole(table[c]).slice(0, n)
                columns.append(shifted.take(pa.array(np.where(starts, 0, at), pa.int64(), mask=starts)))
            for x in sums:
                value = _whole(table[f"_v_{x}"]).slice(1).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = np.cumsum(value)
                base = np.where(begin < 0, -totals[x], upto[np.maximum(begin, 0)] - value[np.maximum(begin, 0)])
                names.append(x)
                columns.append(pa.array(upto - value - base, pa.int64()))
                totals[x] = int(upto[-1] - base[-1])
            own = table.slice(1).combine_chunks().to_batches()[0]
            yield pa.record_batch([*own.columns, pa.array(number, pa.int64()), *columns, _edges(n, not began, last)], [*own.schema.names, seq, *names, "_edge"])
            began = True

    return run


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    lag: list[str] = (),
    sums: dict[str, Column] | None = None,
    seq: str = "seq",
    ranges: int | None = None,
    within: list[str] = (),
    through: tuple | None = None,
) -> DataFrame:
    """Add per group of ``keys``, in the order of ``order`` (which must be unique
    within a group): ``seq`` from 1 on, ``prev_<c>`` for each column of ``lag``, and
    for each name in ``sums`` the sum of its whole-number expression over all earlier rows.

    With ``through`` (a function on Arrow batches and the fields that it adds), each
    range, sorted by ``within`` too, passes through that function first, which may drop
    rows; rows of equal ``keys`` and ``order`` are then always in one range.

    No task holds a whole group. Nulls are keys and order values like others; an empty
    input stays empty.
    """
    sums = sums or {}
    valued = df.withColumns({f"_v_{x}": F.coalesce(v.cast("long"), F.lit(0).cast("long")) for x, v in sums.items()}) if sums else df
    ranged = _in_ranges(valued, [*keys, *order], ranges, within=within)
    names = df.columns
    if through:
        ranged = ranged.mapInArrow(through[0], _with(ranged, *[(f.name, f.dataType) for f in through[1]]))
        names = [*names, *[f.name for f in through[1]]]
    added = [(f"prev_{c}", df.schema[c].dataType) for c in lag] + [(x, T.LongType()) for x in sums]
    schema = _with(ranged, (seq, T.LongType()), *added, ("_edge", T.ByteType()))
    local = cut(ranged.mapInArrow(_scan(keys, list(lag), list(sums), seq), schema), "ranges")
    # a group goes on into a range as its first one, out of a range as its last one
    edges = local.filter("_edge > 0")
    sides = edges.withColumn("_side", F.explode(F.array_compact(F.array(F.when(F.col("_edge").bitwiseAND(FIRST) > 0, 0), F.when(F.col("_edge").bitwiseAND(LAST) > 0, 1)))))
    earlier = Window.partitionBy(*keys).orderBy("_range", "_side").rowsBetween(Window.unboundedPreceding, -1)
    out_of = F.col("_side") == 1
    carried = (
        sides.select(
            F.col("_range").alias("_range0"),
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            "_side",
            F.sum(F.when(out_of, F.col(seq))).over(earlier).alias("_rows0"),
            F.last(F.when(out_of, F.struct(F.lit(1).alias("_any"), *[F.col(c) for c in lag])), ignorenulls=True).over(earlier).alias("_last0"),
            *[F.sum(F.when(out_of, F.col(x) + F.col(f"_v_{x}"))).over(earlier).alias(f"_s0_{x}") for x in sums],
        )
        .filter("_side = 0 and _rows0 is not null")
        .drop("_side")
    )
    same = F.col("_range") == F.col("_range0")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(F.broadcast(carried), same, "left")
    first = F.col(seq) == 1
    columns = [
        *[F.when(first, F.col(f"_last0.{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in lag],
        *[(F.col(x) + F.coalesce(F.col(f"_s0_{x}"), F.lit(0))).alias(x) for x in sums],
        (F.col(seq) + F.coalesce(F.col("_rows0"), F.lit(0))).alias(seq),
    ]
    return out.select(*names, *columns)


def _fill(keys: list[str], mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: pa.Array | None = None
        for table, last in _windows(batches):
            n = table.num_rows - 1
            starts = np.zeros(n, bool)
            for k in keys:
                starts |= _differs(_whole(table[k]))
            starts[0] |= known is None
            marks = _whole(table[mark]).slice(1)
            valid = marks.is_valid().to_numpy(zero_copy_only=False)
            # the latest row with a mark, or row 0 of the pool (what was known before) until the group ends
            at = np.arange(1, n + 1)
            upto = np.maximum.accumulate(np.where(valid | starts, at, 0))
            first = known is None
            pool = pa.concat_arrays([marks.slice(0, 1) if first else known, marks])
            filled = pool.take(pa.array(upto, pa.int64()))
            known = filled.slice(n - 1)
            own = table.slice(1).combine_chunks().to_batches()[0]
            yield pa.record_batch([*own.columns, filled, _edges(n, first, last)], [*own.schema.names, "_own", "_edge"])

    return run


def next_marked(df: DataFrame, keys: list[str], order: list[str], mark: str, ranges: int | None = None) -> DataFrame:
    """Add ``next_<mark>``: the first non-null ``mark`` at or after the row in its
    group (an as-of join forward once two tables are put under each other). The
    rows of a group may span any number of ranges, as in ``ordered_scan``."""
    ranged = _in_ranges(df, [*keys, *order], ranges, back=True)
    schema = _with(ranged, ("_own", df.schema[mark].dataType), ("_edge", T.ByteType()))
    local = cut(ranged.mapInArrow(_fill(keys, mark), schema), "ranges")
    # backwards, a range begins with its last row and hands on what it knows at its first one
    sides = local.filter("_edge > 0").withColumn("_side", F.explode(F.array_compact(F.array(F.when(F.col("_edge").bitwiseAND(FIRST) > 0, 0), F.when(F.col("_edge").bitwiseAND(LAST) > 0, 1)))))
    later = Window.partitionBy(*keys).orderBy(F.desc("_range"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sides.select(
            F.col("_range").alias("_range0"),
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            "_side",
            F.last(F.when(F.col("_side") == 1, F.col("_own")), ignorenulls=True).over(later).alias("_then"),
        )
        .filter("_side = 0 and _then is not null")
        .drop("_side")
    )
    same = F.col("_range") == F.col("_range0")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = local.join(F.broadcast(carried), same, "left")
    return out.select(*df.columns, F.coalesce("_own", "_then").alias(f"next_{mark}"))


def _islands(keys: list[str], position: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the island that is open, as the table row it begins with and its last position so far
        head: pa.Table | None = None
        end, told = 0, False

        def close(rows: pa.Table, ends: list[int], last: bool) -> pa.RecordBatch:
            nonlocal told
            edge = _edges(len(ends), not told, last)
            told = True
            own = rows.combine_chunks().to_batches()[0]
            return pa.record_batch([*own.columns, pa.array(ends, pa.int64()), edge], [*own.schema.names, "last_pos", "_edge"])

        for table, last in _windows(batches):
            n = table.num_rows - 1
            at = _whole(table[position]).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.diff(at) != 1
            for k in keys:
                starts |= _differs(_whole(table[k]))
            starts[0] |= head is None
            own, at = table.slice(1), at[1:]
            places = np.flatnonzero(starts)
            if len(places):
                ends = at[places[1:] - 1].tolist()
                done = own.take(pa.array(places))
                if head is not None:
                    done = pa.concat_tables([head, done])
                    ends.insert(0, int(at[places[0] - 1]) if places[0] else end)
                head = done.slice(done.num_rows - 1)
                if len(ends):
                    yield close(done.slice(0, len(ends)), ends, False)
            end = int(at[n - 1])
            if last:
                yield close(head, [end], True)

    return run


def gap_islands(df: DataFrame, keys: list[str], position: str, ranges: int | None = None) -> DataFrame:
    """Islands of successive whole numbers in ``position`` per group of ``keys``
    (positions unique within a group, not null): one row per island with ``first_pos``
    and ``last_pos``, and all other columns of its first row.

    Ranges are scanned one by one; only islands at the edges of ranges, at most two a
    range, can go on in the next range, and are put together.
    """
    rest = [c for c in df.columns if c not in (*keys, position)]
    ranged = _in_ranges(df, [*keys, position], ranges)
    local = cut(ranged.mapInArrow(_islands(keys, position), _with(ranged, ("last_pos", T.LongType()), ("_edge", T.ByteType()))), "islands")
    order = Window.partitionBy(*keys).orderBy(position)
    inner, edges = local.filter("_edge = 0"), local.filter("_edge > 0")
    joined = (
        edges.withColumn("_new", F.coalesce(F.lag("last_pos").over(order) != F.col(position) - 1, F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_new").over(order))
        .groupBy(*keys, "_island")
        .agg(F.min(position).alias(position), F.max("last_pos").alias("last_pos"), *[F.min_by(c, position).alias(c) for c in rest])
    )
    columns = [*keys, F.col(position).alias("first_pos"), "last_pos", *rest]
    return inner.select(*columns).unionByName(joined.select(*columns))
