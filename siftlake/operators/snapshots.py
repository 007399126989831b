"""What changed between full snapshots, by ordinals, bitmaps and column vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.bitmaps import Bitmap
from siftlake.functions.paths import canonical_path, epoch_seconds
from siftlake.plans.shared import cut, sized_join

KINDS = ["added", "removed", "changed"]
#: Rows, of all listings of a data set together, that a stripe of its keys holds about.
STRIPE_ROWS = 65_536
#: Listings, of a few numbers each, up to which their table is broadcast.
LISTING_ROWS = 200_000
DICTIONARY = "dataset_id bigint, stripes int, stripe int, path string, ordinal bigint"


def listings(snapshot_files: DataFrame) -> DataFrame:
    """(dataset_id, snapshot_no, last_delivery, n, next_no, place, total): the listings of each data set in turn.
    Of a listing only the highest ``delivery_no`` counts (null is lowest)."""
    turn = Window.partitionBy("dataset_id").orderBy("snapshot_no")
    return (
        snapshot_files.filter("dataset_id is not null and snapshot_no is not null and path is not null")
        .groupBy("dataset_id", "snapshot_no")
        .agg(F.max(F.coalesce("delivery_no", F.lit(-1))).alias("last_delivery"), F.count("*").alias("n"))
        .withColumns({"next_no": F.lead("snapshot_no").over(turn), "place": F.row_number().over(turn), "total": F.sum("n").over(Window.partitionBy("dataset_id"))})
    )


def _striped(snapshot_files: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows of the last deliveries and of the dictionary ``known``, each stripe of a data set whole in one task and in the order of paths."""
    of = cut(listings(snapshot_files), "listings")
    stripes = F.expr(f"shiftleft(1, greatest(0, cast(ceil(log2(total / {STRIPE_ROWS})) as int)))").cast("int")
    if known is None:
        of = of.withColumn("stripes", stripes)
    else:
        # a data set keeps the stripes that its dictionary has
        kept = known.groupBy("dataset_id").agg(F.max("stripes").alias("kept"))
        of = of.join(kept, "dataset_id", "left").withColumn("stripes", F.coalesce("kept", stripes)).drop("kept")
    rows = snapshot_files.filter("dataset_id is not null and snapshot_no is not null and path is not null").select(
        "dataset_id",
        "snapshot_no",
        F.coalesce("delivery_no", F.lit(-1)).alias("last_delivery"),
        canonical_path(F.col("path")).alias("path"),
        epoch_seconds(F.col("modification_time")).alias("secs"),
        F.col("length").cast("long").alias("length"),
    )
    current = sized_join(rows, of.select("dataset_id", "snapshot_no", "last_delivery", "next_no", "place", "stripes"), ["dataset_id", "snapshot_no", "last_delivery"], limit=LISTING_ROWS)
    current = current.select(
        F.col("dataset_id").cast("long"), "stripes", F.pmod(F.xxhash64("path"), "stripes").cast("int").alias("stripe"), "path",
        "place", F.col("snapshot_no").cast("int"), F.col("next_no").cast("int"), "secs", "length", F.lit(None).cast("long").alias("ordinal"),
    )
    if known is not None:
        current = current.unionByName(known.select("dataset_id", "stripes", "stripe", "path", F.lit(0).alias("place"), "ordinal"), allowMissingColumns=True)
    return current.repartition("dataset_id", "stripe").sortWithinPartitions("dataset_id", "stripe", "path", "place", F.desc_nulls_last("secs"), F.desc_nulls_last("length"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a partition, stripe by stripe."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sets, stripes = batch["dataset_id"].to_numpy(), batch["stripe"].to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(sets) != 0) | (np.diff(stripes) != 0)) + 1).tolist(), len(sets)]
        for a, b in zip(cuts, cuts[1:]):
            now = (sets[a], stripes[a])
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _ordinals(group: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct paths and their ordinals, which of them are new, and the number of the path of each row.
    Paths of the dictionary keep their ordinals; new ones follow in path order after the largest."""
    path = group["path"].combine_chunks()
    path = pa.concat_arrays(path.chunks) if isinstance(path, pa.ChunkedArray) else path
    coded = path.dictionary_encode()
    which = coded.indices.to_numpy()
    known = group["ordinal"].to_numpy()
    ordinal = np.full(len(coded.dictionary), -1, np.int64)
    told = ~np.isnan(known) if known.dtype.kind == "f" else np.ones(len(known), bool)
    ordinal[which[told]] = known[told].astype(np.int64)
    new = ordinal < 0
    ordinal[new] = ordinal.max(initial=-1) + 1 + np.arange(int(new.sum()))
    return coded.dictionary, ordinal, new, which


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        paths, ordinal, _, _ = _ordinals(group)
        one = lambda c, t: pa.array(np.full(len(paths), group[c][0].as_py()), t)
        yield pa.record_batch([one("dataset_id", pa.int64()), one("stripes", pa.int32()), one("stripe", pa.int32()), paths, pa.array(ordinal)], ["dataset_id", "stripes", "stripe", "path", "ordinal"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        paths, ordinal, _, which = _ordinals(group)
        path_of = np.empty(ordinal.max(initial=-1) + 1, np.int64)
        path_of[ordinal] = np.arange(len(ordinal))
        places = group["place"].to_numpy()
        # one row of a path in a listing, the first as they are sorted; rows of the dictionary are in none
        first = np.ones(len(places), bool)
        first[1:] = (np.diff(which) != 0) | (np.diff(places) != 0)
        rows = np.flatnonzero(first & (places > 0))
        at = ordinal[which[rows]]
        rows = rows[np.lexsort((at, places[rows]))]
        at, places = ordinal[which[rows]], places[rows]
        filled = lambda c, v: group[c].combine_chunks().fill_null(v).to_numpy()
        secs, length, has = filled("secs", -1)[rows], filled("length", 0)[rows], group["length"].is_valid().to_numpy()[rows]
        numbers, follows = group["snapshot_no"].to_numpy()[rows], filled("next_no", -1)[rows]
        cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
        empty = Bitmap(np.empty(0, np.int64)), 0, 0
        #: place of a listing -> its bitmap, and where its vectors lie
        bitmaps = {int(places[a]): (Bitmap(at[a:b]), a, b) for a, b in zip(cuts, cuts[1:]) if b > a}
        number_of = {int(places[a]): int(numbers[a]) for _, a, _ in bitmaps.values()}
        number_of |= {int(places[a]) + 1: int(follows[a]) for _, a, _ in bitmaps.values() if follows[a] != -1}
        out: list[tuple[int, np.ndarray, int]] = []
        for p in sorted(number_of):
            if p == 1:
                continue
            (now, a, b), (was, c, d) = bitmaps.get(p, empty), bitmaps.get(p - 1, empty)
            common = now.both(was)
            i, j = a + np.searchsorted(at[a:b], common), c + np.searchsorted(at[c:d], common)
            other = (secs[i] != secs[j]) | (has[i] & has[j] & (length[i] != length[j]))
            for kind, found in enumerate((now.and_not(was), was.and_not(now), common[other])):
                if found.size:
                    out.append((number_of[p], path_of[found], kind))
        sizes = [x[1].size for x in out]
        n = sum(sizes)
        yield pa.record_batch(
            [
                pa.array(np.full(n, group["dataset_id"][0].as_py(), np.int64)),
                pa.array(np.repeat(np.array([x[0] for x in out], np.int32), sizes), pa.int32()),
                paths.take(pa.array(np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64))),
                pa.array(np.repeat(np.array([x[2] for x in out], np.int32), sizes), pa.int32()),
            ],
            ["dataset_id", "snapshot_no", "path", "kind"],
        )


def snapshot_ordinals(snapshot_files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The dictionary (dataset_id, stripes, stripe, path, ordinal) of all paths of ``snapshot_files`` and ``known``,
    an earlier dictionary, of which data sets keep their stripes and paths their ordinals. Ordinals run from 0 within a stripe."""
    return _striped(snapshot_files, known).mapInArrow(_dictionary, DICTIONARY)


def snapshot_changes(snapshot_files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Files added, removed or changed from each listing of a data set to the next:
    (dataset_id, snapshot_no, path, change_kind), ``snapshot_no`` the later one.

    Keys are dealt by hash over stripes, of which a data set has as many as its rows
    need, so that no stripe holds more than about ``STRIPE_ROWS`` rows however large a data set is,
    and all listings of a stripe meet in one task, after the only shuffle of the
    files. There keys become ordinals, which persist (pass the dictionary that
    ``snapshot_ordinals`` gave for earlier listings as ``known``); the
    entries of each listing form a compressed bitmap and vectors in the order of ordinals.
    AND-NOT of the bitmaps of successive listings gives additions and removals, the
    vectors give changes among common ordinals: another modification time (null
    differs from any), or another length where neither is null.

    Of several rows of a file in a listing the one with the latest modification time in
    whole seconds counts, of equal ones the one with the larger ``length`` (null is
    smallest). Rows without ``dataset_id``, ``snapshot_no`` or ``path`` name no file and are
    left out. The first listing of a data set has nothing before it and gives no row. An
    empty table gives no row.
    """
    found = _striped(snapshot_files, known).mapInArrow(_compare, "dataset_id bigint, snapshot_no int, path string, kind int")
    return found.select("dataset_id", "snapshot_no", "path", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1).alias("change_kind"))
