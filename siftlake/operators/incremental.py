"""Processing only new or changed records: an interval ledger.

Processed sequence numbers are kept as disjoint closed intervals. A run subtracts
them from the numbers that are available, works on the gaps (late commits lie in
gaps between intervals) and commits the merged intervals together with its output.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions.intervals import Interval, IntervalSet, dyadic
from siftlake.functions.paths import canonical_path, epoch_seconds
from siftlake.plans.ordered import gap_islands, next_marked, ordered_scan
from siftlake.plans.shared import cut

#: Holes between processed intervals up to which they are conditions of the scan; more are found by a join.
NAMED_HOLES = 64
_SPAN = "lo bigint, hi bigint"


class IntervalLedger:
    """Exactly-once runs over a table with a unique sequence number per record.

    State lives in ``root``: a run writes its output and the merged intervals, a table,
    into folders of its own, and is committed by the marker ``commits/<n>.json``, which
    is created only if it isn't there (``_commit``). A run that dies before leaves
    nothing that counts, so the next run sees the same gaps again; a run that died
    after is done. Of two runs that race for the same number one is committed; the
    other raises ``RuntimeError``, and what it wrote doesn't count.

    Neither records nor intervals come to the driver beyond ``NAMED_HOLES`` of them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    def _last(self) -> tuple[int, dict]:
        done = self._commits()
        return (done[-1], self._load(done[-1])) if done else (0, {})

    def _commits(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/commits"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{number}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, number: int, body: dict) -> None:
        """Create the marker, whole and only if there is none: on a local disk by a hard link, elsewhere by
        Spark's checkpoint file manager, whose atomic creation every file system has its own way for."""
        final, temp = f"{self.root}/commits/{number}.json", f"{self.root}/commits/.{uuid.uuid4().hex}"
        data = bytearray(json.dumps(body).encode())
        try:
            if self._fs.getUri().getScheme() == "file":
                stream = self._fs.create(self._path(temp), False)
                stream.write(data)
                stream.close()
                local = lambda at: self._jvm.java.io.File(self._path(at).toUri().getPath()).toPath()
                try:
                    self._jvm.java.nio.file.Files.createLink(local(final), local(temp))
                finally:
                    self._fs.delete(self._path(temp), False)
            else:
                managers = self._jvm.org.apache.spark.sql.execution.streaming.checkpointing.CheckpointFileManager
                stream = managers.create(self._path(f"{self.root}/commits"), self.spark._jsc.hadoopConfiguration()).createAtomic(self._path(final), False)
                stream.write(data)
                stream.close()
        except Exception as e:
            if self._fs.exists(self._path(final)):
                raise RuntimeError(f"another run has committed {number}; run again") from e
            raise

    def intervals(self) -> DataFrame:
        """The processed numbers as rows (lo, hi), disjoint."""
        at = self._last()[1].get("intervals")
        return self.spark.read.schema(_SPAN).parquet(at) if at else self.spark.createDataFrame([], _SPAN)

    def processed(self) -> list[Interval]:
        """All intervals, for a ledger that is known to be small."""
        return [(r[0], r[1]) for r in self.intervals().orderBy("lo").collect()]

    def output(self) -> DataFrame | None:
        """All committed output."""
        paths = [p for n in self._commits() if (p := self._load(n)["output"])]
        return self.spark.read.parquet(*paths) if paths else None

    def unprocessed(self, available: DataFrame, seq: str) -> DataFrame:
        """The records of ``available`` whose number no processed interval covers.

        The numbers below, above and in the few holes between intervals are conditions
        of the scan, so Parquet row groups of processed numbers are skipped. Where holes
        are many, only the records between the first and the last hole meet them, by
        equality on the aligned blocks that the holes fall into.
        """
        number = F.col(seq)
        some = available.filter(number.isNotNull())
        done = self._last()[1]
        if not done.get("count"):
            return some
        beyond = (number < done["lo"]) | (number > done["hi"])
        if done["count"] == 1:
            return some.filter(beyond)
        numbered = ordered_scan(self.intervals(), [], ["lo"], lag=["hi"])
        holes = cut(numbered.filter("prev_hi is not null").select((F.col("prev_hi") + 1).alias("lo"), (F.col("lo") - 1).alias("hi")), "holes")
        if done["count"] <= NAMED_HOLES:
            inside = F.lit(False)
            for r in holes.collect():
                inside = inside | number.between(r["lo"], r["hi"])
            return some.filter(beyond | inside)
        blocks = cut(holes.mapInArrow(_blocks, "level int, block bigint"), "hole-blocks")
        edge = holes.agg(F.min("lo"), F.max("hi")).first()
        levels = [r[0] for r in blocks.select("level").distinct().orderBy("level").collect()]  # 63 at most
        near = some.filter(number.between(edge[0], edge[1])).select(F.struct("*").alias("row"), number.cast("long").alias("number"))
        asked = near.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
        found = asked.withColumn("block", F.expr("shiftright(number, level)")).join(blocks, ["level", "block"], "left_semi")
        return some.filter(beyond).unionByName(found.select("row.*"))

    def run(self, available: DataFrame, seq: str, work: Callable[[DataFrame], DataFrame]) -> int:
        """Process the records in the gaps once and commit; returns their number.
        Records with a null number are not processed (they can't be remembered);
        repeated rows of one number are processed together. ``work`` must give the
        same rows whenever it is run on the same records."""
        number, before = self._last()
        new = cut(self.unprocessed(available, seq), "unprocessed")
        count = new.count()
        if not count:
            return 0
        own = f"{number + 1}-{uuid.uuid4().hex}"
        out, merged = f"{self.root}/data/{own}", f"{self.root}/intervals/{own}"
        work(new).write.parquet(out)
        numbers = new.select(F.col(seq).cast("long").alias("n")).distinct()
        gaps = gap_islands(numbers, [], "n").select(F.col("first_pos").alias("lo"), F.col("last_pos").alias("hi"))
        _merged(self.intervals().unionByName(gaps)).write.parquet(merged)
        told = self.spark.read.schema(_SPAN).parquet(merged).agg(F.count("*"), F.min("lo"), F.max("hi")).first()
        self._commit(number + 1, {"intervals": merged, "output": out, "count": told[0], "lo": told[1], "hi": told[2]})
        return count


def _merged(spans: DataFrame) -> DataFrame:
    """Touching ones of disjoint intervals put together."""
    starts = ordered_scan(spans, [], ["lo"], lag=["hi"], seq="n").withColumn("begins", (F.col("prev_hi").isNull() | (F.col("prev_hi") < F.col("lo") - 1)).cast("int"))
    islands = ordered_scan(starts.select("lo", "hi", "begins"), [], ["lo"], sums={"island": F.col("begins")}, seq="n")
    return islands.groupBy((F.col("island") + F.col("begins")).alias("island")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [x for lo, hi in zip(batch["lo"].to_pylist(), batch["hi"].to_pylist()) for x in dyadic(lo, hi)]
        yield pa.record_batch([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int64())], ["level", "block"])


def succeeded_runs(index_runs: DataFrame) -> DataFrame:
    """(dataset_id, run_id, started_at) of successful runs, each once. Runs with a null id, data set, start or outcome can't have succeeded."""
    return (
        index_runs.filter("lower(trim(outcome)) = 'succeeded' and run_id is not null and dataset_id is not null and started_at is not null")
        .select("dataset_id", "run_id", "started_at")
        .distinct()
    )


def _ledger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replays the runs over the arrivals of a range, data set by data set: adds ``place``
    (from 1 on), and first and last place of the gap in which a run took the arrival."""
    held: list[pa.RecordBatch] = []

    def replay(table: pa.Table) -> pa.RecordBatch:
        ids = table["arrival_id"].to_numpy()
        table = table.filter(pa.array(np.diff(ids, prepend=ids[:1] - 1) != 0))  # repeated rows
        n = table.num_rows
        run = table["run"].combine_chunks()
        taken = np.flatnonzero(run.is_valid().to_numpy(zero_copy_only=False))
        start = run.field("started_at").cast(pa.int64()).to_numpy(zero_copy_only=False)[taken] if len(taken) else np.empty(0, np.int64)
        ident = run.field("run_id").to_numpy(zero_copy_only=False)[taken] if len(taken) else np.empty(0, np.int64)
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.lexsort((taken, ident, start))
        places, start, ident = taken[order] + 1, start[order], ident[order]
        # what became available to a run, as ranges; the next run begins where start or id changes
        cuts = np.flatnonzero((np.diff(places) != 1) | (np.diff(start) != 0) | (np.diff(ident) != 0)) + 1
        processed = IntervalSet()
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            if a == b:
                continue
            for lo, hi in processed.gaps(int(places[a]), int(places[b - 1])):
                first[lo - 1 : hi], last[lo - 1 : hi] = lo, hi
                processed.add(lo, hi)
        no = pa.array(first == 0)
        none = pa.scalar(None, pa.int64())
        columns = [pa.array(np.arange(1, n + 1)), pc.if_else(no, none, pa.array(first)), pc.if_else(no, none, pa.array(last)), pa.array(np.full(n, n))]
        own = table.combine_chunks().to_batches()[0]
        return pa.record_batch([*own.columns, *columns], [*own.schema.names, "place", "gap_first", "gap_last", "places"])

    for batch in batches:
        if not batch.num_rows:
            continue
        sets = batch["dataset_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sets)) + 1).tolist(), len(sets)]
        if held and held[-1]["dataset_id"][0].as_py() != sets[0]:
            yield replay(pa.Table.from_batches(held))
            held = []
        for a, b in zip(cuts, cuts[1:]):
            held.append(batch.slice(a, b - a))
            if b < len(sets):
                yield replay(pa.Table.from_batches(held))
                held = []
    if held:
        yield replay(pa.Table.from_batches(held))


def claimed(file_arrivals: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Each arrival with its number ``seq``, the run that takes it, and the interval of the ledger
    (``first_seq``, ``last_seq``) in which that run does; ``edge`` tells intervals that may go on.

    Arrivals of a data set get sequence numbers by ``arrival_id``. An as-of pass
    (``next_marked``) tells to which successful run an arrival first is available: the
    first with ``started_at >= loaded_at``. Then all runs are replayed over the
    sequence: the ranges available to a run, without the intervals processed so far,
    are its gaps, late commits among them, and are merged into the processed
    intervals. Sequences are replayed in ranges of any cut, as gaps of one range
    don't depend on another; an interval across a cut is told in two parts.

    Rows of one ``arrival_id`` in a data set count once (the smallest by ``loaded_at``,
    ``listed_at``, path, time, length). Arrivals that no run has seen yet are numbered but
    left out. Rows without id, data set, path or either time are left out.
    """
    runs = succeeded_runs(index_runs)
    run = F.struct("started_at", "run_id")
    run_type = runs.select(run.alias("r")).schema["r"].dataType
    arrivals = file_arrivals.filter(
        "arrival_id is not null and dataset_id is not null and path is not null and loaded_at is not null and listed_at is not null"
    ).select(
        "dataset_id",
        F.col("loaded_at").alias("at"),
        F.lit(0).alias("kind"),
        "arrival_id",
        "listed_at",
        canonical_path(F.col("path")).alias("path"),
        epoch_seconds(F.col("modification_time")).alias("secs"),
        F.col("length").cast("long").alias("length"),
        F.lit(None).cast(run_type).alias("run"),
    )
    starts = runs.select("dataset_id", F.col("started_at").alias("at"), F.lit(1).alias("kind"), F.col("run_id").alias("arrival_id"), run.alias("run"))
    line = arrivals.unionByName(starts, allowMissingColumns=True)
    seen = next_marked(line, ["dataset_id"], ["at", "kind"], "run").filter("kind = 0")
    seen = seen.select("dataset_id", "arrival_id", "at", "listed_at", "path", "secs", "length", F.col("next_run").alias("run"))
    fields = [T.StructField(n, T.LongType()) for n in ("place", "gap_first", "gap_last", "places")]
    replayed = ordered_scan(seen, ["dataset_id"], ["arrival_id"], within=["at", "listed_at", "path", "secs", "length"], through=(_ledger, fields))
    shift = lambda c: F.col("seq") - F.col("place") + F.col(c)
    return replayed.filter("run is not null").select(
        "dataset_id", "arrival_id", "listed_at", "path", "secs", "length", "run", "seq", shift("gap_first").alias("first_seq"), shift("gap_last").alias("last_seq"),
        ((F.col("gap_first") == 1) | (F.col("gap_last") == F.col("places"))).alias("edge"),
    )


def ledger_intervals(taken: DataFrame) -> DataFrame:
    """The ledger: (dataset_id, run_id, first_seq, last_seq) of all gaps that runs filled, disjoint
    within a data set, none touching another of its run. Parts of an interval, at most two a range of ``claimed``, are put together."""
    spans = taken.filter("seq = first_seq").select("dataset_id", F.col("run.run_id").alias("run_id"), "first_seq", "last_seq", "edge")
    order = Window.partitionBy("dataset_id", "run_id").orderBy("first_seq")
    parts = (
        spans.filter("edge")
        .withColumn("begins", F.coalesce(F.lag("last_seq").over(order) != F.col("first_seq") - 1, F.lit(True)).cast("int"))
        .withColumn("whole", F.sum("begins").over(order))
        .groupBy("dataset_id", "run_id", "whole")
        .agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
        .drop("whole")
    )
    return spans.filter("not edge").drop("edge").unionByName(parts)


def _state() -> Column:
    return F.struct("listed_at", "arrival_id", "secs", "length")


def new_or_changed(taken: DataFrame) -> DataFrame:
    """(run_id, arrival_id): for each successful run the files that are new or whose
    state (length, modification time in whole seconds) changed since the last one.

    Only arrivals in the gaps of the ledger count. The state of a file is that of the
    seen arrival with the latest ``listed_at`` (ties: larger ``arrival_id``). Per run and
    file only the latest arrival of the run's gaps matters, which is kept on the map
    side; a file then has at most one row per run. A gap whose latest arrival is older
    than the known state changes nothing. Null lengths and times are equal to each other.
    """
    in_gaps = taken.filter("seq between first_seq and last_seq")
    per_run = in_gaps.groupBy("dataset_id", "path", "run").agg(F.max(_state()).alias("s"))
    w = Window.partitionBy("dataset_id", "path").orderBy("run.started_at", "run.run_id")
    known = F.max("s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    judged = per_run.withColumn("k", known)
    news = F.col("k").isNull() | (
        (F.col("s") > F.col("k")) & ~(F.col("s.secs").eqNullSafe(F.col("k.secs")) & F.col("s.length").eqNullSafe(F.col("k.length")))
    )
    return judged.filter(news).select("run.run_id", "s.arrival_id")
