"""A stream whose records are processed exactly once through an interval ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siftlake.operators.incremental import IntervalLedger


def run_with_ledger(
    stream: DataFrame, root: str, seq: str, work: Callable[[DataFrame], DataFrame], checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start a query that gives the records of each micro-batch that ``root``'s ledger
    doesn't have yet to ``work`` and commits its output with their numbers.

    Structured Streaming may hand over a batch again after a failure, or all of them
    when its checkpoint is lost; the ledger leaves out what it has, so nothing is
    processed twice, and late records fill their gaps. Records with a null number are
    never processed. An empty batch commits nothing.
    """

    def each(batch: DataFrame, _: int) -> None:
        IntervalLedger(batch.sparkSession, root).run(batch, seq, work)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
