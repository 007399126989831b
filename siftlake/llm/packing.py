"""Filling containers of a fixed number of tokens with documents."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.plans.ordered import ordered_scan

#: Tokens that a container holds.
CAPACITY = 16_384
#: Documents are packed in shards of about so many tokens and at most about so many items: about 2,000 containers, of which sharding costs one or two.
SHARD_TOKENS, SHARD_ITEMS = 1 << 25, 200_000


def size_in_bytes(text: Column) -> Column:
    """Tokens of the byte-level tokenizer: bytes of the UTF-8 text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Container number of each item, all sizes within ``[0, capacity]``.

    Large-item matching: at most two items above a third of the capacity fit into a
    container beside a small one, so they are matched first, each with the largest
    partner that still fits, from the largest item down. Smaller items then go, from
    the largest down, into the tightest gap that holds them, or open a container.
    """
    order = np.argsort(-sizes, kind="stable")
    held = np.empty(len(sizes), np.int64)
    large = [int(i) for i in order[: int(np.count_nonzero(sizes > capacity / 3))]]
    size = sizes.tolist()
    gaps: list[tuple[int, int]] = []
    opened, low = 0, len(large) - 1
    fitting: list[int] = []
    taken = set()
    for high, i in enumerate(large):
        if i in taken:
            continue
        taken.add(i)
        while low > high and size[large[low]] + size[i] <= capacity:
            fitting.append(large[low])
            low -= 1
        while fitting and fitting[-1] in taken:
            fitting.pop()
        room = capacity - size[i]
        held[i] = opened
        if fitting:
            partner = fitting.pop()
            taken.add(partner)
            held[partner] = opened
            room -= size[partner]
        gaps.append((room, opened))
        opened += 1
    gaps.sort()
    for i in order[len(large) :].tolist():
        s = size[i]
        at = bisect_left(gaps, (s, -1))
        if at < len(gaps):
            room, k = gaps.pop(at)
        else:
            room, k = capacity, opened
            opened += 1
        held[i] = k
        insort(gaps, (room - s, k))
    return held


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        ids, sizes = table["doc_id"].combine_chunks(), table["size"].to_numpy()
        order = np.lexsort((sizes, ids.fill_null(-1).to_numpy()))
        ids, sizes = ids.take(pa.array(order)), sizes[order]
        pieces = np.maximum(1, -(-sizes // capacity))
        row = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity, sizes[row] - number * capacity)
        shard = table["shard"][0].as_py()
        return pa.table(
            {
                "doc_id": ids.take(pa.array(row)),
                "piece_no": pa.array(number, pa.int64()),
                "start_token": pa.array(number * capacity, pa.int64()),
                "n_tokens": pa.array(length, pa.int64()),
                "container_id": pa.array((shard << 32) + pack(length, capacity), pa.int64()),
            }
        )

    return run


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id): where each document goes.

    Only ids and sizes move. Documents in the order of their sizes are dealt out over
    shards like cards, so that all shards hold the same mixture and the one or two more
    containers that a shard may take don't count, and each shard is packed by ``pack``. A document larger than a container is cut into full containers and a
    rest, which is an item like others; no other document is cut.

    A null or empty text is an item of size 0 (in a container, taking nothing). Rows
    with a null ``doc_id`` and repeated rows are items of their own. An empty table
    gives no row.
    """
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), size_in_bytes(F.col("text")).alias("size"))
    total = sizes.agg(F.sum("size").alias("tokens"), F.sum(F.ceil(F.greatest("size", F.lit(1)) / capacity)).alias("items")).first()
    shards = max(1, -(-int(total["tokens"] or 0) // shard_tokens), -(-int(total["items"] or 0) // shard_items))
    if shards == 1:
        dealt = sizes.withColumn("shard", F.lit(0).cast("long"))
    else:
        # dealt out in the order of their sizes, every shard gets the same mixture
        ranked = ordered_scan(sizes, [], ["size", "doc_id"], seq="rank")
        dealt = ranked.select("doc_id", "size", F.pmod("rank", F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(
        _pack_shard(capacity), "doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint, container_id bigint"
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: (containers, tokens, largest, least_containers, overfull)."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return per.agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("largest"),
        F.ceil(F.sum("tokens") / capacity).alias("least_containers"),
        F.count_if(F.col("tokens") > capacity).alias("overfull"),
    )
