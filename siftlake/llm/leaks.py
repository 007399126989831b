"""Evaluation texts leaking into training text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftlake.llm.align import align
from siftlake.llm.words import words
from siftlake.plans.shared import cut, sized_join

#: Words of a seed, and of the window of which each holds a chosen seed. A case has
#: at least ``WINDOW`` unchanged words in a row (13 of them, or 10 between changes,
#: or 12 on one side of a single change among 25), so a seed lies in every case.
SEED, WINDOW = 8, 10
#: The rule of a case: so many unchanged words, or so many with changes so far apart.
UNCHANGED, SPAN, APART = 13, 25, 10
#: Grams of the items that workers get as sorted numbers; more are told by a bit table of fixed size, which lets some others through.
SENT_GRAMS, TABLE_BITS = 1 << 22, 1 << 29
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 1 << 20
#: Words of items, together, up to which the items' words are broadcast for the alignment.
SENT_WORDS = 1 << 22

_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SEED)], np.uint64)


class _Hasher:
    """64-bit hashes of the words of texts, each distinct word hashed once."""

    def __init__(self):
        self._known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = words(text)
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        out = np.empty(len(found), np.int64)
        for i, w in enumerate(found):
            h = known.get(w)
            if h is None:
                h = known[w] = int(np.uint64(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))).astype(np.int64))
            out[i] = h
        return out


def _grams(line: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``SEED`` words, by the place of their first word."""
    n = len(line) - SEED + 1
    if n <= 0:
        return np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(SEED):
        total += line[k : k + n].view(np.uint64) * _MULTIPLIERS[k]
    total ^= total >> np.uint64(29)
    return total.view(np.int64)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = _Hasher()
    for batch in batches:
        lines = [hashed(text) for text in batch["prompt"].to_pylist()]
        # items of equal words are searched once
        marks = [xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in lines]
        whole = pa.list_(pa.int64())
        yield pa.record_batch([batch["item_id"], pa.array(marks, pa.int64()), pa.array(lines, whole), pa.array([_grams(x) for x in lines], whole)], ["item_id", "mark", "line", "grams"])


class _Wanted:
    """Which gram hashes are looked for: exactly, or by a table of bits, which never misses one."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None):
        self.hashes, self.bits = hashes, bits

    def places(self, grams: np.ndarray) -> np.ndarray:
        if self.hashes is not None:
            if not len(self.hashes):
                return np.empty(0, np.int64)
            at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
            return np.flatnonzero(self.hashes[at] == grams)
        slot = grams.view(np.uint64) % np.uint64(len(self.bits) * 8)
        return np.flatnonzero((self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)

    @classmethod
    def of(cls, seeds: DataFrame) -> _Wanted:
        """From the distinct ``gram`` numbers, which pass through the driver in pieces; what stays has a fixed largest size."""
        if seeds.limit(SENT_GRAMS + 1).count() <= SENT_GRAMS:
            return cls(np.sort(np.array([r[0] for r in seeds.toLocalIterator()], np.int64)), None)
        bits = np.zeros(TABLE_BITS >> 3, np.uint8)
        for row in seeds.mapInArrow(_slots(TABLE_BITS), "slots binary").toLocalIterator():
            slot = np.frombuffer(row[0], np.uint32)
            np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        return cls(None, bits)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch["gram"].to_numpy().view(np.uint64) % np.uint64(bits)
            yield pa.record_batch([pa.array([slot.astype(np.uint32).tobytes()], pa.binary())], ["slots"])

    return run


def _seek(shared):
    """Documents that hold any gram of any item: their words as hashes, and the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, hashed = shared.value, _Hasher()
        for batch in batches:
            docs, lines, grams, places = [], [], [], []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                line = hashed(text)
                here = _grams(line)
                at = wanted.places(here)
                if len(at):
                    docs.append(doc)
                    lines.append(line)
                    grams.append(here[at])
                    places.append(at.astype(np.int32))
            yield pa.record_batch(
                [pa.array(docs, pa.int64()), pa.array(lines, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                ["doc_id", "line", "grams", "places"],
            )

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns the passages of a document around its seeds with an item's words."""
    for batch in batches:
        out: list[tuple] = []
        for doc, mark, item, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "item", "spans"))):
            where: dict[int, list[int]] = defaultdict(list)
            for i, w in enumerate(item):
                where[w].append(i)
            best = (0, 0, 0)
            for passage in spans:
                best = tuple(map(max, best, align(item, where, passage, APART)[:3]))
            if best[0] >= UNCHANGED or best[1] >= SPAN:
                out.append((doc, mark, *best))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "mark", "unchanged_words", "span_words", "score"])


def leaked_items(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    """(doc_id, item_id, unchanged_words, span_words, score): documents that hold at
    least 13 successive words of an item's prompt, or at least 25 with at least ten
    unchanged words between any two changes.

    However many items there are, documents are read in one pass, which keeps those that share any eight words in
    a row with an item. Workers get the hashes of the items' grams, or a bit table of fixed size where
    these are more than ``SENT_GRAMS``; what the table lets through by mistake meets no
    gram in the join that follows. In every window of ten words of an item the eight-word
    gram found in the fewest documents is its seed; as every case holds ten unchanged
    words in a row, it holds a seed. Seeds join the hits of the documents by shuffle, and
    the passages around them, overlapping ones as one, are aligned with the item (sparse Smith-Waterman), which also decides
    the exact rule. Grams and items of documents stay on the workers. Words are told by 64-bit hashes.

    Words are compared as ``words`` describes. Null ids and null or empty texts give
    no row; repeated documents or items count once; items with equal prompts are all
    reported; an empty table on either side gives no row.
    """
    items = cut(
        eval_items.filter("item_id is not null and prompt is not null").select(F.col("item_id").cast("long").alias("item_id"), "prompt").distinct()
        .mapInArrow(_item_words, "item_id bigint, mark bigint, line array<bigint>, grams array<bigint>"),
        "leak-items",
    )
    texts = items.groupBy("mark").agg(F.first("line").alias("item"), F.first("grams").alias("grams"))
    grams = cut(texts.select("mark", F.size("item").alias("n"), F.posexplode("grams").alias("place", "gram")), "leak-grams")
    wanted = documents.sparkSession.sparkContext.broadcast(_Wanted.of(grams.select("gram").distinct()))
    read = documents.filter("doc_id is not null and text is not null and text != ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = cut(read.mapInArrow(_seek(wanted), "doc_id bigint, line array<bigint>, grams array<bigint>, places array<int>"), "leak-hits")
    counted = hits.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("docs"))
    # the rarest gram of each window of an item, ties by gram; windows run to the last whole one
    window = Window.partitionBy("mark").orderBy("place").rowsBetween(0, WINDOW - SEED)
    rare = grams.join(counted, "gram", "left").withColumn("best", F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "gram", "place")).over(window))
    seeds = rare.filter(F.col("place") <= F.col("n") - WINDOW).select("best.gram", "mark", "n", "best.place").distinct()
    found = hits.select("doc_id", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("doc_id", F.col("h.grams").alias("gram"), F.col("h.places").alias("at"))
    slack = F.floor(F.col("n") / APART) + 2
    near = (
        found.join(seeds, "gram")
        # no path through the seed reaches farther: one added word for ten of the item
        .select("doc_id", "mark", F.greatest(F.lit(0), F.col("at") - F.col("place") - slack).cast("int").alias("lo"), (F.col("at") + F.col("n") - F.col("place") + slack).cast("int").alias("hi"))
        .distinct()
    )
    # overlapping ones put together, so that no word of a document is taken twice for an item
    line_of = Window.partitionBy("doc_id", "mark").orderBy("lo", "hi")
    reach = F.max("hi").over(line_of.rowsBetween(Window.unboundedPreceding, -1))
    begun = near.withColumn("begins", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int")).withColumn("part", F.sum("begins").over(line_of))
    parts = begun.groupBy("doc_id", "mark", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = parts.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    # repeated rows of a document have the same words where their texts are equal; else each is looked at
    lines = hits.select("doc_id", "line")
    passages = spans.join(lines, "doc_id").select("doc_id", "mark", F.transform("spans", lambda s: F.slice("line", s["lo"] + 1, s["hi"] - s["lo"])).alias("spans"))
    total = texts.agg(F.coalesce(F.sum(F.size("item")), F.lit(0))).first()[0]
    own = texts.select("mark", "item")
    paired = passages.join(F.broadcast(own) if total <= SENT_WORDS else own, "mark")
    judged = paired.select("doc_id", "mark", "item", "spans").mapInArrow(_judge, "doc_id bigint, mark bigint, unchanged_words int, span_words int, score int")
    told = sized_join(judged, items.select("mark", "item_id").distinct(), "mark")
    return told.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("unchanged_words", "span_words", "score")])
