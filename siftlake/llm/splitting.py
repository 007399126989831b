"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.llm.packing import size_in_bytes

#: Most tokens (bytes) of a piece, and tokens that it repeats of the piece before.
LIMIT, OVERLAP = 4_096, 256
#: What a cut costs by the place where it falls.
SECTION, BLOCK, LINE, SENTENCE, WORD, SYMBOL, INSIDE = 0.0, 1.0, 3.0, 4.0, 9.0, 60.0, 1000.0
#: Cost of a piece, and of a piece twice or half as long as the others.
PIECE, IMBALANCE = 2.0, 12.0
#: Distance of places considered where a text has no break for too long.
STRIDE = 16

_SPACE = rb"(?:[ \t\r\n\f\v]|\xc2\xa0|\xe2\x80[\x80-\x8b]|\xe3\x80\x80)"
_WORDS = re.compile(_SPACE + rb"+")
_SENTENCES = re.compile(rb"(?:[.!?][\"')\]]*" + _SPACE + rb"+|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)")
#: Only where no better place lies near: behind a sign that ends a part of a word.
_SYMBOLS = re.compile(rb"[,;:|&=/\\)}\]>]|\xe3\x80\x81|\xef\xbc\x8c")
_LINES = re.compile(rb"\n")
_BLANKS = re.compile(rb"\n(?:[ \t\r]*\n)+")
_HEADS = re.compile(rb"^(?:#{1,6}[ \t]|<h[1-6]\b|(?:-{3,}|={3,}|\*{3,})[ \t\r]*$)", re.M | re.I)
_FENCES = re.compile(rb"^[ \t]*(?:```|~~~)[^\n]*\n?", re.M)
_PRE = re.compile(rb"<pre\b|</pre>", re.I)


def boundaries(data: bytes, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Places between which ``data`` may be cut, rising, with their costs. Where no
    natural place lies within ``reach``, signs and every ``STRIDE``-th character are too."""
    n = len(data)
    cost = np.full(n + 1, np.inf, np.float32)

    def mark(places, value: float) -> None:
        at = np.fromiter(places, np.int64)
        cost[at] = np.minimum(cost[at], value)

    mark((m.end() for m in _WORDS.finditer(data)), WORD)
    mark((m.end() for m in _SENTENCES.finditer(data)), SENTENCE)
    mark((m.end() for m in _LINES.finditer(data)), LINE)
    blanks = [m.end() for m in _BLANKS.finditer(data)]
    fences = [(m.start(), m.end()) for m in _FENCES.finditer(data)]
    edges = [f[i % 2] for i, f in enumerate(fences)]
    if edges:
        # an odd number of fence lines so far: inside a code block, where a blank line is a line
        inside = np.searchsorted(np.array([f[0] for f in fences]), np.array(blanks, np.int64), side="right") % 2 == 1
        blanks = np.array(blanks, np.int64)[~inside].tolist()
    mark(blanks, BLOCK)
    mark(edges, BLOCK)
    mark((m.start() if m.group()[1:2] != b"/" else m.end() for m in _PRE.finditer(data)), BLOCK)
    heads = [m.start() for m in _HEADS.finditer(data)]
    if fences:
        inside = np.searchsorted(np.array([f[0] for f in fences]), np.array(heads, np.int64), side="right") % 2 == 1
        heads = np.array(heads, np.int64)[~inside].tolist()
    mark(heads, SECTION)
    cost[0] = cost[n] = 0
    natural = np.flatnonzero(np.isfinite(cost))
    raw = np.frombuffer(data, np.uint8)
    for a, b in zip(natural[:-1].tolist(), natural[1:].tolist()):
        if b - a > reach:
            inner = np.arange(a + 1, b)
            inner = inner[(raw[inner] & 0xC0) != 0x80]
            cost[inner[::STRIDE]] = INSIDE
            mark((m.end() for m in _SYMBOLS.finditer(data, a, b - 1)), SYMBOL)
    at = np.flatnonzero(np.isfinite(cost))
    return at, cost[at]


def split_places(data: bytes, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``data`` in bytes.

    Dynamic programming over the boundary places: the cheapest way to reach a place
    is the cheapest way to an earlier one plus the cost of the piece between, which
    is the cost of the cut and of the distance from an even length. A piece begins
    ``overlap`` bytes before the end of the one before, or up to three bytes later so
    as not to begin inside a character. Ties go to the earlier cut.
    """
    n = len(data)
    if n <= limit:
        return [(0, n)]
    step = limit - overlap
    even = (n - overlap) / -(-(n - overlap) // step)
    places, cost = boundaries(data, step - 4)
    keep = places > overlap
    at = np.concatenate(([overlap], places[keep]))  # the first piece has no overlap: as if it began behind one
    cost = np.concatenate(([0], cost[keep])).astype(np.float64)
    best = np.full(len(at), np.inf)
    back = np.zeros(len(at), np.int64)
    best[0] = 0
    first = np.searchsorted(at, at - step).tolist()
    scaled = at / even
    for j in range(1, len(at)):
        lo = first[j]
        off = scaled[j] - scaled[lo:j] - 1.0
        total = best[lo:j] + IMBALANCE * off * off
        k = int(total.argmin())
        best[j] = total[k] + cost[j] + PIECE
        back[j] = lo + k
    ends, j = [], len(at) - 1
    while j > 0:
        ends.append(int(at[j]))
        j = int(back[j])
    ends.reverse()
    out, start = [], 0
    for e in ends:
        out.append((start, e))
        start = e - overlap
        while start < e and data[start] & 0xC0 == 0x80:
            start += 1
    return out


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few texts at a time: pieces repeat their overlap
            docs, numbers, starts, ends, texts, held = [], [], [], [], [], 0
            for doc, text in zip(batch["doc_id"], batch["text"]):
                data = text.as_buffer().to_pybytes()
                for k, (a, b) in enumerate(split_places(data, limit, overlap)):
                    docs.append(doc.as_py())
                    numbers.append(k)
                    starts.append(a)
                    ends.append(b)
                    texts.append(data[a:b])
                held += len(data)
                if held > 1 << 24:
                    yield _pieces(docs, numbers, starts, ends, texts)
                    docs, numbers, starts, ends, texts, held = [], [], [], [], [], 0
            yield _pieces(docs, numbers, starts, ends, texts)

    return run


def _pieces(docs, numbers, starts, ends, texts) -> pa.RecordBatch:
    text = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.record_batch(
        [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), text],
        ["doc_id", "piece_no", "start_token", "end_token", "text"],
    )


def split_documents(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece_no, start_token, end_token, text): the pieces of each document
    with more than ``limit`` tokens (bytes), none longer than ``limit``, each after the
    first beginning with the last ``overlap`` tokens, or up to three fewer, of the one
    before, cut by ``split_places``.

    Documents within the limit, null and empty texts have no pieces here and are
    sorted out in the JVM. Repeated rows are split each; a null ``doc_id`` stays null.
    ``limit`` must be at least twice ``overlap`` and 64, else ``ValueError``.
    """
    if limit < 64 or overlap < 0 or limit < 2 * overlap:
        raise ValueError(f"a limit of {limit} doesn't go with an overlap of {overlap}")
    large = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(size_in_bytes(F.col("text")) > limit)
    return large.mapInArrow(_split(limit, overlap), "doc_id bigint, piece_no int, start_token bigint, end_token bigint, text string")
