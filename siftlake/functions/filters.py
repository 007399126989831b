"""Membership filters of a column within a row group (numpy).

Integers, dates and timestamps are numbers here; strings stay strings. A filter may
answer "maybe" wrongly, never "no".
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash

from siftlake.functions import bitmaps

#: Wrong answers of a bloom filter, and the most values it is sized for.
FALSE_SHARE, MOST_VALUES = 0.03, 1 << 20
#: Filter kinds by the name of the option; the exact kind of 32-bit integers is a bitmap.
KINDS = ("bloom", "dict")


#: Seed of Spark's ``xxhash64``, and the bytes of a number that it hashes; strings are hashed as UTF-8.
SEED, WIDTH = 42, {"int": 4, "date": 4, "bigint": 8, "timestamp": 8, "timestamp_ntz": 8, "string": 0}


class BloomFilter:
    """Membership of 64-bit hashes, which Spark's ``xxhash64`` takes of the values."""

    kind = "bloom"

    def __init__(self, bits: np.ndarray, probes: int, width: int):
        self.bits, self.probes, self.width = bits, probes, width

    @staticmethod
    def _places(h: np.ndarray, probes: int, size: int) -> np.ndarray:
        low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        steps = np.arange(probes, dtype=np.uint64)[:, None]
        return (low[None, :] + steps * high[None, :]) % np.uint64(size)

    @classmethod
    def of(cls, hashed: np.ndarray, rows: int, kind: str) -> BloomFilter:
        """Filter for a row group of ``rows`` rows of type ``kind`` from the hashes of its values."""
        if rows <= 0:
            raise ValueError(f"a bloom filter needs a positive number of rows, not {rows}")
        n = min(rows, MOST_VALUES)
        size = max(64, math.ceil(-n * math.log(FALSE_SHARE) / math.log(2) ** 2 / 64) * 64)
        probes = max(1, round(size / n * math.log(2)))
        bits = np.zeros(size, bool)
        for one in cls._places(np.unique(hashed).astype(np.uint64), probes, size):
            bits[one] = True
        return cls(bits, probes, WIDTH[kind])

    def might_contain(self, value) -> bool:
        """A value of a type that the column doesn't have is never ruled out."""
        if value is None or isinstance(value, str) != (self.width == 0):
            return True
        if self.width and not -(1 << 8 * self.width - 1) <= value < 1 << 8 * self.width - 1:
            return True
        plain = value.to_bytes(self.width, "little", signed=True) if self.width else value.encode()
        h = np.array([xxhash.xxh64_intdigest(plain, SEED)], np.uint64)
        return bool(self.bits[self._places(h, self.probes, len(self.bits)).ravel()].all())

    def dump(self) -> bytes:
        return bytes([self.probes, self.width]) + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, data: bytes) -> BloomFilter:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8, offset=2)).astype(bool), data[0], data[1])


class ValueSet:
    """All distinct values."""

    kind = "dict"

    def __init__(self, values: pa.Array):
        self.values, self._known = values, None

    @classmethod
    def of(cls, values, rows: int) -> ValueSet:
        return cls(pa.array(values, pa.int64() if isinstance(values, np.ndarray) and values.dtype.kind == "i" else pa.string()))

    def might_contain(self, value) -> bool:
        if value is None:
            return True
        if isinstance(value, int) != pa.types.is_integer(self.values.type):
            return True
        if self._known is None:
            self._known = set(self.values.to_pylist())
        return value in self._known

    def dump(self) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([self.values], ["v"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def load(cls, data: bytes) -> ValueSet:
        return cls(pa.ipc.open_stream(data).read_all()["v"].combine_chunks())


class IntBitmap:
    """All distinct 32-bit integers as compressed bitmaps of chunks."""

    kind = "bitmap"

    def __init__(self, chunks: dict[int, bytes]):
        self.chunks = chunks

    @classmethod
    def of(cls, values: np.ndarray, rows: int) -> IntBitmap:
        values = np.asarray(values, np.int64)
        chunk, inner = values // bitmaps.CHUNK, values % bitmaps.CHUNK
        order = np.argsort(chunk, kind="stable")
        chunk, inner = chunk[order], inner[order]
        ids, first = np.unique(chunk, return_index=True)
        return cls({int(c): bitmaps.compress(part) for c, part in zip(ids, np.split(inner, first[1:]))} if len(values) else {})

    def might_contain(self, value) -> bool:
        if not isinstance(value, int):
            return True
        found = self.chunks.get(value // bitmaps.CHUNK)
        return found is not None and bool(np.isin(value % bitmaps.CHUNK, bitmaps.offsets(found)))

    def dump(self) -> bytes:
        head = np.array([len(self.chunks), *self.chunks, *map(len, self.chunks.values())], np.int64)
        return head.tobytes() + b"".join(self.chunks.values())

    @classmethod
    def load(cls, data: bytes) -> IntBitmap:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, 1 + 2 * n)
        at, out = head.nbytes, {}
        for c, size in zip(head[1 : n + 1].tolist(), head[n + 1 :].tolist()):
            out[c] = data[at : at + size]
            at += size
        return cls(out)


_BY_KIND = {c.kind: c for c in (BloomFilter, ValueSet, IntBitmap)}


def filter_class(option: str, spark_type: str):
    """Filter class for an option (``bloom`` or ``dict``) and a column type."""
    if option not in KINDS:
        raise ValueError(f"Unsupported filter statistics type {option}, expected one of {', '.join(KINDS)}")
    if option == "bloom":
        return BloomFilter
    return IntBitmap if spark_type == "int" else ValueSet


def load_filter(kind: str, data: bytes):
    return _BY_KIND[kind].load(data)
