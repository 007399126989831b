"""Compressed bitmaps over ordinals and their set operations (numpy).

A bitmap covers one chunk of ``CHUNK`` ordinals. It is stored in the smaller of
two forms, told apart by the first byte: a sorted list of 16-bit offsets for thin
chunks, packed bits for dense ones.
"""

from __future__ import annotations

import numpy as np

#: Ordinals a bitmap covers; offsets fit 16 bits.
CHUNK = 4096
_LIST, _BITS = b"\x00", b"\x01"


def compress(offsets: np.ndarray) -> bytes:
    """Bitmap of distinct offsets in ``[0, CHUNK)``."""
    offsets = np.asarray(offsets, np.uint16)
    if offsets.size * 2 <= CHUNK // 8:
        return _LIST + np.sort(offsets).tobytes()
    bits = np.zeros(CHUNK, bool)
    bits[offsets] = True
    return _BITS + np.packbits(bits, bitorder="little").tobytes()


def offsets(bitmap: bytes) -> np.ndarray:
    """The set offsets in rising order."""
    if bitmap[:1] == _LIST:
        return np.frombuffer(bitmap, np.uint16, offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))


def and_not(a: bytes, b: bytes) -> np.ndarray:
    """Offsets in ``a`` and not in ``b``."""
    if a[:1] == _BITS and b[:1] == _BITS:
        left = np.frombuffer(a, np.uint8, offset=1) & ~np.frombuffer(b, np.uint8, offset=1)
        return np.flatnonzero(np.unpackbits(left, bitorder="little"))
    return np.setdiff1d(offsets(a), offsets(b), assume_unique=True)


def both(a: bytes, b: bytes) -> np.ndarray:
    """Offsets in ``a`` and in ``b``."""
    if a[:1] == _BITS and b[:1] == _BITS:
        common = np.frombuffer(a, np.uint8, offset=1) & np.frombuffer(b, np.uint8, offset=1)
        return np.flatnonzero(np.unpackbits(common, bitorder="little"))
    return np.intersect1d(offsets(a), offsets(b), assume_unique=True)


class Bitmap:
    """A set of ordinals as compressed bitmaps of its chunks."""

    def __init__(self, ordinals: np.ndarray):
        """From distinct ordinals in rising order."""
        self.chunks: dict[int, bytes] = {}
        if len(ordinals):
            number = ordinals // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(ordinals)]
            for a, b in zip(cuts, cuts[1:]):
                self.chunks[int(number[a])] = compress(ordinals[a:b] - number[a] * CHUNK)

    def _against(self, other: Bitmap, how) -> np.ndarray:
        found = [how(bits, other.chunks.get(k, _LIST)) + k * CHUNK for k, bits in self.chunks.items()]
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def and_not(self, other: Bitmap) -> np.ndarray:
        """Ordinals in this set and not in the other, rising."""
        return self._against(other, and_not)

    def both(self, other: Bitmap) -> np.ndarray:
        return self._against(other, both)
