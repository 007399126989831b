"""Hilbert-curve codes of whole-number coordinates (numpy, vectorised).

Follows J. Skilling, "Programming the Hilbert curve" (AIP Conf. Proc. 707, 2004):
the transposed index is found by undoing excess work from the highest bit down and
then Gray-encoding; the code is the interleaving of the transposed bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per dimension; with three dimensions a code has 60 bits.
BITS = 20


def hilbert_codes(coordinates: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Codes of the points in the rows of ``coordinates`` (values in [0, 2^bits))."""
    x = np.array(coordinates, np.int64).T.copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    code = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            code = (code << 1) | ((x[i] >> b) & 1)
    return code


def coordinates(values: np.ndarray, bounds: list[list[float]], bits: int = BITS) -> np.ndarray:
    """Values of each dimension (columns; not-a-number for null) as whole numbers in ``[0, 2^bits)``.

    ``bounds`` has rising quantiles of each dimension. A value's coordinate is its place among
    them, in between by proportion, so dimensions are spread evenly however skewed
    their values are, and greater values never have lesser coordinates. Null is 0.
    """
    top = (1 << bits) - 1
    out = np.zeros(values.shape, np.int64)
    for i, known in enumerate(bounds):
        xs, first = np.unique(np.asarray(known, np.float64), return_index=True)
        if len(xs) > 1:
            share = np.interp(values[:, i], xs, first / (len(known) - 1))
            out[:, i] = np.where(np.isnan(values[:, i]), 0, share * top)
    return out


def quantile_bounds(df: DataFrame, values: list[Column], pieces: int = 1024) -> list[list[float]]:
    """``pieces`` + 1 approximate quantiles of each value, in one pass; these few numbers come to the driver."""
    steps = F.array(*[F.lit(i / pieces) for i in range(pieces + 1)])
    got = df.agg(*[F.percentile_approx(v.cast("double"), steps, 10_000).alias(f"q{i}") for i, v in enumerate(values)]).first()
    return [list(got[f"q{i}"] or []) for i in range(len(values))]


def hilbert_column(values: list[Column], bounds: list[list[float]], bits: int) -> Column:
    """Code column of up to 60 / bits values, computed batch by batch."""
    if len(values) * bits > 60:
        raise ValueError(f"{len(values)} dimensions of {bits} bits exceed 60 bits")

    @F.pandas_udf("bigint")
    def codes(points: pd.DataFrame) -> pd.Series:
        places = coordinates(points.to_numpy(np.float64), bounds, bits)
        return pd.Series(places[:, 0] if places.shape[1] == 1 else hilbert_codes(places, bits))

    return codes(F.struct(*[v.cast("double").alias(f"c{i}") for i, v in enumerate(values)]))
