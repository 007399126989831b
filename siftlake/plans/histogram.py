"""Exact histograms of codes, refined only where a cell holds too many rows.

Groups (``keys``) are cut into cells of their rows' codes: a whole group is one cell
as long as it is small, else its code is split by its next ``STEP`` bits, and so on;
where rows share a code, by bits of a tie number. A cell thus holds at most ``most``
rows, cells are ranges of (code, tie), and their exact counts and sums along the
codes tell where each cell lies in its group. Nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.plans.ordered import ordered_scan
from siftlake.plans.shared import cut, sized_join

#: Bits by which a cell is split, and bits of a code and of a tie number.
STEP, CODE_BITS, TIE_BITS = 12, 60, 60
#: Rows of a table of cells, of six numbers and a key each, up to which it is broadcast.
CELL_ROWS = 200_000
CELL = ["_level", "_c1", "_c2"]


def _cell(level: int, code_bits: int) -> dict[str, Column]:
    """Prefixes of code and tie at a level."""
    depth = level * STEP
    c1 = F.shiftright("code", max(0, code_bits - depth))
    over = max(0, depth - -(-code_bits // STEP) * STEP)
    c2 = F.shiftright("tie", max(0, TIE_BITS - over)) if over else F.lit(0).cast("long")
    return {"_c1": c1 if level else F.lit(0).cast("long"), "_c2": c2}


def coded_cells(rows: DataFrame, keys: list[str], most: Column, code_bits: int = CODE_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (with ``code`` and ``tie``, whole numbers below 2^``code_bits`` and 2^``TIE_BITS``) with the
    ``_level``, ``_c1`` and ``_c2`` of their cell, and the tables of split cells, for ``place_in_cells``."""
    last = -(-code_bits // STEP) + TIE_BITS // STEP
    hot: list[DataFrame] = []
    at = rows.withColumn("_most", most)
    for level in range(last):
        counts = at.withColumns(_cell(level, code_bits)).groupBy(*keys, "_c1", "_c2").agg(F.count("*").alias("_n"), F.max("_most").alias("_m"))
        split = cut(counts.filter("_n > _m").select(*keys, "_c1", "_c2"), "split-cells")
        if split.isEmpty():
            break
        hot.append(split)
        # only rows in split cells go on
        at = sized_join(at.withColumns(_cell(level, code_bits)), split, [*keys, "_c1", "_c2"], "left_semi", CELL_ROWS).drop("_c1", "_c2")
    return place_in_cells(rows, keys, hot, code_bits), hot


def place_in_cells(rows: DataFrame, keys: list[str], hot: list[DataFrame], code_bits: int = CODE_BITS) -> DataFrame:
    """``rows`` with their cell, given the split cells of each level."""
    deep = rows.withColumn("_level", F.lit(0))
    for level, split in enumerate(hot):
        marked = split.withColumnsRenamed({"_c1": "_h1", "_c2": "_h2"}).withColumn("_hot", F.lit(1))
        named = deep.withColumns({k.replace("_c", "_h"): v for k, v in _cell(level, code_bits).items()})
        joined = sized_join(named, marked, [*keys, "_h1", "_h2"], "left", CELL_ROWS)
        deep = joined.withColumn("_level", F.when(F.col("_hot").isNotNull() & (F.col("_level") == level), level + 1).otherwise(F.col("_level"))).drop("_h1", "_h2", "_hot")
    pick = lambda c: F.coalesce(*[F.when(F.col("_level") == x, _cell(x, code_bits)[c]) for x in range(len(hot) + 1)])
    return deep.withColumns({"_c1": pick("_c1"), "_c2": pick("_c2")})


def cell_offsets(placed: DataFrame, keys: list[str], sums: dict[str, Column], code_bits: int = CODE_BITS) -> DataFrame:
    """One row per cell: (keys, ``_level``, ``_c1``, ``_c2``, and for each name in ``sums`` ``<name>`` of the
    cell, ``<name>_before`` of the group's earlier cells and ``<name>_all`` of the group)."""
    cells = cut(placed.groupBy(*keys, *CELL).agg(F.min(F.struct("code", "tie")).alias("_low"), *[F.sum(v).cast("long").alias(x) for x, v in sums.items()]), "cells")
    whole = cells.groupBy(*keys).agg(*[F.sum(x).alias(f"{x}_all") for x in sums])
    flat = cells.select(*keys, *CELL, F.col("_low.code").alias("_low_code"), F.col("_low.tie").alias("_low_tie"), *sums)
    run = ordered_scan(flat, keys, ["_low_code", "_low_tie"], sums={f"{x}_before": F.col(x) for x in sums}, seq="_cell_no").drop("_low_code", "_low_tie", "_cell_no")
    return run.join(whole, keys)
