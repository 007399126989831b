"""Keys that hold most records: detection, joins and aggregates without imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.plans.shared import BROADCAST_ROWS, cut, row_count_within

#: Largest number of keys treated as heavy; also the number of counters of the sketch.
MOST_HEAVY = 64
#: A key is heavy from this share of all rows on.
HEAVY_SHARE = 0.01


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE, most: int = MOST_HEAVY) -> list:
    """Values of ``key`` that hold about ``share`` of the rows or more, found by a
    mergeable frequent-items sketch in one pass; at most ``most`` values reach the
    driver. The answer steers only where rows go, never what comes out, so an
    approximate one is enough. Nulls are never heavy; an empty table has none.
    """
    k = min(most, int(1 / share))
    got = (
        df.filter(F.col(key).isNotNull())
        .agg(F.expr(f"approx_top_k(`{key}`, {k}, {max(10 * k, 1000)})").alias("top"), F.count("*").alias("n"))
        .first()
    )
    return [x["item"] for x in got["top"] or [] if x["count"] >= share * got["n"]] if got["n"] else []


def skew_join(
    fact: DataFrame, dim: DataFrame, key: str, how: str = "inner", share: float = HEAVY_SHARE, most: int = MOST_HEAVY
) -> DataFrame:
    """Join ``fact`` with ``dim`` on ``key`` where a few keys hold most of ``fact``.

    Heavy keys are found by sketch; their rows of ``dim`` are broadcast (after a
    check of their number), so that the rows of ``fact`` stay where they are. All
    other keys take an ordinary shuffle join, and both parts are united. If even
    the heavy part of ``dim`` is large, heavy rows are salted instead.

    Null keys match nothing. ``how`` is ``inner`` or ``left``; other column names
    must not clash (rename first). Rows may repeat on either side.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"skew_join supports inner and left, not {how}")
    heavy = heavy_keys(fact, key, share, most)
    if not heavy:
        return fact.join(dim, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    some = dim.filter(is_heavy)
    if row_count_within(some, BROADCAST_ROWS):
        hot = fact.filter(is_heavy).join(F.broadcast(some), key, how)
    else:
        salts = max(2, int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        salted = fact.filter(is_heavy).withColumn("_salt", F.pmod(F.xxhash64(*fact.columns), F.lit(salts)))
        spread = some.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
        hot = salted.join(spread, [key, "_salt"], how).drop("_salt")
    rest = fact.filter(~is_heavy).join(dim.filter(~is_heavy), key, how)
    return hot.unionByName(rest)


def host_name_key(name: Column) -> Column:
    """A host name without surrounding space, port, final dot and letter case."""
    bare = F.lower(F.regexp_replace(name, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.regexp_replace(F.regexp_replace(bare, r":\d+$", ""), r"\.$", "")


def distinct_blocks(block_locations: DataFrame) -> DataFrame:
    """One row per (file_id, block_no): repeated rows of a block are one block.
    Of contradicting repeats the largest ``length`` and the longest ``hosts`` hold."""
    return block_locations.groupBy("file_id", "block_no").agg(
        F.max("length").alias("length"),
        F.max(F.struct(F.coalesce(F.size("hosts"), F.lit(-1)).alias("n"), F.col("hosts"))).alias("h"),
    ).select("file_id", "block_no", "length", F.col("h.hosts").alias("hosts"))


def file_sizes(file_status: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file_id, size): the recorded length, or the sum over the file's distinct
    blocks where none is recorded. Only blocks of such files are summed."""
    known = file_status.filter("file_id is not null").groupBy("file_id").agg(F.max("length").alias("length"))
    missing = known.filter("length is null").select("file_id")
    summed = blocks.select("file_id", "length").join(missing, "file_id", "left_semi").groupBy("file_id").agg(F.sum("length").alias("blocks_length"))
    return known.join(summed, "file_id", "left").select("file_id", F.coalesce("length", "blocks_length").alias("size"))


def host_load(block_locations: DataFrame, file_status: DataFrame, cluster_hosts: DataFrame) -> DataFrame:
    """Placements and bytes of each host: (host_id, placements, bytes).

    A placement is an entry of ``hosts`` of a distinct block whose name is a host's
    name, its first label, its ip or its alias. Entries of a file are counted per
    name before any shuffle by name; names that hold most entries join by
    broadcast, the others by shuffle (``skew_join``). Bytes come from the distinct
    (host, file) pairs, which are spread by file; the last sum per host combines
    on the map side, so no task's work grows with the busiest host.

    Null or empty ``hosts``, null names and names of no host add nothing; a host
    without placements is not listed; a file without a known size adds 0 bytes.
    """
    blocks = distinct_blocks(block_locations.filter("file_id is not null and block_no is not null"))
    # read for the sketch and for both parts of the join
    entries = cut(
        blocks.select("file_id", F.explode("hosts").alias("name"))
        .select("file_id", host_name_key(F.col("name")).alias("name"))
        .groupBy("file_id", "name")
        .agg(F.count("*").alias("n")),
        "placements",
    )
    names = F.array(F.col("host_name"), F.substring_index("host_name", ".", 1), F.col("ip"), F.col("alias"))
    hosts = (
        cluster_hosts.filter("host_id is not null")
        .select("host_id", F.explode(names).alias("name"))
        .select("host_id", host_name_key(F.col("name")).alias("name"))
        .filter("name is not null and name != ''")
        .distinct()
    )
    placed = skew_join(entries, hosts, "name").groupBy("file_id", "host_id").agg(F.sum("n").alias("n"))
    sized = placed.join(file_sizes(file_status, blocks), "file_id", "left")
    return sized.groupBy("host_id").agg(
        F.sum("n").alias("placements"), F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("bytes")
    )


def busiest(load: DataFrame, share: float = 0.02) -> DataFrame:
    """Hosts of ``host_load`` with at least ``share`` of all placements or bytes."""
    total = load.agg(F.sum("placements"), F.sum("bytes")).first()
    if total[0] is None:
        return load.limit(0)
    return load.filter((F.col("placements") >= share * float(total[0])) | (F.col("bytes") >= share * float(total[1])))
