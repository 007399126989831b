"""Places and joins that hold at cluster size.

``shared_dir`` is the folder all executors can reach, ``cut`` writes a lineage
cut there, ``sized_join`` broadcasts only a side whose row count was checked.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast up to this many rows, and bytes by the plan's or the rows' size; beyond either both sides shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20

_LOCAL_DIRS: dict[str, str] = {}
#: Folders made so far: (file system, path) in the JVM.
_MADE: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests on
    one machine), a temporary folder of this process, removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="siftlake-")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[app], ignore_errors=True)
    return "file://" + _LOCAL_DIRS[app]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder. The folder is removed when this process ends, or by ``drop_made``."""
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not _MADE:
        atexit.register(drop_made, 0)
    _MADE.append((path.getFileSystem(spark._jsc.hadoopConfiguration()), path))
    return at


def made() -> int:
    """How many folders there are; a place for ``drop_made`` to go back to."""
    return len(_MADE)


def drop_made(since: int) -> None:
    """Remove the folders made since ``made()`` gave ``since``: whatever reads from them must be done by then.
    A long session calls it when a query's result has been taken; at the end of the process all go."""
    while len(_MADE) > since:
        fs, path = _MADE.pop()
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001, S110 - the JVM may be gone already
            pass


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage ends
    there, the rows are computed once, and a lost executor costs nothing."""
    spark = df.sparkSession
    at = fresh_dir(spark, label)
    df.write.mode("error").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def row_count_within(df: DataFrame, limit: int, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows, of about ``size`` bytes together at most; reads no more than needed to tell."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if t in ("string", "binary") else F.lit(16)).cast("long") for c, t in df.dtypes if "<" not in t)
    nested = [c for c, t in df.dtypes if "<" in t]
    width = width + sum(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)).cast("long") for c in nested)
    got = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return got[0] <= limit and got[1] <= size


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` when it has at most ``limit`` rows and ``BROADCAST_BYTES``
    bytes, else lets both sides shuffle (with adaptive skew handling)."""
    if row_count_within(right, limit):
        right = F.broadcast(right)
    return left.join(right, on, how)
