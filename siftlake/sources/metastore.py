"""Where indexes are kept: a folder per table, marked complete by ``_SUCCESS``."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Option that names the metastore folder.
METASTORE_LOCATION = "spark.sql.index.metastore"
#: Loaded indexes that are kept, and for how many seconds.
CACHED, CACHED_SECONDS = 16, 12 * 3600
SUCCESS = "_SUCCESS"


@dataclass(frozen=True)
class IndexLocation:
    """Which index: of a path (``source``) or of a catalog table (``catalog``)."""

    path: str
    dataspace: str = "source"
    identifier: str = "parquet"

    def __post_init__(self):
        for what, value in (("identifier", self.identifier), ("dataspace", self.dataspace)):
            if not value:
                raise ValueError(f"Empty {what}")
            if not re.fullmatch("[0-9a-z]+", value):
                raise ValueError(f"Invalid character in {what} {value}, expected lower-case letters and digits")


class Files:
    """The few file-system calls an index needs, through Hadoop, so that any of its file systems will do."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def fs(self, at: str):
        return self.path(at).getFileSystem(self._conf)

    def qualified(self, at: str) -> str:
        return self.fs(at).makeQualified(self.path(at)).toString()

    def exists(self, at: str) -> bool:
        return self.fs(at).exists(self.path(at))

    def is_dir(self, at: str) -> bool:
        return self.exists(at) and self.fs(at).getFileStatus(self.path(at)).isDirectory()

    def modified(self, at: str) -> int:
        return self.fs(at).getFileStatus(self.path(at)).getModificationTime()

    def delete(self, at: str) -> None:
        self.fs(at).delete(self.path(at), True)

    def rename(self, a: str, b: str) -> None:
        self.fs(b).mkdirs(self.path(b).getParent())
        if not self.fs(a).rename(self.path(a), self.path(b)):
            raise OSError(f"Failed to move {a} to {b}")

    def write(self, at: str, text: str) -> None:
        out = self.fs(at).create(self.path(at), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, at: str) -> str:
        stream = self.fs(at).open(self.path(at))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Metastore:
    """Creates, finds, loads and deletes indexes below one root folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.files = spark, Files(spark)
        self._cache: OrderedDict[str, tuple[float, int, object]] = OrderedDict()

    @property
    def root(self) -> str:
        """The root, resolved anew at each use; made if missing. It must be a folder
        that its owner can write and everyone can read."""
        named = self.spark.conf.get(METASTORE_LOCATION, "") or ""
        if not named and not self.spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {METASTORE_LOCATION} to a folder that all executors share")
        at = self.files.qualified(named or "file://" + os.path.join(os.getcwd(), "index_metastore"))
        fs, path = self.files.fs(at), self.files.path(at)
        permission = self.files._jvm.org.apache.hadoop.fs.permission
        if not fs.exists(path):
            fs.mkdirs(path, permission.FsPermission("744"))
        status = fs.getFileStatus(path)
        if not status.isDirectory():
            raise ValueError(f"Expected directory for metastore, found {at}")
        have, action = status.getPermission(), permission.FsAction
        if not (have.getUserAction().implies(action.ALL) and have.getGroupAction().implies(action.READ) and have.getOtherAction().implies(action.READ)):
            raise PermissionError(f"Expected directory with rwxr--r--, found {at} with {have.toString()}")
        return at.rstrip("/")

    def location(self, spec: IndexLocation) -> str:
        """Folder of an index. The authority of a table's path is part of it, so that equal paths of two clusters stay apart."""
        uri = self.files.path(self.files.qualified(spec.path)).toUri()
        scheme, authority = uri.getScheme() or "file", uri.getAuthority()
        place = f"/{re.sub('[^A-Za-z0-9.@_-]', '_', authority)}" if authority else ""
        return f"{self.root}/{spec.dataspace}/{spec.identifier}/{scheme}{place}{uri.getPath().rstrip('/')}/.index"

    def exists(self, spec: IndexLocation) -> bool:
        at = self.location(spec)
        return self.files.is_dir(at) and self.files.exists(f"{at}/{SUCCESS}")

    def create(self, spec: IndexLocation, mode: str, build: Callable[[str], None]) -> None:
        """Run ``build`` into a folder aside and move it into place when it is complete.
        ``mode`` is error, ignore, overwrite or append; half-written indexes count as none."""
        at = self.location(spec)
        found = self.exists(spec)
        if found and mode == "error":
            raise OSError(f"Index already exists at {at}; use mode overwrite to replace it")
        if found and mode == "ignore":
            return
        if found and mode == "append":
            raise NotImplementedError(f"Index for {spec.path} does not support append to existing index")
        aside = f"{self.root}/_building/{uuid.uuid4().hex}"
        try:
            build(aside)
            self.files.write(f"{aside}/{SUCCESS}", "")
            self._cache.pop(at, None)
            # the old index goes aside, so that it is back where moving the new one fails
            old = f"{self.root}/_building/{uuid.uuid4().hex}"
            if self.files.exists(at):
                self.files.rename(at, old)
            try:
                self.files.rename(aside, at)
            except BaseException:
                if self.files.exists(old) and not self.files.exists(at):
                    self.files.rename(old, at)
                raise
            if self.files.exists(old):
                self.files.delete(old)
        finally:
            if self.files.exists(aside):
                self.files.delete(aside)

    def load(self, spec: IndexLocation, read: Callable[[str], object]) -> object:
        at = self.location(spec)
        if not self.files.is_dir(at):
            self._cache.pop(at, None)
            raise FileNotFoundError(f"Index does not exist for {spec.path}")
        if not self.files.exists(f"{at}/{SUCCESS}"):
            raise OSError(f"Possibly corrupt index at {at}, {SUCCESS} is missing")
        mark, now = self.files.modified(f"{at}/{SUCCESS}"), time.time()
        kept = self._cache.get(at)
        if kept and kept[1] == mark and now - kept[0] < CACHED_SECONDS:
            self._cache.move_to_end(at)
            return kept[2]
        loaded = read(at)
        self._cache[at] = (now, mark, loaded)
        self._cache.move_to_end(at)
        while len(self._cache) > CACHED:
            self._cache.popitem(last=False)
        return loaded

    def delete(self, spec: IndexLocation) -> None:
        at = self.location(spec)
        self._cache.pop(at, None)
        if self.files.exists(at):
            self.files.delete(at)


def dump_json(value) -> str:
    return json.dumps(value, indent=1, sort_keys=True)
