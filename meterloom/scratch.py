"""Folders for intermediate tables, and leases that remove them.

Every process keeps its folders under one owner folder in the shared one, with a mark whose time it
renews. A lease (``with lease(spark):``) removes all folders made inside it when it ends, as a
micro-batch's do once its sinks have committed; what no lease holds is removed when the process ends.
Owner folders whose mark has not been renewed for a while are those of drivers that died, and
``sweep_orphans`` removes them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: This process's owner folder is named so; its mark is renewed when a lease starts.
OWNER = f"owner-{uuid.uuid4().hex}"
MARK = "_alive"
#: Owner folders of others whose mark is older than this are taken for those of dead drivers.
STALE_AFTER_S = 24 * 3600
_leases = threading.local()


def shared_base(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Where that is unset a local session gets a temporary folder; a cluster has no folder that all
    its machines share by default, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all machines share")
        base = _local_base()
    return base.rstrip("/")


_local: list[str] = []


def _local_base() -> str:
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="meterloom-"))
    return _local[0]


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder in this process's owner folder under the shared one; a lease that is open takes it."""
    owner = f"{shared_base(spark)}/{OWNER}"
    if not _exists(spark, f"{owner}/{MARK}"):
        _touch(spark, f"{owner}/{MARK}")
    folder = f"{owner}/{purpose}-{uuid.uuid4().hex}"
    held = getattr(_leases, "open", None)
    if held:
        held[-1].append(folder)
    return folder


@contextlib.contextmanager
def lease(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made inside the block, in this thread, are removed when it ends, whether it fails or not.

    The owner's mark is renewed at the start, so a long-running stream is not taken for a dead one.
    """
    _touch(spark, f"{shared_base(spark)}/{OWNER}/{MARK}")
    stack = _leases.__dict__.setdefault("open", [])
    folders: list[str] = []
    stack.append(folders)
    try:
        yield folders
    finally:
        stack.pop()
        for folder in folders:
            _remove(spark, folder)


def sweep_orphans(spark: SparkSession, stale_after_s: float = STALE_AFTER_S) -> list[str]:
    """Removes the owner folders of other processes whose mark is older than ``stale_after_s``; returns them."""
    base = shared_base(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    gone, now_ms = [], time.time() * 1000
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if not status.isDirectory() or not name.startswith("owner-") or name == OWNER:
            continue
        mark = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), MARK)
        seen_ms = fs.getFileStatus(mark).getModificationTime() if fs.exists(mark) else status.getModificationTime()
        if now_ms - seen_ms > stale_after_s * 1000:
            fs.delete(status.getPath(), True)
            gone.append(status.getPath().toString())
    return gone


class Scratch:
    """Tables of one run of an operator in the shared folder.

    ``keep`` computes a table once, safe against lost executors; ``drop`` removes it. What the operator's
    result still reads is removed when the lease it was made in ends, else when the process ends.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose = spark, purpose
        self.folders: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        folder = scratch_folder(self.spark, self.purpose)
        df.write.parquet(folder)
        self.folders.append(folder)
        _remove_owner_at_exit(self.spark)
        table = self.spark.read.schema(df.schema).parquet(folder)
        table._scratch_folder = folder
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that no result still to be computed reads."""
        for table in tables:
            _remove(self.spark, table._scratch_folder)

    def drop_all(self, *but: DataFrame) -> None:
        """Removes all tables of the run, but those given."""
        read = {table._scratch_folder for table in but}
        for folder in self.folders:
            if folder not in read:
                _remove(self.spark, folder)


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended before
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_registered: list[bool] = []


def _remove_owner_at_exit(spark: SparkSession) -> None:
    """Once a process: its owner folder goes when it ends, with what no lease removed before."""
    if not _registered:
        _registered.append(True)
        atexit.register(_remove, spark, f"{shared_base(spark)}/{OWNER}")


def _exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _touch(spark: SparkSession, file: str) -> None:
    """Writes the file anew, so that its time is now."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True).close()


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in a scratch folder, computed once."""
    return Scratch(df.sparkSession, purpose).keep(df)
