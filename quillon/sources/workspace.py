"""Written tables in the cluster's shared folder: how iterative operators cut lineage so that a lost executor costs nothing that was done."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. In local mode, as in tests, a temporary one is set where none is named; on a cluster that raises, as executors would each write to a disk of their own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-")
        sc.setCheckpointDir(base)
        atexit.register(shutil.rmtree, base[7:], True)
    return base.rstrip("/")


def fs_uri(path: str) -> str:
    """A path of the shared folder as a URI that pyarrow's file systems take."""
    if "://" in path:
        return path
    return "file://" + os.path.abspath(path.removeprefix("file:"))


def remove(path: str) -> None:
    """Removes a folder of the shared one, if it is there."""
    fs, root = pyarrow.fs.FileSystem.from_uri(fs_uri(path))
    if fs.get_file_info(root).type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(root)


def _leave(path: str, pid: int) -> None:
    if os.getpid() == pid:  # not in a process that was forked
        try:
            remove(path)
        except OSError:  # the shared folder itself is gone
            pass


def table_path(spark: SparkSession, name: str) -> str:
    """A new path among this application's tables, all of which are removed when the driver ends."""
    base = f"{shared_dir(spark)}/quillon-tables-{spark.sparkContext.applicationId}"
    known = spark.sparkContext.__dict__.setdefault("_quillon_tables", set())
    if base not in known:
        known.add(base)
        atexit.register(_leave, base, os.getpid())
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_leave(spark: SparkSession):
    """What is written inside leaves no shuffle files behind; else they stay until the driver's JVM happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it again; drop_table() removes it before the driver ends. Nothing reads the shuffles behind it once it is written, so they go."""
    path = table_path(df.sparkSession, name)
    with shuffles_leave(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_table(table: DataFrame | None) -> None:
    """Removes what write_table() wrote; for tables of a round that the next round's table has taken in."""
    if table is not None and getattr(table, "written_to", None):
        remove(table.written_to)
