"""Session helpers: the shared folder, cut lineage, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()
_scratch: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a run in one process gets a temporary folder; on a
    cluster it is an error, as executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="scholion-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; Spark's file system deletes it when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark).rstrip('/')}/scholion/{context.applicationId}"
    if folder not in _scratch.get(context, ()):
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _scratch.setdefault(context, set()).add(folder)
    return folder


def scratch_file(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared folder."""
    spark = df.sparkSession
    path = scratch_file(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a `checkpointed` frame that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str | list[str], buckets: int, placed: bool = False, apart: str | None = None) -> DataFrame:
    """The rows of df, written once in buckets of `key`: joins on that key then move the other side only.

    `placed` says that df is dealt out by them already. Values of `apart` have
    files of their own. `drop_bucketed` takes table and files away again.
    """
    spark = df.sparkSession
    keys = [key] if isinstance(key, str) else key
    name = f"scholion_{uuid.uuid4().hex}"
    path = f"{scratch_folder(spark)}/{name}"
    writer = (df if placed else df.repartition(buckets, *keys)).write
    (writer.partitionBy(apart) if apart else writer).bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._table, out._scratch = name, path
    return out


def drop_bucketed(df: DataFrame) -> None:
    """Drop the table of a `bucketed` frame that nothing reads any more, and its files."""
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    discard(df)


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' path, once a session's context."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="scholion-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "scholion.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context)
