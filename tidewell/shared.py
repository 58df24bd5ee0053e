"""Table access and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per context, so that tasks can import it where it isn't installed."""
    context = spark.sparkContext
    if not getattr(context, "_tidewell_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="tidewell-"), "tidewell")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        context._tidewell_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this machine takes its
    place, but only if all tasks run in this one process (tests, a laptop); on a cluster it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (they are counted); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def kept(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as parquet below the shared folder and read again.

    Cheaper than a checkpoint where only a few columns are read later, because the copy is
    columnar and compressed; it too survives the loss of executors. ``dropped`` deletes it.
    """
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes kept tables that no later step and no result reads."""
    for df in tables:
        if df is not None and hasattr(df, "kept_at"):
            remove(df.sparkSession, df.kept_at)


def _file(spark: SparkSession, path: str):
    """The Hadoop path and its file system: the shared folder need not be a local one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, files = _file(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it is not there."""
    at, files = _file(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder to a place where none is; False if there is one."""
    source, files = _file(spark, path)
    target, _ = _file(spark, to)
    if files.exists(target):
        return False
    files.mkdirs(target.getParent())
    return files.rename(source, target)


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all; raises if it is there already."""
    draft, files = _file(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    target, _ = _file(spark, path)
    if files.exists(target) or not files.rename(draft, target):
        files.delete(draft, False)
        raise FileExistsError(path)


def read_small(spark: SparkSession, path: str) -> str:
    at, files = _file(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def buckets(spark: SparkSession) -> int:
    """How many hash buckets a hand-made exchange should use: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
