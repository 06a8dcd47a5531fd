"""Tables written between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir (in local mode without it, a temporary one)."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="acceptlake-")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet and read again: what comes behind doesn't run it again, whatever executors are lost."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._acceptlake_path = path
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def unstage(*frames: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in frames:
        delete(df.sparkSession, df._acceptlake_path)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Give a finished folder its name; one that is there already is an error."""
    (source, fs), (target, _) = _path(spark, made), _path(spark, path)
    if fs.exists(target):
        raise FileExistsError(f"{path} is there already")
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    if not fs.rename(source, target):
        raise OSError(f"{made} can't be renamed to {path}")
