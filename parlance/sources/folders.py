"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder is made and set, but only if driver and executors are one
    process (tests); on a cluster the setting is asked for."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_made: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_made() -> None:
    for path, spark in _made.items():
        try:
            delete(spark, path)
        except Exception:  # the session has ended already
            return


def new(spark: SparkSession, name: str) -> str:
    """A path of its own for each call, in the shared folder; what is still there when the driver ends is deleted."""
    if not _made:
        atexit.register(_delete_made)
    path = f"{shared(spark)}/parlance/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def keep(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what several plans read is made once, and a lost executor costs no
    more than a read."""
    path = new(df.sparkSession, "kept")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def path_of(kept: DataFrame) -> str:
    """Where `keep` wrote a table."""
    return kept.kept_at


def move(spark: SparkSession, source: str, target: str, force: bool) -> None:
    """Make a finished folder appear under its name in one step; what is there already is an error unless forced. What is
    replaced is first renamed: it comes back if the new one cannot take its place, and goes only once that has."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = None
    if fs.exists(path(target)):
        if not force:
            fs.delete(path(source), True)
            raise FileExistsError(target)
        aside = f"{target}.replaced-{uuid.uuid4().hex}"
        if not fs.rename(path(target), path(aside)):
            raise OSError(f"could not rename {target} to {aside}")
    if not fs.exists(path(source)) or not fs.rename(path(source), path(target)):
        if aside:
            fs.rename(path(aside), path(target))
        raise OSError(f"could not rename {source} to {target}")
    if aside:
        fs.delete(path(aside), True)
