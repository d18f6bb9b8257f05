"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only in local mode, where all share the machine, a new local folder stands in for it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lodestone.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("lodestone.shared.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, which cuts its lineage: a lost executor
    costs the tasks that ran on it, not the stages before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def shuffled(df: DataFrame) -> DataFrame:
    """For a side of a join that grows with the input: it is never broadcast. Spark takes the bytes of the files for a written table's size, but
    they are compressed; its hash table, which the driver makes, has been twenty times as large."""
    return df.hint("merge")


def remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def drop(df: DataFrame) -> None:
    """Removes a table as ``written`` gave it; no later result may read it."""
    remove(df.sparkSession, df._written_to)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside the block are removed at its end, but those that were put into the list it gives."""
    before, keep = len(_made), []
    try:
        yield keep
    finally:
        kept = [df._written_to for df in keep]
        for path in set(_made[before:]).difference(kept):
            remove(spark, path)
        _made[before:] = kept


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    fs, own = _path(spark, path)
    return fs.exists(own)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Gives a written folder its name; if the name is taken, the folder is removed."""
    fs, own = _path(spark, path)
    there = spark._jvm.org.apache.hadoop.fs.Path(to)
    if fs.exists(there) or not fs.rename(own, there):
        fs.delete(own, True)


def stamp(spark: SparkSession, path: str) -> str:
    """What changes when a table's files do: their number, bytes and the time of the last change to the folder or file."""
    fs, own = _path(spark, path)
    size = fs.getContentSummary(own)
    return f"{size.getFileCount()}-{size.getLength()}-{fs.getFileStatus(own).getModificationTime()}"
