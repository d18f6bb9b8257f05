"""Versioned Parquet snapshots: a new folder per version, and a manifest row that says which one is active."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, path string, n_rows long, checksum string, created double"


class SnapshotError(RuntimeError):
    """code is artifact_missing or artifact_invalid."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(MANIFEST).json(f"{root}/manifest")


def checksum(rows: DataFrame) -> DataFrame:
    """Order-free and of one size: the number of rows and two sums over row hashes."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]), {"ignoreNullFields": "false"})
    low = F.pmod(F.xxhash64(row), F.lit(1 << 31))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws(":", F.lit(",".join(rows.columns)), F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(low), F.lit(0)).cast("string"), F.coalesce(F.bit_xor(F.xxhash64(row)), F.lit(0)).cast("string")).cast("binary"), 256).alias("checksum"))


def publish(rows: DataFrame, root: str) -> int:
    """Writes all columns as text and then appends the manifest row that makes the version active. A write that fails leaves no
    row, so the version before stays active."""
    spark = rows.sparkSession
    known = _manifest(spark, root)
    version = (known.agg(F.max("version")).first()[0] if known is not None else 0) + 1
    path = f"{root}/v={version}-{uuid.uuid4().hex}"
    rows.select(*[F.col(f"`{c}`") if c == "row_number" else F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns]).write.option("compression", "zstd").parquet(path)
    n, digest = checksum(spark.read.parquet(path)).first()
    spark.createDataFrame([(version, path, n, digest, time.time())], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


def refresh(rows: DataFrame, root: str) -> str:
    """Imports a table anew: published, or kept where it came back empty, for then the version before stays active."""
    if rows.isEmpty():
        return "kept"
    publish(rows, root)
    return "published"


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and state (added, removed, changed, unchanged) of the rows of two versions; rows are compared by all their columns."""
    row = lambda df: df.select(F.col(key), F.xxhash64(*[F.coalesce(F.col(f"`{c}`"), F.lit("\0")) for c in sorted(df.columns)]).alias("row"))
    j = row(before).withColumnRenamed("row", "was").join(row(after).withColumnRenamed("row", "is"), key, "full")
    return j.select(key, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") == F.col("is"), "unchanged").otherwise("changed").alias("state"))


def active(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the latest version; its path must lie below the root."""
    known = _manifest(spark, root)
    if known is None:
        raise SnapshotError("artifact_missing")
    path = known.orderBy(F.desc("version")).first()["path"]
    if not path.startswith(f"{root}/v=") or ".." in path:
        raise SnapshotError("artifact_invalid")
    return spark.read.parquet(path)
