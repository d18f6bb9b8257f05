"""Structured Streaming forms of monitoring, leases and missing confirmation. Each takes a streaming DataFrame of events
(event_id, ts, user_id, event_type, value) and returns one; ``run_available`` drives it over what is there."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import store


class ScanStopped(RuntimeError):
    """A scan was cancelled; its checkpoint stays."""


def read_events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # a streaming source wants a folder; a single file is named by its pattern
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    single = not any(f.startswith(path.rstrip("/") + "/") or f"/{name}/" in f for f in spark.read.parquet(path).inputFiles()[:1])
    rows = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant


def hourly_metrics(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count, sum and greatest value by hour and type; an hour is final once the watermark passes it."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most")).select(F.col("w.start").alias("hour"), "event_type", "n", "total", "most")


def lease_sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events without a gap longer than the lease."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return out.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), "n")


def first_of_key(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Idempotent enqueue: one event for each key that arrives within the watermark."""
    return events.withColumn("key", F.concat_ws(":", "event_type", F.col("user_id").cast("string"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"]).select("key", "event_id", "ts")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a query over all that is available into a memory table; for tests and small results."""
    name = f"stream_{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_through(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a query over all that is available, each batch of the sink being written by the executors as a table of its own in the shared
    folder; the last one is the result."""
    spark, root = stream.sparkSession, store.new_path(stream.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number:09d}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", store.new_path(spark, "stream-state")).foreachBatch(put).trigger(availableNow=True)
    query = writer.start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{root}/batch={last['batchId']:09d}") if last else spark.createDataFrame([], stream.schema)


def scan_folder(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files_per_batch: int = 3, stop_before: int | None = None) -> bool:
    """Reads a folder a few files at a time. The checkpoint holds what was visited, so a scan that was lost or stopped goes on
    where it was; a batch that runs again replaces its own rows. True once all files are in; stop_before cancels at that batch."""

    def put(batch: DataFrame, number: int) -> None:
        if number == stop_before:
            raise ScanStopped(f"cancelled before batch {number}")
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as stopped:
        if "cancelled before batch" in str(stopped):
            return False
        raise
    return True


def run_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a query over all that is available into Parquet; a checkpoint makes the next run go on from there."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_appended(stream: DataFrame) -> DataFrame:
    """Runs an append query over all that is available into files in the shared folder, and reads them."""
    spark, root = stream.sparkSession, store.new_path(stream.sparkSession, "appended")
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
