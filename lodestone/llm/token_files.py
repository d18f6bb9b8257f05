"""Token ids in Parquet files: list columns with dictionary or delta encoding, chosen row groups and page indexes.

Documents are dealt to files by ranges of doc_id and sorted within each, so the files in the order of their names hold all
documents in ascending doc_id order. Each row has doc_id, n_tokens and the list of ids. Row groups and pages are small
and Parquet writes column and offset indexes for them, so a reader that filters on doc_id, or wants n_tokens alone,
touches those pages and columns only.

Cases: a null text has no ids but the end id. Null doc_ids come first. Rows with equal doc_id stay separate rows, in one
file, in any order among themselves. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.store import new_path
from lodestone.llm.tokens import encoder

FILE_SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def _encode_batches(path: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for batch in batches:
            for begin, end, ids, at in enc.encode(batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), pa.array(np.diff(at)), lists], ["doc_id", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, encoding: str = "dictionary", row_group_mb: int = 16, page_kb: int = 256, page_rows: int = 1000) -> None:
    """Encodes every whole text and writes the files. encoding: dictionary, or delta (binary packed)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_mb << 20,
        "parquet.page.size": page_kb << 10,
        "parquet.page.row.count.limit": page_rows,
        "parquet.dictionary.page.size": 1 << 20,
    }
    rows.mapInArrow(_encode_batches(tokenizer, end_id), FILE_SCHEMA).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows with the name of their file and their place in it."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def read_tokens_of(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id and ids of the documents from first to last: row groups and pages of other ranges are not read."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).where(F.col("doc_id").between(first, last)).select("doc_id", "ids")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        at = lists.offsets.to_numpy()
        crc = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("row"), batch.column("doc_id"), pa.array(np.diff(at).astype(np.int64)), crc], ["file", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The start is the sum of the files before (one row per file, from the n_tokens column alone) and of the rows before it
    in its own file."""
    rows = read_token_files(spark, path)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = files.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    read = rows.mapInArrow(_digest_batches, "file string, row long, doc_id long, n_tokens long, ids_crc32 long")
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return read.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_index_of(docs: DataFrame, tokenizer: str, end_id: int | None = 0, encoding: str = "dictionary") -> DataFrame:
    """Writes the files into the shared folder and returns the index read back from them."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id, encoding)
    return token_index(docs.sparkSession, path)
