"""Exact deduplication with a heavy-hitter split.

The digests of all texts (A-Z lower-cased, null as empty) are counted with the Misra-Gries summary behind
``DataFrame.stat.freqItems``: at most 1/support candidates, among them every digest of more than that share of the rows.
Their exact counts and largest ids are then taken, and those that do pass the share (the verified winners, a table whose size the support bounds) are
broadcast, so that rows of large groups get their answer on the map side and are never shuffled. All other digests go
through an ordinary aggregation and join on the digest.

Cases: a null text counts as the empty text. A null doc_id is smaller than any other; where a whole group has null ids,
keep_id is null. Of rows with one doc_id and equal text, or of a group of null ids, the row read last is kept, so one row of each group
stays in every case. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups of more than this share of all rows are heavy; its inverse bounds the broadcast table.
SUPPORT = 0.001


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the hex digest of the normalised text, and a row number, which holds once the table is written."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))


def heavy_groups(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Verified winners of the Misra-Gries summary: digest, keep_id, group_size; 1/support rows at most."""
    found = rows.stat.freqItems(["text_sha256"], support)
    candidates = found.select(F.explode("text_sha256_freqItems").alias("text_sha256")).distinct()
    return _groups(rows.join(F.broadcast(candidates), "text_sha256")).where(F.col("group_size") > support * rows.count())


def _groups(rows: DataFrame) -> DataFrame:
    last = F.max(F.struct("doc_id", "row"))  # a null doc_id is less than any other
    return rows.groupBy("text_sha256").agg(last["doc_id"].alias("keep_id"), last["row"].alias("keep_row"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(digests(docs), "digests")
    heavy = heavy_groups(rows, support)
    marked = rows.join(F.broadcast(heavy), "text_sha256", "left")
    done = marked.where(F.col("group_size").isNotNull())
    rest = rows.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    rest = rest.join(_groups(rest), "text_sha256")
    kept = F.col("row") == F.col("keep_row")
    return done.unionByName(rest).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
