"""One id a row for tables whose doc_id is null or repeated in several rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import shuffled, written
from lodestone.operators.ranks import global_rank

#: The doc_id as it was given.
OWN_ID = "own_doc_id"


def one_id_a_row(docs: DataFrame) -> DataFrame:
    """docs with the doc_id as given in OWN_ID, and in doc_id a number that no two rows share and that has the order of the ids
    (null first; rows of one id in the order they are read): the id itself where no two rows share one and none is null, else a written rank."""
    docs = docs.withColumns({OWN_ID: F.col("doc_id"), "doc_id": F.col("doc_id").cast("long")})
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs
    rows = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    ranks = written(global_rank(rows.select("doc_id", "row"), F.asc_nulls_first("doc_id"), F.col("row")).select("row", "rank"), "row-ids")
    return written(rows.join(ranks, "row").withColumn("doc_id", F.col("rank").cast("long")).drop("row", "rank"), "numbered")


#: Ids that are broadcast at most.
MAX_BROADCAST = 250_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (of one_id_a_row, so none is null) whose doc_id is not in the one column of ids. Few enough ids are broadcast, so that
    the texts stay where they are; more are joined by a shuffle."""
    ids = written(ids.toDF("dropped_id").distinct(), "dropped")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST else shuffled(ids)
    return docs.join(ids, docs["doc_id"] == ids["dropped_id"], "left_anti")  # null-safe, the hash table would be three times as large


def with_own_ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table of one_id_a_row, doc_id as it was given."""
    return rows.select(*[F.col(OWN_ID).alias(c) if c == "doc_id" else c for c in columns])
