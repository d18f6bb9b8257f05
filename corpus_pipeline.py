"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir), works on every row of docs and returns what it keeps. The
rows are written as Parquet between stages and read again, so a lost executor costs no more than its tasks. All stages
but the last return the columns of documents (``COLUMNS``; other columns are left out). Rows that share a doc_id, or have none, are documents each in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, jaccard_join, langid, packing
from lodestone.llm.row_ids import one_id_a_row, with_own_ids, without_ids
from lodestone.llm.store import drop, temporary, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which no language can be recognised: without text or letters, or with a score below the
    calibrated threshold. Where nothing could be learned, all with a letter stay."""
    docs = docs.select(*COLUMNS)
    model = langid.train_on(docs)
    return langid.recognised(docs, model, langid.least_score(docs, model))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the largest doc_id of each group of equal texts; the last row read where ids are equal or null."""
    docs = one_id_a_row(docs.select(*COLUMNS))
    return with_own_ids(without_ids(docs, exact_dedup.exact_groups(docs).where("not kept").select("doc_id")), COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group linked by a Jaccard similarity of 0.8 or more between sets
    of five-word shingles; the first row read where ids are equal or null."""
    docs = one_id_a_row(docs.select(*COLUMNS))
    groups = jaccard_join.jaccard_groups(docs, k=5, percent=80)
    return with_own_ids(without_ids(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id")), COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a test item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, benchmark, k=5, percent=80).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences of 2048: the pieces with their ids, their sequence and their place in it."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, with_ids=True)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, similarity groups and token ids are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:  # what a stage writes for itself goes when its rows are written
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
