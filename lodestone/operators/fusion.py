"""Vector search, rank fusion and evidence budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vector import cosine_to

RRF = 60


def vector_topk(vectors: DataFrame, query: list[float], k: int = 80, otherwise: float = -1.0) -> DataFrame:
    """Exact cosine search; the query is a literal, so there is no join, and the order needs k rows per task only."""
    scored = vectors.select("chunk_id", cosine_to(F.col("embedding"), query, otherwise).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "chunk_id").limit(k)


def vector_only(ranked: DataFrame, lexical: bool, share: float = 0.80, below: float = 0.12) -> DataFrame:
    """Of a vector ranking (a top-k page), the rows near its best, where a lexical ranking has hits as well."""
    if not lexical:
        return ranked
    best = ranked.agg(F.max("similarity").alias("best"))
    floor = F.greatest(F.col("best") * share, F.col("best") - below)
    return ranked.join(F.broadcast(best), F.col("similarity") >= floor).drop("best")


def rrf(rankings: dict[str, DataFrame], key: str = "document_id") -> DataFrame:
    """Reciprocal-rank fusion of rankings (key, rank from 1): the first place of a key in each ranking counts."""
    parts = [r.groupBy(key).agg(F.min("rank").alias("rank")).withColumn("channel", F.lit(name)) for name, r in rankings.items()]
    all_ = reduce(lambda a, b: a.unionByName(b), parts)
    return all_.groupBy(key).agg(F.sum(F.lit(1.0) / (RRF + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), "+").alias("channels"))


def within_budget(items: DataFrame, group: str, order: list, size: str, most_items: int, most_chars: int) -> DataFrame:
    """The first items of each group while their number and summed size stay within the budget."""
    w = Window.partitionBy(group).orderBy(*order)
    counted = items.withColumns({"place": F.row_number().over(w), "used": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return counted.where((F.col("place") <= most_items) & (F.col("used") <= most_chars))


def feature_evidence(candidates: DataFrame, features: list[str], title_weight: float = 0.15) -> DataFrame:
    """The candidate of each document whose words say most about the question: weights by how few candidates of
    the document have a feature, less for words of the title; ties go to the anchor, the better rank, the larger id."""
    words = F.array_distinct(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"))
    wanted = F.array(*[F.lit(f) for f in features])
    long = candidates.select("document_id", "chunk_id", "rank", "anchor", "title", F.explode_outer(F.array_intersect(words, wanted)).alias("feature"))
    by_doc = Window.partitionBy("document_id")
    df = F.size(F.collect_set("chunk_id").over(Window.partitionBy("document_id", "feature")))
    n = F.size(F.collect_set("chunk_id").over(by_doc))
    in_title = F.array_contains(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), F.col("feature"))
    weight = F.when(F.col("feature").isNull(), 0.0).otherwise(F.when(in_title, title_weight).otherwise(1.0) * (1 + F.log((1 + n) / (1 + df))))
    scores = long.withColumn("weight", weight).groupBy("document_id", "chunk_id", "rank", "anchor").agg(F.round(F.sum("weight"), 6).alias("score"))
    best = scores.groupBy("document_id").agg(F.max(F.struct("score", "anchor", (-F.col("rank")).alias("r"), (-F.col("chunk_id")).alias("c"))).alias("b"))
    return best.select("document_id", (-F.col("b.c")).alias("chunk_id"), "b.score")


def page(rows: DataFrame, order: list, limit: int = 20, offset: int = 0, most: int = 50) -> DataFrame:
    """A page of ranked rows; pages have most rows at most."""
    return rows.orderBy(*order).offset(offset).limit(min(limit, most))
