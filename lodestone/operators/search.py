"""Lexical search over chunks: matching, scoring, one best chunk per document, counts, neighbours and snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import snippet


def word_array(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def matches_all(text: Column, words: list[str]) -> Column:
    """Every word of the query is a word of the text."""
    return reduce(lambda a, b: a & b, [F.array_contains(word_array(text), w.lower()) for w in words])


def matches_any(text: Column, terms: list[str]) -> Column:
    """Any term is part of the text, without regard to case; no character of a term is a wildcard."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(t.lower())) for t in terms])


def websearch(text: Column, query: str) -> Column:
    """Words, quoted phrases, ``or`` between alternatives and a minus sign before what must be missing."""
    import re

    flat = F.concat(F.lit(" "), F.array_join(word_array(text), " "), F.lit(" "))
    has = lambda term: F.contains(flat, F.lit(" " + " ".join(re.findall(r"\w+", term.lower())) + " "))
    groups: list[list[Column]] = []
    alternative = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        term = phrase or word
        if not phrase and term.lower() == "or" and groups:
            alternative = True
            continue
        if not re.search(r"\w", term):
            continue
        condition = ~has(term) if minus else has(term)
        if alternative:
            groups[-1].append(condition)
        else:
            groups.append([condition])
        alternative = False
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, g) for g in groups]) if groups else F.lit(False)


def weighted_score(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The sum of the weights of the patterns that the text has."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a + b, [F.when(F.contains(lowered, F.lit(p.lower())), w).otherwise(0) for p, w in patterns])


def best_chunks(ranked: DataFrame, score: str = "score", per_document: int = 1) -> DataFrame:
    """The best chunks of each document, ties by chunk id."""
    w = Window.partitionBy("document_id").orderBy(F.desc(score), "chunk_id")
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_document)


def best_chunk(ranked: DataFrame, score: str = "score") -> DataFrame:
    """document_id, chunk_id and score of the best chunk of each document, ties by chunk id: a maximum, which combines before the shuffle."""
    best = ranked.groupBy("document_id").agg(F.max(F.struct(F.col(score), (-F.col("chunk_id")).alias("c"))).alias("b"))
    return best.select("document_id", (-F.col("b.c")).alias("chunk_id"), F.col("b")[score].alias(score))


def page(documents: DataFrame, score: str, limit: int, offset: int = 0) -> DataFrame:
    return documents.orderBy(F.desc(score), "chunk_id").offset(offset).limit(limit)


def count_documents(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count_distinct("document_id").alias("total"))


def neighbours(chunks: DataFrame, cut: int = 1800) -> DataFrame:
    """Each chunk with the ones before and after it in its document, cut around its middle."""
    w = Window.partitionBy("document_id").orderBy("place")
    around = F.concat_ws("\n\n", F.lag("content").over(w), "content", F.lead("content").over(w))
    middle = F.coalesce(F.length(F.lag("content").over(w)) + 2, F.lit(0)) + F.floor(F.length("content") / 2).cast("int")
    begin = F.greatest(F.lit(0), F.least(middle - cut // 2, F.length(around) - cut))
    return chunks.withColumn("context", F.substring(around, begin + 1, F.lit(cut)))


def with_snippets(hits: DataFrame, needle: str) -> DataFrame:
    return hits.withColumn("snippet", snippet(F.col("content"), needle))


def attach_labels(hits: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of each hit as one list, in the order of their links."""
    lists = links.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "label"))), lambda x: x["label"]), ",").alias("labels"))
    return hits.join(lists, "document_id", "left").withColumn("labels", F.coalesce("labels", F.lit("")))
