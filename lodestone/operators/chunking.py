"""Blocks, sections and chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.structure import let

#: Target, most, least and overlap of chunk sizes in characters (fixed values).
PROFILES = {"table": (1800, 2400, 100, 0), "code": (1200, 1800, 100, 200), "general": (600, 900, 80, 120)}


def blocks(documents: DataFrame, heading: str = r"^#{1,6}\s") -> DataFrame:
    """document_id, place, kind and text of each non-blank line: fenced code, headings, list items, quotes, tables,
    paragraphs. Whether a line is inside a fence is the parity of the fences before it in the document."""
    lines = documents.select("document_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    w = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(r"^\s*```")
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(w))
    kind = (
        F.when(fence | (F.col("fences") % 2 == 1), "code_block").when(F.col("line").rlike(heading), "heading").when(F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+"), "list_item")
        .when(F.col("line").rlike(r"^\s*>"), "blockquote").when(F.contains("line", F.lit(" | ")), "table").otherwise("paragraph")
    )
    return lines.where((F.trim("line") != "") & ~fence).select("document_id", F.col("place").cast("long").alias("place"), kind.alias("kind"), F.col("line").alias("text"))


def sections(rows: DataFrame, opens: Column) -> DataFrame:
    """Numbers the sections: one begins at each block that opens it. Blocks before the first opening are section 0."""
    w = Window.partitionBy("document_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.sum(opens.cast("long")).over(w))


def page_safe(rows: DataFrame, quality: DataFrame) -> DataFrame:
    """Headings of documents whose verdict in quality (one row a document) is fallback are paragraphs, so that they open no sections."""
    verdict = quality.select("document_id", "verdict")
    kind = F.when((F.col("kind") == "heading") & (F.col("verdict") == "fallback"), "paragraph").otherwise(F.col("kind"))
    return rows.join(verdict, "document_id", "left").withColumn("kind", kind).drop("verdict")


#: Where a span of source text ends best: after a line, else after a sentence.
ENDS = (r"\n", r"[.!?。！？]")


def source_spans(documents: DataFrame, size: int = 600) -> DataFrame:
    """document_id, span, begin and end of spans of at most size characters that follow each other without a gap. A span ends after
    the last line, else the last sentence, that ends in its second half, else at size. An empty or null text has none."""
    import re

    marks = [re.compile(f"(?s).*{end}") for end in ENDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for document, text in zip(batch["document_id"], batch["text"]):
                begin, span, text = 0, 0, text or ""
                while begin < len(text):
                    found = (m.match(text, begin, begin + size) for m in marks)
                    best = next((m.end() for m in found if m and m.end() - begin > size // 2), begin + size)
                    end = best if len(text) - begin > size else len(text)
                    out.append((document, span, begin, end))
                    begin, span = end, span + 1
            yield pd.DataFrame(out, columns=["document_id", "span", "begin", "end"])

    return documents.select("document_id", "text").mapInPandas(run, "document_id long, span long, begin long, end long")


def row_parts(rows: DataFrame, size: int) -> DataFrame:
    """n, part and text of table rows (n, line): a line longer than size is cut into parts that name their row, part and number of parts."""
    k = F.greatest(F.ceil(F.length("line") / size), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.substring("line", i * size + 1, F.lit(size)))
    rows = rows.select("n", k.alias("k"), F.posexplode(parts).alias("i", "body"))
    head = F.concat(F.lit("行 "), F.col("n").cast("string"), F.lit("｜【片段 "), (F.col("i") + 1).cast("string"), F.lit("/"), F.col("k").cast("string"), F.lit("】"))
    return rows.select("n", (F.col("i") + 1).alias("part"), F.when(F.col("k") == 1, F.col("body")).otherwise(F.concat(head, "body")).alias("text"))


def lines_of_words(texts: DataFrame, size: int) -> DataFrame:
    """A row for each line of so many words of the column text, numbered from 0, with the other columns; words stand between single spaces."""
    lines = let(F.split("text", " "), lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / size).cast("int")), lambda k: F.array_join(F.slice(w, k * size + 1, size), " ")))
    return texts.where("text is not null").select(*[c for c in texts.columns if c != "text"], F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def chunk_quality(chunks: DataFrame, short: int = 80) -> DataFrame:
    """A score of 100, less up to 45 for short chunks and 20 for repeated ones."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("content") < short).alias("n_short"), (F.count(F.lit(1)) - F.count_distinct("content")).alias("n_repeated"))
    score = F.lit(100) - F.bround(F.lit(45.0) * F.col("n_short") / F.col("n")).cast("long") - F.least(2 * F.col("n_repeated"), F.lit(20))
    return per.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "review").otherwise("fallback"))


def demote_repeated_headings(rows: DataFrame, page: Column) -> DataFrame:
    """A heading whose text stands on two pages or more is a running title, not a heading. The pages of a text are
    counted by least and greatest, which needs no distinct set."""
    rows = rows.withColumn("page", page)
    heads = rows.where("kind = 'heading'").groupBy("document_id", "text").agg((F.min("page") != F.max("page")).alias("repeated"))
    out = rows.join(heads, ["document_id", "text"], "left")
    return out.withColumn("kind", F.when((F.col("kind") == "heading") & F.col("repeated"), "paragraph").otherwise(F.col("kind"))).drop("repeated")
