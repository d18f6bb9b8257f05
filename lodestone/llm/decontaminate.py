"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is short and a document may be long, so their Jaccard similarity says little; what is asked is which share
of the item's k-word shingles the document has. Items are partitioned by size, each partition up to twice its least
size. A partition's sketch size follows from its upper bound U: the (1 - threshold) U + 1 least shingle hashes of an
item. An item contained to the threshold misses at most (1 - threshold) U shingles, so some hash of its sketch is among the
document's, whatever the hash order: the search loses nothing. Documents are looked through as they are read, their
shingle hashes joined with the sketches, a table whose size is the benchmark's and is counted before it is
broadcast (``MAX_BROADCAST``; beyond it, the join is shuffled). Each pair found is then verified on the words of the whole
text. Only columns and SQL functions are used.

Words are lower-case runs of letters and digits. Items of fewer than k words have one shingle, all their words.

Cases: null, empty and wordless items or texts match nothing. A null doc_id is kept as one; items with a null id are not
searched. Rows that share a doc_id (or item_id) give one row with the greatest containment. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.native_text import bare_words, gram_hashes, gram_texts, words
from lodestone.llm.row_ids import one_id_a_row, with_own_ids, without_ids
from lodestone.llm.store import written

#: Rows of a table that is broadcast.
MAX_BROADCAST = 1_000_000
NULL_ID = -(1 << 63)


def item_shingles(benchmark: DataFrame, k: int) -> DataFrame:
    """item_id, k (words of a shingle), shingles (distinct texts), n."""
    items = benchmark.where("item_id is not null").select("item_id", bare_words(F.coalesce("text", F.lit(""))).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(k)))
    shingles = F.when(F.col("k") == k, gram_texts(F.col("w"), k)).otherwise(F.array(F.array_join("w", " ")))
    return items.select("item_id", "k", F.array_distinct(shingles).alias("shingles")).withColumn("n", F.size("shingles"))


def sketches(items: DataFrame, k: int, percent: int) -> DataFrame:
    """hash, item_id: of each item, as many least hashes as the upper bound of its size partition asks for."""
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.col("n"))) + 1) - 1
    size = F.floor(upper * (100 - percent) / 100).cast("int") + 1
    hashes = F.transform("shingles", lambda s: gram_hashes(F.split(s, " "), k)[0])  # of the words, as documents have it
    return items.select("item_id", F.explode(F.slice(F.array_sort(hashes), 1, size)).alias("hash"))


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found and containment of each item that a document has to
    percent / 100 at least."""
    items = written(item_shingles(benchmark, k), "items")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").where("text is not null")
    found = None
    for own_k in sorted(r["k"] for r in items.select("k").distinct().collect()):  # k values at most
        sketch = written(sketches(items.where(F.col("k") == own_k), own_k, percent), "sketches")
        if sketch.count() <= MAX_BROADCAST:
            sketch = F.broadcast(sketch)
        hits = rows.select("doc_id", F.explode(gram_hashes(words(F.col("text")), own_k)).alias("hash")).join(sketch, "hash").select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    if found is None:
        found = rows.select("doc_id", F.lit(None).cast("long").alias("item_id")).where("false")
    pairs = written(found.distinct(), "candidates")
    wanted = pairs.select("doc_id").distinct()
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, "doc_id").select("doc_id", F.concat(F.lit(" "), F.array_join(bare_words(F.col("text")), " "), F.lit(" ")).alias("flat"))
    checked = texts.join(pairs, "doc_id").join(items.select("item_id", "shingles", "n"), "item_id")
    there = F.size(F.filter("shingles", lambda s: F.contains(F.col("flat"), F.concat(F.lit(" "), s, F.lit(" ")))))
    checked = checked.select("doc_id", "item_id", F.col("n").cast("long").alias("n_shingles"), there.cast("long").alias("n_found"))
    checked = checked.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")).alias("b"))
    return best.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "item_id", "b.n_shingles", "b.n_found", "b.containment")


def without_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item; rows that share a doc_id, or have none, are judged each."""
    rows = one_id_a_row(docs)
    return with_own_ids(without_ids(rows, contained_items(rows, benchmark, k, percent).select("doc_id")), docs.columns)
