"""What each filter removes, under every order in which five filters can be applied.

Method: direct relational replay. Each document's flags (one bit a filter that it fails) are crossed with the 120 orders, which are
broadcast; the five steps of an order are exploded; the first filter of the order that fails a document removes it; and conditional sums, combined
before the shuffle, give the counts of each part, order and step. Documents of one part with equal flags and labels fare alike in every order, so they are counted
first and replayed once, with their number as weight: what is crossed is no more than the parts' different flags.

Texts are read once: digests and flags are written, and the rest works on them. That a smaller doc_id has the same text is told by
the least doc_id of each repeated digest (SHA-256), joined back; copies are combined before the shuffle on one side of that join, and Spark can split
a hot digest on the other.

Cases: a null text is empty (no words; it fails the first filter and equals other empty texts). A null source is the part ''. A document with a null
doc_id is no copy of another, nor is another a copy of it. Rows that share a doc_id are documents each, none of which is the copy of another.
Labels are those of any row with the doc_id; a document without is neither good nor toxic. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.native_text import let
from lodestone.llm.store import written

#: White space between words.
BLANKS = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_flags(text: Column) -> Column:
    """Bits 0 to 3: under 200 words; under half of the words distinct; over 2 % capitals; a sign of markup."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    sizes = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    bit = lambda k, fails: F.when(fails, 1 << k).otherwise(0)
    by_words = let(sizes, lambda s: bit(0, s["n"] < 200) + bit(1, s["distinct"].cast("long") * 100 < s["n"].cast("long") * 50))
    return by_words + bit(2, capitals * 100 > F.length(text).cast("long") * 2) + bit(3, text.rlike("[#$%&*|]"))


def flagged(documents: DataFrame) -> DataFrame:
    """doc_id, part and flags of every document, the fifth bit for copies of a smaller doc_id's text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = written(
        documents.select(F.col("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text_flags(text).alias("flags")),
        "flags",
    )
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    first = written(first, "repeated")  # with exchanges of their own on both sides, the join can be split
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return marks.join(first, "digest", "left").select("doc_id", "part", (F.col("flags") + copy).alias("flags"))


def replay(groups: DataFrame) -> DataFrame:
    """The counts of each part, order and step from groups (part, flags, good, toxic, n)."""
    orders = [("".join(p), [1 << FILTERS.index(x) for x in p]) for p in permutations(FILTERS)]
    orders = groups.sparkSession.createDataFrame(orders, "filter_order string, bits array<int>")
    crossed = groups.crossJoin(F.broadcast(orders))
    failed = F.array_position(F.transform("bits", lambda b: F.col("flags").bitwiseAND(b) > 0), True)  # from 1; 0: none
    crossed = crossed.withColumn("first", F.when(failed == 0, len(FILTERS) + 1).otherwise(failed))
    steps = crossed.select("part", "filter_order", "flags", "good", "toxic", "n", "first", F.posexplode("bits").alias("step", "bit")).withColumn("step", F.col("step") + 1)
    here, fails = F.col("first") == F.col("step"), F.col("flags").bitwiseAND(F.col("bit")) > 0
    when = [F.col("first") > F.col("step"), here, fails & (F.col("first") < F.col("step")), F.col("flags") == F.col("bit"), here & F.col("good"), here & F.col("toxic")]
    sums = [F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for c, name in zip(when, MEASURES)]
    return steps.groupBy("part", "filter_order", "step").agg(*sums)


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of MEASURES; shapley is the number that the step's filter removes over all orders."""
    labels = labels.groupBy(F.col("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = flagged(documents).join(labels, "doc_id", "left")
    no = F.lit(False)
    groups = rows.groupBy("part", "flags", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    counts = replay(groups).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "filter"))  # of 120 rows each
    return counts.select("part", "filter_order", F.col("step").cast("int").alias("step"), *MEASURES, shapley.alias("shapley"))
