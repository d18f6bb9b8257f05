"""An inverted index over chunks, written once, and search that reads the lists of a query's terms alone.

Tables, in the shared folder:

* ``postings``, in directories by bucket (a hash of the term), a file of each for a slice of documents, in the order of terms: a row is a block, the chunks of
  some documents that have one term, in arrays of equal length in the order of chunk_id: chunks, documents, lengths (characters) and counts, and positions as a list for each;
  n chunks of d documents. A slice holds about ``BLOCK`` chunks and a block those of about ``AT_ONCE`` words (the chunks of a document are in one), so the list of a word
  that every chunk has is many rows in many files.
* ``terms``: df (chunks that have the term), ddf (documents) and its bucket, added up from the blocks. Bounds of searches come from it.

What only the text can tell is read from the table that was indexed, as its files are when the index is opened.

Terms are words (the runs of letters and digits of the lower-case text) and, for runs of ideographs, their grams of two and three. A pattern that is
made of letters and digits is part of a text if it is part of one of its words, so substring matches read the lists of the words that contain it; only patterns with other
signs look at texts: those of the chunks that have all their words, where these are few.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import word_array
from lodestone.store import exists, rename, shared_dir, stamp

#: Chunks of a slice, about, and buckets of terms.
BLOCK, BUCKETS = 1 << 18, 32
#: Slices are smaller, down to such a part, while there are more cores than slices.
LEAST_PART = 16
#: Words that are grouped at once.
AT_ONCE = 1 << 19
#: Terms that are read by name; beyond, lists are filtered by the pattern itself.
MOST_NAMED = 256
#: Candidates of a top-k that are broadcast to the lists of the lighter patterns, where those are so many times longer.
MOST_CANDIDATES, FAR_MORE = 1_000_000, 4
IDEOGRAPHS = "一-鿿"
GRAM = "\u0001"  # before a gram, so that none is taken for a word
KEYS = ["chunk_id", "document_id", "length"]
BLOCKS = "term string, n int, d int, chunks array<long>, documents array<long>, lengths array<int>, counts array<int>, positions array<array<int>>"
POSTINGS = f"{BLOCKS}, bucket int"
TERMS = "term string, bucket int, df long, ddf long"


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


def _grams(text: Column) -> Column:
    """The different grams of two and three ideographs of a text."""
    runs = F.regexp_extract_all(text, F.lit(f"([{IDEOGRAPHS}]{{2,}})"), F.lit(1))
    of = lambda run, n: F.transform(F.sequence(F.lit(1), F.length(run) - (n - 1)), lambda i: F.concat(F.lit(GRAM), F.substring(run, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.concat(of(r, 2), F.when(F.length(r) >= 3, of(r, 3)).otherwise(F.array().cast("array<string>"))))))


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, in the order of document_id, in batches of AT_ONCE words or more that no document crosses."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in (b for b in batches if b.num_rows):
        own = batch.column("document_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        last = int(np.searchsorted(own, own[-1]))  # where its last document begins
        goes_on = bool(held) and held[-1].column("document_id")[-1].as_py() == batch.column("document_id")[0].as_py()
        if n >= AT_ONCE and (last or not goes_on):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
            batch, held, n = batch.slice(last), [], 0
        held.append(batch)
        n += len(batch.column("words").flatten())
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of chunks (in the order of document_id) grouped by term, the chunks of each in order."""
    for batch in _whole_documents(batches):
        words = batch.column("words")
        term = words.flatten().dictionary_encode()
        n = words.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        number = term.indices.to_numpy().astype(np.int64)
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(batch.column("chunk_id").to_numpy(), kind="stable")] = np.arange(len(n))
        order = np.argsort(number * len(n) + rank[row], kind="stable")
        row, place, number = row[order], place[order], number[order]
        if not len(row):
            continue
        new_block = np.concatenate([[True], number[1:] != number[:-1]])
        postings = np.flatnonzero(new_block | np.concatenate([[True], row[1:] != row[:-1]]))
        blocks = np.flatnonzero(new_block)
        own = row[postings]
        at = np.append(np.searchsorted(postings, blocks), len(postings)).astype(np.int32)
        ends = np.append(postings, len(row)).astype(np.int32)
        document = batch.column("document_id").dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        different = np.unique(number[postings] * len(n) + document[own]) // len(n)  # a term for each of its documents
        d = np.searchsorted(different, number[blocks], "right") - np.searchsorted(different, number[blocks])
        lists = lambda values: pa.ListArray.from_arrays(pa.array(at), values)
        of = [lists(batch.column(name).take(pa.array(own))) for name in ("chunk_id", "document_id", "length")]
        positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
        columns = [term.dictionary.take(pa.array(number[blocks])), pa.array(np.diff(at)), pa.array(d.astype(np.int32)), *of, lists(pa.array(np.diff(ends))), lists(positions)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])


def build(chunks: DataFrame, path: str) -> None:
    """Writes the tables of an index over chunks (chunk_id, document_id and content) into path. Only the texts are shuffled, once, so that a task has all chunks of
    its documents; each task then writes the lists of its own slice, which none else adds to."""
    spark = chunks.sparkSession
    n = chunks.count()
    slices = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, -(-n * LEAST_PART // BLOCK)))
    dealt = chunks.select("chunk_id", "document_id", F.coalesce("content", F.lit("")).alias("content")).repartition(slices, "document_id").sortWithinPartitions("document_id", "chunk_id")
    words = F.concat(word_array(F.col("content")), _grams(F.lower("content")))
    blocks = dealt.select("chunk_id", "document_id", F.length("content").alias("length"), words.alias("words")).mapInArrow(_blocks, BLOCKS).where("term <> ''")
    bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int")
    compact = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}  # places and ids as differences
    blocks.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").options(**compact).parquet(f"{path}/postings")
    stats = spark.read.schema(POSTINGS).parquet(f"{path}/postings").groupBy("term", "bucket").agg(F.sum("n").alias("df"), F.sum("d").alias("ddf"))
    stats.sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{path}/terms")


_opened: dict[tuple[str, str, str], TermIndex] = {}


def ensure(spark: SparkSession, source: str, chunks: Callable[[], DataFrame]) -> TermIndex:
    """The index over the chunks made from the table at source: the one that was written for that table's files as they are now, else a new one."""
    at = (spark.sparkContext.applicationId, source, stamp(spark, source))
    if at in _opened:
        return _opened[at]
    rows = chunks()
    key = hashlib.sha256(f"{at[1:]}|{','.join(rows.columns)}|{BLOCK}|{BUCKETS}|{POSTINGS}".encode()).hexdigest()[:32]
    path = f"{shared_dir(spark)}/term-index-{key}"
    if not exists(spark, f"{path}/terms/_SUCCESS"):
        own = f"{path}-{uuid.uuid4().hex}"
        build(rows, own)
        rename(spark, own, path)  # another session may have been first; its tables are the same
    _opened[at] = TermIndex(spark, path, rows)
    return _opened[at]


@dataclass(frozen=True)
class Pattern:
    """A part of a text that counts for so much."""

    text: str
    weight: int = 1

    @property
    def lowered(self) -> str:
        return self.text.lower()

    @property
    def in_words(self) -> bool:
        """Whether it is made of letters and digits, so that words tell where it is."""
        return bool(re.fullmatch(r"[^\W_]+", self.lowered))

    @property
    def gram(self) -> str | None:
        return GRAM + self.lowered if re.fullmatch(f"[{IDEOGRAPHS}]{{2,3}}", self.lowered) else None

    def of_term(self) -> Column:
        """Whether a term's chunks have the pattern."""
        term = F.col("term")
        if self.gram:
            return term == self.gram
        return F.contains(term, F.lit(self.lowered)) & ~F.startswith(term, F.lit(GRAM))

    def pieces(self) -> list[Column]:
        """Conditions on the words that chunks with the pattern must have."""
        whole = re.findall(r"[^\W_]+", self.lowered)
        inside = [F.col("term") == w for w in whole[1:-1]]
        opens, closes = (bool(re.match(r"[\W_]", x)) for x in (self.lowered, self.lowered[::-1]))
        if len(whole) == 1:
            return [F.col("term") == whole[0] if opens and closes else F.startswith("term", F.lit(whole[0])) if opens else F.endswith("term", F.lit(whole[0]))]
        first = [F.col("term") == whole[0] if opens else F.endswith("term", F.lit(whole[0]))] if whole else []
        last = [F.col("term") == whole[-1] if closes else F.startswith("term", F.lit(whole[-1]))] if whole else []
        return first + inside + last


@dataclass(frozen=True)
class Bounds:
    """How many chunks and documents have a pattern at least (those of one of its words), how many chunks at most, and of how many terms it is part."""

    least_chunks: int
    least_documents: int
    chunks: int
    terms: int


def _postings_of(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """A row a posting: chunk_id, document_id, length and what else is asked for."""
    names = {"chunks": "chunk_id", "documents": "document_id", "lengths": "length", "counts": "count", "positions": "positions"}
    wanted = [*names] if columns == ["*"] else ["chunks", "documents", "lengths", *columns]
    others = [c for c in blocks.columns if c not in names]
    zipped = blocks.select(*others, F.explode(F.arrays_zip(*wanted)).alias("p"))
    return zipped.select(*others, *[F.col("p")[c].alias(names[c]) for c in wanted])


class TermIndex:
    def __init__(self, spark: SparkSession, path: str, chunks: DataFrame):
        self.spark, self.path, self.chunks = spark, path, chunks
        self._known: dict[Pattern, Bounds] = {}  # the tables do not change

    @cached_property
    def terms(self) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/terms")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def named(self, terms: list[str]) -> DataFrame:
        """The blocks of these terms: only their buckets' directories are read, and of them the row groups that may have the terms."""
        return self.blocks.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms})) & F.col("term").isin(terms))

    def matching(self, condition: Column, terms: int | None = None) -> DataFrame:
        """The blocks of the terms that meet a condition; by name where they are few (if their number is known, so many), else the lists are filtered by the condition."""
        if terms is None or terms <= MOST_NAMED:
            found = [r["term"] for r in self.terms.where(condition).select("term").limit(MOST_NAMED + 1).collect()] if terms != 0 else []
            if len(found) <= MOST_NAMED:
                return self.named(found)
        return self.blocks.where(condition)

    # words

    def with_all(self, words: list[str]) -> DataFrame:
        """chunk_id, document_id and length of the chunks that have every word."""
        words = sorted({w.lower() for w in words})
        rows = _postings_of(self.named(words).select("chunks", "documents", "lengths"), [])
        if len(words) == 1:
            return rows
        return rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).drop("n")  # a chunk is in each word's list once

    def websearch(self, query: str) -> DataFrame:
        """chunk_id, document_id and length of the chunks that meet a query: words, quoted phrases (places that follow each other), ``or``, and a minus."""
        groups: list[list[tuple[bool, list[str]]]] = []
        alternative = False
        for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
            atom = re.findall(r"[^\W_]+", (phrase or word).lower())
            if not phrase and word.lower() == "or" and groups:
                alternative = True
                continue
            if atom:
                if alternative:
                    groups[-1].append((bool(minus), atom))
                else:
                    groups.append([(bool(minus), atom)])
            alternative = False
        if not groups:
            return self.chunks.where(F.lit(False)).select("chunk_id", "document_id", F.length("content").alias("length"))
        terms = sorted({w for g in groups for _, atom in g for w in atom})
        rows = _postings_of(self.named(terms).select("term", "chunks", "documents", "lengths", "positions"), ["positions"])
        per = rows.groupBy(*KEYS).agg(*[F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"t{k}") for k, t in enumerate(terms)])

        def has(atom: list[str]) -> Column:
            lists = [F.col(f"t{terms.index(w)}") for w in atom]
            there = reduce(lambda a, b: a & b, [x.isNotNull() for x in lists])
            follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(x, p + k) for k, x in enumerate(lists[1:], 1)])
            return there if len(atom) == 1 else there & F.coalesce(F.exists(lists[0], follows), F.lit(False))

        holds = lambda minus, atom: ~has(atom) if minus else has(atom)
        meets = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [holds(*x) for x in g]) for g in groups])
        if all(any(minus for minus, _ in g) for g in groups):  # chunks with none of the words may meet it
            missed = per.where(~meets).select("chunk_id")
            return self.chunks.select("chunk_id", "document_id", F.length("content").alias("length")).join(missed, "chunk_id", "left_anti")
        return per.where(meets).select(*KEYS)

    def cover_ranked(self, words: list[str]) -> DataFrame:
        """chunk_id, document_id, length and rank of the chunks that have every word: cover density over the merged positions of the words' lists."""
        words = sorted({w.lower() for w in words})
        rows = _postings_of(self.named(words).select("term", "chunks", "documents", "lengths", "positions"), ["positions"])
        number = F.array_position(F.lit(words), F.col("term")) - 1
        entries = F.transform("positions", lambda p: F.struct(p.alias("pos"), number.cast("int").alias("word")))
        per = rows.select(*KEYS, entries.alias("e")).groupBy(*KEYS).agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("e"), F.count(F.lit(1)).alias("n"))
        return per.where(F.col("n") == len(words)).select(*KEYS, cover_density(F.col("e"), len(words)).alias("rank"))

    # parts of texts

    def _masks(self, patterns: list[Pattern], numbers: list[int], terms: int | None = None) -> DataFrame:
        """chunk_id, document_id, length and bits of the patterns (by number): a row a posting of the words that contain one; a row a chunk for patterns that the texts
        had to tell."""
        words = [(k, patterns[k]) for k in numbers if patterns[k].in_words]
        out = []
        if words:
            bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(p.of_term(), 1 << k).otherwise(0).cast("long") for k, p in words])
            blocks = self.matching(reduce(lambda a, b: a | b, [p.of_term() for _, p in words]), terms)
            out.append(_postings_of(blocks.select("chunks", "documents", "lengths", bits.alias("bits")), []).select(*KEYS, "bits"))
        for k in (k for k in numbers if not patterns[k].in_words):
            out.append(self._verified(patterns[k]).select(*KEYS, F.lit(1 << k).cast("long").alias("bits")))
        return reduce(lambda a, b: a.unionByName(b), out)

    def _verified(self, pattern: Pattern) -> DataFrame:
        """The chunks whose text contains a pattern that is not of letters and digits alone. Where few chunks have all its words, only they are looked up, by
        their ids; else all texts are read."""
        rows = self.chunks
        conditions = pattern.pieces()
        if conditions:
            having = [_postings_of(self.matching(c).select("chunks", "documents", "lengths"), []).select("chunk_id") for c in conditions]
            few = reduce(lambda a, b: a.join(b, "chunk_id", "left_semi"), having).distinct().limit(MOST_NAMED + 1).collect()
            if len(few) <= MOST_NAMED:
                rows = rows.where(F.col("chunk_id").isin([r["chunk_id"] for r in few]))
        return rows.where(F.contains(F.lower("content"), F.lit(pattern.lowered))).select("chunk_id", "document_id", F.length("content").alias("length"))

    def containing_any(self, patterns: list[str]) -> DataFrame:
        """chunk_id, document_id and length of the chunks whose text contains a pattern, without regard to case."""
        made = [Pattern(p) for p in patterns]
        return self._masks(made, list(range(len(made)))).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).drop("n")

    def weighted(self, patterns: list[tuple[str, int]], least: int = 1, top: int | None = None, of: str = "chunk_id") -> DataFrame:
        """chunk_id, document_id, length and score (the weights of the patterns in the text) of the chunks with a score of least at least. With top, chunks that
        can't be among the best so many (chunks, or documents if of says so) may be left out: patterns whose weights together stay below a weight that is reached
        often enough can't bring in a chunk by themselves, so their lists only add to chunks of the heavier patterns' lists."""
        made = [Pattern(*p) for p in patterns]
        every = list(range(len(made)))
        bounds = self._bounds(made) if top and all(p.in_words for p in made) else None
        light = self._light(made, bounds, top, of) if bounds else []
        heavy = [k for k in every if k not in light]
        chunks = lambda numbers: sum(bounds[k].chunks for k in numbers)
        if light and chunks(heavy) <= MOST_CANDIDATES and chunks(light) > FAR_MORE * chunks(heavy):
            few = self._masks(made, heavy, sum(bounds[k].terms for k in heavy)).groupBy(*KEYS).agg(F.bit_or("bits").alias("bits"))
            rows = few.unionByName(self._masks(made, light).join(F.broadcast(few.select("chunk_id")), "chunk_id", "left_semi"))
        else:
            rows = self._masks(made, every, sum(b.terms for b in bounds) if bounds else None)
        has = lambda k: F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0
        score = reduce(lambda a, b: a + b, [F.when(has(k), p.weight).otherwise(0) for k, p in enumerate(made)])
        scored = rows.groupBy(*KEYS).agg(F.bit_or("bits").alias("bits"))
        return scored.where(reduce(lambda a, b: a | b, map(has, heavy))).select(*KEYS, score.alias("score")).where(F.col("score") >= least)

    def _bounds(self, patterns: list[Pattern]) -> list[Bounds]:
        """What the terms tell of each pattern of letters and digits, in one pass over them."""
        new = [p for p in patterns if p not in self._known]
        if new:
            rows = self.terms.select("df", "ddf", *[p.of_term().alias(f"p{k}") for k, p in enumerate(new)])
            of = [[F.max(F.when(F.col(f"p{k}"), F.col(c))) for c in ("df", "ddf")] + [F.sum(F.when(F.col(f"p{k}"), F.col("df"))), F.count_if(f"p{k}")] for k in range(len(new))]
            row = rows.agg(*[c for own in of for c in own]).first()
            self._known |= {p: Bounds(*[x or 0 for x in row[4 * k : 4 * k + 4]]) for k, p in enumerate(new)}
        return [self._known[p] for p in patterns]

    def _light(self, patterns: list[Pattern], bounds: list[Bounds], top: int, of: str) -> list[int]:
        """The numbers of the patterns that can't bring in a chunk by themselves: the lightest ones whose weights add up to less than a weight that top chunks (documents) reach."""
        often = [b.least_documents if of == "document_id" else b.least_chunks for b in bounds]
        reached = max([p.weight for p, n in zip(patterns, often) if n >= top], default=0)
        light, total = [], 0
        for k in sorted(range(len(patterns)), key=lambda k: patterns[k].weight):
            total += patterns[k].weight
            if total >= reached:
                break
            light.append(k)
        return light


def cover_density(entries: Column, words: int) -> Column:
    """The sum over all minimal covers of 0.1 / (1 + the words between that are not the query's). entries: (pos, word) in order of place, words numbered
    from 0. One sweep: behind each entry lies the last place of every word, and a cover is minimal where the least of them has moved on."""
    none = F.array_repeat(F.lit(-1), words)
    start = F.struct(none.alias("last"), F.lit(-1).alias("at"), F.lit(-1).alias("first"), F.lit(0.0).alias("rank"))

    def step(s: Column, e: Column) -> Column:
        at = s["at"] + 1
        last = F.transform(s["last"], lambda x, k: F.when(k == e["word"], at).otherwise(x))
        first = F.array_min(last)
        noise = e["pos"] - F.get(entries, F.greatest(first, F.lit(0)))["pos"] - (at - first)
        more = F.when(first > s["first"], F.lit(0.1) / (1 + noise)).otherwise(0.0)
        return F.struct(last.alias("last"), at.alias("at"), first.alias("first"), (s["rank"] + more).alias("rank"))

    return F.aggregate(entries, start, step, lambda s: s["rank"])
