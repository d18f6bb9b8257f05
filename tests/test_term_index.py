"""Search over the index against scans of all texts, and cover density against all intervals."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search, term_index
from lodestone.operators.term_index import Pattern

WORDS = "red Pie blue the with of ÄPFEL naïve x1 12 don't tion nation national 华东地区 销售额 华东 a".split()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [rng.choice([" ", ", ", " - "]).join(rng.choices(WORDS, k=rng.randint(1, 14))) for _ in range(400)]
    texts += ["", None, "the", "the with", "with the", "With,The with", "100% of it", "50 % of it", "东", "华东地区销售额增长", "地 区", " the with", "x" * 3000, "the " * 2000 + "with"]
    return [(k, k // 3, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def made(spark, rows, tmp_path_factory):
    source = str(tmp_path_factory.mktemp("source") / "t.parquet")
    spark.createDataFrame(rows, "chunk_id long, document_id long, content string").write.parquet(source)
    before = term_index.BLOCK
    term_index.BLOCK = 100  # several slices
    try:
        yield term_index.ensure(spark, source, lambda: spark.read.parquet(source)), source
    finally:
        term_index.BLOCK = before


def ids(df):
    found = [r.chunk_id for r in df.select("chunk_id").collect()]
    assert len(found) == len(set(found))
    return sorted(found)


@pytest.mark.parametrize("words", [["the"], ["THE", "with"], ["red", "pie", "blue"], ["äpfel"], ["华东"], ["absent", "the"], ["the", "the"]])
def test_words_equal_a_scan(made, words):
    own = made[0]
    assert ids(own.with_all(words)) == ids(own.chunks.where(search.matches_all(F.col("content"), words)))


@pytest.mark.parametrize("query", ['the with', '"the with"', 'red or blue -pie', '"red pie" or "with the"', '-the', 'the -"the with"', '"a" x1', "or", "-the or -with", ""])
def test_websearch_equals_a_scan(made, query):
    own = made[0]
    assert ids(own.websearch(query)) == ids(own.chunks.where(F.coalesce(search.websearch(F.coalesce("content", F.lit("")), query), F.lit(False))))


@pytest.mark.parametrize("pattern", ["tion", "NATION", "东地", "华东地", "华东地区销", "东", "0%", "% of", "d, b", "the with", "n't", " - ", "区 销", "zzz", "äpf", "don't"])
def test_parts_of_texts_equal_a_scan(made, pattern):
    own = made[0]
    assert ids(own.containing_any([pattern])) == ids(own.chunks.where(search.matches_any(F.col("content"), [pattern])))


PATTERNS = [("nation", 5), ("tion", 2), ("th", 1), ("pie", 1), ("东地", 2), ("0%", 4)]


@pytest.mark.parametrize("patterns", [PATTERNS, PATTERNS[:4], PATTERNS[:1], [("zzz", 3), ("th", 1)]])
@pytest.mark.parametrize("named", [256, 1])
def test_weights_equal_a_scan(made, patterns, named, monkeypatch):
    monkeypatch.setattr(term_index, "MOST_NAMED", named)
    own = made[0]
    score = search.weighted_score(F.coalesce("content", F.lit("")), patterns)
    want = {r.chunk_id: r.score for r in own.chunks.select("chunk_id", score.alias("score")).where("score >= 1").collect()}
    rows = own.weighted(patterns).collect()
    assert {r.chunk_id: r.score for r in rows} == want and len(rows) == len(want)
    order = lambda scores: sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    for top in (1, 10, 60):
        for most in (0, 1000):
            monkeypatch.setattr(term_index, "MOST_CANDIDATES", most)
            monkeypatch.setattr(term_index, "FAR_MORE", 0)
            found = {r.chunk_id: r.score for r in own.weighted(patterns, top=top).collect()}
            assert order(found)[:top] == order(want)[:top]


def test_light_patterns_are_left_out_of_a_top(made):
    own = made[0]
    patterns = [Pattern(*p) for p in PATTERNS[:4]]
    bounds = own._bounds(patterns)
    assert sorted(own._light(patterns, bounds, 5, "chunk_id")) == [1, 2, 3]  # together 4, below the 5 that many chunks reach
    assert own._light(patterns, bounds, 10**6, "document_id") == []
    assert bounds[0].least_chunks <= bounds[0].chunks and bounds[0].terms == 2


def brute_covers(text, words):
    places = [(p, w) for p, w in enumerate(re.split(r"[^\w]+|_", text.lower())) if w in words]
    has_all = lambda i, j: {w for _, w in places[i : j + 1]} == set(words)
    covers = [(i, j) for i in range(len(places)) for j in range(i, len(places)) if has_all(i, j) and not has_all(i + 1, j) and not has_all(i, j - 1)]
    return sum(0.1 / (1 + places[j][0] - places[i][0] - (j - i)) for i, j in covers)


@pytest.mark.parametrize("words", [["the", "with"], ["the"], ["red", "pie", "blue"], ["the", "with", "of", "x1"]])
def test_cover_density_equals_all_intervals(made, rows, words):
    got = {r.chunk_id: r["rank"] for r in made[0].cover_ranked(words).collect()}
    want = {k: r for k, _, t in rows if t and len(t) < 5000 and (r := brute_covers(t, words))}
    assert {k: v for k, v in got.items() if len(rows[k][2]) < 5000} == pytest.approx(want)


def test_only_the_buckets_of_a_query_are_read(made):
    own = made[0]
    words = ["the", "with"]
    plan = own.named(words)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("(bucket", "(bucket") or "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "In(term, [the,with])" in plan
    buckets = {term_index.bucket_of(w) for w in words}
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in own.named(words).inputFiles()} <= set(range(term_index.BUCKETS)) and buckets == {r.bucket for r in own.named(words).select("bucket").distinct().collect()}


def test_the_index_is_written_once_for_the_same_files(spark, made):
    own, source = made
    again = term_index.ensure(spark, source, lambda: spark.read.parquet(source))
    assert again.path == own.path
    spark.createDataFrame([(10**6, 10**6, "new text")], "chunk_id long, document_id long, content string").write.mode("append").parquet(source)
    newer = term_index.ensure(spark, source, lambda: spark.read.parquet(source))
    assert newer.path != own.path and ids(newer.with_all(["new"])) == [10**6]


def test_an_index_over_nothing(spark, tmp_path):
    source = str(tmp_path / "none.parquet")
    spark.createDataFrame([], "chunk_id long, document_id long, content string").write.parquet(source)
    own = term_index.ensure(spark, source, lambda: spark.read.parquet(source))
    assert own.with_all(["a"]).collect() == own.weighted([("a", 1)], top=3).collect() == own.cover_ranked(["a"]).collect() == []


@pytest.mark.parametrize("at_once", [1, 5, 10**6])
def test_a_document_is_in_one_block_of_a_term(at_once, monkeypatch):
    monkeypatch.setattr(term_index, "AT_ONCE", at_once)
    texts = [(0, 7, "a b"), (1, 7, "b a b"), (2, 8, "a"), (5, 8, "c"), (4, 9, "b"), (3, 9, "b c")]  # (chunk, document, words), dealt to batches that cross documents
    table = pa.table({"chunk_id": [c for c, _, _ in texts], "document_id": [d for _, d, _ in texts], "length": pa.array([len(t) for _, _, t in texts], pa.int32()), "words": [t.split() for _, _, t in texts]})
    for size in (1, 2, 4, 6):
        found = [r for b in term_index._blocks(iter(table.to_batches(size))) for r in b.to_pylist()]
        postings = sorted((r["term"], *p) for r in found for p in zip(r["chunks"], r["documents"], r["counts"], map(tuple, r["positions"])))
        assert postings == sorted((w, c, d, t.split().count(w), tuple(k for k, x in enumerate(t.split()) if x == w)) for c, d, t in texts for w in set(t.split()))
        assert all(r["chunks"] == sorted(r["chunks"]) and r["n"] == len(r["chunks"]) and r["d"] == len(set(r["documents"])) for r in found)
        for term, documents in (("a", 2), ("b", 2), ("c", 2)):
            assert sum(r["d"] for r in found if r["term"] == term) == documents


def test_texts_are_not_written_again(spark, made):
    own = made[0]
    folders = spark._jvm.org.apache.hadoop.fs.Path(own.path)
    names = {f.getPath().getName() for f in folders.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folders)}
    assert names == {"postings", "terms"}
