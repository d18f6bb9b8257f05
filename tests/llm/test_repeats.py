import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from lodestone.llm import jaccard_join, row_ids, substring_dedup  # noqa: E402

SF = "/root/testdata/sf0.01"


def made_corpus(seed, n=250):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "the", "of", "é", "x"]
    text = lambda m: [str(w) for w in rng.choice(vocab, m)]
    line, base = text(12), text(150)
    docs = []
    for d in range(n):
        kind = d % 5
        words = text(int(rng.integers(1, 200)))
        if kind == 0:  # near copies of one text
            words = list(base)
            for _ in range(int(rng.integers(0, 6))):
                words[int(rng.integers(len(words)))] = str(rng.choice(vocab))
        elif kind == 1:  # a common line inside
            words[len(words) // 2 : len(words) // 2] = line
        elif kind == 2 and docs:  # part of an earlier text
            earlier = (docs[int(rng.integers(len(docs)))][1] or "").split()
            at = int(rng.integers(0, len(earlier) + 1))
            words = words[:30] + earlier[at : at + 70] + words[30:]
        elif kind == 3 and docs and rng.random() < 0.5:
            docs.append((d, docs[int(rng.integers(len(docs)))][1]))
            continue
        docs.append((d, "".join(w + str(rng.choice([" ", "\n", "  ", "\t"])) for w in words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "one"), (n + 5, "a a a a " * 40), (n + 6, "z " * 30000), (n + 7, "One")]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, spans string").repartition(5)


@pytest.mark.parametrize("seed, width, group", [(1, 20, 500), (2, 20, 3), (3, 5, 500), (4, 8, 2)])
def test_substring_dedup(spark, monkeypatch, seed, width, group):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    docs = made_corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, docs), width).collect()}
    assert got == brute.substring_dedup(docs, width)


def test_substring_dedup_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (3, text), (4, text + " more")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, with_text=True).collect()}
    assert got == {None: (0, text), 3: (30, ""), 4: (30, "more")}
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_of_rows_without_an_id_of_their_own(spark):
    own = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    shared = own("s", 20)
    one, two = f"{own('a', 70)} {shared} {own('b', 10)}", f"{own('c', 5)} {shared} {own('d', 5)}"
    for id_ in (None, 4):
        docs = spark.createDataFrame([(id_, one), (id_, two), (9, own("e", 25)), (id_, one)], "doc_id long, text string").coalesce(1)
        got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(docs, with_text=True).collect())
        assert got == sorted([(id_ or 0, 100, 0, one), (id_ or 0, 30, 20, f"{own('c', 5)} {own('d', 5)}"), (9, 25, 0, own("e", 25)), (id_ or 0, 100, 100, "")])


@pytest.mark.parametrize("seed, k, percent, long", [(1, 4, 85, 8), (2, 5, 80, 3), (3, 1, 70, 2), (4, 2, 95, 4)])
def test_jaccard_groups(spark, monkeypatch, seed, k, percent, long):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 7)
    docs = made_corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, docs), k, percent).collect()}
    assert got == brute.jaccard_groups(docs, k, percent)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(None, "a b c"), (3, "A B c"), (4, "q"), (4, "q"), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_join.jaccard_groups(docs).collect())
    assert got == [(0, 1, 0), (3, 1, 0), (4, 1, 4), (4, 1, 4), (5, 0, 5)]
    assert jaccard_join.jaccard_groups(docs.limit(0)).count() == 0


def test_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.substring_dedup(rows, 20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs, 4, 85).collect()}
    assert got == brute.jaccard_groups(rows, 4, 85)


def test_sets_that_share_a_signature_stay_apart(spark):
    docs = made_corpus(7, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, docs), 3, 80, bits=5).collect()}
    assert got == brute.jaccard_groups(docs, 3, 80)


def test_groups_grow_with_the_table(spark, monkeypatch):
    """With more suffixes than one group may have on average there are more groups, and the result is the same."""
    monkeypatch.setattr(substring_dedup, "GROUP_MARKS", 20)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 100)
    docs = made_corpus(8)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(frame(spark, docs), 20).collect()}
    assert got == brute.substring_dedup(docs, 20)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, docs), 4, 85).collect()}
    assert found == brute.jaccard_groups(docs, 4, 85)


def test_words_that_share_32_bits_of_their_codes_are_not_equal(spark):
    """Windows that differ in one word alone, whose codes agree in their first half."""
    words = [f"w{i}" for i in range(44)]
    docs = [(1, " ".join([*words[:22], "w219102", *words[22:]])), (2, " ".join([*words[:22], "w332044", *words[22:]]))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute.substring_dedup(docs, 20)


def test_a_null_id_and_the_least_one_are_documents_each(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = spark.createDataFrame([(None, text), (-(1 << 63), text), (5, "other words " * 30)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(rows).collect()}
    assert got == {None: 0, -(1 << 63): 30, 5: 58}


def test_sets_are_made_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE", 200)
    texts = [" ".join(f"w{k}x{j}" for j in range(k % 9)) for k in range(60)] + ["long " * 300, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    parts = list(jaccard_join._base(2, 64)(iter([batch])))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 60
    monkeypatch.setattr(jaccard_join, "SLICE", 1 << 20)
    assert pa.Table.from_batches(parts).combine_chunks().equals(pa.Table.from_batches(jaccard_join._base(2, 64)(iter([batch]))).combine_chunks())


def test_jaccard_groups_broadcasts_nothing_that_grows(spark, monkeypatch):
    """The driver holds no table of the join, however small Spark takes its files for."""
    monkeypatch.setattr(jaccard_join, "LONG", 3)
    docs = made_corpus(5)
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    last = max([-1, *(runs().apply(i).executionId() for i in range(runs().size()))])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(frame(spark, docs), 5, 80).collect()}
    assert got == brute.jaccard_groups(docs, 5, 80)
    plans = [x.physicalPlanDescription() for x in (runs().apply(i) for i in range(runs().size())) if x.executionId() > last]
    assert sum("SortMergeJoin" in p for p in plans) > 3 and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("most", [0, 2])
def test_without_ids(spark, monkeypatch, most):
    """Few ids are broadcast, as plain numbers; more meet by a shuffle."""
    monkeypatch.setattr(row_ids, "MAX_BROADCAST", most)
    docs = row_ids.one_id_a_row(frame(spark, [(d, "a") for d in range(-2, 4)]))
    left = row_ids.without_ids(docs, spark.createDataFrame([(-2,), (3,), (3,)], "id long"))
    assert sorted(r.doc_id for r in left.collect()) == [-1, 0, 1, 2]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan, "SortMergeJoin" in plan) == (most > 0, most == 0)
    assert "isnull" not in plan.lower().replace("isnotnull", "")
