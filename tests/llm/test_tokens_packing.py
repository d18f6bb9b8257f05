import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import exact_dedup, packing, token_files, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Stop. stop, ünï; stop. don't! x1. Stop.\nStop. end?!", "a b\nc", None, "", "  two  spaces \n\n end ", "tab\there\x0b", "it's we'll\nDon't", " lead", "trail\n", "ünï ” “ 数字 12 34", "nbsp x  y", "<|endoftext|> ok", "x" * 9000, "w " * 5000, "a b\nc"]


def docs(spark, texts=TEXTS):
    rows = [(k, t, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string")


def reference_ids(text):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, encoding):
    rows = sorted(token_files.token_index_of(docs(spark), PATH, encoding=encoding).collect(), key=lambda r: r.doc_id)
    start = 0
    for row, text in zip(rows, TEXTS, strict=True):
        ids = reference_ids(text)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encoder_is_exact_when_it_drops_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 40)
    monkeypatch.setattr(tokens, "SLICE", 60)
    rng = np.random.default_rng(3)
    words = ["word", "Word.", "x1", "ünï,", "(in", "don't", "\u00e9\u0301", "…", "long" * 9, "e.", "n" * 70]
    texts = [" ".join(str(w) for w in rng.choice(words, 9)) + str(k) for k in range(60)] + [t or "" for t in TEXTS]
    enc = tokens.Encoder(PATH, 0)
    got = [ids[a:b] for _, _, ids, at in enc.encode(pa.array(texts)) for a, b in zip(at[:-1], at[1:])]
    assert len(got) == len(texts) and len(enc.kept) < 120
    for text, ids in zip(texts, got):
        assert np.array_equal(ids, reference_ids(text))


def test_selective_reads_touch_few_pages(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    token_files.write_token_files(rows, path, PATH, row_group_mb=1, page_rows=100)
    metas = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / "tokens").glob("*.parquet"))]
    column = lambda m, g, name: next(c for c in map(m.row_group(g).column, range(m.num_columns)) if c.path_in_schema.startswith(name))
    assert all(column(m, g, "doc_id").has_column_index and column(m, g, "ids").has_offset_index for m in metas for g in range(m.num_row_groups))
    wanted = token_files.read_tokens_of(spark, path, 1000, 1010)
    assert sorted(r.doc_id for r in wanted.collect()) == list(range(1000, 1011))
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,1000), LessThanOrEqual(doc_id,1010)]" in plan and "ReadSchema: struct<doc_id:bigint,ids:array<int>>" in plan
    sizes = spark.read.parquet(path).select("n_tokens")
    assert "ReadSchema: struct<n_tokens:bigint>" in sizes._jdf.queryExecution().executedPlan().toString()


def test_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b"), (None, "c"), (7, "x y z"), (7, "x y z"), (7, None)], "doc_id long, text string")
    files = token_files.token_index_of(rows, PATH).collect()
    assert sorted(r.n_tokens for r in files) == sorted(len(reference_ids(t)) for t in ("a b", "c", "x y z", "x y z", ""))
    assert [r.doc_id for r in sorted(files, key=lambda r: r.start)] == [None, None, 7, 7, 7]
    packed = packing.pack_documents(rows, PATH, 16).collect()
    assert len(packed) == 5 and len({(r.sequence_id, r.offset) for r in packed}) == 5


def test_ranks_of_a_frequent_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "LEAST", 7)
    rows = packing.pack_documents(docs(spark, ["a b"] * 100 + ["a b c"] * 5), PATH, 16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 105
    assert max(r.offset + r.length for r in rows) <= 16


def test_token_files_empty(spark):
    assert token_files.token_index_of(docs(spark, []), PATH).count() == 0


def test_packing_is_whole_and_gapless(spark):
    capacity = 64
    rows = packing.pack_documents(docs(spark), PATH, capacity, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for k, text in enumerate(TEXTS):
        ids, own = reference_ids(text), sorted(by_doc[k], key=lambda r: r.piece)
        assert np.array_equal(np.concatenate([r.ids for r in own]), ids)
        assert all(r.length == capacity for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own[:-1]]]))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(docs(spark, []), PATH, capacity).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    counts = np.bincount(rng.integers(1, capacity + 1, 400) if seed % 2 else rng.geometric(0.05, 400).clip(1, capacity), minlength=capacity + 1)
    plan = packing.plan_sequences(counts, capacity)
    seen = np.zeros(capacity + 1, int)
    for pattern, many in plan:
        assert sum(s * n for s, n in pattern) <= capacity and many > 0
        for s, n in pattern:
            seen[s] += n * many
    assert np.array_equal(seen, counts)
    bound = -(-int((np.arange(capacity + 1) * counts).sum()) // capacity)
    large = int(counts[capacity // 2 + 1 :].sum())
    assert sum(m for _, m in plan) <= max(bound, large) * 1.03 + 1


def fewest(pieces, capacity):
    """The optimal number of sequences, by search."""
    pieces = sorted(pieces, reverse=True)
    best = len(pieces)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= pieces[k]:
                left = list(rooms)
                left.remove(room)
                place(k + 1, [*left, room - pieces[k]])
        place(k + 1, [*rooms, capacity - pieces[k]])

    place(0, [])
    return best


def test_reduction_goes_past_a_length_it_cannot_fix():
    counts = np.bincount([90, 60, 40, 55, 45, 3, 3, 3, 2], minlength=101)  # 90 has room for three pieces and more
    fixed, rest = packing.reduce_by_dominance(counts, 100)
    assert {pattern for pattern, _ in fixed} >= {((60, 1), (40, 1)), ((55, 1), (45, 1))}
    assert rest[[60, 40, 55, 45]].sum() == 0


def test_reduction_fixes_three_pieces():
    fixed, rest = packing.reduce_by_dominance(np.bincount([50, 50, 30, 30, 19, 19], minlength=101), 100)
    assert (((50, 2),), 1) in fixed
    fixed, rest = packing.reduce_by_dominance(np.bincount([60, 20, 19, 18], minlength=101), 100)
    assert fixed[0] == (((60, 1), (20, 1), (19, 1)), 1) and not rest.any()


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(5)
    kinds = set()
    for _ in range(400):
        capacity = int(rng.integers(8, 40))
        pieces = rng.integers(1 + int(rng.integers(0, capacity // 4 + 1)), capacity + 1, int(rng.integers(2, 10)))
        fixed, rest = packing.reduce_by_dominance(np.bincount(pieces, minlength=capacity + 1), capacity)
        kinds |= {sum(n for _, n in pattern) for pattern, _ in fixed}
        assert fewest(pieces, capacity) == sum(m for _, m in fixed) + fewest(np.repeat(np.arange(capacity + 1), rest), capacity)
    assert kinds == {1, 2, 3}


def test_exact_groups(spark):
    rows = [(5, "Ab C", "x"), (9, "aB c", "y"), (2, "É", None), (3, "é", None), (7, None, "z"), (8, "", "z"), (None, "n", "q"), (4, "x", "w"), (4, "x", "w")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    for support in (0.001, 0.9):
        got = exact_dedup.exact_groups(frame, support).collect()
        assert len(got) == len(rows)
        assert sorted(r.kept for r in got if r.doc_id == 4) == [False, True]  # of two equal rows one stays
        found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in sorted(got, key=lambda r: r.kept)}
        assert found == {5: (9, 2, False), 9: (9, 2, True), 2: (2, 1, True), 3: (3, 1, True), 7: (8, 2, False), 8: (8, 2, True), None: (None, 1, True), 4: (4, 2, True)}
    assert exact_dedup.exact_groups(frame.limit(0)).count() == 0
    none = exact_dedup.exact_groups(spark.createDataFrame([(None, "same"), (None, "Same"), (None, "sAme" * 300_000)], "doc_id long, text string")).collect()
    assert sorted((r.group_size, r.kept) for r in none) == [(1, True), (2, False), (2, True)]
    heavy = exact_dedup.heavy_groups(exact_dedup.digests(frame), 0.25)  # three pairs of ten rows each do not pass a quarter
    assert heavy.count() == 0


def test_an_encoder_that_rests_gives_the_same_ids():
    enc = tokens.Encoder(PATH, 0)
    texts = pa.array([" ".join(f"word{i}" for i in range(200)), "the the of the", None])
    first = [ids.tolist() for _, _, ids, _ in enc.encode(texts)]
    enc.rest(3)
    assert len(enc.kept) == 3
    assert [ids.tolist() for _, _, ids, _ in enc.encode(texts)] == first


def test_packing_with_ids_takes_little_of_a_worker(spark):
    enc = tokens.Encoder(PATH, 0, at_once=60, cache=40)
    texts = [f"word{k} more{k % 7} end{k}" for k in range(200)]
    ranges = list(enc.encode(pa.array(texts)))
    assert all(sum(len(t) for t in texts[a:b]) <= 60 for a, b, _, _ in ranges) and len(enc.kept) <= 40 + 60
    for a, b, ids, at in ranges:
        for k in range(a, b):
            assert np.array_equal(ids[at[k - a] : at[k - a + 1]], reference_ids(texts[k]))
    packed = packing.pack_documents(docs(spark), PATH, with_ids=True)
    assert "MapInArrow" not in packed._jdf.queryExecution().executedPlan().toString()  # ids stay out of Python when places are given
    for r in packed.collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.offset + r.length <= 2048 and len(r.ids) == r.length
