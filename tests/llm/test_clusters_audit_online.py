"""Centroid clustering, the filter audit and online packing against brute force, with odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm import clusters, filter_audit, online_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


# centroids


def brute_clusters(rows, k, rounds, size, scale, seed):
    kept = [(i, [int(np.floor(np.float64(x) * scale)) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and np.isfinite(x) for x in e)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for i, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))][:k]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        own = defaultdict(list)
        for (_, v), (_, j) in zip(kept, assign()):
            own[j].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(col) // len(vs) for col in zip(*vs)]
    found, most = assign(), (1 << 63) - 1
    sums = Counter()
    for d, j in found:
        sums[j] += min(d, most)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, min(d, most), min(sums[j], most), min(sum(sums.values()), most), digest[j]) for (i, _), (d, j) in zip(kept, found)), key=str)


def vectors_of(kind, rng):
    n, size = 300, 8
    x = {"spread": rng.normal(0, 1, (n, size)), "grid": rng.integers(-2, 3, (n, size)) / 1024, "copies": np.repeat(rng.normal(0, 1, (5, size)), 60, 0), "far": rng.normal(0, 1, (n, size)) * 10.0 ** rng.integers(0, 12, (n, 1)), "vast": rng.normal(0, 1, (n, size)) * 1e30}[kind]
    rows = [(int(i), [float(y) for y in v]) for i, v in enumerate(x.astype(np.float32))]
    return rows + [(None, rows[0][1]), (7, rows[1][1]), (7, rows[2][1]), (900, None), (901, []), (902, [1.0] * 7), (903, [float("nan")] * 8), (904, [float("inf")] + [0.0] * 7), (905, [None] + [0.0] * 7), (906, [-0.0] * 8)]


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "far", "vast"])
def test_clusters_equal_brute_force(spark, kind):
    rows = vectors_of(kind, np.random.default_rng(5))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int")
    got = clusters.cluster(df, k=6, rounds=4, size=8, scale=1024, seed=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 6, 4, 8, 1024, 3)


def test_clusters_of_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert clusters.cluster(spark.createDataFrame([], schema), size=2).collect() == []
    assert clusters.cluster(spark.createDataFrame([(1, [1.0])], schema), size=2).collect() == []
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5])]
    got = clusters.cluster(spark.createDataFrame(rows, schema), size=2)
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, 8, 10, 2, 1024, 3)


def test_screen_never_loses_the_nearest():
    """Vectors on the border of two centroids, whose float32 products cannot tell them apart."""
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 20), 1 << 20, 64)
    b = a + rng.integers(-1, 2, 64)
    centroids = [[int(x) for x in c] for c in (b, a, a, a + 1)]
    v = np.array([a + rng.integers(-3, 4, 64) for _ in range(500)], float)
    want = [min((sum((int(x) - y) ** 2 for x, y in zip(row, c)), j) for j, c in enumerate(centroids))[1] for row in v]
    screen = clusters.Screen(centroids)
    assert screen.nearest(v).tolist() == want
    assert (screen.candidates(v).sum(1) > 1).all()  # the screen says that it cannot tell
    apart = np.array([[0.0] * 64, [4096.0] * 64])
    assert clusters.Screen([[0] * 64, [4096] * 64]).candidates(apart).tolist() == [[True, False], [False, True]]


@pytest.mark.parametrize("x", [0, 1, -1, 1 << 40, -(1 << 40), (1 << 199) + 12345, -(1 << 199) - 12345])
def test_limbs(x):
    assert sum(y << clusters.LIMB * k for k, y in enumerate(clusters._limbs(x))) == x


# filter audit


def brute_audit(docs, labels):
    def fails(doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in docs)
        return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]

    rows = []
    for doc, text, part in docs:
        own = [x for x in labels if x[0] == doc and doc is not None]
        rows.append((part or "", dict(zip("ABCDE", fails(doc, text or ""))), any(q == 1 for _, q, _ in own), any(t == 1 for *_, t in own)))
    out = []
    for part in {r[0] for r in rows}:
        total = Counter()
        lines = []
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, x in enumerate(order, 1):
                gone, gone_before = [r for r in left if r[1][x]], [r for r in rows if r[0] == part and r[1][x] and not any(r is y for y in left)]
                left = [r for r in left if not r[1][x]]
                total[x] += len(gone)
                lines.append(["".join(order), step, len(left), len(gone), len(gone_before), sum(r[0] == part and r[1][x] and sum(r[1].values()) == 1 for r in rows), sum(r[2] for r in gone), sum(r[3] for r in gone), x])
        out += [(part, *line[:-1], total[line[-1]]) for line in lines]
    return sorted(out)


def audit_docs():
    word = [f"w{i}" for i in range(260)]
    long = " ".join(word)
    texts = ["", None, "short", long, long, " ".join(word[:100] * 3), " ".join(word[:99] * 3).replace("w", "W"), long.replace("w1 ", "w# "), "É" * 500 + " A", " ".join(word[:200]), " ".join(word[:199]), "\t\n\x0b" + long + "\x0d\x0c", "a\x85b c\xa0d", "X" * 2 + "y" * 98, "X" * 3 + "y" * 98, long + " #", ("$ " * 300), "x" * 50_000]
    parts = ["s0", None, "", "s1", "s'2"]
    docs = [(i, t, parts[i % 5]) for i, t in enumerate(texts)] + [(2, "short", "s0"), (3, long, "s1"), (None, long, "s1"), (None, "only nulls", None), (None, "only nulls", "s0"), (50, "only nulls", "s0"), (51, "", "s9")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(12)] + [(0, 1, None), (1, None, None), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark):
    docs, labels = audit_docs()
    d = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, source string, n int, part string")
    la = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, flags int")
    assert sorted(map(tuple, filter_audit.audit(d, la).collect())) == brute_audit(docs, labels)


def test_audit_of_empty_tables(spark):
    d, la = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
    assert filter_audit.audit(spark.createDataFrame([], d), spark.createDataFrame([], la)).collect() == []
    got = filter_audit.audit(spark.createDataFrame([(1, "a", "s")], d), spark.createDataFrame([], la)).collect()
    assert sorted(map(tuple, got)) == brute_audit([(1, "a", "s")], [])


# online packing


def brute_levels(sizes, capacity):
    """The level to which each size goes, by trying all and summing all squares."""
    counts, out = Counter(), []
    for size in sizes:
        def squares(level):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < capacity:
                after[level + size] += 1
            return sum(n * n for n in after.values())

        best = min((h for h in range(capacity - size + 1) if not h or counts[h] > 0), key=lambda h: (squares(h), -h))
        out.append(best)
        counts[best] -= bool(best)
        counts[best + size] += best + size < capacity
    return out


@pytest.mark.parametrize("seed", range(4))
def test_levels_minimise_squares(seed):
    rng = np.random.default_rng(seed)
    capacity = 32
    sizes = rng.integers(1, capacity, 300).tolist() if seed else [16] * 40 + [8] * 40 + [31, 1] * 20 + [20] * 40
    levels, got = online_packing.Levels(capacity), []
    for size in sizes:
        got.append(levels.best(size))
        levels.place((0, size, 0, np.zeros(size, np.uint32)))
    assert got == brute_levels(sizes, capacity)


def check_pieces(rows, texts, capacity, end_id):
    """Every id in one piece, sequences gapless and unpadded; ids as the tokenizer gives them."""
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(texts)
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.length > 0
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0  # the capacity or another power of two


@pytest.mark.parametrize("most_open", [1024, 3])
def test_online_packing_keeps_every_id(spark, most_open):
    rng = np.random.default_rng(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = [(i, " ".join(rng.choice(words, rng.integers(1, 90)))) for i in range(300)] + [(-1, None), (-2, ""), (-3, "long " * 5000), (-4, "x" * 9000), (None, "no id"), (301, "<|endoftext|> ok")]
    df = spark.createDataFrame([(*t, 5, "c", 1) for t in texts], "doc_id long, text string, length int, sequence_id string, ids int")
    rows = online_packing.pack_online(df.repartition(3), PATH, capacity=64, end_id=1, most_open=most_open).collect()
    check_pieces(rows, texts, 64, 1)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(n < 64 for n in used.values()) <= (3 * 12 + 100 if most_open == 1024 else 3 * 20)


def test_windows_that_nothing_fills_are_poured(spark):
    """Documents of which no two fit together, far more than may be open."""
    docs = [[(i, np.full(40, i, np.uint32)) for i in range(1000)]]
    windows = [w for some in online_packing.packed(iter(docs), 64, 10) for w in some]
    assert sum(len(x[3]) for w in windows for x in w) == 40_000
    assert all(sum(len(x[3]) for x in w) == 64 for w in windows[:-1]) and len(windows) == 40_000 // 64


def test_online_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert online_packing.pack_online(empty, PATH).collect() == []
    repeated = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = online_packing.pack_online(repeated.coalesce(1), PATH, capacity=4).collect()
    assert sorted((r.start, r.length, r.sequence_id, r.offset) for r in rows) == [(0, 1, 0, 3), (0, 3, 0, 0), (1, 2, 1, 0)]
    with pytest.raises(ValueError):
        online_packing.pack_online(empty, PATH, capacity=100)
