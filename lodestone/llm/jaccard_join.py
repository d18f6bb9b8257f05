"""Jaccard self-join over word n-grams, exact, with the groups of linked documents.

Method: universe-partition pigeonhole. Sets are taken in size bands, each the threshold's share wider than the one before,
so that a pair that can link is of one band or of two neighbours; for each such pair of bands a scheme says into how many
segments the token universe is cut by a hash. A set's tokens in a segment make its key (an order-free sum). If two sets
differ in H tokens at most, and the segments are allotted more than H in all (1 for a segment indexed as it is, 2 for one
indexed with its one-deletion neighbourhood, whose difference must then be 2 to be missed), some allotted segment matches.
``scheme`` chooses both by expected cost: small sets take deletions, larger ones more plain segments than H + 1.

With spare segments, two sets that link agree in more segments than are spare. Short lists give their pairs with the
number of lists that show them, and a pair shown by fewer lists than that, less the long lists that either set is in, is no
candidate. This is the second, per-set allocation, by the cost that the lists turn out to have: a set may skip as many
long lists, which unlike sets have in common, as there are spare segments. Only two sets with more of them can have a link
that no short list shows.

Equal sets are one node from the start. All pairs of a long list would grow with its square, so such sets first give pairs
with one hub, the one that is in most long lists. What the verified hub links leave apart is compared without making pairs:
nodes that can link at all meet by hub, in blocks of bounded size, where exact counts of common tokens come from
matrix products, and only links between groups come out. A node cannot link if its tokens occur nowhere else in long lists
to such an extent that no partner of its lists can reach the threshold. That leaves out no link. Every link is verified on
whole token sets, in 64-bit hashes of shingles; sets are equal when 128 bits of their signatures are. Every join is shuffled, so
that no table is whole on the driver.

Cases: null, empty and blank texts have an empty set and link with nothing. Texts of fewer than k words have one shingle,
the whole sequence. A null doc_id is smaller than any other and then gives a null component_id. Repeated rows are
equal sets, hence one group. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.memory import release, releasing
from lodestone.llm.store import shuffled, written
from lodestone.llm.words import mix, runs_hash, within_row, word_slices

#: Stands for a null doc_id inside the jobs.
NULL_ID = -(1 << 63)
#: Lists of more nodes are long.
LONG = 8
#: Bounds of a block of nodes that are compared with each other.
BLOCK_NODES, BLOCK_TOKENS = 1000, 2_000_000
#: Tokens, and index entries, of one group on average.
GROUP_TOKENS = 2_000_000
#: Signatures that different sets share; more of them say that the hash is broken.
MOST_SHARED = 10_000
_TOKEN, _CHECK = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def band_starts(percent: int, upto: int) -> np.ndarray:
    """Least set size of each band; sizes that can link differ by one band at most."""
    starts = [1]
    while starts[-1] <= upto:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
    return np.array(starts, np.int64)


def most_differing(percent: int, largest: int) -> int:
    """Most tokens in which two sets of at most this size differ and link: a + c - 2i, where 100 i >= percent (a + c - i)."""
    return max(total - 2 * -(-percent * total // (100 + percent)) for total in range(max(0, 2 * largest - 3), 2 * largest + 1))


@lru_cache(maxsize=None)
def scheme(percent: int, largest: int) -> tuple[int, bool, int]:
    """Number of segments, whether they have one-deletion neighbourhoods, and how many segments are spare, by the expected
    number of keys of a set plus what the likely empty segments would bring."""
    h = most_differing(percent, largest)
    empty = lambda m: 20.0 * m * np.exp(-largest / m) if m > 1 else 0.0
    by_deletion = (h + 2) // 2
    plain = h + 1 + max(1, (h + 1) // 2) if h else 1
    if h and by_deletion + largest + empty(by_deletion) < plain + empty(plain):
        return by_deletion, True, 0
    return plain, False, plain - (h + 1)


def _slice_sets(w, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the rows of a slice: row and hash, sorted by both."""
    counts = np.diff(w.first)
    runs = runs_hash(w.code, k)
    use = within_row(w.first, k)
    row, token = w.row[: len(runs)][use], runs[use]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = [mix(runs_hash(w.code[w.first[r] : w.first[r + 1]], counts[r]) + np.uint64(counts[r])) for r in short]
        row, token = np.concatenate([row, short]), np.concatenate([token, *own])
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    if len(row):
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (token[1:] != token[:-1])])
        row, token = row[new], token[new]
    return row, token


def _sums(at: np.ndarray, token: np.ndarray, salt: np.uint64) -> np.ndarray:
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(token + salt), dtype=np.uint64)])
    return sums[at[1:]] - sums[at[:-1]]


def _signatures(row: np.ndarray, token: np.ndarray, rows: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, signature (of so many bits) and a second, independent signature of each set."""
    n = np.bincount(row, minlength=rows)
    at = np.concatenate([[0], np.cumsum(n)])
    size = mix(n.astype(np.uint64))
    return n, (mix(_sums(at, token, _TOKEN) ^ size) >> np.uint64(64 - bits)).view(np.int64), mix(_sums(at, token, _CHECK) ^ size).view(np.int64)


def _nodes(row: np.ndarray, token: np.ndarray, rows: int, shared: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and node of each set: its signature, or both in one where different sets share the first."""
    n, sig, check = _signatures(row, token, rows, bits)
    return n, np.where(np.isin(sig, shared), sig ^ check, sig)


#: Bytes of text whose sets are made at once; workers give memory back after each.
SLICE = 1 << 20


def _base(k: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_slices(batch.column("text"), lower=True, at_once=SLICE):
                n, sig, check = _signatures(*_slice_sets(w, k), w.end - w.begin, bits)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.begin, w.end - w.begin), pa.array(n.astype(np.int64)), pa.array(sig), pa.array(check)], ["doc_id", "n_shingles", "sig", "check"])
                release()

    return run


ENTRY = np.dtype([("key", "<u4"), ("scheme", "u1"), ("n", "<u4"), ("node", "<i8")])


def _scheme_entries(row, token, n, sig, percent: int, starts: np.ndarray):
    """Keys of all sets under the schemes of their band with the next and with the one before."""
    band = np.searchsorted(starts, n, "right") - 1
    value = mix(token + _TOKEN)
    top = mix(token ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)
    for low in np.unique(np.concatenate([band[n > 0], band[n > 0] - 1])):
        if low < 0:
            continue
        m, deletion, _ = scheme(percent, int(starts[min(low + 2, len(starts) - 1)]) - 1)
        rows = np.flatnonzero((n > 0) & ((band == low) | (band == low + 1)))
        if not len(rows):
            continue
        index = np.full(len(n), -1)
        index[rows] = np.arange(len(rows))
        use = index[row] >= 0
        cell = index[row[use]] * m + ((top[use] * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(len(rows) * m, np.uint64)
        np.add.at(sums, cell, value[use])
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64((int(low) + 1) << 32))
        yield mix(sums + np.tile(salt, len(rows))), np.full(len(sums), low, np.uint8), np.repeat(rows, m)
        if deletion:
            yield mix(sums[cell] - value[use] + np.tile(salt, len(rows))[cell]), np.full(len(cell), low, np.uint8), rows[cell // m]


def _entries(k: int, percent: int, groups: int, shared: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_slices(batch.column("text"), lower=True, at_once=SLICE):
                row, token = _slice_sets(w, k)
                n, sig = _nodes(row, token, w.end - w.begin, shared, bits)
                _, once = np.unique(sig, return_index=True)  # equal sets of a slice are indexed once
                keep = np.zeros(len(n), bool)
                keep[once] = True
                use = keep[row]
                row, token, n = row[use], token[use], np.where(keep, n, 0)
                if not len(row):
                    continue
                starts = band_starts(percent, int(n.max()))
                parts = list(_scheme_entries(row, token, n, sig, percent, np.append(starts, [-(-starts[-1] * 100 // percent)])))
                key = np.concatenate([p[0] for p in parts])
                rec = np.zeros(len(key), ENTRY)
                rec["key"], rec["scheme"] = key & np.uint64(0xFFFFFFFF), np.concatenate([p[1] for p in parts])
                own = np.concatenate([p[2] for p in parts])
                rec["n"], rec["node"] = n[own], sig[own]
                group = ((key >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                cuts = np.flatnonzero(np.diff(group[order])) + 1
                blobs = [(int(group[p[0]]), rec[p].tobytes()) for p in np.split(order, cuts)]
                yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], ["group", "blob"])
                release()

    return run


#: kind 0: nodes a and b are in so many (weight) short lists of a scheme; kind 1: the long list a, which stands for so many
#: equal ones, has node b. With the number of spare segments of the scheme.
LISTS = "kind int, a long, b long, weight int, scheme int, spare int"


def _lists(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rec = np.concatenate([np.frombuffer(b, ENTRY) for b in rows["blob"]])
        rec = rec[np.lexsort((rec["node"], rec["scheme"], rec["key"]))]
        other = np.concatenate([[True], (rec["key"][1:] != rec["key"][:-1]) | (rec["scheme"][1:] != rec["scheme"][:-1])])
        keep = other | np.concatenate([[True], rec["node"][1:] != rec["node"][:-1]])
        rec, other = rec[keep], other[keep]
        head = np.flatnonzero(other)
        size = np.diff(np.append(head, len(rec)))
        starts = band_starts(percent, int(rec["n"].max()) * 2 + 2)
        spare = np.array([scheme(percent, int(starts[low + 2]) - 1)[2] for low in range(int(rec["scheme"].max()) + 1)], np.int64)
        out = []
        a, b, low = [], [], []
        for many in range(2, LONG + 1):
            first = head[size == many]
            for i in range(many):
                for j in range(i + 1, many):
                    x, y = rec[first + i], rec[first + j]
                    use = 100 * np.minimum(x["n"], y["n"]).astype(np.int64) >= percent * np.maximum(x["n"], y["n"]).astype(np.int64)
                    a.append(x["node"][use])
                    b.append(y["node"][use])
                    low.append(x["scheme"][use].astype(np.int64))
        if a:
            pairs, count = np.unique(np.stack([np.concatenate(a), np.concatenate(b), np.concatenate(low)], 1), axis=0, return_counts=True)
            out.append(pd.DataFrame({"kind": 0, "a": pairs[:, 0], "b": pairs[:, 1], "weight": count, "scheme": pairs[:, 2], "spare": spare[pairs[:, 2]]}))
        long = size > LONG
        part, which = rec[np.repeat(long, size)], np.repeat(np.arange(int(long.sum())), size[long])
        if len(part):
            # lists of the same nodes, as near copies have many of, are one list
            sums = np.zeros(int(long.sum()), np.uint64)
            np.add.at(sums, which, mix(part["node"].view(np.uint64) + part["scheme"].astype(np.uint64)))
            _, once, weight = np.unique(sums, return_index=True, return_counts=True)
            weights = np.zeros(len(sums), np.int64)
            weights[once] = weight
            use = weights[which] > 0
            part, which = part[use], which[use]
            lists = which.astype(np.int64) + (int(rows["group"].iloc[0]) << 32)
            out.append(pd.DataFrame({"kind": 1, "a": lists, "b": part["node"], "weight": weights[which], "scheme": part["scheme"], "spare": spare[part["scheme"]]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("kind", "a", "b", "weight", "scheme", "spare")})

    return run


def _sets(k: int, shared: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in word_slices(batch.column("text"), lower=True, at_once=SLICE):
                row, token = _slice_sets(w, k)
                at = np.searchsorted(row, np.arange(w.end - w.begin + 1))
                node = batch.column("node").slice(w.begin, w.end - w.begin)
                own = pa.array(_nodes(row, token, w.end - w.begin, shared, bits)[1] == node.to_numpy())  # other rows may share the doc_id
                blobs = pa.array([token[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([node.filter(own), blobs.filter(own)], ["node", "tokens"])
                release()

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                links.append(100 * both >= percent * (len(s) + len(t) - both))
            use = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(use), batch.column("b").filter(use)], ["a", "b"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(shuffled(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))), "a").join(shuffled(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(releasing(_verified(percent)), "a long, b long")


def _block_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between nodes of different labels, within one block or between two; one for each pair of labels."""
        rows = rows.drop_duplicates("node").sort_values("own", kind="stable")
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        sets = [np.frombuffer(x, "<u8") for x in rows["tokens"]]
        node, label = rows["node"].to_numpy(), rows["label"].to_numpy()
        left = np.flatnonzero(rows["own"].to_numpy() == lo)
        right = left if lo == hi else np.flatnonzero(rows["own"].to_numpy() == hi)
        n = np.array([len(x) for x in sets], np.int64)
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        token = token[count > 1]  # a token of one node is common to no two
        both = np.zeros((len(left), len(right)), np.float32)
        for k in range(0, len(token), 4096):
            part = token[k : k + 4096]
            have = np.zeros((len(sets), len(part)), np.float32)
            for i, own in enumerate(sets):  # sets are sorted
                own = own[np.searchsorted(own, part[0]) : np.searchsorted(own, part[-1], "right")]
                at = np.searchsorted(part, own)
                have[i, at[part[np.minimum(at, len(part) - 1)] == own]] = 1
            both += have[left] @ have[right].T
        both = both.astype(np.int64)
        linked = (100 * both >= percent * (n[left][:, None] + n[right][None] - both)) & (label[left][:, None] != label[right][None])
        x, y = np.nonzero(linked)
        x, y = left[x], right[y]
        _, once = np.unique(np.stack([np.minimum(label[x], label[y]), np.maximum(label[x], label[y])], 1), axis=0, return_index=True)
        return pd.DataFrame({"a": node[x[once]], "b": node[y[once]]})

    return run


def _rare(groups: int, node_parts: int):
    """By group of tokens: how many of each node's tokens no other node has."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column("tokens")]
            if not sets:
                continue
            rec = np.zeros(sum(map(len, sets)), [("token", "<u8"), ("node", "<i8")])
            rec["token"], rec["node"] = np.concatenate(sets), np.repeat(nodes, [len(s) for s in sets])
            # a token that two nodes here have is in no node alone: one entry of node 0 and count 2 says so
            token, first, count = np.unique(rec["token"], return_index=True, return_counts=True)
            group = (mix(token) % np.uint64(groups)).astype(np.int64)
            node = np.where(count > 1, 0, rec["node"][first])
            out = np.zeros(len(token), [("token", "<u8"), ("node", "<i8"), ("many", "u1")])
            out["token"], out["node"], out["many"] = token, node, count > 1
            order = np.argsort(group, kind="stable")
            blobs = [(int(group[p[0]]), out[p].tobytes()) for p in np.split(order, np.flatnonzero(np.diff(group[order])) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], ["group", "blob"])

    def alone(rows: pd.DataFrame) -> pd.DataFrame:
        """The nodes of the tokens that one node has, dealt to parts by node."""
        rec = np.concatenate([np.frombuffer(b, [("token", "<u8"), ("node", "<i8"), ("many", "u1")]) for b in rows["blob"]])
        _, first, many = np.unique(rec["token"], return_index=True, return_counts=True)
        rec = rec[first[many == 1]]
        node = np.sort(rec["node"][rec["many"] == 0])
        part = (mix(node.view(np.uint64)) % np.uint64(node_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        blobs = [(int(part[p[0]]), node[p].tobytes()) for p in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(p)]
        return pd.DataFrame(blobs, columns=["part", "blob"])

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        node, n = np.unique(np.concatenate([np.frombuffer(b, "<i8") for b in rows["blob"]]), return_counts=True)
        return pd.DataFrame({"node": node, "rare": n.astype(np.int64)})

    return deal, alone, count


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the least doc_id it reaches by links of at least
    percent / 100 Jaccard similarity between sets of k-word shingles (A-Z lower-cased). bits: of the signatures that name sets."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = written(rows.mapInArrow(releasing(_base(k, bits)), "doc_id long, n_shingles long, sig long, check long"), "sets")
    equal = written(base.where("n_shingles > 0").groupBy("sig", "check").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "equal")
    # signatures that different sets share are hardly ever any: a few in 10^10 sets
    shared = np.array(sorted(r["sig"] for r in equal.groupBy("sig").count().where("count > 1").select("sig").limit(MOST_SHARED + 1).collect()), np.int64)
    if len(shared) > MOST_SHARED:
        raise ValueError("more signatures are shared by different sets than a 64-bit hash can explain")
    node = F.when(F.col("sig").isin(shared.tolist()), F.col("sig").bitwiseXOR(F.col("check"))).otherwise(F.col("sig"))
    nodes = equal.select(node.alias("node"), "doc_id", "n")
    # groups are as many as keep their size, whatever the corpus has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens, sets_ = equal.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(4 * parts, -(-(tokens + 30 * sets_) // GROUP_TOKENS))
    node_parts = max(64, groups // 4)
    lists = rows.mapInArrow(releasing(_entries(k, percent, groups, shared, bits)), "group int, blob binary").groupBy("group").applyInPandas(_lists(percent), LISTS)
    lists = written(lists, "lists")
    long = lists.where("kind = 1").select(F.col("a").alias("list"), F.col("b").alias("node"), "weight", "scheme", "spare")
    # the sets that short lists may not do for
    own = Window.partitionBy("node", "scheme")
    bound = long.withColumn("long", F.sum("weight").over(own)).where("long > spare").select("list", "node", "weight")
    members = bound.groupBy("node").agg(F.sum("weight").alias("degree")).join(shuffled(nodes), "node").select("node", "degree", "n")
    bound = written(bound.join(shuffled(members), "node"), "bound")
    members = bound.select("node", "n").distinct()
    hubs = bound.groupBy("list").agg(F.max(F.struct("degree", F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("h"), F.min("n").alias("least")).select("list", "h.hub", "h.hub_n", "least")
    hubs = written(hubs, "hubs")
    stars = bound.join(shuffled(hubs), "list").where(f"node != hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    shown = lists.where("kind = 0").groupBy("a", "b", "scheme").agg(F.sum("weight").alias("shown"), F.first("spare").alias("spare"))
    skipped = long.groupBy("node", "scheme").agg(F.sum("weight").alias("skipped"))
    for side in ("a", "b"):
        shown = shown.join(shuffled(skipped.select(F.col("node").alias(side), "scheme", F.col("skipped").alias(f"skipped_{side}"))), [side, "scheme"], "left")
    enough = F.greatest(F.lit(1), F.col("spare") - F.least(F.coalesce("skipped_a", F.lit(0)), F.coalesce("skipped_b", F.lit(0))))
    pairs = shown.where(F.col("shown") >= enough).select("a", "b").union(stars.select(F.least("node", "hub"), F.greatest("node", "hub"))).distinct()
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct().join(shuffled(nodes), "node").select("doc_id", "node")
    sets = written(rows.join(shuffled(wanted), "doc_id").select("node", "text").mapInArrow(releasing(_sets(k, shared, bits)), "node long, tokens binary"), "tokens")
    links = written(_verify(pairs, sets, percent), "links")
    labels = components(links)
    # what hubs left apart in long lists
    deal, alone, count = _rare(groups, node_parts)
    rare = sets.join(shuffled(members.select("node")), "node", "left_semi").mapInArrow(releasing(deal), "group int, blob binary").groupBy("group").applyInPandas(alone, "part int, blob binary").groupBy("part").applyInPandas(count, "node long, rare long")
    near = bound.join(shuffled(hubs.select("list", "least")), "list").groupBy("node").agg(F.min("least").alias("least"))
    able = members.join(shuffled(near), "node").join(shuffled(rare), "node", "left").withColumn("cap", F.col("n") - F.coalesce("rare", F.lit(0)))
    # the best partner is as large as the tokens that can be shared, or the least that its lists have
    able = able.where(f"100 * cap >= {percent} * (n + greatest(cap, least) - cap)").select("node", "cap")
    able = able.join(shuffled(labels), "node", "left").select("node", "cap", F.coalesce("label", "node").alias("label"))
    left = written(bound.select("list", "node", "n").join(shuffled(able), "node").join(shuffled(hubs.select("list", "hub")), "list").select("hub", "node", "n", "label").distinct(), "left")
    mixed = left.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("tokens")).where("lo != hi")
    blocks = F.greatest(F.ceil(F.col("nodes") / BLOCK_NODES), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    left = left.join(shuffled(mixed.select("hub", blocks.alias("blocks"))), "hub").withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("hub", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "label").join(shuffled(sets), "node")
    more = written(left.groupBy("hub", "lo", "hi").applyInPandas(_block_links(percent), "a long, b long"), "links")
    labels = components(links.union(more)) if more.limit(1).count() else labels
    named = nodes.join(shuffled(labels), "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = named.join(shuffled(least), "label").select("node", "component_id")
    out = base.where("n_shingles > 0").withColumn("node", node).join(shuffled(found), "node").select("doc_id", "n_shingles", "component_id")
    out = out.union(base.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_shingles", F.nullif("component_id", F.lit(NULL_ID)).alias("component_id"))
