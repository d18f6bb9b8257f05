"""Packs documents into sequences of a fixed number of tokens.

Method: Martello-Toth dominance reduction, then best-fit decreasing. All that decides where a piece goes is its length, so
the plan is made on the histogram of lengths, which has as many entries as the sequence has tokens, whatever the size of
the corpus. The reduction fixes sets of up to three pieces that dominate every alternative for one of them (the piece alone
where nothing fits; a pair that fills the sequence, or whose partner is as large as any two pieces that would fit; three
pieces where no fourth fits and each other pair is dominated). It goes through all lengths, past those that have no such
set, until nothing changes; best-fit decreasing packs what is left. The plan is a list of patterns with multiplicities, a few thousand at most; each
piece finds its place from its rank among the pieces of its length. A length that more pieces share than one
sort takes (``SORTS``) is counted in salted groups, their number taken from the count.

Cases: a null text has the end id alone. Rows that share a doc_id are packed as separate documents. An empty table gives
no rows. Only documents longer than a sequence are cut; their first piece takes the remainder. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.memory import release, releasing
from lodestone.llm.store import written
from lodestone.llm.tokens import encoder

#: Pieces of one length are numbered in sorts of a SORTS-th of all pieces, or of LEAST if that is more.
SORTS, LEAST = 4096, 1000
#: Bytes of text that are encoded at once, and distinct pieces that are kept, where the ids go on: workers of a pipeline have little room.
WITH_IDS = (1 << 20, 200_000)
Pattern = tuple[tuple[int, int], ...]  # (length, how many), in order of place


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if with_ids:
            release()  # what the stages before left
        enc = encoder(tokenizer, end_id, *(WITH_IDS if with_ids else ()))
        for batch in batches:
            for begin, end, ids, at in enc.encode(batch.column("text")):
                n = np.diff(at)  # one at least
                many = -(-n // capacity)
                row = np.repeat(np.arange(end - begin), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                first = (n - (many - 1) * capacity)[row]
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                places = np.concatenate([[0], np.cumsum(length)])  # the pieces lie one after the other
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
                columns = [batch.column("doc_id").slice(begin, end - begin).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
                if with_ids:
                    release()
        if with_ids:  # a step of a pipeline, after which workers do other things
            enc.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), schema)


def _largest_pair(counts: np.ndarray, room: int) -> int:
    """The largest sum of two pieces left that is at most room; 0 if no two fit."""
    there = np.flatnonzero(counts)
    there = there[there < room]
    at = np.searchsorted(there, np.minimum(there, room - there), "right") - 1  # the larger piece's best partner
    at -= (at >= 0) & (there[at] == there) & (counts[there] < 2)
    return int((there + there[at])[at >= 0].max(initial=0))


def _sum_of_smallest(counts: np.ndarray, many: int) -> int:
    """The sum of so many smallest pieces left; a sum past any capacity if there are fewer."""
    there = np.flatnonzero(counts)[:many]
    found = np.repeat(there, np.minimum(counts[there], many))[:many]
    return int(found.sum()) if len(found) == many else len(counts) * many


def _dominating_set(counts: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """The lengths of a set of up to three pieces with j that dominates every set with j that fits; None if none is known."""
    room = capacity - j
    own = counts[: room + 1].copy()
    if j <= room:
        own[j] -= 1
    fits = np.flatnonzero(own)
    if not len(fits):
        return [j]
    k = int(fits[-1])
    if k == room:
        return [j, k]
    if _sum_of_smallest(own, 3) <= room:
        return None  # three more pieces fit, which may be better than any two
    if _largest_pair(own, room) <= k:
        return [j, k]
    # with the largest partner k and the largest piece b beside both, a pair is dominated unless both of it are larger
    # than b and it is larger than k
    beside = own[: room - k + 1].copy()
    if k <= room - k:
        beside[k] -= 1
    b = int(np.flatnonzero(beside)[-1]) if beside.any() else 0
    own[: b + 1] = 0
    return [j, k, b] if b and _largest_pair(own, room) <= k else None


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Martello-Toth: takes dominating sets off the histogram; the sets with multiplicities, and what is left. A length
    that has no such set is left for the next round, and rounds go on until one takes nothing."""
    counts, fixed = counts.copy(), []
    before = -1
    while len(fixed) != before:
        before = len(fixed)
        for j in range(capacity, 0, -1):
            while counts[j] and (chosen := _dominating_set(counts, j, capacity)):
                each = [(size, chosen.count(size)) for size in dict.fromkeys(chosen)]
                m = min(int(counts[size]) // n for size, n in each)  # the set dominates as long as its pieces last
                fixed.append((tuple(each), m))
                for size, n in each:
                    counts[size] -= n * m
    return fixed, counts


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over a histogram, many equal sequences at a time."""
    open_: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left: [pattern, multiplicity]
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        for room in range(size, capacity + 1):
            if not left:
                break
            each = room // size
            groups, open_[room] = open_[room], []
            for pattern, many in groups:
                full = min(many, left // each)
                if full:
                    open_[room - each * size].append([(*pattern, (size, each)), full])
                    left -= full * each
                    many -= full
                if many and 0 < left < each:
                    open_[room - left * size].append([(*pattern, (size, left)), 1])
                    left, many = 0, many - 1
                if many:
                    open_[room].append([pattern, many])
        each = capacity // size
        if left // each:
            open_[capacity - each * size].append([((size, each),), left // each])
        if left % each:
            open_[capacity - left % each * size].append([((size, left % each),), 1])
    return [(pattern, many) for groups in open_ for pattern, many in groups]


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(plan: list[tuple[Pattern, int]], capacity: int) -> list[np.ndarray | None]:
    """By length: rows of first rank, pieces per sequence, first sequence, place in it; sorted by first rank."""
    slots: list[list] = [[] for _ in range(capacity + 1)]
    used, base = np.zeros(capacity + 1, np.int64), 0
    for pattern, many in plan:
        place = 0
        for size, each in pattern:
            slots[size].append((used[size], each, base, place))
            used[size] += each * many
            place += size * each
        base += many
    return [np.array(s, np.int64) if s else None for s in slots]


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces that have doc_id, piece and length (1 to capacity). The pieces are read three
    times, so give a written table."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # capacity rows at most
        counts[row["length"]] = row["count"]
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_sequences(counts, capacity), capacity))
    # a length that many pieces share is dealt to as many salts as its sorts need
    most = max(LEAST, int(counts.sum()) // SORTS)
    shared = [int(size) for size in np.flatnonzero(counts > most)]
    salts = [F.lit(x) for size in shared for x in (size, int(-(-counts[size] // most)))]
    salt = F.pmod(F.hash("doc_id", "piece"), F.coalesce(F.create_map(*salts)[F.col("length").cast("int")], F.lit(1))) if salts else F.lit(0)
    salted = pieces.withColumn("salt", salt)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    if salts:
        own = salted.where(F.col("length").isin(shared)).groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = own.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
        ranked = ranked.join(F.broadcast(before), ["length", "salt"], "left")  # 2 * SORTS rows at most
        ranked = ranked.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(at):
                size = int(length[at[0]])
                table = slots.value[size]
                first, each, base, start = table[np.searchsorted(table[:, 0], rank[at], "right") - 1].T
                sequence[at] = base + (rank[at] - first) // each
                offset[at] = start + (rank[at] - first) % each * size
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    placed = ranked.select(*pieces.columns, place.asNondeterministic()("length", F.col("rank").cast("long")).alias("place"))
    return placed.select(*pieces.columns, "place.sequence_id", "place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenizes whole texts once, cuts and packs: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
