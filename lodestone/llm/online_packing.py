"""Packs documents into sequences as they come, with next to no padding.

Method: sum-of-squares online packing. A task keeps an array of levels: how many of its windows are filled to each level below the
capacity. A document goes to the level (or to a new window) for which the sum of the squared counts grows least, the fullest of equal ones, so that no level gathers
windows that nothing fills. Documents longer than a window give full windows first, and what is left of them is placed.

A sequence whose length is a power of two is not padded, and documents may be cut, so what is open at the end of a task is closed without
padding: windows at a power of two stay as they are; the others are poured together into full windows, and what is left over is cut into
powers of two. The same is done, but that what is left over stays open, whenever more than ``most_open`` windows are open (documents of which no two fit together would open
one each), which bounds what a task keeps in memory: most_open times the capacity ids.

Tasks pack the rows of their own partitions, in the order of the scan, so nothing is shuffled and a task that is run again gives the same
pieces. Each leaves as many sequences that are not full as its count of open windows at powers of two, and eleven more at most.

Cases: a null text has the end id alone. Rows that share a doc_id, or have none, are packed as separate documents. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Sequence ids of a partition begin at its number times this.
IDS = 1 << 40
Piece = tuple[int | None, int, int, np.ndarray]  # doc_id, tokens of the document, start, ids
Window = list[Piece]


class Levels:
    """The windows of a task that are partly filled, by level."""

    def __init__(self, capacity: int):
        self.capacity, self.open = capacity, 0
        self.windows: list[list[Window]] = [[] for _ in range(capacity + 1)]
        self.grows = np.ones(capacity + 1, np.int64)  # of the squares, where one more window comes to the level
        self.grows[capacity] = 0
        self.shrinks = np.full(capacity + 1, -(1 << 40), np.int64)  # where one leaves it; there must be one
        self.shrinks[0] = 0  # a new window

    def _count(self, level: int) -> None:
        n = len(self.windows[level])
        self.grows[level] = 2 * n + 1
        self.shrinks[level] = 2 * n - 1 if n else -(1 << 40)

    def put(self, level: int, window: Window) -> None:
        self.windows[level].append(window)
        self.open += 1
        self._count(level)

    def take(self, level: int) -> Window:
        self.open -= 1
        window = self.windows[level].pop()
        self._count(level)
        return window

    def best(self, size: int) -> int:
        """The level to which a piece goes; 0 for a new window."""
        growth = self.grows[size:] - self.shrinks[: self.capacity - size + 1]
        return len(growth) - 1 - int(np.argmin(growth[::-1]))

    def place(self, piece: Piece) -> Window | None:
        """Puts a piece, shorter than a window, where it fits best; the window if that fills it."""
        size = len(piece[3])
        level = self.best(size)
        window = self.take(level) if level else []
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.put(level + size, window)
        return None

    def close(self) -> Iterator[Window]:
        """Takes all windows: those at a power of two as they are, the others poured together, the fullest first; the last may be short."""
        poured: Window = []
        room = self.capacity
        for level in range(self.capacity - 1, 0, -1):
            while self.windows[level]:
                window = self.take(level)
                if level & (level - 1) == 0:
                    yield window
                    continue
                for doc, tokens, start, ids in window:
                    while len(ids) >= room:
                        yield [*poured, (doc, tokens, start, ids[:room])]
                        start, ids, poured, room = start + room, ids[room:], [], self.capacity
                    if len(ids):
                        poured.append((doc, tokens, start, ids))
                        room -= len(ids)
        if poured:
            yield poured


def powers(window: Window) -> Iterator[Window]:
    """A window cut into windows whose lengths are powers of two, the longest first."""
    left = sum(len(ids) for *_, ids in window)
    room = 1 << left.bit_length() >> 1
    own: Window = []
    for doc, tokens, start, ids in window:
        while len(ids):
            own.append((doc, tokens, start, ids[:room]))
            n = len(own[-1][3])
            start, ids, room, left = start + n, ids[n:], room - n, left - n
            if not room:
                yield own
                own, room = [], 1 << left.bit_length() >> 1


def packed(documents: Iterator[list[tuple[int | None, np.ndarray]]], capacity: int, most_open: int) -> Iterator[list[Window]]:
    """The windows of a task's documents (lists of doc_id and ids), as they are closed; a list for each list."""
    levels = Levels(capacity)
    for some in documents:
        out: list[Window] = []
        for doc, ids in some:
            whole = len(ids) // capacity * capacity
            out += [[(doc, len(ids), at, ids[at : at + capacity])] for at in range(0, whole, capacity)]
            if whole < len(ids):
                full = levels.place((doc, len(ids), whole, ids[whole:].copy()))
                if full:
                    out.append(full)
            if levels.open > most_open:
                *closed, last = levels.close()
                out += closed
                size = sum(len(x[3]) for x in last)
                if size < capacity:
                    levels.put(size, last)
                else:
                    out.append(last)
        yield out
    yield [w for window in levels.close() for w in powers(window)]


def pack_online(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, most_open: int = 1024) -> DataFrame:
    """doc_id, start, length and ids_crc32 of each piece, doc_tokens of its document, and sequence_id and offset of its place. The capacity is a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(tokenizer, end_id), TaskContext.get().partitionId() * IDS

        def documents() -> Iterator[list]:
            for batch in batches:
                names = batch.column("doc_id").to_pylist()
                for begin, end, ids, at in enc.encode(batch.column("text")):
                    yield [(names[begin + k], ids[at[k] : at[k + 1]]) for k in range(end - begin)]

        for windows in packed(documents(), capacity, most_open):
            rows = []
            for window in windows:
                offset = 0
                for doc, tokens, start, ids in window:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset))
                    offset += len(ids)
                sequence += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
