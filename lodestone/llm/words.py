"""Word codes of whole texts, computed in numpy on the Arrow buffers of a batch.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D (no byte of a longer UTF-8 character is one of these). A
word's code is a polynomial over its bytes modulo 2**64, from prefix sums, then mixed; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
#: Bytes of text that are worked on at once; one longer document is worked on alone.
SLICE = 1 << 21
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n + n // 8, (1 << 20) + 1) if n <= 4 * SLICE else n
        tables = []
        for base in (_R, _R_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if n > 4 * SLICE:
            return tables[0], tables[1]  # one very long text does not keep its tables
        _powers[:] = tables
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of the rows begin..end of a batch: code by word, and where each row's words begin."""

    begin: int
    end: int
    code: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.end - self.begin), np.diff(self.first))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; a null has length 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _codes(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    space = _IS_SPACE[data]
    edge = np.ones(n, bool)  # a word begins where the byte before is white space or of another text
    edge[1:] = space[:-1]
    inner = at[(at > 0) & (at < n)]
    edge[inner] = True
    starts = np.flatnonzero(edge & ~space)
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    last[inner - 1] = True
    ends = np.flatnonzero(last & ~space) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[:n], out=sums[1:])
    code = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return code, np.searchsorted(starts, at)


def word_slices(texts: pa.Array, lower: bool = False, at_once: int = SLICE) -> Iterator[Words]:
    at, data = text_buffers(texts)
    begin, rows = 0, len(at) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + at_once, "right")) - 1)
        end = min(end, rows)
        code, first = _codes(data[at[begin] : at[end]], at[begin : end + 1] - at[begin], lower)
        yield Words(begin, end, code, first)
        begin = end


def runs_hash(code: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive codes; len(code) - k + 1 of them."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _R + code[j : j + n]
    return mix(total)


def within_row(first: np.ndarray, k: int) -> np.ndarray:
    """Of the positions of k consecutive words over all rows, which stay in one row."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    return left >= k
