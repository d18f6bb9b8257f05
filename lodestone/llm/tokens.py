"""Token ids of whole texts from a public tokenizer, in Arrow batches inside tasks.

A byte-level BPE splits a text into pre-tokens before merging, and where all white space of a text is single spaces and
line ends, each space or line end that stands between two other characters begins a pre-token. Such texts are cut at
those places, and each distinct piece is encoded by the tokenizer once per worker and kept (``CACHE`` pieces at most); the ids of the
texts are gathered from those of their pieces in numpy. A Latin word with a stop after it is two pre-tokens, hence two pieces.
Every other text, or tokenizer, is encoded whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.words import text_buffers

#: Distinct pieces that a Python worker keeps before it drops those that only one slice had.
CACHE = 1_000_000
#: Bytes of text that are encoded at once; one longer text is encoded alone.
SLICE = 1 << 23
#: White space other than single spaces and line ends between other characters (RE2).
UNEVEN = r"\A\s|\s\z|\s\s|[\t\r\f\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: A word whose stop is a pre-token of its own (RE2).
STOPPED = r"\A(?P<word>\n?[A-Za-zÀ-ÖØ-öø-ɏ]+)(?P<stop>[.,;:!?]+)\z"


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of all ranges, one after the other."""
    before = np.cumsum(size, dtype=np.int64) - size
    return pool[np.repeat(begin - before, size) + np.arange(int(size.sum()))]


class Encoder:
    """Encodes texts to ids; ``end_id`` follows each text if it is given. at_once and cache: other bounds than SLICE and CACHE."""

    def __init__(self, path: str, end_id: int | None = None, at_once: int | None = None, cache: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.end_id, self.at_once, self.cache = end_id, at_once or SLICE, cache or CACHE
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        if self.by_pieces:
            vocab = self.tokenizer.get_vocab()
            self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, k in vocab.items():  # each character of a byte-level token stands for one byte
                self.n_bytes[k] = len(token)
            self._forget()

    def _forget(self) -> None:
        self.kept = pa.array([], pa.string())  # pieces by number
        self.begin, self.size, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)  # by number; begin is in the pool
        self.pool = np.zeros(0, np.uint32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, pieces: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.kept = pa.concat_arrays([self.kept, pieces])
        self.begin = np.concatenate([self.begin, (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.int32)])
        self.size = np.concatenate([self.size, sizes.astype(np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(len(pieces), np.int32)])
        self.pool = np.concatenate([self.pool, ids])

    def _shrink(self) -> None:
        """Keeps the pieces that more than one slice had; none if they are too many."""
        stay = np.flatnonzero(self.hits > 1)
        if len(stay) > self.cache // 2:
            return self._forget()
        self._hold(stay)

    def _hold(self, stay: np.ndarray) -> None:
        """Keeps the pieces of these numbers alone."""
        self.kept, self.size, self.pool = self.kept.take(pa.array(stay)), self.size[stay], _gather(self.pool, self.begin[stay], self.size[stay])
        self.begin, self.hits = (np.cumsum(self.size) - self.size).astype(np.int32), np.ones(len(stay), np.int32)

    def rest(self, most: int = 50_000) -> None:
        """Keeps the most frequent pieces alone, so that a worker that goes on with other work holds little."""
        if self.by_pieces and len(self.kept) > most:
            self._hold(np.sort(np.argpartition(self.hits, -most)[-most:]))

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Encodes new pieces, many in one text, and cuts the ids where the bytes of a piece end: all ids, and how many each piece has."""
        parts, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        texts = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(" ", pieces, ""))
        at, data = text_buffers(texts)
        for k in range(0, len(pieces), 500):
            own = at[k : k + 501]
            ids = np.array(self.tokenizer.encode_batch_fast([data[own[0] : own[-1]].tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(ends, own[1:] - own[0])
            if np.array_equal(ends[np.minimum(cuts, len(ends) - 1)], own[1:] - own[0]):
                parts.append(ids)
                sizes.append(np.diff(cuts + 1, prepend=0))
            else:
                found = self._whole(texts.slice(k, 500).to_pylist())
                parts += found
                sizes.append(np.array(list(map(len, found))))
        return np.concatenate(parts), np.concatenate(sizes).astype(np.int32)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        """The numbers of distinct pieces; those that are not kept yet are encoded and kept."""
        if len(self.kept) > self.cache:
            self._shrink()
        number = pc.index_in(pieces, value_set=self.kept)
        new = pieces.filter(number.is_null())
        found = number.fill_null(-1).to_numpy().copy()
        if len(new):
            cut = pc.extract_regex(new, STOPPED)
            word = pc.coalesce(pc.struct_field(cut, "word"), new).dictionary_encode()
            stop = pc.struct_field(cut, "stop").fill_null("").dictionary_encode()
            ids, size = self._learn(word.dictionary)
            ends = self._whole(stop.dictionary.to_pylist())
            size = np.concatenate([size, np.array(list(map(len, ends)), np.int32)])
            own = np.stack([word.indices.to_numpy(), stop.indices.to_numpy() + len(word.dictionary)], 1).ravel()
            ids = _gather(np.concatenate([ids, *ends]), (np.cumsum(size) - size)[own], size[own])
            found[found < 0] = np.arange(len(self.kept), len(self.kept) + len(new))
            self._keep(new, size[own].reshape(-1, 2).sum(1), ids)
        self.hits[found] += 1
        return found

    def _by_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text after the id of a line end that is put before it, and where each text's begin."""
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        coded = lists.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.cast(pa.string()))[coded.indices.to_numpy()]
        size = self.size[number]
        return _gather(self.pool, self.begin[number], size), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[lists.offsets.to_numpy()]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        even = pc.invert(pc.match_substring_regex(texts, UNEVEN)).to_numpy(zero_copy_only=False) if self.by_pieces else np.zeros(len(texts), bool)
        ids, at = self._by_pieces(texts if even.all() else texts.filter(pa.array(even))) if even.any() else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        if even.all() and self.end_id is not None:  # each text's line end gives its place to the end id of the one before
            ids = np.append(ids[1:], np.uint32(self.end_id))
            ids[at[1:] - 1] = self.end_id
            return ids, at
        whole = iter(self._whole(texts.filter(pa.array(~even)).to_pylist()))
        end = np.array([] if self.end_id is None else [self.end_id], np.uint32)
        parts, k = [], 0
        for ok in even:
            parts.append(ids[at[k] + 1 : at[k + 1]] if ok else next(whole))
            parts.append(end)
            k += int(ok)
        sizes = np.array(list(map(len, parts)), np.int64).reshape(-1, 2).sum(1)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of texts of about at_once bytes: begin and end of the range, the ids of all its texts, and where in them each
        text's begin (one more than there are texts). A null text is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        at, _ = text_buffers(texts)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + self.at_once, "right")) - 1)
            own = texts.slice(begin, end - begin)
            ids, places = self._slice(own.cast(pa.large_string()) if at[end] - at[begin] > 1 << 29 else own)
            yield begin, end, ids, places
            begin = end


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = None, at_once: int | None = None, cache: int | None = None) -> Encoder:
    return Encoder(path, end_id, at_once, cache)
