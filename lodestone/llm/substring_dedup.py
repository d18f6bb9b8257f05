"""Substring deduplication: removes every word covered by a window of words that also starts earlier in the corpus.

Method: prefix-partitioned suffix trees. A suffix here is the window of the next ``width`` words, and a tree need only hold
suffixes that can repeat, so three jobs come before the trees:

1. Anchors. In every window the k-word run with the least hash is its anchor; equal windows have equal anchors at equal
   places. About one word in nine is an anchor, so what is shuffled is a fraction of the text.
2. Repeated anchors. A count by anchor hash (combined before the shuffle) keeps those that occur twice or more, and a join
   brings them back to their documents. Whole copies of an earlier document are found the same way by one hash each, and
   need no tree: all their windows repeat.
3. Groups by variable-length prefixes. Suffixes are dealt by the anchor's k words, read from the anchor on; where an anchor
   occurs more than ``group`` times, its prefix is lengthened to the whole window, and equal windows of one slice are
   merged before the shuffle, so that a passage that a third of all documents share is one suffix per slice. Groups are as many
   as keep ``GROUP_MARKS`` repeated anchors in each on average.

In each group the suffixes are sorted and neighbours compared: the sorted leaves and the lengths of their common prefixes
are the subtree, and a run of leaves that agree on all ``width`` words is an internal node at that depth, a repeat. Its
earliest leaf stays; the windows of the others are removed. Words are compared by 64-bit codes, ``width`` of them at once.

Windows are judged on the input, and earlier means a smaller doc_id, or an earlier start in the same document.

Cases: a null text has no words. Texts of fewer than ``width`` words lose none. A null doc_id sorts before all others. Rows
that share a doc_id, or have none, are documents each, in the order they are read; where there are such rows, the jobs work
on written row numbers (``row_ids``). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.row_ids import OWN_ID, one_id_a_row
from lodestone.llm.store import written
from lodestone.llm.words import mix, runs_hash, text_buffers, within_row, word_slices

#: Words of an anchor.
K = 5
#: An anchor that occurs more often is dealt by the whole window.
GROUP = 500
#: Repeated anchors of one group of suffixes, on average.
GROUP_MARKS = 100_000
#: Stands for a null doc_id inside the jobs.
NULL_ID = -(1 << 63)


def _anchors(code: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the windows, each one's anchor position, and the hash of each k-word run."""
    runs = runs_hash(code, K)
    whole = within_row(first, width)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), runs
    span = width - K + 1
    # the high bits of the hash with the place below: the least of these is the first run with the least hash
    bits = np.uint64(max(1, int(len(runs)).bit_length()))
    value = ((runs >> bits) << bits) | np.arange(len(runs), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        value = np.minimum(value[:-step], value[step:])
        step *= 2
    if step < span:
        value = np.minimum(value[: len(value) - (span - step)], value[span - step :])
    at = np.flatnonzero(whole)
    return at, (value[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), runs


def _entries(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w in word_slices(batch.column("text")):
                _, anchor, runs = _anchors(w.code, w.first, width)
                anchor = np.unique(anchor)
                row = np.searchsorted(w.first, anchor, "right") - 1
                long = np.flatnonzero(np.diff(w.first) >= width)
                # one entry for the whole document: a hash over the codes with their places, at place -1
                place = np.arange(len(w.code)) - np.repeat(w.first[:-1], np.diff(w.first))
                sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(w.code + mix(place.astype(np.uint64))), dtype=np.uint64)])
                total = sums[w.first[long + 1]] - sums[w.first[long]]
                whole = mix((sums[w.first[long + 1]] - sums[w.first[long]]) ^ mix(np.diff(w.first)[long].astype(np.uint64) + np.uint64(1 << 40)))
                yield pa.RecordBatch.from_arrays(
                    [
                        # the last bit of a key tells whole documents from anchors; 32 more bits of another hash tell documents apart
                        pa.array(np.concatenate([runs[anchor] & ~np.uint64(1), whole | np.uint64(1)]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(len(anchor), np.uint64), mix(total + np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)]).astype(np.uint32).view(np.int32)),
                        pa.array(np.concatenate([ids[w.begin + row], ids[w.begin + long]])),
                        pa.array(np.concatenate([anchor - w.first[row], np.full(len(long), -1)]).astype(np.int32)),
                    ],
                    ["key", "check", "doc_id", "pos"],
                )

    return run


def _leaf_types(width: int) -> tuple[np.dtype, np.dtype]:
    base = [("doc", "<i8"), ("pos", "<i4")]
    return np.dtype([*base, ("lo", "u1"), ("hi", "u1"), ("w", "<u8", (2 * width - K,))]), np.dtype([*base, ("w", "<u8", (width,))])


def _distinct_nodes(windows: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subtree over the windows (a row of codes each): which leaves are repeats of an earlier leaf, and the earliest
    leaf of each node at full depth."""
    n, width = windows.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    leaf = np.ascontiguousarray(windows.astype(">u8")).view(f"V{8 * width}").ravel()
    order = np.argsort(leaf)
    rows = windows[order]
    same = rows[1:] == rows[:-1]
    depth = np.where(same.all(1), width, same.argmin(1))  # common prefix with the leaf before
    node = np.concatenate([[0], np.cumsum(depth < width)])
    by = np.lexsort((pos[order], doc[order], node))
    head = np.concatenate([[True], node[by][1:] != node[by][:-1]])
    return order[by[~head]], order[by[head]]


def _spans(doc: np.ndarray, pos: np.ndarray, width: int) -> pd.DataFrame:
    """Removed words as spans: windows that touch or overlap in a document are one span."""
    by = np.lexsort((pos, doc))
    doc, pos = doc[by], pos[by]
    if not len(doc):
        return pd.DataFrame({"doc_id": np.zeros(0, np.int64), "begin": np.zeros(0, np.int64), "end": np.zeros(0, np.int64)})
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + width)])
    at = np.flatnonzero(head)
    last = np.concatenate([at[1:] - 1, [len(doc) - 1]])
    return pd.DataFrame({"doc_id": doc[at], "begin": pos[at].astype(np.int64), "end": pos[last].astype(np.int64) + width})


def _suffixes(width: int, groups: int):
    """Deals the suffixes of each document's repeated anchors to groups. kind 0: an anchor with what surrounds it; 1: a
    window; 2: spans that are known to be removed."""
    by_anchor, by_window = _leaf_types(width)
    side = width - K

    def blobs(kind: int, group: np.ndarray, records: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        for part in np.split(order, cuts):
            if len(part):
                yield int(group[part[0]]), kind, records[part].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            lists = batch.column("marks").combine_chunks() if isinstance(batch.column("marks"), pa.ChunkedArray) else batch.column("marks")
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            marks = lists.flatten()
            mark_pos, mark_hot = (marks.field("pos").to_numpy(zero_copy_only=False), marks.field("hot").to_numpy(zero_copy_only=False)) if len(marks) else (np.zeros(0, np.int64), np.zeros(0, bool))
            mark_row = np.repeat(np.arange(len(sizes)), sizes)
            copies = np.zeros(len(ids), bool)
            copies[mark_row[mark_pos < 0]] = True
            for w in word_slices(batch.column("text")):
                own = (mark_row >= w.begin) & (mark_row < w.end) & (mark_pos >= 0) & ~copies[mark_row]
                if not own.any():
                    continue
                flag = np.zeros(len(w.code), np.int8)
                spot = w.first[mark_row[own] - w.begin] + mark_pos[own]
                flag[spot] = 1 + mark_hot[own]
                at, anchor, runs = _anchors(w.code, w.first, width)
                use = flag[anchor] > 0
                at, anchor = at[use], anchor[use]
                row = np.searchsorted(w.first, at, "right") - 1
                code = np.concatenate([np.zeros(side, np.uint64), w.code, np.zeros(width, np.uint64)])
                out: list[tuple[int, int, bytes]] = []
                hot = flag[anchor] == 2
                # windows of a frequent anchor, equal ones of this slice merged
                a, r = at[hot], row[hot]
                windows = code[a[:, None] + np.arange(side, side + width)]
                doc, pos = ids[w.begin + r], (a - w.first[r]).astype(np.int32)
                again, earliest = _distinct_nodes(windows, doc, pos)
                if len(again):
                    spans = _spans(doc[again], pos[again], width)
                    to = int(mix(np.array([spans["doc_id"].iloc[0]]).astype(np.uint64))[0] % np.uint64(groups))
                    out.append((to, 2, spans.to_numpy().astype("<i8").tobytes()))
                rec = np.zeros(len(earliest), by_window)
                rec["doc"], rec["pos"], rec["w"] = doc[earliest], pos[earliest], windows[earliest]
                out += blobs(1, (runs_hash_rows(windows[earliest]) % np.uint64(groups)).astype(np.int64), rec)
                # anchors with their windows: places of the window relative to the anchor from lo to hi
                a, c, r = at[~hot], anchor[~hot], row[~hot]
                if len(a):
                    head = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (a[1:] != a[:-1] + 1)]))
                    last = np.concatenate([head[1:] - 1, [len(a) - 1]])
                    rec = np.zeros(len(head), by_anchor)
                    rec["doc"], rec["pos"] = ids[w.begin + r[head]], c[head] - w.first[r[head]]
                    rec["hi"], rec["lo"] = c[head] - a[head], c[head] - a[last]
                    rec["w"] = code[c[head][:, None] + np.arange(2 * width - K)]
                    out += blobs(0, (mix(runs[c[head]]) % np.uint64(groups)).astype(np.int64), rec)
                if out:
                    group, kind, blob = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["group", "kind", "blob"])

    return run


def runs_hash_rows(windows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(windows), np.uint64)
    for column in windows.T:
        total = mix(total + column)
    return total


def _subtree(width: int):
    """The removed spans of one group of suffixes."""
    by_anchor, by_window = _leaf_types(width)
    side = width - K

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(np.frombuffer(b, "<i8").reshape(-1, 3), columns=["doc_id", "begin", "end"]) for b in rows.loc[rows["kind"] == 2, "blob"]]
        anchors = [np.frombuffer(b, by_anchor) for b in rows.loc[rows["kind"] == 0, "blob"]]
        if anchors:
            rec = np.concatenate(anchors)
            many = rec["hi"].astype(np.int64) - rec["lo"] + 1
            k = np.repeat(np.arange(len(rec)), many)
            shift = rec["hi"].astype(np.int64)[k] - (np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many))
            windows = rec["w"][k[:, None], (side - shift)[:, None] + np.arange(width)]
            doc, pos = rec["doc"][k], rec["pos"][k].astype(np.int64) - shift
            again, _ = _distinct_nodes(windows, doc, pos)
            out.append(_spans(doc[again], pos[again], width))
        hot = [np.frombuffer(b, by_window) for b in rows.loc[rows["kind"] == 1, "blob"]]
        if hot:
            rec = np.concatenate(hot)
            again, _ = _distinct_nodes(rec["w"], rec["doc"], rec["pos"])
            out.append(_spans(rec["doc"][again], rec["pos"][again].astype(np.int64), width))
        return pd.concat(out)[["doc_id", "begin", "end"]]

    return run


def _kept_batches(width: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = text_buffers(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            copies = batch.column("copy").to_pylist()
            n_words, n_removed, digests, texts = [], [], [], []
            for k, (own, copy) in enumerate(zip(spans, copies)):
                words = data[at[k] : at[k + 1]].tobytes().split()
                n = len(words)
                if copy and n >= width:
                    words = []
                elif own:
                    gone = np.zeros(n + 1, np.int32)
                    for s in own:
                        gone[s["begin"]] += 1
                        gone[s["end"]] -= 1
                    stays = np.cumsum(gone)[:n] == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                kept = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names + ["kept_text"] * with_text)

    return run


def remove_repeats(docs: DataFrame, width: int = 20, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    if not K <= width <= 255:
        raise ValueError(f"width must be from {K} to 255")
    docs = one_id_a_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), OWN_ID, "text")
    entries = written(rows.select("doc_id", "text").mapInArrow(_entries(width), "key long, check int, doc_id long, pos int"), "anchors")
    repeated = entries.groupBy("key", "check").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    repeated = written(repeated, "repeated")
    # groups are as many as keep their size, whatever the corpus has
    n_marks = repeated.where("(key & 1) = 0").agg(F.sum("n")).first()[0] or 0
    groups = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_marks // GROUP_MARKS))
    found = entries.join(repeated, ["key", "check"]).where("pos >= 0 or doc_id > least")
    marks = found.groupBy("doc_id").agg(F.collect_list(F.struct("pos", (F.col("n") > GROUP).alias("hot"))).alias("marks"))
    marked = rows.join(marks, "doc_id", "left")
    suffixes = marked.where("marks is not null").mapInArrow(_suffixes(width, groups), "group int, kind int, blob binary")
    spans = suffixes.groupBy("group").applyInPandas(_subtree(width), "doc_id long, begin long, end long")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    copy = F.coalesce(F.exists("marks", lambda m: m["pos"] < 0), F.lit(False)).alias("copy")
    judged = marked.join(spans, "doc_id", "left").select(F.col(OWN_ID).alias("doc_id"), "text", "spans", copy)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return judged.mapInArrow(_kept_batches(width, with_text), schema)
