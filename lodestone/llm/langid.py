"""Language identification with a byte convolutional network, trained in numpy.

A text is cut into fixed-length windows of bytes, the last filled up with zero bytes. Each byte has an embedding; filters
of several widths slide over the window, the greatest value of each is kept, and a softmax layer turns these into the
probabilities of the languages. The languages of a text are the mean over all of its windows. Windows are worked on in
batches, as one matrix product for all filters (narrower ones have zeros at their end).

Training takes a bounded sample of labelled rows (``SAMPLE_DOCS``, with ``PIECES`` pieces of each), those with the least
hash of their doc_id and text, and learns from text and lang only, all windows of each piece. It runs on the driver, on data of that bound.

``recognised`` keeps the rows whose score is ``least_score`` at least. That threshold is calibrated on all labelled rows that were not
learned from: of n of them, the floor((n + 1) * CLEAN_LOSS)-th smallest score, so
that a text like them falls below it with a chance of CLEAN_LOSS at most. Fewer than 1 / CLEAN_LOSS - 1 of them say nothing about so
small a share; the threshold is 0 then. Without a model, every text with a letter is kept.

Cases: a null text, or one without any letter, is ``und`` with score 0. Of languages with one probability the first by name is taken. Where no row is labelled, every text is ``und``. A
null doc_id counts as held out. Repeated rows are predicted each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.memory import in_slices, releasing
from lodestone.llm.sampling import least_hashes
from lodestone.llm.store import temporary, written

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  # of each width
EMBEDDING = 6
#: Bounds of the training sample.
SAMPLE_DOCS, PIECES, PIECE_CHARS = 3000, 3, 200
EPOCHS, BATCH, RATE = 5, 64, 0.004
#: Windows in one matrix product.
AT_ONCE = 128
#: Bytes of text that a worker has in Python at once.
SLICE = 1 << 20
UNKNOWN = "und"
#: Of clean texts, the share that the threshold may cost.
CLEAN_LOSS = 0.001
_WORDLY = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of the text is of the letter categories; numerals such as a half or a superscript two are not."""
    return any(m.group().isalpha() for m in _WORDLY.finditer(text))


@dataclass
class Model:
    langs: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # max(WIDTHS) * EMBEDDING x filters
    bias: np.ndarray
    out: np.ndarray  # filters x langs
    out_bias: np.ndarray


def _columns(model: Model, windows: np.ndarray) -> np.ndarray:
    """What each filter place sees: windows x places x (widest filter's bytes' embeddings)."""
    wide = max(WIDTHS)
    values = model.embedding[np.pad(windows, ((0, 0), (0, wide - 1)))]
    return np.concatenate([values[:, j : j + windows.shape[1]] for j in range(wide)], axis=2)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """windows: n x WINDOW bytes."""
    found = []
    for k in range(0, len(windows), AT_ONCE):
        own = _columns(model, windows[k : k + AT_ONCE])
        top = (own.reshape(-1, own.shape[2]) @ model.filters).reshape(len(own), own.shape[1], -1).max(1)
        found.append(_softmax(np.maximum(top + model.bias, 0) @ model.out + model.out_bias))
    return np.concatenate(found)


def cut_windows(data: bytes) -> np.ndarray:
    n = -(-len(data) // WINDOW)
    whole = np.zeros(n * WINDOW, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    return whole.reshape(n, WINDOW)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Adam on the cross entropy of single windows."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    cut = [cut_windows(t.encode()) for t in texts]
    x = np.concatenate(cut)
    y = np.repeat(np.searchsorted(langs, labels), [len(c) for c in cut])
    wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide, EMBEDDING, n), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    mask = mask.reshape(wide * EMBEDDING, n)
    new = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    model = Model(langs, new(256, EMBEDDING, by=0.5), new(wide * EMBEDDING, n, by=0.2) * mask, np.zeros(n, np.float32), new(n, len(langs), by=0.2), np.zeros(len(langs), np.float32))
    names = ["embedding", "filters", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(model, k)) for k in names}
    second = {k: np.zeros_like(getattr(model, k)) for k in names}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(order), BATCH):
            own = order[k : k + BATCH]
            seen = _columns(model, x[own])
            raw = (seen.reshape(-1, seen.shape[2]) @ model.filters).reshape(len(own), WINDOW, n)
            at = raw.argmax(1)
            top = np.take_along_axis(raw, at[:, None, :], 1)[:, 0] + model.bias
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ model.out + model.out_bias)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = (p @ model.out.T) * (top > 0)  # rows x filters
            chosen = np.take_along_axis(seen, at[:, :, None], 1)  # rows x filters x what it saw
            grad = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("bfk,bf->kf", chosen, back) * mask}
            to_bytes = (back[:, :, None] * model.filters.T[None]).reshape(len(own), n, wide, EMBEDDING)
            spot = np.pad(x[own], ((0, 0), (0, wide - 1)))[np.arange(len(own))[:, None, None], at[:, :, None] + np.arange(wide)]
            grad["embedding"] = np.zeros_like(model.embedding)
            np.add.at(grad["embedding"], spot.ravel(), to_bytes.reshape(-1, EMBEDDING))
            step += 1
            for name in names:
                g = grad[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                change = RATE * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                setattr(model, name, (getattr(model, name) - change).astype(np.float32))
    return model


def held_out() -> Column:
    """Rows whose crc32 of doc_id as text leaves 2 by 4 are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train_on(docs: DataFrame) -> Model | None:
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    few = labelled.select(F.xxhash64("doc_id", "text").alias("by"), "lang", F.length("text").alias("n"), "text")
    places = [F.substring("text", F.greatest(F.lit(1), (F.col("n") * k / PIECES).cast("int") + 1), F.lit(PIECE_CHARS)) for k in range(PIECES)]
    n = docs.where(~held_out() & F.col("lang").isNotNull()).count()
    rows = least_hashes(few.select("by", "lang", F.array(*places).alias("pieces")), "by", n, SAMPLE_DOCS).collect()
    texts = [(p, r["lang"]) for r in rows for p in r["pieces"] if has_letter(p)]
    return train([t for t, _ in texts], [str(lang) for _, lang in texts]) if texts else None


def judge(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text."""
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows: list[int] = []
    windows: list[np.ndarray] = []

    def flush() -> None:
        sizes = [len(w) for w in windows]
        sums = np.add.reduceat(probabilities(model, np.concatenate(windows)), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        mean = sums / np.array(sizes)[:, None]
        for k, p in zip(rows, mean):
            pred[k], score[k] = model.langs[p.argmax()], min(1.0, float(p.max()))
        rows.clear()
        windows.clear()

    for k, text in enumerate(texts):
        if model is None or text is None or not has_letter(text):
            continue
        rows.append(k)
        windows.append(cut_windows(text.encode()))
        if sum(map(len, windows[-64:])) > 4096 or len(windows) >= 1024:
            flush()
    if rows:
        flush()
    return pred, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Adds nothing to docs but gives doc_id, held_out, lang_pred and score of each row."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            pred, score = judge(batch.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), schema)


def threshold(scores: list[float], loss: float) -> float:
    """Of n scores of clean texts, the floor((n + 1) * loss)-th smallest; 0 if they are too few for that."""
    k = int((len(scores) + 1) * loss)
    return sorted(scores)[k - 1] if k else 0.0


def threshold_of(scores: DataFrame, loss: float) -> float:
    """``threshold`` of the column score. Only values up to a bound somewhat above it are counted one by one, so that what reaches the driver is about twice as many as may be lost."""
    found = scores.agg(F.count("score").alias("n"), F.percentile_approx("score", min(1.0, 2 * loss), 100_000).alias("bound")).first()
    k = int((found["n"] + 1) * loss)
    if not k:
        return 0.0
    seen = 0
    for row in scores.where(F.col("score") <= found["bound"]).groupBy("score").count().orderBy("score").toLocalIterator():
        seen += row["count"]
        if seen >= k:
            return row["score"]
    return scores.orderBy("score").offset(k - 1).first()["score"]  # the bound is approximate


def least_score(docs: DataFrame, model: Model | None) -> float:
    """The threshold, set on all labelled rows of docs that the model has not seen."""
    if model is None:
        return 0.0
    unseen = docs.where(held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    with temporary(docs.sparkSession):
        return threshold_of(written(predict(unseen, model).where(F.col("lang_pred") != UNKNOWN).select("score"), "scores"), CLEAN_LOSS)


def recognised(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of docs whose text has a letter and, where there is a model, a score of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            if model is None:
                keep = [bool(t and has_letter(t)) for t in texts]
            else:
                pred, score = judge(texts, model)
                keep = [p != UNKNOWN and s >= least for p, s in zip(pred, score)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Trains on docs (doc_id, text, lang) and predicts every row of it."""
    return predict(docs, train_on(docs))
