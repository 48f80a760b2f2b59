"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (n = 3, 4; a
gram may begin or end with the space beside a word, never span one), followed by
a linear softmax, both trained by stochastic gradient descent in numpy.  As the
average is linear, prediction looks up each gram's row of embeddings times
softmax weights and averages these: whole texts, a few operations per byte.

Calibration: a tenth of the sample is kept from training; the temperature that
minimises its log loss scales the scores, and the lowest score at which it is
right in 99 of 100 cases becomes the rejection threshold (``rejected`` says the
score is below it; the predicted language stays a learned one).

The model is fitted on a bounded sample of labelled rows (``max_rows``, lowest
hashes of id, text and label first); a row sends at most BUCKETS pairs to the driver, however long
its text is.  Prediction covers every row.

Defined results: a null text or one without a letter is ``und`` with score 0; a
text with letters but no gram (one letter) gets the prior; null labels don't
train; without any labelled row everything is ``und``; repeated rows each give
one row, and rows that share an id are told apart by their texts when sampling; a carried
column of an output's name gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowmap import carried, least_hashed, map_batches

BUCKETS = 1 << 13
DIM = 16
MAX_ROWS = 3000
_PIECE = 1 << 18


def _squashed() -> np.ndarray:
    table = tb.LOWER.copy()
    table[tb.IS_SPACE] = 0x20
    return table


_TABLE = _squashed()


def grams(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block, and their number by row, in row order."""
    d = _TABLE[block.data]
    if len(d) < 3:
        return np.zeros(0, np.int32), np.zeros(len(block.starts), np.int64)
    space = d == 0x20
    w = d.astype(np.uint32)
    three = (w[:-2] << np.uint32(16)) | (w[1:-1] << np.uint32(8)) | w[2:]
    row_end = np.zeros(len(d) + 1, bool)
    row_end[block.ends] = True
    inner3 = ~space[1:-1] & ~row_end[1:-2] & ~row_end[2:-1]
    inner4 = inner3[:-1] & ~space[2:-1] & ~row_end[3:-1]
    at3, at4 = np.flatnonzero(inner3), np.flatnonzero(inner4)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    b3 = (three[at3] * np.uint32(0x9E3779B1)) >> shift
    b4 = ((three[at4] * np.uint32(0x85EBCA6B)) ^ (w[at4 + 3] * np.uint32(0xC2B2AE35))) * np.uint32(0x9E3779B1) >> shift
    # Both lists are sorted by place; the merge keeps rows together.
    n3 = np.searchsorted(at3, block.ends) - np.searchsorted(at3, block.starts)
    n4 = np.searchsorted(at4, block.ends) - np.searchsorted(at4, block.starts)
    total = n3 + n4
    out = np.empty(len(at3) + len(at4), np.int32)
    first = np.cumsum(total) - total
    i3 = np.repeat(first - (np.cumsum(n3) - n3), n3) + np.arange(len(at3))
    i4 = np.repeat(first + n3 - (np.cumsum(n4) - n4), n4) + np.arange(len(at4))
    out[i3], out[i4] = b3, b4
    return out, total


@dataclass
class Model:
    """Languages; logits of each bucket; bias (the prior); temperature; and the score under which a prediction is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, block: tb.Block) -> np.ndarray:
        buckets, counts = grams(block)
        out = np.zeros((len(counts), len(self.languages)), np.float64)
        # Long rows go in pieces, so a piece's lookups stay small; sums are whole.
        at = np.cumsum(counts) - counts
        start = 0
        while start < len(buckets):
            stop = min(start + _PIECE, len(buckets))
            lo, hi = np.searchsorted(at, start, "right") - 1, np.searchsorted(at, stop, "left")
            rows = np.arange(lo, hi)[counts[lo:hi] > 0]
            out[rows] += np.add.reduceat(self.table[buckets[start:stop]], np.maximum(at[rows] - start, 0), axis=0)
            start = stop
        return out / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        p = _softmax(self.logits(block) / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(p)), best]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def sample(df: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", label: str = "lang", key: str = "doc_id") -> tuple[np.ndarray, list[str]]:
    """Averaged bucket counts [rows, BUCKETS] and labels of a bounded sample of labelled rows."""
    labelled = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(text, label, key)
    chosen = least_hashed(labelled, max_rows, 17, key, text, label).select(text, label, "_order")

    def run(batch: pa.RecordBatch):
        for block in tb.blocks(batch.column(0)):
            buckets, counts = grams(block)
            at = np.cumsum(counts) - counts
            pairs = [np.unique(buckets[a : a + n], return_counts=True) for a, n in zip(at, counts)]
            yield {"label": batch.column(1).slice(block.lo, block.hi - block.lo), "order": batch.column(2).slice(block.lo, block.hi - block.lo), "buckets": [b.astype(np.int32).tobytes() for b, _ in pairs], "shares": [(c / max(1, c.sum())).astype(np.float32).tobytes() for _, c in pairs]}

    rows = sorted(map_batches(chosen, run, "label string, order long, buckets binary, shares binary").collect(), key=lambda r: (r.order, r.label, r.buckets))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.buckets, np.int32)] = np.frombuffer(r.shares, np.float32)
    return x, [r.label for r in rows]


def train(x: np.ndarray, labels: list[str], seed: int = 1, epochs: int = 12, rate: float = 4.0) -> Model:
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    y = np.searchsorted(languages, labels)
    rng = np.random.default_rng(seed)
    held = np.arange(len(y)) % 10 == 9
    fit = np.flatnonzero(~held)
    e = rng.normal(0, 0.5, (BUCKETS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIM, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            hidden = x[part] @ e
            grad = _softmax(hidden @ w + bias).astype(np.float32)
            grad[np.arange(len(part)), y[part]] -= 1
            grad /= len(part)
            step = np.float32(rate * (1 - epoch / epochs))
            used = np.flatnonzero(x[part].any(0))
            e[used] -= step * 40 * (x[part][:, used].T @ (grad @ w.T))
            w -= step * 0.2 * (hidden.T @ grad)
            bias -= step * 0.1 * grad.sum(0)
            steps += 1
    model = Model(languages, (e @ w).astype(np.float64), bias.astype(np.float64))
    if held.any():
        z = x[held] @ model.table + model.bias
        right = y[held]
        loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(right)), right], 1e-300)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = _softmax(z / model.temperature)
        best, top = p.argmax(1) == right, p.max(1)
        order = np.argsort(-top, kind="stable")
        precise = np.cumsum(best[order]) >= 0.99 * np.arange(1, len(order) + 1)
        model.reject_below = float(top[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def identify(df: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """Carried columns, lang_pred, score (calibrated probability) and rejected."""
    carry, schema = carried(df, carry, "lang_pred string, score double, rejected boolean")
    names = np.array([*model.languages, "und"], dtype=object)

    def run(batch: pa.RecordBatch):
        lettered = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for block in tb.blocks(batch.column(0)):
            here = lettered[block.lo : block.hi]
            if model.languages:
                best, top = model.predict(block)
                best, top = np.where(here, best, len(model.languages)), np.where(here, top, 0.0)
            else:
                best, top = np.zeros(len(here), int), np.zeros(len(here))
            yield {c: batch.column(i + 2).slice(block.lo, block.hi - block.lo) for i, c in enumerate(carry)} | {"lang_pred": names[best].tolist(), "score": top, "rejected": top < max(model.reject_below, 1e-12)}

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_l_lettered")
    return map_batches(df.select(text, lettered, *carry), run, schema)
