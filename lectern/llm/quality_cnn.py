"""Quality classifier: a byte-level convolutional network in numpy.

WIDTH byte positions by FILTERS filters slide over the text with stride one.  A
filter's response is a sum of WIDTH table rows, one for each byte, so no
embedding is multiplied.  The text is cut into overlapping chunks that cover all
of it; each filter is max-pooled over a chunk, and a document's probability is a
logistic function of the mean and the maximum of its chunks' pooled responses.

Trained by Adam on the driver on a bounded sample of labelled rows (``max_rows``
with the lowest hashes of the id), whole texts as in scoring.  Responses are made and pooled
PIECE bytes at a time, so memory does not grow with a text.

Defined results: a null or empty text has no chunk and scores what the bias
alone gives; null labels don't train; without labelled rows every score is 0.5;
repeated rows each give one row; a carried column of an output's name gives way to it;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb
from .arrowmap import carried, least_hashed, map_batches

WIDTH, FILTERS = 5, 16
CHUNK, STEP = 128, 112
MAX_ROWS, PIECE = 3000, 1 << 18


def chunk_bounds(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk starts and ends in a block, and chunks by row; chunks of a row overlap and cover it."""
    length = ends - starts
    n = np.where(length > 0, 1 + np.maximum(0, -(-(length - CHUNK) // STEP)), 0)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    s = np.repeat(starts, n) + k * STEP
    return s, np.minimum(s + CHUNK, np.repeat(ends, n)), n


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with WIDTH - 1 zeros after each row, and the rows' starts and ends in them; no filter reaches the next row."""
    length = ends - starts
    shift = (WIDTH - 1) * np.arange(len(length))
    new = np.cumsum(length) - length + shift
    out = np.zeros(int(length.sum()) + (WIDTH - 1) * len(length), np.uint8)
    within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(new, length) + within] = data[np.repeat(starts, length) + within]
    return out, new, new + length


@dataclass
class Model:
    tables: np.ndarray  # [WIDTH, 256, FILTERS]
    bias: np.ndarray  # [FILTERS]
    weights: np.ndarray  # [2 * FILTERS]
    intercept: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """[len(data) + 1, FILTERS]; positions near the end see zero bytes; the last row only pads reduceat."""
        padded = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
        out = self.tables[0].take(padded[: len(data) + 1], axis=0)
        for k in range(1, WIDTH):
            out += self.tables[k].take(padded[k : len(data) + 1 + k], axis=0)
        return out

    def pooled(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """[chunks, FILTERS]: each chunk's maxima and, if asked for, the first place in ``data`` of each."""
        top, place, lo = np.zeros((len(s), FILTERS), np.float32), np.zeros((len(s) if places else 0, FILTERS), np.int64), 0
        while lo < len(s):
            hi = max(lo + 1, int(np.searchsorted(e, s[lo] + PIECE, "right")))
            a, b = s[lo], e[hi - 1]
            # A filter at a chunk's last bytes sees what follows: the text, or zeros.
            response = self.responses(data[a : b + WIDTH - 1])
            top[lo:hi] = np.maximum.reduceat(response, np.stack((s[lo:hi], e[lo:hi]), 1).ravel() - a, axis=0)[::2]
            if places:
                place[lo:hi] = [response[i - a : j - a].argmax(0) + i for i, j in zip(s[lo:hi], e[lo:hi])]
            lo = hi
        return top, place

    def features(self, pooled: np.ndarray, n: np.ndarray) -> np.ndarray:
        act = np.maximum(pooled + self.bias, 0)
        out = np.zeros((len(n), 2 * FILTERS), np.float32)
        rows = np.flatnonzero(n)
        if len(rows):
            at = (np.cumsum(n) - n)[rows]
            out[rows, :FILTERS] = np.add.reduceat(act, at, axis=0) / n[rows, None]
            out[rows, FILTERS:] = np.maximum.reduceat(act, at, axis=0)
        return out

    def scores(self, block: tb.Block) -> np.ndarray:
        data, starts, ends = spaced(block.data, block.starts, block.ends)
        s, e, n = chunk_bounds(starts, ends)
        f = self.features(self.pooled(data, s, e)[0], n)
        return 1 / (1 + np.exp(-(f.astype(float) @ self.weights + self.intercept)))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, text: str = "text", label: str = "quality", key: str = "doc_id") -> tuple[list[bytes], np.ndarray]:
    """Texts and 0/1 labels of a bounded sample of rows with a label.

    The sample is chosen from ids and labels; only its own texts (``max_rows`` at most) move.
    """
    docs = docs.where(F.col(text).isNotNull())
    labelled = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("y"))
    chosen = least_hashed(docs.select(key).join(labelled, key), max_rows, 23, key, "y").withColumnRenamed("_order", "h")
    rows = docs.select(key, text).join(F.broadcast(chosen.distinct()), key).select(text, "y", "h").orderBy("h", "y", text).limit(max_rows).collect()
    return [r[0].encode() for r in rows], np.array([r.y for r in rows], np.float32)


def train(texts: list[bytes], labels: np.ndarray, seed: int = 3, epochs: int = 8, batch: int = 32, rate: float = 0.01) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    if not len(labels):
        model.weights[:] = 0
        return model
    # Both classes weigh the same in training; the intercept then moves to the sample's share of ones.
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    params = [model.tables, model.bias, model.weights, np.zeros(1, np.float32)]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            raw = [texts[i] for i in part]
            ends = np.cumsum([len(t) for t in raw]).astype(np.int64)
            starts = ends - np.array([len(t) for t in raw])
            data, starts, ends = spaced(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
            s, e, n = chunk_bounds(starts, ends)
            pooled, place = model.pooled(data, s, e, True)
            f = model.features(pooled, n)
            z = f @ model.weights + params[3][0]
            g = ((1 / (1 + np.exp(-z)) - labels[part]) * weight[part] / len(part)).astype(np.float32)
            grad_w, grad_f = f.T @ g, g[:, None] * model.weights
            row = np.repeat(np.arange(len(n)), n)
            act = np.maximum(pooled + model.bias, 0)
            top = (act == f[row, FILTERS:]).astype(np.float32)
            grad_act = grad_f[row, :FILTERS] / n[row, None] + grad_f[row, FILTERS:] * top
            grad_act *= act > 0
            grad_t = np.zeros_like(model.tables)
            padded = np.concatenate((data, np.zeros(WIDTH, np.uint8)))
            for k in range(WIDTH):
                np.add.at(grad_t[k], (padded[place + k], np.broadcast_to(np.arange(FILTERS), place.shape)), grad_act)
            step += 1
            for i, grad in enumerate((grad_t, grad_act.sum(0), grad_w + 1e-4 * model.weights, np.array([g.sum()], np.float32))):
                m[i] += 0.1 * (grad - m[i])
                v[i] += 0.01 * (grad * grad - v[i])
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    model.intercept = float(params[3][0] + np.log(share / (1 - share)))
    return model


def score(df: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """Carried columns, score (probability of label 1) and predicted."""
    carry, schema = carried(df, carry, "score double, predicted int")

    def run(batch: pa.RecordBatch):
        for block in tb.blocks(batch.column(0), 1 << 18):
            p = model.scores(block)
            yield {c: batch.column(i + 1).slice(block.lo, block.hi - block.lo) for i, c in enumerate(carry)} | {"score": p, "predicted": (p >= 0.5).astype(np.int32)}

    return map_batches(df.select(text, *carry), run, schema)
