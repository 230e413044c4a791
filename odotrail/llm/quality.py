"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages (runs of ``PASSAGE_BYTES`` bytes). Every passage is encoded from its
byte-class bigrams, word lengths, repeats and distinct-word share, through a learned layer; gated
attention (tanh branch times sigmoid branch) weighs the passages, and the weighted sum is scored by a
logistic unit. All weights are learned together from the documents' labels.

Learning uses a bounded sample of labelled documents (``max_texts``, ``max_bytes``; see ``bounded_rows``), whose
passages are encoded in tasks. Scoring encodes every passage of every whole text.

Cases: null and empty texts are one empty passage and get a score as well. Labels null or other than 0
and 1 are left out; of several labels of an id the largest counts. Rows that repeat an id are all labelled rows,
within the sample's bounds, and are scored one by one; null ids have no label. A sample with one class gives that
class's share as every score. An empty table gives no rows. Columns other than id and text are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_rows, bounded_sample, utf8, word_hashes, words
from .toxicity import sigmoid

PASSAGE_BYTES = 600
#: lower case, upper case, digit, blank, line break, sentence punctuation, other symbol, beyond ASCII
CLASSES = 8
BYTE_CLASS = np.full(256, 6, np.int64)
BYTE_CLASS[97:123], BYTE_CLASS[65:91], BYTE_CLASS[48:58], BYTE_CLASS[128:] = 0, 1, 2, 7
BYTE_CLASS[[32, 9]], BYTE_CLASS[[10, 11, 12, 13]] = 3, 4
BYTE_CLASS[list(b".,;:?'\"-()")] = 5
WIDTH = CLASSES * CLASSES + 6


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds of all passages, number of passages of each row); an empty row has one empty passage."""
    size = np.diff(bounds)
    n = np.maximum(1, -(-size // PASSAGE_BYTES))
    row = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[row] + (k * size[row]) // n[row]
    return np.append(start, bounds[-1]), n


def encode(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """WIDTH numbers for each passage."""
    rows = len(bounds) - 1
    out = np.zeros((rows, WIDTH))
    if not len(data):
        return out
    size = np.diff(bounds)
    row = np.repeat(np.arange(rows), size)
    kind = BYTE_CLASS[data]
    pair = kind[:-1] * CLASSES + kind[1:]
    inside = row[:-1] == row[1:]
    bigrams = np.bincount(row[:-1][inside] * CLASSES**2 + pair[inside], minlength=rows * CLASSES**2).reshape(rows, -1)
    out[:, : CLASSES**2] = np.log1p(1000 * bigrams / np.maximum(1, size)[:, None])
    start, end, first = words(data, bounds)
    n = np.diff(first)
    if len(start):
        at = np.repeat(np.arange(rows), n)
        h = word_hashes(data, start, end)
        length = (end - start).astype(float)
        again = np.append(False, (h[1:] == h[:-1]) & (at[1:] == at[:-1]))
        order = np.lexsort((h, at))
        fresh = np.append(True, (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1]))
        per = np.maximum(1, n)
        mean = np.bincount(at, length, rows) / per
        out[:, -6] = np.bincount(at, again, rows) / per
        out[:, -5] = np.bincount(at[order], fresh, rows) / per
        out[:, -4] = mean
        out[:, -3] = np.sqrt(np.maximum(0, np.bincount(at, length**2, rows) / per - mean**2))
        out[:, -2] = np.bincount(at, length > 20, rows) / per
    out[:, -1] = np.log1p(size)
    return out


@dataclass
class AttentionMil:
    """p: the weights; mean and scale standardise the passage numbers."""

    p: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    @staticmethod
    def start(hidden: int, gate: int, seed: int) -> dict[str, np.ndarray]:
        r = np.random.default_rng(seed)
        draw = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        return {"E": draw(WIDTH, hidden), "e": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """x: passages (not standardised); first: the first passage of each bag. -> logits and what the gradient needs."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        g = (t * s) @ p["w"]
        n = np.diff(np.append(first, len(x)))
        a = np.exp(g - np.repeat(np.maximum.reduceat(g, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        z = np.add.reduceat(a[:, None] * h, first)
        return z @ p["c"] + p["b"][0], (x, h, t, s, a, z, n)

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (x, h, t, s, a, z, n) = self.forward(x, first)
        d = (sigmoid(logit) - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], n, 0)
        da = (dz * h).sum(1)
        dg = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
        dt, ds = dg[:, None] * p["w"] * s * (1 - t * t), dg[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dg, "c": z.T @ d, "b": np.array([d.sum()])}

    @staticmethod
    def fit(x: np.ndarray, bags: np.ndarray, labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 25, rate: float = 5e-3, decay: float = 1e-4, seed: int = 7) -> AttentionMil:
        """x: all passages; bags: number of passages of each document; labels: of each document."""
        y = np.asarray(labels, float)
        if not len(y) or y.min() == y.max():
            share = y.mean() if len(y) else 0.5
            p = {k: np.zeros_like(v) for k, v in AttentionMil.start(1, 1, 0).items()}
            p["b"][0] = np.log((share + 1e-3) / (1 - share + 1e-3))
            return AttentionMil(p, np.zeros(WIDTH), np.ones(WIDTH))
        model = AttentionMil(AttentionMil.start(hidden, gate, seed), x.mean(0), x.std(0) + 1e-3)
        begin = np.cumsum(bags) - bags
        r = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), 128):
                chosen = order[k : k + 128]
                n = bags[chosen]
                first = np.cumsum(n) - n
                rows = np.repeat(begin[chosen] - first, n) + np.arange(n.sum())
                step += 1
                for name, g in model.gradient(x[rows], first, y[chosen]).items():
                    m, v = moment[name]
                    g = g + decay * model.p[name] * (name not in "eb")
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    model.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return model

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        cut, n = passages(bounds)
        return sigmoid(self.forward(encode(data, cut), np.cumsum(n) - n)[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_texts: int = 8000, max_bytes: int = 64 << 20, **options) -> AttentionMil:
    """Fit on a bounded sample of the rows of ``docs`` that have a label."""
    chosen = bounded_sample(labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__y")), max_texts, id_col)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    sample = bounded_rows(found, max_texts, text_col, max_bytes).select(text_col, F.col("__y").cast("double"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(0))
            for i, j in blocks(bounds):
                cut, n = passages(bounds[i : j + 1] - bounds[i])
                x = encode(data[bounds[i] : bounds[j]], cut).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)) * WIDTH, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), lists], names=["y", "x"])

    rows = sample.mapInArrow(encoded, "y double, x array<float>").withColumn("h", F.xxhash64("x")).toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
    lists = rows.column("x").combine_chunks()
    x = lists.flatten().to_numpy().reshape(-1, WIDTH).astype(float)
    return AttentionMil.fit(x, np.diff(lists.offsets.to_numpy()) // WIDTH, rows.column("y").to_numpy(), **options)


def score(docs: DataFrame, model: AttentionMil, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, bounds = utf8(b.column(1))
            out = np.empty(b.num_rows)
            for i, j in blocks(bounds):
                out[i:j] = m.score(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[id_col, "score"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, score double")
