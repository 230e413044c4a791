"""Toxicity: a character n-gram linear classifier on features scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams of its characters (3 to 6 of them, lower-cased, white space as blanks, one
blank before and after the text). A feature's value is f = log(1 + UNIT * count / characters). Each has the log-ratio r
of its smoothed mean values in the two classes; a logistic regression with L2 penalty is trained on the vectors of
r * f, scaled to length one, and a text's logit is b + w . (r * f) / |r * f|.

Learning uses a bounded sample of labelled texts (``max_texts``, ``max_bytes``; see ``bounded_rows``). The n-grams'
statistics are counted in Spark; the ``max_features`` that tell the classes apart best (t statistic; ties: the
smaller slot) are kept, and only their values come to the driver. Scores are shifted so that the limit ``decide_at``
lies where the F1 measure of out-of-fold predictions on the sample is best. Scoring covers every character of every text.

Cases: null and empty texts have no features and get the bias's score. Labels null or other than 0 and 1
are left out; of several labels of an id the largest counts. Rows that repeat an id are all labelled rows, within the
sample's bounds, and are scored one by one; null ids have no label. A sample with one class only gives that class's
share as every score. An empty table gives no rows. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_rows, bounded_sample, code_points, discard, materialize, mix64, utf8

SIZES = (3, 4, 5, 6)
SLOT_BITS = 20
#: Counts are taken per this many characters; a shorter text than ``SHORT`` counts as one of that length.
UNIT, SHORT = 300.0, 50
FOLDS = 5
#: Characters that one numpy step works on.
STEP = 1 << 20
BASE = 0x2545F4914F6CDD1D
LOWER = np.arange(1 << 16, dtype=np.uint32)
LOWER[:] = [ord(low) if len(low := chr(i).lower()) == 1 else i for i in range(1 << 16)]
LOWER[9:14] = 32


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of every n-gram slot of every row, sorted; only slots marked in ``wanted`` if given."""
    chars, cut = code_points(data, bounds)
    rows = len(cut) - 1
    text = np.full(len(chars) + 2 * rows, 32, np.uint32)  # a blank before and after each row
    text[np.arange(len(chars)) + 1 + 2 * np.repeat(np.arange(rows), np.diff(cut))] = np.where(chars < len(LOWER), LOWER[np.minimum(chars, len(LOWER) - 1)], chars)
    cut = cut + 2 * np.arange(rows + 1)
    size = np.diff(cut)
    keys = []
    for lo in range(0, len(text), STEP):
        part = text[lo : lo + STEP + max(SIZES) - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(SIZES) + 1):
            with np.errstate(over="ignore"):
                h = h[: max(0, len(part) - n + 1)] * np.uint64(BASE) + part[n - 1 :]
            if n not in SIZES:
                continue
            slot = (mix64(h[:STEP] ^ np.uint64(n << 56)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            at = np.arange(len(slot)) if wanted is None else np.flatnonzero(wanted[slot])
            row = np.searchsorted(cut, at + lo, "right") - 1
            inside = at + lo + n <= cut[row + 1]
            keys.append((row[inside] << SLOT_BITS) | slot[at[inside]])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    row = key >> SLOT_BITS
    return row, key & ((1 << SLOT_BITS) - 1), np.log1p(UNIT * count / np.maximum(SHORT, size[row]))


def minimize(f, x: np.ndarray, steps: int = 200, memory: int = 10, tolerance: float = 1e-6) -> np.ndarray:
    """Least point of a smooth convex function (value, gradient) by limited-memory quasi-Newton steps."""
    value, gradient = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, weights = -gradient, []
        for s, y, sy in reversed(moves):
            weights.append((s @ d) / sy)
            d = d - weights[-1] * y
        if moves:
            s, y, sy = moves[-1]
            d = d * (sy / (y @ y))
        for (s, y, sy), a in zip(moves, reversed(weights), strict=True):
            d = d + (a - (y @ d) / sy) * s
        slope, step = gradient @ d, 1.0 if moves else 1 / max(1.0, float(np.linalg.norm(gradient)))
        new, (new_value, new_gradient) = x + step * d, f(x + step * d)
        while new_value > value + 1e-4 * step * slope and step > 1e-10:
            step /= 2
            new, (new_value, new_gradient) = x + step * d, f(x + step * d)
        s, y = new - x, new_gradient - gradient
        if (sy := float(s @ y)) > 1e-14:
            moves = [*moves[-memory + 1 :], (s, y, sy)]
        x, value, gradient = new, new_value, new_gradient
        if np.linalg.norm(gradient) < tolerance or step <= 1e-10:
            break
    return x


@dataclass
class NaiveBayesLinear:
    slots: np.ndarray
    ratio: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def constant(share: float) -> NaiveBayesLinear:
        none = np.zeros(0)
        return NaiveBayesLinear(none.astype(np.int64), none, none, float(np.log((share + 1e-3) / (1 - share + 1e-3))))

    @staticmethod
    def train(slots: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, smoothing: float, l2: float) -> NaiveBayesLinear:
        """row, column, value: the features of all texts (columns number ``slots``); y: labels of the texts, both 0 and 1 among them."""
        n, d = len(y), len(slots)
        sums = [np.bincount(column[m], value[m], d) for m in (y[row] == 0, y[row] == 1)]
        ratio = np.log((sums[1] + smoothing) / (y.sum() + 2)) - np.log((sums[0] + smoothing) / (n - y.sum() + 2))
        x = value * ratio[column]
        x = x / np.maximum(1e-12, np.sqrt(np.bincount(row, x * x, n)))[row]

        def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
            w, b = p[:d], p[d]
            z = np.bincount(row, x * w[column], n) + b
            error = (sigmoid(z) - y) / n
            return float((np.logaddexp(0, z) - y * z).mean() + 0.5 * l2 * w @ w), np.append(np.bincount(column, x * error[row], d) + l2 * w, error.sum())

        p = minimize(loss, np.append(np.zeros(d), np.log(y.mean() / (1 - y.mean()))))
        return NaiveBayesLinear(slots, ratio, p[:d], float(p[d]))

    def logits(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        x = value * self.ratio[column]
        size = np.sqrt(np.bincount(row, x * x, rows))
        return self.bias + np.bincount(row, x * self.weights[column], rows) / np.maximum(1e-12, size)

    def score(self, data: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        row, slot, value = features(data, bounds, wanted)
        return sigmoid(self.logits(row, np.searchsorted(self.slots, slot), value, len(bounds) - 1))

    def wanted(self) -> np.ndarray:
        out = np.zeros(1 << SLOT_BITS, bool)
        out[self.slots] = True
        return out


def best_limit(logits: np.ndarray, y: np.ndarray) -> float:
    """The limit on logits with the best F1 measure, midway to the next lower logit (the highest, if several are as good)."""
    order = np.argsort(-logits, kind="stable")
    z, hits = logits[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # no limit lies between equal logits
    at = int(np.argmax(f1))
    return float((z[at] + z[min(at + 1, len(z) - 1)]) / 2)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, y) -> for every slot and class: texts, sum of values, sum of squares."""
    total = np.zeros((2, 3, 1 << SLOT_BITS))
    for b in batches:
        data, bounds = utf8(b.column(0))
        y = b.column(1).to_numpy().astype(int)
        for i, j in blocks(bounds):
            row, slot, value = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            for c in (0, 1):
                mine = y[i:j][row] == c
                for k, v in enumerate((None, value[mine], value[mine] ** 2)):
                    total[c, k] += np.bincount(slot[mine], v, 1 << SLOT_BITS)
    slot = np.flatnonzero(total[:, 0].any(0))
    for at in range(0, len(slot), 1 << 16):
        s = slot[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(s), *[pa.array(total[c, k, s]) for c in (0, 1) for k in range(3)]], names=["slot", "n0", "s0", "q0", "n1", "s1", "q1"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_texts: int = 10_000, max_bytes: int = 64 << 20, max_features: int = 16_384, min_texts: int = 5, l2: float = 1e-4, decide_at: float = 0.7) -> NaiveBayesLinear:
    """Fit on a bounded sample of the rows of ``docs`` that have a label."""
    chosen = bounded_sample(labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("__y")), max_texts, id_col)
    found = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    sample = materialize(bounded_rows(found, max_texts, text_col, max_bytes).select(F.col(text_col).alias("t"), F.col("__y").cast("double").alias("y")), "toxicity-sample")
    share = sample.agg(F.coalesce(F.avg("y"), F.lit(0.5)).alias("y"), F.count("*").alias("n")).first()
    if share["y"] in (0, 1) or not share["n"]:
        discard(sample)
        return NaiveBayesLinear.constant(share["y"])
    n1 = share["n"] * share["y"]
    n0 = share["n"] - n1
    names = ["n0", "s0", "q0", "n1", "s1", "q1"]
    counted = sample.mapInArrow(count_features, "slot long, " + ", ".join(f"{c} double" for c in names)).groupBy("slot").agg(*[F.sum(c).alias(c) for c in names])
    counted = materialize(counted, "toxicity-features")
    mean = counted.agg(F.sum(F.col("s0") + F.col("s1")) / F.sum(F.col("n0") + F.col("n1"))).first()[0] or 1.0
    spread = lambda c, n: F.greatest(F.col(f"q{c}") / n - (F.col(f"s{c}") / n) ** 2, F.lit(0.0)) / n
    apart = F.abs(F.col("s1") / n1 - F.col("s0") / n0) / F.sqrt(spread(0, n0) + spread(1, n1) + 1e-6 / n0 + 1e-6 / n1)
    best = counted.filter(F.col("n0") + F.col("n1") >= min_texts).orderBy(F.desc(apart), "slot").limit(max_features).select("slot")
    slots = np.sort(np.array([r["slot"] for r in best.collect()], np.int64))

    wanted = np.zeros(1 << SLOT_BITS, bool)
    wanted[slots] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = utf8(b.column(0))
            for i, j in blocks(bounds):
                row, slot, value = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], shared.value)
                cut = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.ListArray.from_arrays(cut, pa.array(slot, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(value, pa.float32()))], names=["y", "slot", "value"])

    got = sample.mapInArrow(values, "y double, slot array<int>, value array<float>").withColumn("h", F.xxhash64("slot", "value")).toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).combine_chunks()
    discard(sample)
    discard(counted)
    lists = got.column("slot").combine_chunks()
    y, row = got.column("y").to_numpy(), np.repeat(np.arange(len(got)), np.diff(lists.offsets.to_numpy()))
    column, value = np.searchsorted(slots, lists.flatten().to_numpy()), got.column("value").combine_chunks().flatten().to_numpy().astype(float)
    train = lambda rows: NaiveBayesLinear.train(slots, (np.cumsum(rows) - 1)[row[rows[row]]], column[rows[row]], value[rows[row]], y[rows], mean, l2)
    model = train(np.ones(len(y), bool))
    held, fold = np.zeros(len(y)), np.random.default_rng(3).integers(0, FOLDS, len(y))
    for k in range(FOLDS):
        rest = fold != k
        if y[rest].min() == y[rest].max():  # too few of one class to hold any out
            return model
        held[~rest] = train(rest).logits(row, column, value, len(y))[~rest]
    model.bias += float(np.log(decide_at / (1 - decide_at))) - best_limit(held, y)
    return model


def score(docs: DataFrame, model: NaiveBayesLinear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        wanted = m.wanted()
        for b in batches:
            data, bounds = utf8(b.column(1))
            out = np.empty(b.num_rows)
            for i, j in blocks(bounds):
                out[i:j] = m.score(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], wanted)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[id_col, "score"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, score double")
