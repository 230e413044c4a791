"""Isolation forest (Liu, Ting and Zhou, 2008): random trees on small samples, scores by mean path length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import percentiles


LARGEST = np.finfo(float).max


def average_path(n) -> float:
    """Mean path length of an unsuccessful search among n values."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def isolation_forest_fit(df: DataFrame, features: list[str], trees: int = 200, psi: int = 256, seed: int = 42, keys: tuple[str, ...] = ("sequence_id", "row_idx")) -> DataFrame:
    """One row a tree node: tree, node, feature (-1: a leaf), cut, left, right, size.

    Every tree has its own sample of ``psi`` rows (all, if there are fewer): each row is in each tree's draw with one small
    probability, and a tree keeps the ``psi`` draws with the least hashes. Which trees draw a row follows from one hash of the row,
    by skips: the trees up to the next one that draws it are geometrically distributed. The trees are grown in parallel.
    """
    total = df.count()
    psi = max(1, min(psi, total))
    rate = min(1.0, (psi + 8 * math.sqrt(psi) + 32) / max(1, total))  # more than needed, so that no tree falls short
    vector = F.array(*[F.col(f"`{f}`").cast("double") for f in features])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, row = b.column(0).to_numpy().astype(np.uint64), np.arange(b.num_rows)
            at, step, found = np.full(len(h), -1), 0, []
            while len(row):
                step += 1
                u = (mix64(h[row] ^ mix64(np.full(len(row), step, np.uint64))) >> np.uint64(11)).astype(float) / (1 << 53)
                skip = np.ones(len(row)) if rate >= 1 else 1 + np.floor(np.log1p(-u) / math.log1p(-rate))
                at = at + np.minimum(skip, trees + 1).astype(np.int64)
                row, at = row[at < trees], at[at < trees]
                found.append((row, at))
            row, at = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            order = mix64(h[row] + mix64(at.astype(np.uint64) + np.uint64(1 << 32)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(order.view(np.int64)), b.column(1).take(pa.array(row))], names=["tree", "h", "v"])

    drawn = df.select(F.xxhash64(*keys, F.lit(seed)).alias("h"), vector.alias("v")).mapInArrow(draw, "tree int, h long, v array<double>")
    kept = drawn.withColumn("n", F.row_number().over(Window.partitionBy("tree").orderBy("h"))).filter(F.col("n") <= psi)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("n")["v"].to_numpy()).astype(float)
        r = np.random.default_rng(seed * 100_003 + t)
        limit = math.ceil(math.log2(max(2, psi)))
        rows, todo = [], [(0, np.arange(len(x)), 0)]
        count = 1
        while todo:
            node, idx, depth = todo.pop()
            low, high = x[idx].min(0), x[idx].max(0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(idx) < 2 or not len(usable):
                rows.append((t, node, -1, 0.0, -1, -1, len(idx)))
                continue
            f = int(r.choice(usable))
            cut = float(r.uniform(low[f], high[f]))
            side = x[idx, f] < cut
            rows.append((t, node, f, cut, count, count + 1, len(idx)))
            todo += [(count, idx[side], depth + 1), (count + 1, idx[~side], depth + 1)]
            count += 2
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return kept.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, left int, right int, size int")


def _walk(tree: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(feature, cut, left child, path length, depth) of a tree's nodes; a right child follows its left one, and a walk stays in a leaf."""
    feature, left, size = (tree[c].to_numpy(np.int64) for c in ("feature", "left", "size"))
    leaf, depth = feature < 0, np.zeros(len(tree), np.int64)
    for i in np.flatnonzero(~leaf).tolist():  # parents come before their children
        depth[left[i] : left[i] + 2] = depth[i] + 1
    cut = np.where(leaf, np.inf, tree["cut"].to_numpy(float))
    return np.maximum(feature, 0), cut, np.where(leaf, np.arange(len(tree)), left), depth + average_path(size), int(depth.max())


def isolation_forest_score(df: DataFrame, forest: DataFrame, features: list[str], psi: int = 256) -> DataFrame:
    """Adds drift_score = 2 ** (-mean path / c(psi)) - 0.5; larger is more anomalous. The forest has at most
    trees * 2 * psi nodes, and is broadcast."""
    nodes = forest.orderBy("tree", "node").toPandas()
    by_tree = [_walk(g) for _, g in nodes.groupby("tree")]
    psi = max(1, min(psi, int(nodes.loc[nodes["node"] == 0, "size"].max()))) if len(nodes) else psi
    shared = df.sparkSession.sparkContext.broadcast(by_tree)
    vector = F.array(*[F.col(f"`{f}`").cast("double") for f in features])

    @F.pandas_udf("double")
    def score(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in vectors:
            x = np.stack(v.to_numpy()).astype(float) if len(v) else np.zeros((0, len(features)))
            # missing values go right, as the largest ones do
            x, first = np.nan_to_num(x, nan=LARGEST, posinf=LARGEST, neginf=-np.inf).ravel(), np.arange(len(x)) * x.shape[1]
            path = np.zeros(len(first))
            for feature, cut, left, length, depth in shared.value:
                node = np.zeros(len(first), np.int64)
                for _ in range(depth):
                    node = left.take(node) + (x.take(first + feature.take(node)) >= cut.take(node))
                path += length.take(node)
            yield pd.Series(np.power(2.0, -path / len(shared.value) / max(float(average_path(psi)), 1e-9)) - 0.5)

    return df.withColumn("drift_score", score(vector))


def select_threshold(scores: DataFrame, percentile: float = 99.0, score: str = "drift_score") -> DataFrame:
    """One row: the threshold."""
    return percentiles(scores, F.col(score), {"threshold": percentile / 100})


def anomaly_flag(scores: DataFrame, threshold: DataFrame, score: str = "drift_score") -> DataFrame:
    """Adds drift_detected: the score reaches the threshold (a table of one row; more are an error)."""
    one = threshold.agg(F.any_value("threshold").alias("threshold"), F.assert_true(F.count("*") == 1, "the threshold must be one row").alias("__one")).filter(F.col("__one").isNull()).drop("__one")
    return scores.join(F.broadcast(one), F.lit(True)).withColumn("drift_detected", F.col(score) >= F.col("threshold"))
