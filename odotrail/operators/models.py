"""Models on windows and candidates, by Spark ML, and scoring with a loaded model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _summaries(windows: pa.Array, n_features: int) -> pa.Array:
    """The summary of each window, in one go for all windows of a length."""
    size = np.nan_to_num(windows.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
    steps = windows.flatten()
    values = np.append(pc.fill_null(steps.values, 0.0).to_numpy(zero_copy_only=False), 0.0)
    if (steps.drop_null().value_lengths().to_numpy(zero_copy_only=False) < n_features).any():
        raise ValueError(f"a window holds vectors of fewer than {n_features} values")
    at = steps.offsets.to_numpy()[:-1, None] + np.arange(n_features)
    x = values[np.where(steps.is_valid().to_numpy(zero_copy_only=False)[:, None], at, len(values) - 1)]
    begin, out = np.cumsum(size) - size, np.zeros((len(size), n_features, 6))
    for n in set(size.tolist()) - {0}:
        rows = np.flatnonzero(size == n)
        w = x[begin[rows][:, None] + np.arange(n)]
        mean = w.sum(1) / n
        std = np.sqrt(((w - mean[:, None]) ** 2).sum(1) / n)
        out[rows] = np.stack([w[:, -1], mean, std, np.fmin.reduce(w, 1), w.max(1), (w[:, -1] - w[:, 0]) / max(n - 1, 1)], 2)
    ends = np.append(0, np.cumsum(np.where(size > 0, n_features * 6, 0)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out[size > 0].ravel()), mask=pa.array(size == 0))


def window_summary(window: str | Column, n_features: int) -> Column:
    """A window (array of vectors) as one vector: the last row, and each feature's mean, deviation, least, greatest and slope. Missing values count
    as 0; a missing or empty window gives null."""

    @F.arrow_udf("array<double>")
    def summary(w: pa.Array) -> pa.Array:
        return _summaries(w, n_features)

    return summary(window)


def window_regressor(train: DataFrame, targets: list[str], n_features: int, window: str = "window", kind: str = "linear", **options) -> dict:
    """One model a target on summaries of windows; ``linear`` or ``gbt``."""
    data = train.withColumn("features", array_to_vector(window_summary(window, n_features)))
    make = LinearRegression if kind == "linear" else GBTRegressor
    default = {"regParam": 0.1} if kind == "linear" else {"maxIter": 20, "maxDepth": 4, "seed": 1}
    return {t: make(featuresCol="features", labelCol=t, predictionCol=f"predicted_{t}", **(default | options)).fit(data) for t in targets}


def predict_windows(df: DataFrame, models: dict, n_features: int, window: str = "window") -> DataFrame:
    """Adds predicted_<target>."""
    out = df.withColumn("features", array_to_vector(window_summary(window, n_features)))
    for m in models.values():
        out = m.transform(out)
    return out.drop("features")


def fit_reranker(labelled: DataFrame, point: str = "point_id", features: str = "features", seed: int = 42, test_share: float = 0.2):
    """(model, held-out candidates): logistic regression on candidate features; whole points are held out, by hash."""
    held = F.pmod(F.xxhash64(point, F.lit(seed)), F.lit(1000)) < int(test_share * 1000)
    data = labelled.withColumn("x", array_to_vector(F.col(features)))
    model = LogisticRegression(featuresCol="x", labelCol="label", predictionCol="guess", probabilityCol="p", maxIter=50, regParam=1e-3).fit(data.filter(~held))
    return model, data.filter(held).drop("x")


def learned_rerank(ranked: DataFrame, model, point: str = "point_id", features: str = "features", off_road: float = 20.0) -> DataFrame:
    """Rank and confidence by the learned score over its sum; points whose best candidate is off the road are left alone."""
    scored = model.transform(ranked.withColumn("x", array_to_vector(F.col(features)))).withColumn("learned_score", vector_to_array("p")[1]).drop("x", "p", "guess", "rawPrediction")
    every = Window.partitionBy(point)
    first = every.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = scored.withColumns({"__off": F.first("distance_m").over(first) > off_road, "__n": F.row_number().over(every.orderBy(F.desc("learned_score"), "segment_id")), "__sum": F.sum("learned_score").over(every)})
    share = F.col("learned_score") / F.nullif(F.col("__sum"), F.lit(0.0))
    return out.withColumns({"rank": F.when(F.col("__off"), F.col("rank")).otherwise(F.col("__n")), "confidence": F.when(F.col("__off"), F.col("confidence")).otherwise(F.coalesce(share, F.lit(0.0)))}).drop("__off", "__n", "__sum")


def batch_score(df: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], outputs: list[str], window: str = "window", mean: list[float] | None = None, std: list[float] | None = None) -> DataFrame:
    """Adds ``outputs`` of any model on window arrays. ``load`` is called once a task and returns a function from
    (rows, steps, features) to (rows, outputs); mean and std bring its outputs back to their scale."""
    schema = ", ".join(f"{o} double" for o in outputs)
    mean, std = mean or [0.0] * len(outputs), std or [1.0] * len(outputs)

    @F.pandas_udf(schema)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            x = np.array([[[np.nan if v is None else v for v in step] for step in w] for w in b], float)
            y = model(x) if len(b) else np.zeros((0, len(outputs)))
            yield pd.DataFrame(y * np.array(std) + np.array(mean), columns=outputs)

    return df.withColumn("__o", score(window)).select(*df.columns, *[F.col(f"__o.{o}").alias(o) for o in outputs])
