"""The model's input as it is made online: the last ``n`` steps of a track by the ``DEPLOYABLE_FEATURES``, from raw sensor states.

Changes here are signed, and rolling statistics are over ``n`` rows (unlike those of ``features.engineer``); turn rates are named by the axis they
turn about. Defaults: a step without time or backwards, and a track's first step, count as a tenth of a second; an unknown magnetic field has
strength 0, unknown gravity 9.8066. Other missing values stay missing, are left out of rolling statistics, and are filled by ``scaled``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from .features import DEPLOYABLE_FEATURES

#: Columns of a sensor state, besides its time: position, speed (m/s), heading; acceleration, gravity, turn rates, magnetic field, orientation.
SENSORS = ("lat", "lon", "altitude", "speed", "accuracy", "heading", "ax", "ay", "az", "gravity_x", "gravity_y", "gravity_z", "gx", "gy", "gz", "mx", "my", "mz", "yaw", "pitch", "roll", "satellites", "confidence")
#: Step (s), field and gravity where they are not known (fixed values).
STEP, FIELD, GRAVITY = 0.1, 0.0, 9.8066
#: What is rolled, in the order of the features.
ROLLED = ("accel", "gyro", "field", "gravity", "kmh", "accel_change", "gyro_change", "kmh_change")


def _row(v: dict) -> list:
    """The features before the rolling ones, from a row's values and derived ones, in the features' order."""
    rate = lambda x: v[x] / v["dt"]
    position, gyro = [v["lat"], v["lon"], v["altitude"]], [v["gz"], v["gx"], v["gy"]]
    accel, field, gravity, angles = ([v[c] for c in names] for names in (("ax", "ay", "az"), ("mx", "my", "mz"), ("gravity_x", "gravity_y", "gravity_z"), ("yaw", "pitch", "roll")))
    first = [v["t"], v["dt"], *position, v["kmh"], v["accuracy"], v["heading"], v["elapsed"] * 1000, *accel, *gravity, *gyro, *field, *angles]
    second = [v["t"], v["elapsed"], v["dt"], *accel, v["accel"], *gyro, v["gyro"], *field, v["field"], *gravity, v["gravity"], *angles, *position, v["speed"], v["accuracy"], v["satellites"]]
    changes = [x for c in ("accel", "gyro", "field", "kmh", "yaw_rate", "pitch_rate", "roll_rate") for x in (v[f"{c}_change"], rate(f"{c}_change"))]
    return [*first, *second, *changes, v["confidence"]]


def online_vectors(df: DataFrame, n: int = 30, track: str = "track_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """track, time, row, step (its number in the track, from 1) and vector: all features of each row. Columns that ``df`` lacks are missing in all rows."""
    w = Window.partitionBy(track).orderBy(on, row)
    have = set(df.columns)
    value = lambda c: scalar.finite(f"`{c}`") if c in have else F.lit(None).cast("double")
    size = lambda *c: F.sqrt(F.col(c[0]) * F.col(c[0]) + F.col(c[1]) * F.col(c[1]) + F.col(c[2]) * F.col(c[2]))
    out = df.select(track, on, row, F.col(on).cast("double").alias("__t"), *[value(c).alias(f"__{c}") for c in SENSORS])
    named = lambda *c: [f"__{x}" for x in c]
    out = out.withColumns(
        {
            "__step": F.row_number().over(w),
            "__dt": F.col("__t") - F.lag("__t").over(w),
            "__elapsed": F.col("__t") - F.first("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "__accel": size(*named("ax", "ay", "az")),
            "__gyro": size(*named("gx", "gy", "gz")),
            "__field": F.when(F.col("__mx").isNull(), FIELD).otherwise(size(*named("mx", "my", "mz"))),
            "__gravity": F.when(F.col("__gravity_x").isNull(), GRAVITY).otherwise(size(*named("gravity_x", "gravity_y", "gravity_z"))),
            "__kmh": F.col("__speed") * 3.6,
            "__yaw_rate": F.col("__gz"),
            "__pitch_rate": F.col("__gx"),
            "__roll_rate": F.col("__gy"),
        }
    )
    change = lambda c: F.when(F.col("__step") == 1, 0.0).otherwise(F.col(f"__{c}") - F.lag(f"__{c}").over(w))
    out = out.withColumns({"__dt": F.when(F.col("__dt") > 0, F.col("__dt")).otherwise(STEP)} | {f"__{c}_change": change(c) for c in ("accel", "gyro", "field", "kmh", "yaw_rate", "pitch_rate", "roll_rate")})
    frame = w.rowsBetween(1 - n, 0)
    rolled: list[Column] = []
    for c in ROLLED:
        low, high = F.min(f"__{c}").over(frame), F.max(f"__{c}").over(frame)
        rolled += [F.avg(f"__{c}").over(frame), F.stddev_pop(f"__{c}").over(frame), low, high, high - low]
    values = {c: F.col(f"__{c}") for c in (*SENSORS, "t", "dt", "elapsed", "accel", "gyro", "field", "gravity", "kmh", *[f"{c}_change" for c in ("accel", "gyro", "field", "kmh", "yaw_rate", "pitch_rate", "roll_rate")])}
    vector = [*_row(values), *rolled]
    if len(vector) != len(DEPLOYABLE_FEATURES):
        raise AssertionError("features and their names differ in number")
    return out.select(track, on, row, F.col("__step").alias("step"), F.array(*vector).alias("vector"))


def online_windows(df: DataFrame, n: int = 30, track: str = "track_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """track, time, row and window (``n`` steps by features): for each row with 2 n - 2 rows before it, so that all rolling statistics are over ``n`` rows."""
    w = Window.partitionBy(track).orderBy(on, row)
    out = online_vectors(df, n, track, on, row).withColumn("window", F.collect_list("vector").over(w.rowsBetween(1 - n, 0)))
    return out.filter(F.col("step") >= 2 * n - 1).select(track, on, row, "window")


def scaled(windows: DataFrame, medians: list[float], means: list[float], scales: list[float], column: str = "window") -> DataFrame:
    """``column`` with missing values filled by ``medians`` and all standardised."""
    fit = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(c)).alias("c")) for a, b, c in zip(medians, means, scales, strict=True)])
    return windows.withColumn(column, F.transform(column, lambda step: F.zip_with(step, fit, lambda x, f: (F.coalesce(x, f["a"]) - f["b"]) / f["c"])))


def windows(rows: np.ndarray, first: float, n: int, old: int, begins: bool) -> list:
    """The same by arrays, for streams: the window of each row after the ``old`` first ones (None if too few came before). ``rows``: time and
    ``SENSORS``; ``first``: the track's first time; ``begins``: whether the track begins with these rows."""
    v = dict(zip(("t", *SENSORS), rows.T, strict=True))
    size = lambda *c: np.sqrt(sum(v[x] * v[x] for x in c))
    v["elapsed"] = v["t"] - first
    step = np.append(np.nan, np.diff(v["t"]))
    v["dt"] = np.where(step > 0, step, STEP)
    v |= {"accel": size("ax", "ay", "az"), "gyro": size("gx", "gy", "gz"), "kmh": v["speed"] * 3.6, "yaw_rate": v["gz"], "pitch_rate": v["gx"], "roll_rate": v["gy"]}
    v["field"] = np.where(np.isnan(v["mx"]), FIELD, size("mx", "my", "mz"))
    v["gravity"] = np.where(np.isnan(v["gravity_x"]), GRAVITY, size("gravity_x", "gravity_y", "gravity_z"))
    for c in ("accel", "gyro", "field", "kmh", "yaw_rate", "pitch_rate", "roll_rate"):
        v[f"{c}_change"] = np.append(0.0 if begins else np.nan, np.diff(v[c]))
    plain = np.column_stack(_row(v))
    out: list = [None] * (len(rows) - old)
    for i in range(max(old, 2 * n - 2), len(rows)):
        rolled = []
        for c in ROLLED:
            x = np.lib.stride_tricks.sliding_window_view(v[c][i - 2 * n + 2 : i + 1], n)
            none = np.isnan(x).all(1)
            filled = np.where(none[:, None], 0.0, x)
            low, high = np.nanmin(filled, 1), np.nanmax(filled, 1)
            rolled += [np.where(none, np.nan, s) for s in (np.nanmean(filled, 1), np.nanstd(filled, 1), low, high, high - low)]
        whole = np.column_stack([plain[i - n + 1 : i + 1], *rolled])
        out[i - old] = [[None if x != x else x for x in line] for line in whole.tolist()]
    return out
