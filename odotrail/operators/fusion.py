"""Track fusion: navigation modes, filters, calibration, inertial tracks, Kalman filtering.

What goes through a track in order is spread over tasks by ``tracks``: mode machine, low and high passes and throttle as scans, the rest as
folds of array steps with all tracks of a task side by side (``kinematics``). Long tracks are cut into blocks either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, scalar
from . import kinematics as kin
from . import tracks
from .kinematics import G
from .tracks import flags, numbers, typed

DOMINANT, HYBRID, DEGRADED, DENIED, RECOVERY = "GNSS_DOMINANT", "HYBRID", "GNSS_DEGRADED", "GNSS_DENIED", "RECOVERY"
RECOVERY_STEPS = 10


def next_mode(mode: str, count: int, confidence: float, anomalous: bool, nav_mode: str) -> tuple[str, int]:
    """(mode, steps in recovery) after one update."""
    c = min(1.0, max(0.0, confidence))
    if mode == DENIED:
        return (RECOVERY, 0) if nav_mode != "DENIED" and c > 0.1 else (DENIED, count)
    if mode == RECOVERY:
        if count < RECOVERY_STEPS:
            return RECOVERY, count + 1
        return (DEGRADED if anomalous or c < 0.3 else DOMINANT if c > 0.8 else HYBRID), 0
    if nav_mode == "DENIED" or c < 0.05:
        return DENIED, count
    if mode == DEGRADED:
        return (HYBRID if not anomalous and c > 0.4 else DEGRADED), count
    if anomalous or nav_mode == "ANOMALOUS" or c < (0.3 if mode == DOMINANT else 0.2):
        return DEGRADED, count
    if mode == DOMINANT:
        return (HYBRID if c < 0.7 else DOMINANT), count
    return (DOMINANT if c > 0.8 else HYBRID), count


def fold_tracks(df: DataFrame, fold: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], track: str, on: str, row: str, **columns: str) -> DataFrame:
    """``fold`` over the rows of whole tracks, many of them a task, in order and with where each track's begin; it returns the rows with the new columns."""
    schema, d = typed(df, **columns), tracks.deal(df, track, on, row, block_rows=2**62)  # no track is cut
    return d.rows.groupBy("__piece").applyInPandas(lambda pdf: fold(*tracks.in_order(pdf, (track, on, row)))[[f.name for f in schema]], schema)


#: What the mode machine can be in: a mode and, in recovery, the steps in it.
MODE_STATES = [(DOMINANT, 0), (HYBRID, 0), (DEGRADED, 0), (DENIED, 0), *[(RECOVERY, n) for n in range(RECOVERY_STEPS + 1)]]
MODE_NAMES = np.array([m for m, _ in MODE_STATES], object)
IN_RECOVERY, IN_DENIED = MODE_NAMES == RECOVERY, MODE_NAMES == DENIED
#: Confidences at which the machine's rules change; a confidence is told by how many of these are below it and at most it.
_CUTS = np.array([0.05, 0.1, 0.2, 0.3, 0.4, 0.7, 0.8])


def _mode_table() -> np.ndarray:
    """(inputs x states): the state after one. Inputs: confidence by cuts, anomalous, navigation mode (other, ANOMALOUS, DENIED)."""
    at = {s: i for i, s in enumerate(MODE_STATES)}
    inner = [_CUTS[0] / 2, *((_CUTS[1:] + _CUTS[:-1]) / 2), 0.9]
    levels = [v for pair in zip(inner, [*_CUTS, None], strict=True) for v in pair if v is not None]
    return np.array([[at[next_mode(m, n, c, bad, nav)] for m, n in MODE_STATES] for c in levels for bad in (False, True) for nav in ("", "ANOMALOUS", "DENIED")])


MODE_TABLE = _mode_table()


def mode_inputs(pdf: pd.DataFrame) -> np.ndarray:
    """The row of ``MODE_TABLE`` of each row: a missing confidence counts as 0, a missing flag as false, a missing navigation mode as none."""
    c = np.clip(np.nan_to_num(numbers(pdf, "confidence")[:, 0]), 0.0, 1.0)
    level = np.searchsorted(_CUTS, c, "left") + np.searchsorted(_CUTS, c, "right")
    nav = pdf["navigation_mode"]
    return level * 6 + flags(pdf, "is_anomalous") * 3 + (nav == "ANOMALOUS").to_numpy(bool) + 2 * (nav == "DENIED").to_numpy(bool)


class ModeScan(tracks.Scan):
    """A row is a map from states to states, and so is a block; maps compose."""

    def effects(self, pdf: pd.DataFrame, starts: np.ndarray) -> list[list[float]]:
        inputs, (begin, of) = mode_inputs(pdf), tracks.cut(starts, len(pdf))
        every = np.tile(np.arange(len(MODE_STATES)), (len(begin), 1))
        maps = tracks.steps(begin, len(pdf), every, lambda s, at: MODE_TABLE[inputs[at][:, None], s])
        out = [np.arange(len(MODE_STATES))] * len(starts)
        for m, k in zip(maps, of.tolist(), strict=True):
            out[k] = m[out[k]]
        return [m.astype(float).tolist() for m in out]

    def after(self, state: list[float], effect: list[float]) -> list[float]:
        return [effect[int(state[0]) if state else 0]]

    def states(self, pdf: pd.DataFrame, starts: np.ndarray, states: list[list[float]]) -> np.ndarray:
        """The state after each row."""
        inputs, (begin, of) = mode_inputs(pdf), tracks.cut(starts, len(pdf))
        every = np.tile(np.arange(len(MODE_STATES)), (len(begin), 1))
        maps = tracks.steps(begin, len(pdf), every, lambda s, at: MODE_TABLE[inputs[at][:, None], s])
        now, first = [int(s[0]) if s else 0 for s in states], np.zeros(len(begin), np.int64)
        for i, k in enumerate(of.tolist()):
            first[i] = now[k]
            now[k] = int(maps[i][now[k]])
        out = np.zeros(len(pdf), np.int64)

        def step(s: np.ndarray, at: np.ndarray) -> np.ndarray:
            out[at] = MODE_TABLE[inputs[at], s]
            return out[at]

        tracks.steps(begin, len(pdf), first, step)
        return out

    def fill(self, pdf: pd.DataFrame, starts: np.ndarray, states: list[list[float]]) -> pd.DataFrame:
        return pdf.assign(mode=MODE_NAMES[self.states(pdf, starts, states)])


def mode_fsm(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Adds mode, from confidence, is_anomalous and navigation_mode.

    As in ``mode_fsm_fold``, a missing confidence (null or NaN) counts as 0, a missing flag as false, a missing navigation mode as
    none; rows without a time come last, and repeated rows are steps each."""
    return tracks.scan(df, ModeScan(), track, on, row, {"mode": "string"}, block_rows)


def mode_fsm_fold(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """The same by a fold in Python, a row at a time: what ``mode_fsm`` is tested against."""

    def fold(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        first, out = np.zeros(len(pdf), bool), []
        first[starts] = True
        for new, c, a, m in zip(first.tolist(), pdf["confidence"], pdf["is_anomalous"], pdf["navigation_mode"], strict=True):
            mode, n = next_mode(*((DOMINANT, 0) if new else (mode, n)), c, a, m)
            out.append(mode)
        return pdf.assign(mode=out)

    return fold_tracks(df, fold, track, on, row, mode="string")


def gnss_weight_ramp(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Adds gnss_weight: 0 when denied, n/10 in the n-th step of recovery, else 0.5 if anomalous, 1 if not."""
    w = Window.partitionBy(track).orderBy(on, row)
    changed = F.coalesce((F.col("mode") != F.lag("mode").over(w)).cast("int"), F.lit(0))
    out = df.withColumn("__new", changed).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(track, "__run").orderBy(on, row))
    weight = F.when(F.col("mode") == RECOVERY, F.least(F.col("__n") / 10.0, F.lit(1.0))).when(F.col("mode") == DENIED, 0.0).when(F.col("is_anomalous"), 0.5).otherwise(1.0)
    return out.withColumn("__n", n).withColumn("gnss_weight", weight).drop("__new", "__run", "__n")


class LowPass(tracks.Scan):
    """Over a block f becomes A f + B; S, if there was no f yet."""

    def __init__(self, columns: list[str], alpha: float):
        self.columns, self.alpha = columns, alpha

    def step(self, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), f, np.where(np.isnan(f), x, self.alpha * f + (1 - self.alpha) * x))

    def lines(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(parts x 3 x columns): A, B and S."""
        start = np.zeros((len(begin), 3, len(self.columns)))
        start[:, 0], start[:, 2] = 1.0, np.nan

        def step(s: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.stack([np.where(np.isnan(x[at]), s[:, 0], self.alpha * s[:, 0]), self.step(s[:, 1], x[at]), self.step(s[:, 2], x[at])], 1)

        return tracks.steps(begin, len(x), start, step)

    @staticmethod
    def moved(line: np.ndarray, f: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(f), line[2], line[0] * f + line[1])

    def before(self, state: list[float]) -> np.ndarray:
        return np.array(state) if state else np.full(len(self.columns), np.nan)

    def effects(self, pdf: pd.DataFrame, starts: np.ndarray) -> list[list[float]]:
        x, (begin, of) = numbers(pdf, *self.columns), tracks.cut(starts, len(pdf))
        out = [np.stack([np.ones(x.shape[1]), np.zeros(x.shape[1]), np.full(x.shape[1], np.nan)]) for _ in starts]
        for line, k in zip(self.lines(x, begin), of.tolist(), strict=True):
            a = out[k]
            out[k] = np.stack([line[0] * a[0], line[0] * a[1] + line[1], self.moved(line, a[2])])
        return [o.ravel().tolist() for o in out]

    def after(self, state: list[float], effect: list[float]) -> list[float]:
        return self.moved(np.array(effect).reshape(3, -1), self.before(state)).tolist()

    def fill(self, pdf: pd.DataFrame, starts: np.ndarray, states: list[list[float]]) -> pd.DataFrame:
        x, (begin, of) = numbers(pdf, *self.columns), tracks.cut(starts, len(pdf))
        now = [self.before(s) for s in states]
        first, out = np.zeros((len(begin), len(self.columns))), np.zeros(x.shape)
        for i, (line, k) in enumerate(zip(self.lines(x, begin), of.tolist(), strict=True)):
            first[i] = now[k]
            now[k] = self.moved(line, now[k])

        def step(f: np.ndarray, at: np.ndarray) -> np.ndarray:
            out[at] = self.step(f, x[at])
            return out[at]

        tracks.steps(begin, len(x), first, step)
        return pdf.assign(**{f"{c}_low": out[:, i] for i, c in enumerate(self.columns)})


def low_pass(df: DataFrame, columns: list[str], alpha: float = 0.9, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Adds <column>_low: f = alpha f + (1 - alpha) x, from the first value on; a missing value holds f."""
    return tracks.scan(df, LowPass(columns, alpha), track, on, row, {f"{c}_low": "double" for c in columns}, block_rows)


class HighPass(tracks.Scan):
    """The state is f and the last value; over a block f becomes A (f - last + first) + B, with the block's first value; S, if there was no value yet."""

    def __init__(self, columns: list[str], alpha: float):
        self.columns, self.alpha = columns, alpha

    def step(self, f: np.ndarray, last: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = np.where(np.isnan(last), 0.0, self.alpha * (f + x - last))
        return np.where(np.isnan(x), f, moved), np.where(np.isnan(x), last, x)

    def lines(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(parts x 5 x columns): A, B, S, first and last value."""
        start = np.zeros((len(begin), 5, len(self.columns)))
        start[:, 0], start[:, 3:] = 1.0, np.nan

        def step(s: np.ndarray, at: np.ndarray) -> np.ndarray:
            v = x[at]
            gone = np.isnan(v)
            s0, last = self.step(s[:, 2], s[:, 4], v)
            return np.stack([np.where(gone, s[:, 0], self.alpha * s[:, 0]), self.step(s[:, 1], s[:, 4], v)[0], s0, np.where(np.isnan(s[:, 3]), v, s[:, 3]), last], 1)

        return tracks.steps(begin, len(x), start, step)

    @staticmethod
    def moved(line: np.ndarray, state: np.ndarray) -> np.ndarray:
        f, last = state
        none = np.isnan(line[4])
        new = np.where(np.isnan(last), line[2], line[0] * (f - last + line[3]) + line[1])
        return np.stack([np.where(none, f, new), np.where(none, last, line[4])])

    def effects(self, pdf: pd.DataFrame, starts: np.ndarray) -> list[list[float]]:
        x, (begin, of) = numbers(pdf, *self.columns), tracks.cut(starts, len(pdf))
        empty = np.zeros((5, x.shape[1]))
        empty[0], empty[3:] = 1.0, np.nan
        out = [empty for _ in starts]
        for line, k in zip(self.lines(x, begin), of.tolist(), strict=True):
            a = out[k]
            none, fresh = np.isnan(line[4]), np.isnan(a[4])
            joined = np.stack([line[0] * a[0], line[0] * (a[1] - a[4] + line[3]) + line[1], self.moved(line, a[[2, 4]])[0], a[3], line[4]])
            out[k] = np.where(none, a, np.where(fresh, line, joined))
        return [o.ravel().tolist() for o in out]

    def before(self, state: list[float]) -> np.ndarray:
        return np.array(state).reshape(2, -1) if state else np.stack([np.zeros(len(self.columns)), np.full(len(self.columns), np.nan)])

    def after(self, state: list[float], effect: list[float]) -> list[float]:
        return self.moved(np.array(effect).reshape(5, -1), self.before(state)).ravel().tolist()

    def fill(self, pdf: pd.DataFrame, starts: np.ndarray, states: list[list[float]]) -> pd.DataFrame:
        x, (begin, of) = numbers(pdf, *self.columns), tracks.cut(starts, len(pdf))
        now = [self.before(s) for s in states]
        first, out = np.zeros((len(begin), 2, x.shape[1])), np.zeros(x.shape)
        for i, (line, k) in enumerate(zip(self.lines(x, begin), of.tolist(), strict=True)):
            first[i] = now[k]
            now[k] = self.moved(line, now[k])

        def step(s: np.ndarray, at: np.ndarray) -> np.ndarray:
            out[at], last = self.step(s[:, 0], s[:, 1], x[at])
            return np.stack([out[at], last], 1)

        tracks.steps(begin, len(x), first, step)
        return pdf.assign(**{f"{c}_high": out[:, i] for i, c in enumerate(self.columns)})


def high_pass(df: DataFrame, columns: list[str], alpha: float = 0.98, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Adds <column>_high: f = alpha (f + x - previous x), from 0 on; a missing value holds f."""
    return tracks.scan(df, HighPass(columns, alpha), track, on, row, {f"{c}_high": "double" for c in columns}, block_rows)


def imu_calibration(df: DataFrame, columns: list[str], seconds: float = 3.0, track: str = "track_id", on: str = "t") -> DataFrame:
    """Mean of each column over a track's first seconds: its bias."""
    start = df.groupBy(track).agg(F.min(on).alias("__t0"))
    early = df.join(start, track).filter(F.col(on) - F.col("__t0") < seconds)
    return early.groupBy(track).agg(F.count("*").alias("samples"), *[F.avg(c).alias(f"{c}_bias") for c in columns])


def motion_window_std(df: DataFrame, n: int = 50, x: str = "accel_magnitude", track: str = "track_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Adds motion_std (sample deviation of the last ``n`` values, 0 for one) and vibration (a 2.5th of it, at most 1)."""
    frame = Window.partitionBy(track).orderBy(on, row).rowsBetween(1 - n, 0)
    std = F.coalesce(F.stddev_samp(x).over(frame), F.lit(0.0))
    return df.withColumn("motion_std", std).withColumn("vibration", F.least(F.col("motion_std") / 2.5, F.lit(1.0)))


#: Limits of the motion states (fixed values): the library's own, and those of the phone module.
MOTION = {"gyro_still": 0.05, "accel_still": 0.15, "std_still": 0.04, "disturbed_gyro": 1.5, "disturbed_accel": 2.5, "pothole": 5.0, "pothole_jerk": 150.0, "braking": -2.5, "turning": 0.4, "accelerating": 1.5}
PHONE_MOTION = {"gyro_still": 0.08, "accel_still": 0.35, "std_still": 0.70, "disturbed_gyro": 4.0, "disturbed_accel": 2.5, "pothole": 5.0, "pothole_jerk": 25.0, "braking": -5.0, "turning": 0.25, "accelerating": 1.0}


def motion_state(df: DataFrame, gyro: tuple[str, str, str] = ("gx", "gy", "gz"), vehicle_accel: str = "vehicle_ax", track: str = "track_id", on: str = "t", row: str = "row_idx", limits: dict[str, float] = MOTION) -> DataFrame:
    """Adds motion_state, from accel_magnitude, motion_std, gyroscope and forward acceleration; first rule first."""
    w = Window.partitionBy(track).orderBy(on, row)
    a, m = F.col("accel_magnitude"), limits
    rate = scalar.vector_magnitude(*gyro)
    dt = F.col(on) - F.lag(on).over(w)
    jerk = F.when(dt > 0.001, F.abs(a - F.lag(a).over(w)) / F.when(dt > 0.001, dt)).otherwise(0.0)
    off = F.abs(a - G)
    forward = F.coalesce(vehicle_accel, F.lit(0.0))
    state = (
        F.when((rate > m["disturbed_gyro"]) & (off > m["disturbed_accel"]), "PHONE_DISTURBANCE")
        .when((off > m["pothole"]) & (jerk > m["pothole_jerk"]), "POTHOLE")
        .when((off < m["accel_still"]) & (rate < m["gyro_still"]) & (F.col("motion_std") < m["std_still"]), "STATIONARY")
        .when(forward < m["braking"], "BRAKING")
        .when(F.abs(F.col(gyro[2])) > m["turning"], "TURNING")
        .when(forward > m["accelerating"], "ACCELERATING")
        .otherwise("NORMAL")
    )
    return df.withColumn("motion_state", state)


def imu_confidence(df: DataFrame, heading: str = "gnss_heading", long_seconds: float = 60.0, bias_stability: float = 1.0, track: str = "track_id", on: str = "t", row: str = "row_idx", low_rate_hz: float | None = None, motion: str | None = None) -> DataFrame:
    """Adds imu_confidence: less with vibration and unstable biases, 0 before the first heading, decaying long after the last one.

    The phone module's variant takes ``long_seconds`` 300, a ``low_rate_hz`` (0.45 off where the step before was slower) and the
    ``motion`` state (a disturbance leaves 0.1 at most, a pothole six tenths, a turn nine tenths)."""
    w = Window.partitionBy(track).orderBy(on, row)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col(heading).isNotNull(), F.col(on)), ignorenulls=True).over(running)
    outage = F.col(on) - F.col("__seen")
    c = (1 - 0.45 * F.col("vibration")) * (1 - 0.35 * (1 - F.lit(bias_stability)))
    if low_rate_hz is not None:
        df = df.withColumn("__step", F.lag(on, 1).over(w) - F.lag(on, 2).over(w))
        c = c * F.when((F.col("__step") > 0) & (F.col("__step") * low_rate_hz > 1), 0.55).otherwise(1.0)
    if motion is not None:
        m = F.col(motion)
        c = F.when(m == "PHONE_DISTURBANCE", F.least(c, F.lit(0.1))).when(m == "POTHOLE", c * 0.6).when(m == "TURNING", c * 0.9).otherwise(c)
    c = c * F.when(outage > long_seconds, F.exp(-(outage - long_seconds) / long_seconds)).otherwise(1.0)
    return df.withColumn("__seen", seen).withColumn("imu_confidence", F.when(F.col("__seen").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(c, F.lit(1.0))))).drop("__seen", "__step")


class OrientationFold(tracks.Fold):
    width = 5

    def __init__(self, on: str, gyro: tuple[str, str, str], euler: tuple[str, str, str], accel: tuple[str, str, str] | None):
        self.on, self.gyro, self.euler, self.accel = on, gyro, euler, accel

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        t = numbers(pdf, self.on)[:, 0]
        rate, angles = np.nan_to_num(numbers(pdf, *self.gyro)), np.nan_to_num(numbers(pdf, *self.euler))
        pull = None if self.accel is None else np.nan_to_num(numbers(pdf, *self.accel))

        def step(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = np.isnan(s[:, 0])
            q = kin.turn(np.nan_to_num(s[:, :4]), rate[at], kin.gyro_step(t[at] - s[:, 4]))
            q = q if pull is None else kin.level_by_gravity(q, pull[at])
            q = np.where(new[:, None], kin.quaternion_of(*angles[at].T), q)
            return np.column_stack([q, t[at]]), np.stack(kin.euler_of(q), 1)

        state, out = tracks.side_by_side(starts, len(pdf), state, step)
        return dict(zip(("track_yaw", "track_pitch", "track_roll"), _columns(out, 3), strict=True)), state


def _columns(out: np.ndarray | None, n: int) -> np.ndarray:
    return np.zeros((n, 0)) if out is None else out.T


def orientation_track(df: DataFrame, gyro: tuple[str, str, str] = ("gx", "gy", "gz"), euler: tuple[str, str, str] = ("yaw", "pitch", "roll"), track: str = "track_id", on: str = "t", row: str = "row_idx", accel: tuple[str, str, str] | None = None, block_rows: int | None = None) -> DataFrame:
    """Adds track_yaw, track_pitch, track_roll: the first row's angles, turned on by the gyroscope; with ``accel``, pitch and roll are
    corrected by the accelerometer after each turn (a missing value is 0, and so no gravity)."""
    return tracks.fold(df, OrientationFold(on, gyro, euler, accel), track, on, row, dict.fromkeys(("track_yaw", "track_pitch", "track_roll"), "double"), block_rows)


def _kinds(fields: tuple[str, ...]) -> dict[str, str]:
    return {c: "string" if c == "mode" else "boolean" if c in ("zero_velocity", "drift_warning") else "double" for c in fields}


def _named(fields: tuple[str, ...], out: np.ndarray | None) -> dict[str, np.ndarray]:
    """Columns of an output array; missing doubles and flags are null."""
    found = {}
    for c, x in zip(fields, _columns(out, len(fields)), strict=True):
        found[c] = np.where(np.isnan(x), None, x == 1) if _kinds((c,))[c] == "boolean" else np.where(np.isnan(x), None, x)
    return found


def _sensors(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """accel, gyro, angles, still, grade of each row, for ``kin.ins_step``."""
    three = [np.nan_to_num(numbers(pdf, *c)) for c in (("ax", "ay", "az"), ("gx", "gy", "gz"), ("yaw", "pitch", "roll"))]
    return *three, flags(pdf, "still"), np.nan_to_num(numbers(pdf, "grade_pct")[:, 0])


class InsFold(tracks.Fold):
    width = kin.INS_WIDTH

    def __init__(self, on: str):
        self.on = on

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        t, lat, lon, heading, speed = numbers(pdf, self.on, "lat", "lon", "heading", "speed").T
        accel, gyro, angles, still, grade = _sensors(pdf)
        reset = flags(pdf, "reset")
        fresh = np.isnan(state[:, kin.OFFSET])
        state[fresh] = kin.ins_start(int(fresh.sum()))

        def step(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fix = lat[at], lon[at], heading[at], speed[at]
            kin.ins_enter(s, *fix)
            out = kin.ins_step(s, t[at], accel[at], gyro[at], angles[at], still[at], grade[at])
            kin.ins_fix(s, reset[at], *fix)
            return s, out

        state, out = tracks.side_by_side(starts, len(pdf), state, step)
        return _named(kin.INS_FIELDS, out), state


def ins_track(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Adds the inertial track (``kinematics.INS_FIELDS``). Needs ax..az, gx..gz, yaw, pitch, roll, lat, lon, heading, speed
    (m/s), still and reset (a fix to trust), and optionally grade_pct; the first position is a fix. Missing values: see ``kinematics``;
    ins_lat and ins_lon are null before the first position and heading."""
    return tracks.fold(df, InsFold(on), track, on, row, _kinds(kin.INS_FIELDS), block_rows)


class FilterFold(tracks.Fold):
    width = kin.UKF_WIDTH

    def __init__(self, on: str):
        self.on = on

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        columns = numbers(pdf, self.on, "lat", "lon", "speed", "heading", "accuracy", "confidence", "gnss_weight")

        def step(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return s, kin.filter_step(s, *columns[at].T)

        state, out = tracks.side_by_side(starts, len(pdf), state, step)
        return _named(kin.UKF_FIELDS, out), state


def track_filter(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Adds the fused track (``kinematics.UKF_FIELDS``). Needs lat, lon, speed, heading, accuracy, confidence, gnss_weight. Rows without a
    position, speed or heading are predicted, and corrected by what they have; null before the first position."""
    return tracks.fold(df, FilterFold(on), track, on, row, _kinds(kin.UKF_FIELDS), block_rows)


FUSED = ("mode", "gnss_weight", *kin.INS_FIELDS, *kin.UKF_FIELDS, "final_lat", "final_lon")


class FusionFold(tracks.Fold):
    """The whole cycle: inertial step, mode, weight, filter, choice of position, reset of the inertial state, and the grade of the row's
    map match for the next step. The state: inertial, filter, mode machine, steps of recovery, grade."""

    width = kin.INS_WIDTH + kin.UKF_WIDTH + 3

    def __init__(self, on: str = "t"):
        self.on = on

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        t, lat, lon, heading, speed, accuracy, confidence, matched = numbers(pdf, self.on, "lat", "lon", "heading", "speed", "accuracy", "confidence", "map_grade_pct").T
        accel, gyro, angles, still, grade = _sensors(pdf)
        inputs, bad = mode_inputs(pdf), flags(pdf, "is_anomalous")
        trusted = ~bad & (pdf["navigation_mode"] == "STRONG").to_numpy(bool)
        ins, ukf, (mode, ramp, road) = slice(0, kin.INS_WIDTH), slice(kin.INS_WIDTH, kin.INS_WIDTH + kin.UKF_WIDTH), range(self.width - 3, self.width)
        fresh = np.isnan(state[:, mode])
        state[fresh, ins], state[np.ix_(fresh, [mode, ramp, road])] = kin.ins_start(int(fresh.sum())), 0.0

        def step(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            fix = lat[at], lon[at], heading[at], speed[at]
            kin.ins_enter(s[:, ins], *fix)
            moved = kin.ins_step(s[:, ins], t[at], accel[at], gyro[at], angles[at], still[at], grade[at] + s[:, road])
            now = MODE_TABLE[inputs[at], s[:, mode].astype(int)]
            s[:, ramp] = np.where(IN_RECOVERY[now], s[:, ramp] + 1, 0)
            weight = np.where(IN_RECOVERY[now], np.minimum(1.0, s[:, ramp] / 10), np.where(IN_DENIED[now], 0.0, np.where(bad[at], 0.5, 1.0)))
            s[:, mode] = now
            fused = kin.filter_step(s[:, ukf], t[at], lat[at], lon[at], speed[at], heading[at], accuracy[at], confidence[at], weight)
            final = np.where((IN_DENIED[now] & ~np.isnan(moved[:, 0]))[:, None], moved[:, :2], fused[:, :2])
            kin.ins_fix(s[:, ins], trusted[at], *fix)
            s[:, road] = np.where(np.isnan(matched[at]), s[:, road], matched[at])
            return s, np.column_stack([now, weight, moved, fused, final])

        state, out = tracks.side_by_side(starts, len(pdf), state, step)
        found = _named(FUSED, out)
        return found | {"mode": MODE_NAMES[np.zeros(0, int) if out is None else out[:, 0].astype(int)]}, state


def fused_types() -> dict[str, str]:
    return _kinds(FUSED)


def ins_types() -> dict[str, str]:
    return _kinds(kin.INS_FIELDS)


def fusion_pipeline(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Adds ``FUSED``: needs the columns of ``ins_track`` and ``track_filter``, is_anomalous and navigation_mode. grade_pct is the road's
    grade in a row; map_grade_pct, that of a map match in the row, counts from the next row on (the last one known).

    From the first position on, final_lat and final_lon are there in every row, whatever is missing in it; before, they are null."""
    return tracks.fold(df, FusionFold(on), track, on, row, fused_types(), block_rows)


class Throttle(tracks.Scan):
    """A block's effect: for each row that can be the first one kept (those up to ``min_gap`` after its first row, and the next), its time
    and that of the last one then kept, found by pointers from each row to the next one kept after it, doubled until they end."""

    def __init__(self, on: str, min_gap: float):
        self.on, self.min_gap = on, min_gap

    def next_kept(self, t: np.ndarray) -> np.ndarray:
        """Of each row the first later one at least ``min_gap`` after it, or the number of rows; times ascend."""
        n = len(t)
        at = np.arange(n)
        j = np.maximum(np.searchsorted(t, t + self.min_gap), at + 1)
        far = lambda j: t[np.minimum(j, n - 1)] - t >= self.min_gap
        while (early := (j < n) & ~far(j)).any():  # the sum was rounded
            j[early] += 1
        while (late := (j - 1 > at) & far(j - 1)).any():
            j[late] -= 1
        return j

    def entry(self, t: np.ndarray, last: float) -> int:
        """The first row at least ``min_gap`` after ``last``."""
        return int(np.argmax(np.append(t - last >= self.min_gap, True)))

    def parts(self, pdf: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        t = numbers(pdf, self.on)[:, 0]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
            yield s, t[s:e][~np.isnan(t[s:e])]  # those without a time are last

    def effects(self, pdf: pd.DataFrame, starts: np.ndarray) -> list[list[float]]:
        out = []
        for _, t in self.parts(pdf, starts):
            j = self.next_kept(t)
            ends = np.where(j < len(t), j, np.arange(len(t)))
            while (ends[ends] != ends).any():
                ends = ends[ends]
            k = min(len(t), self.entry(t, t[0]) + 1) if len(t) else 0
            out.append([*t[:k].tolist(), *t[ends[:k]].tolist()])
        return out

    def after(self, state: list[float], effect: list[float]) -> list[float]:
        first, ends = np.array(effect[: len(effect) // 2]), effect[len(effect) // 2 :]
        k = self.entry(first, state[0] if state else -math.inf)
        return [ends[k]] if k < len(first) else state

    def fill(self, pdf: pd.DataFrame, starts: np.ndarray, states: list[list[float]]) -> pd.DataFrame:
        keep = np.zeros(len(pdf), bool)
        for (s, t), state in zip(self.parts(pdf, starts), states, strict=True):
            first = self.entry(t, state[0] if state else -math.inf)
            if first < len(t):
                jump, reached = np.append(self.next_kept(t), len(t)), np.zeros(len(t) + 1, bool)
                reached[first] = True
                while not reached[jump[reached]].all():
                    reached[jump[reached]] = True
                    jump = jump[jump]
                keep[s : s + len(t)] = reached[:-1]
        return pdf[keep]


def throttle(df: DataFrame, min_gap: float = 0.05, track: str = "track_id", on: str = "t", row: str = "row_idx", block_rows: int | None = None) -> DataFrame:
    """Rows at least ``min_gap`` seconds after the last *kept* row of their track; rows without a time are not kept."""
    return tracks.scan(df, Throttle(on, min_gap), track, on, row, {}, block_rows)


class TrackFilter:
    """``kinematics.filter_step`` of one track, one row at a time."""

    FIELDS = kin.UKF_FIELDS

    def __init__(self):
        self.state = kin.filter_start(1)

    def step(self, t: float, lat: float, lon: float, speed: float, heading: float, accuracy: float, confidence: float, weight: float) -> tuple:
        return tuple(kin.filter_step(self.state, *(np.array([v], float) for v in (t, lat, lon, speed, heading, accuracy, confidence, weight)))[0])


class InertialState:
    """``kinematics.ins_step`` of one track, one row at a time."""

    FIELDS = kin.INS_FIELDS

    def __init__(self):
        self.state = kin.ins_start(1)

    def fix(self, lat: float, lon: float, heading: float, speed: float) -> None:
        kin.ins_fix(self.state, np.ones(1, bool), *(np.array([v], float) for v in (lat, lon, heading, speed)))

    def step(self, t: float, accel: np.ndarray, gyro: np.ndarray, angles: np.ndarray, still: bool, grade_pct: float = 0.0) -> tuple:
        return tuple(kin.ins_step(self.state, np.array([t], float), *(np.array([v], float) for v in (accel, gyro, angles)), np.array([bool(still)]), np.array([grade_pct], float))[0])


def sensor_states(df: DataFrame, accuracy: str = "accuracy", satellites: str = "satellites") -> DataFrame:
    """Adds confidence, is_anomalous, anomaly_reasons and navigation_mode of each fix."""
    out = df.withColumn("__q", scalar.gnss_quality(accuracy, satellites))
    return out.select(*df.columns, F.col("__q.confidence").alias("confidence"), F.col("__q.anomalous").alias("is_anomalous"), F.col("__q.reasons").alias("anomaly_reasons"), F.col("__q.mode").alias("navigation_mode"))
