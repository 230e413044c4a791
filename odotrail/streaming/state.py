"""Streaming operators: state kept per track, and the watermarked synchronisation of two streams.

The operators are those of tables (``Fold`` and ``Scan`` of ``operators.tracks``), so a stream and a table give the same rows. Their state
is a typed entry of the state store; the state that a table's fold ends in can be a stream's first one.

- Without ``event_time``, each batch's rows of a track are put in order and worked on as they come. Tracks are dealt to ``BUCKETS`` keys by hash; those of
  a bucket run side by side, each with its own entry in the bucket's map of states. ``ttl_ms`` drops the state of a track that
  has had no rows for so long (such a query goes on looking for idle tracks, and does not end by itself).
- With ``event_time`` (a timestamp), rows wait in a list of the state store until the watermark, ``late`` behind the newest row, has passed
  their batch, and are then worked on in order, whatever batch they came in; rows later than that are dropped by the watermark. ``idle_ms`` after a
  track's last row (by the watermark) its state is dropped, and its next row begins it anew.

These need Spark's RocksDB state store, which is chosen where the session still has the default one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import fusion, online
from ..operators import tracks as tr

#: Keys of streams without ``event_time``; fixed, as a query's state is found by them.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Carried:
    """A ``Fold`` with its states from batch to batch. ``run``: rows in order, where each track's begin, and what was held of each (or None)."""

    state = "state array<double>"

    def __init__(self, op: tr.Fold):
        self.op = op

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, held: list[tuple | None]) -> tuple[pd.DataFrame, list[tuple | None]]:
        before = np.array([np.full(self.op.width, np.nan) if h is None else h[0] for h in held], float)
        found, after = self.op.run(pdf, starts, before)
        return pdf.assign(**found), [(s,) for s in after.tolist()]


class CarriedScan:
    """A ``Scan`` with its states from batch to batch."""

    state = "state array<double>"

    def __init__(self, op: tr.Scan):
        self.op = op

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, held: list[tuple | None]) -> tuple[pd.DataFrame, list[tuple | None]]:
        before = [[] if h is None else list(h[0]) for h in held]
        after = [([float(v) for v in self.op.after(b, e)],) for b, e in zip(before, self.op.effects(pdf, starts), strict=True)]
        return self.op.fill(pdf, starts, before), after


class OneByOne:
    """Tracks one after the other: ``one`` with a track's rows and what was held of it."""

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, held: list[tuple | None]) -> tuple[pd.DataFrame, list[tuple | None]]:
        ends = [*starts[1:].tolist(), len(pdf)]
        done = [self.one(pdf.iloc[a:b], h) for a, b, h in zip(starts.tolist(), ends, held, strict=True)]
        return pd.concat([out for out, _ in done]), [after for _, after in done]

    def one(self, pdf: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        raise NotImplementedError


class Sticky(OneByOne):
    """The last match of a track stands in where there is none."""

    state = "segment string, lat double, lon double"

    def one(self, pdf: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        own = pdf["road_segment_id"].notna()
        match = pdf[["road_segment_id", "matched_latitude", "matched_longitude"]]
        last = match.where(own).ffill()
        known = own.cumsum() > 0
        if held is not None:
            last.loc[~known] = list(held)
            known[:] = True
        out = pdf.assign(source=np.where(own, "match", np.where(known, "last", "query")))
        out["road_segment_id"] = last["road_segment_id"].where(known, "")
        out["matched_latitude"] = last["matched_latitude"].astype(float).where(known, pdf["lat"])
        out["matched_longitude"] = last["matched_longitude"].astype(float).where(known, pdf["lon"])
        out["map_confidence"] = pdf["map_confidence"].where(own, np.where(known, 0.3, 0.0))
        end = last.iloc[-1]
        return out, (str(end.iloc[0]), float(end.iloc[1]), float(end.iloc[2])) if known.iloc[-1] else None


class Windows(OneByOne):
    """Windows of online features, from the last 2 n rows of a track."""

    def __init__(self, names: list[str], n: int):
        self.names, self.n = names, n
        self.state = "first double, rows array<array<double>>"

    def one(self, pdf: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        new = tr.numbers(pdf, *self.names)
        old = np.zeros((0, len(self.names))) if held is None else np.array(held[1], float).reshape(-1, len(self.names))
        rows = np.concatenate([old, new])
        first = float(rows[0, 0]) if held is None else held[0]
        found = online.windows(rows, first, self.n, len(old), len(old) < 2 * self.n)
        keep = np.array([w is not None for w in found], bool)
        out = pdf[keep].assign(window=[w for w in found if w is not None])
        return out, (first, rows[-2 * self.n :].tolist())


class TrackProcessor(StatefulProcessor):
    """The rows of a key, a bucket of tracks or a track alone, put in order and given to ``op``, all tracks side by side."""

    def __init__(self, op, waiting: T.StructType, wanted: list[str], track: str, on: str, row: str, event_time: str | None, idle_ms: int | None, ttl_ms: int | None):
        self.op, self.schema, self.wanted, self.track, self.on, self.row = op, waiting, wanted, track, on, row
        self.event_time, self.idle_ms, self.ttl_ms = event_time, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", T.StructType([self.schema[self.track]]), self.op.state, self.ttl_ms)
        if self.event_time:
            self.waiting = handle.getListState("waiting", self.schema)
            self.last = handle.getValueState("last", "ms long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for name, state in zip(self._names(initialState), initialState["state"], strict=True):
            self.held.updateValue(name, (list(state),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        if not self.event_time:
            yield from self._work(new)
            return
        now = timerValues.getCurrentWatermarkInMs()
        new = new[new[self.event_time].map(lambda v: pd.isna(v) or now <= 0 or _ms(v) > now).to_numpy(bool)]  # what is older may have been passed
        if not len(new):
            return
        self.waiting.appendList(_plain(new))
        newest = new[self.event_time].max()
        if pd.notna(newest):
            self.handle.registerTimer(_ms(newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.waiting.get()) if self.waiting.exists() else [], columns=[f.name for f in self.schema])
        due = held[self.event_time].map(lambda v: pd.isna(v) or _ms(v) <= now).to_numpy(bool) if len(held) else np.zeros(0, bool)
        if due.any():
            rest = held[~due]
            if len(rest):
                self.waiting.put(_plain(rest))
            else:
                self.waiting.clear()
            newest = held[due][self.event_time].max()
            if pd.notna(newest):
                self.last.update((_ms(newest),))
                if self.idle_ms is not None:
                    self.handle.registerTimer(_ms(newest) + self.idle_ms)
            yield from self._work(held[due])
        elif not len(held) and self.idle_ms is not None and self.last.exists() and self.last.get()[0] + self.idle_ms <= now:
            self.held.clear()
            self.last.clear()

    def _work(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows, starts = tr.in_order(rows, (self.track, self.on, self.row))
        names, known = self._names(rows.iloc[starts]), self.held.exists()
        held = [self.held.getValue(n) if known and self.held.containsKey(n) else None for n in names]
        out, states = self.op.run(rows, starts, held)
        for name, state in zip(names, states, strict=True):
            if state is not None:
                self.held.updateValue(name, state)
        if len(out):
            yield out[self.wanted]

    def _names(self, rows: pd.DataFrame) -> list[tuple]:
        """Tracks as keys; whole numbers beside a null come as doubles."""
        whole = isinstance(self.schema[self.track].dataType, T.IntegralType)
        return [(None if pd.isna(v) else int(v) if whole else v,) for (v,) in _plain(rows[[self.track]])]


def _ms(v) -> int:
    """Milliseconds of a timestamp, rounded up."""
    return -(-pd.Timestamp(v).value // 1_000_000)


def _plain(pdf: pd.DataFrame) -> list[tuple]:
    """Rows as Python's own values."""
    columns = []
    for c in pdf.columns:
        values = pdf[c].tolist()  # numpy's numbers become Python's
        columns.append([None if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.tolist() if isinstance(v, np.ndarray) else v for v in values])
    return list(zip(*columns, strict=True))


def stateful(df: DataFrame, op, schema: T.StructType, track: str, on: str, row: str, event_time: str | None = None, late: str = "10 seconds", idle_ms: int | None = None, ttl_ms: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """``op`` (as ``Carried``) over each track of a stream. ``initial``: (track, state), the state that tracks begin with; see ``operators.tracks.end_states``."""
    conf = df.sparkSession.conf
    if "RocksDB" not in (conf.get("spark.sql.streaming.stateStore.providerClass", "") or ""):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    if event_time:
        df = df.withWatermark(event_time, late)
    processor = TrackProcessor(op, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]), [f.name for f in schema], track, on, row, event_time, idle_ms, ttl_ms)
    mode = "EventTime" if event_time else "ProcessingTime" if ttl_ms else "None"
    bucket = F.pmod(F.xxhash64(track), F.lit(BUCKETS))
    dealt = lambda x: x.groupBy(track) if event_time else x.withColumn("__bucket", bucket).groupBy("__bucket")
    return dealt(df).transformWithStateInPandas(processor, schema, "Append", mode, initialState=None if initial is None else dealt(initial))


class ModeFold(tr.Fold):
    """The mode machine and the weight that comes of it; state: mode, steps of recovery."""

    width = 2

    def run(self, pdf: pd.DataFrame, starts: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        inputs, bad = fusion.mode_inputs(pdf), tr.flags(pdf, "is_anomalous")
        state = np.nan_to_num(state)

        def step(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            now = fusion.MODE_TABLE[inputs[at], s[:, 0].astype(int)]
            ramp = np.where(fusion.IN_RECOVERY[now], s[:, 1] + 1, 0)
            weight = np.where(fusion.IN_RECOVERY[now], np.minimum(1.0, ramp / 10), np.where(fusion.IN_DENIED[now], 0.0, np.where(bad[at], 0.5, 1.0)))
            return np.column_stack([now, ramp]), np.column_stack([now, weight])

        state, out = tr.side_by_side(starts, len(pdf), state, step)
        return {"mode": fusion.MODE_NAMES[out[:, 0].astype(int)], "gnss_weight": out[:, 1]}, state


def mode_fsm_stream(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """Adds mode and gnss_weight. ``options``: those of ``stateful``."""
    return stateful(df, Carried(ModeFold()), tr.typed(df, mode="string", gnss_weight="double"), track, on, row, **options)


def sticky_match_stream(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """Rows with road_segment_id, matched_latitude, matched_longitude, map_confidence (null without a match), lat and lon:
    without a match the last one's with confidence 0.3, or the own position with confidence 0. Adds source."""
    return stateful(df, Sticky(), tr.typed(df, source="string"), track, on, row, **options)


def throttle_stream(df: DataFrame, min_gap: float = 0.05, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """Rows at least ``min_gap`` seconds after the last kept one of their track."""
    return stateful(df, CarriedScan(fusion.Throttle(on, min_gap)), df.schema, track, on, row, **options)


def online_features(df: DataFrame, n: int = 30, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """track, time, row and window: the model's input at each row with 2 n - 2 rows before it, as ``operators.online.online_windows`` of a table."""
    schema = T.StructType([df.schema[track], df.schema[on], df.schema[row], T.StructField("window", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return stateful(df, Windows([on, *online.SENSORS], n), schema, track, on, row, **options)


def orientation_stream(df: DataFrame, gyro: tuple[str, str, str] = ("gx", "gy", "gz"), euler: tuple[str, str, str] = ("yaw", "pitch", "roll"), accel: tuple[str, str, str] | None = None, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """Adds track_yaw, track_pitch and track_roll."""
    return stateful(df, Carried(fusion.OrientationFold(on, gyro, euler, accel)), tr.typed(df, track_yaw="double", track_pitch="double", track_roll="double"), track, on, row, **options)


def ins_stream(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """Adds the inertial track, as ``fusion.ins_track``."""
    return stateful(df, Carried(fusion.InsFold(on)), tr.typed(df, **fusion.ins_types()), track, on, row, **options)


def fusion_stream(df: DataFrame, track: str = "track_id", on: str = "t", row: str = "row_idx", **options) -> DataFrame:
    """The whole cycle (``fusion.FUSED``), as ``fusion.fusion_pipeline``; a map match joined before gives map_grade_pct."""
    return stateful(df, Carried(fusion.FusionFold(on)), tr.typed(df, **fusion.fused_types()), track, on, row, **options)


def watermarked_sync_stream(s: DataFrame, v: DataFrame, tolerance: str = "50 milliseconds", late: str = "10 seconds", by: str = "sequence_id", ts: str = "ts", row: str = "row_idx") -> DataFrame:
    """Two streams joined within ``tolerance`` of each other, per sequence; every S row keeps its nearest V row (a tie: the
    later one), or nulls if there is none. ``row`` numbers the rows of S, so that equal ones stay apart. Rows later than ``late`` are
    dropped by the watermark; results come once it has passed them."""
    if row not in s.columns:
        raise ValueError(f"S has no column {row} that numbers its rows")
    left = s.select(by, F.col(ts).alias("s_ts"), *[F.col(c).alias(f"S_{c}") for c in s.columns if c not in (by, ts)]).withWatermark("s_ts", late)
    right = v.select(F.col(by).alias("__by"), F.col(ts).alias("v_ts"), *[F.col(c).alias(f"V_{c}") for c in v.columns if c not in (by, ts)]).withWatermark("v_ts", late)
    near = (F.col(by) == F.col("__by")) & F.expr(f"v_ts between s_ts - interval {tolerance} and s_ts + interval {tolerance}")
    pairs = left.join(right, near, "left").drop("__by")
    away = F.abs(F.unix_micros("v_ts") - F.unix_micros("s_ts"))
    keys = [by, "s_ts", *[c for c in pairs.columns if c.startswith("S_")]]
    rest = F.struct("v_ts", *[F.col(c) for c in pairs.columns if c.startswith("V_")])
    best = pairs.groupBy(*keys).agg(F.min_by(rest, F.struct(away.alias("d"), (-F.unix_micros("v_ts")).alias("t"))).alias("v"), F.min(away).alias("difference_us"))
    return best.select(*keys, "v.*", "difference_us")


def to_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text, for a message sink."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def from_json_lines(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("value", schema).alias("v")).select("v.*")
