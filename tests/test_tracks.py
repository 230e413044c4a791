"""Operators that go through tracks in order: long tracks in blocks, missing values, equal to plain folds of one row at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from odotrail.functions import geo
from odotrail.operators import fusion, tracks
from odotrail.operators.kinematics import UNKNOWN_ACCURACY, G

SENSORS = "track_id string, row_idx int, t double, ax double, ay double, az double, gx double, gy double, gz double, yaw double, pitch double, roll double, lat double, lon double, speed double, heading double, accuracy double, confidence double, gnss_weight double, is_anomalous boolean, navigation_mode string, still boolean, reset boolean, grade_pct double"
NAMES = [c.split()[0] for c in SENSORS.split(", ")]


def drives(missing, n=40, seed=0, lost=()):
    """Rows of four drives; ``missing``: the share of each measurement that is null; ``lost``: measurements that are null or NaN in all rows from 5 to 30."""
    r, out = np.random.default_rng(seed), []
    for k in range(4):
        t = 0.0
        for i in range(n + k):
            t += float(r.choice([0.1, 0.1, 0.05, 0.7, 3.0]))
            bad, mode = bool(r.random() < 0.2), str(r.choice(["STRONG", "WEAK", "DENIED", "ANOMALOUS"]))
            x = [float(v) for v in r.normal(0, [0.5, 0.5, 0.3, 0.1, 0.1, 0.1])]
            x[2] += G
            row = ["abcd"[k], i, t, *x, *[float(v) for v in r.uniform(-20, 20, 3)], 52 + i * 1e-5, -1.5 + i * 2e-5, float(r.uniform(0, 20)), float(r.uniform(-10, 370)), float(r.uniform(1, 60)), float(r.random()), float(r.choice([0.0, 0.5, 1.0])), bad, mode, bool(r.random() < 0.1), mode == "STRONG", float(r.uniform(-5, 5))]
            for j in range(3, len(row)):
                if r.random() < missing or (NAMES[j] in lost and 5 <= i < 30):
                    row[j] = float("nan") if isinstance(row[j], float) and r.random() < 0.3 else None
            out.append(tuple(row))
    return out


# --- the filter and the inertial track, one row at a time with plain matrices


def known(v):
    return v is not None and not math.isnan(v)


def wrap(a):
    return (a + math.pi) % (2 * math.pi) - math.pi


def one_filter(rows):
    spread = 0.1 * 0.1 * 4
    wm = np.array([(spread - 4) / spread, *[1 / (2 * spread)] * 8])
    wc = wm.copy()
    wc[0] += 1 - 0.01 + 2
    x = p = origin = last = None
    out = []

    def points():
        low = np.linalg.cholesky((p + p.T) / 2 * spread + np.eye(4) * 1e-12)
        return np.array([x, *[x + low[:, j] for j in range(4)], *[x - low[:, j] for j in range(4)]])

    for r in rows:
        here = known(r["lat"]) and known(r["lon"])
        if x is None and here:
            origin, last = (r["lat"], r["lon"]), r["t"]
            x, p = np.array([0, 0, r["speed"] if known(r["speed"]) else 0.0, math.radians(r["heading"] % 360) if known(r["heading"]) else 0.0]), np.eye(4)
        if x is None:
            out.append(None)
            continue
        s = points()
        dt = min(1.0, max(0.0, r["t"] - last))
        last = r["t"]
        s[:, 0], s[:, 1] = s[:, 0] + s[:, 2] * np.cos(s[:, 3]) * dt, s[:, 1] + s[:, 2] * np.sin(s[:, 3]) * dt
        x = wm @ s
        d = s - x
        d[:, 3] = wrap(d[:, 3])
        p = sum(w * np.outer(v, v) for w, v in zip(wc, d, strict=True)) + np.eye(4) * 0.01
        z, rows_of = [], []
        if here:
            z += [math.radians(r["lon"] - origin[1]) * geo.MEAN_RADIUS * math.cos(math.radians(origin[0])), math.radians(r["lat"] - origin[0]) * geo.MEAN_RADIUS]
            rows_of += [0, 1]
        if known(r["speed"]):
            z, rows_of = [*z, r["speed"]], [*rows_of, 2]
        if known(r["heading"]):
            z, rows_of = [*z, math.radians(r["heading"] % 360)], [*rows_of, 3]
        if rows_of:
            bound = lambda v: min(1.0, max(1e-6, v if known(v) else 0.0))
            noise = min(1e15, max(r["accuracy"] if known(r["accuracy"]) else UNKNOWN_ACCURACY, 1.0) / (bound(r["confidence"]) * bound(r["gnss_weight"])))
            s = points()
            zs = s[:, rows_of]
            mean = wm @ zs
            dz, dx = zs - mean, s - x
            dx[:, 3] = wrap(dx[:, 3])
            cov = sum(w * np.outer(a, a) for w, a in zip(wc, dz, strict=True)) + np.eye(len(z)) * noise
            gain = sum(w * np.outer(a, b) for w, a, b in zip(wc, dx, dz, strict=True)) @ np.linalg.inv(cov)
            x = x + gain @ (np.array(z) - mean)
            p = p - gain @ cov @ gain.T
        x[3] = wrap(x[3])
        out.append((origin[0] + math.degrees(x[1] / geo.MEAN_RADIUS), origin[1] + math.degrees(x[0] / (geo.MEAN_RADIUS * math.cos(math.radians(origin[0])))), x[2], math.sqrt(np.trace(p))))
    return out


def by_track(df):
    out = {}
    for r in df.orderBy("track_id", "t", "row_idx").collect():
        out.setdefault(r.track_id, []).append(r)
    return out


@pytest.mark.parametrize("missing, lost", [(0.0, ()), (0.25, ()), (0.0, ("lat",)), (0.1, ("lat", "lon", "heading", "accuracy", "confidence"))])
def test_filter_with_missing_measurements(spark, missing, lost):
    df = spark.createDataFrame(drives(missing, lost=lost), SENSORS)
    for rows in by_track(fusion.track_filter(df)).values():
        want = one_filter([r.asDict() for r in rows])
        assert any(want)
        for r, w in zip(rows, want, strict=True):
            if w is None:
                assert r.fused_lat is None and r.drift_warning is None
            else:
                assert (r.fused_lat, r.fused_lon, r.fused_speed, r.position_error) == pytest.approx(w, rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("missing, lost", [(0.0, ()), (0.3, ()), (0.05, ("lat", "lon", "speed", "heading", "accuracy"))])
def test_fusion_is_whole_from_the_first_fix_on(spark, missing, lost):
    df = spark.createDataFrame(drives(missing, seed=3, lost=lost), SENSORS)
    for rows in by_track(fusion.fusion_pipeline(df)).values():
        begun = False
        for r in rows:
            begun = begun or (known(r.lat) and known(r.lon))
            assert begun == (r.final_lat is not None and r.final_lon is not None)
            if begun:
                assert all(math.isfinite(v) for v in (r.final_lat, r.final_lon, r.fused_lat, r.fused_speed, r.position_error)) and abs(r.final_lat - 52) < 0.1
            assert r["mode"] and r.gnss_weight is not None and math.isfinite(r.ins_speed)
    one = [r for rows in by_track(fusion.fusion_pipeline(df)).values() for r in rows]
    many = [r for rows in by_track(fusion.fusion_pipeline(df, block_rows=7)).values() for r in rows]
    assert one == many


def test_position_of_the_outage_is_the_inertial_one(spark):
    rows = [("a", i, i * 0.1, 1.0, 0.0, G, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, *((52.0, -1.5, 10.0, 0.0, 5.0, 0.9) if i < 20 else (None,) * 6), 1.0, False, "STRONG" if i < 20 else "DENIED", False, i < 20, 0.0) for i in range(120)]
    got = by_track(fusion.fusion_pipeline(spark.createDataFrame(rows, SENSORS)))["a"]
    assert [r["mode"] for r in got[-90:]] == [fusion.DENIED] * 90
    assert all((r.final_lat, r.final_lon) == (r.ins_lat, r.ins_lon) for r in got[-90:])
    assert got[-1].ins_lat > got[30].ins_lat > 52.0
    never = spark.createDataFrame([r[:12] + (None,) * 6 + r[18:] for r in rows], SENSORS)
    assert all(r.final_lat is None and r.fused_lat is None for r in fusion.fusion_pipeline(never).collect())


def test_grade_of_the_last_match_counts_in_the_next_row(spark):
    rows = drives(0.0, seed=5)
    df = spark.createDataFrame(rows, SENSORS).withColumn("match", F.when(F.col("row_idx") % 3 == 0, F.col("row_idx") / 4.0))
    w = "(partition by track_id order by t, row_idx rows between unbounded preceding and 1 preceding)"
    before = df.withColumn("grade_pct", F.expr(f"coalesce(last_value(match) ignore nulls over {w}, 0.0D)"))
    want = by_track(fusion.fusion_pipeline(before))
    got = by_track(fusion.fusion_pipeline(df.withColumn("grade_pct", F.lit(0.0)).withColumnRenamed("match", "map_grade_pct")))
    for k in want:
        assert [(r.ins_lat, r.ins_speed, r.final_lat) for r in got[k]] == [(r.ins_lat, r.ins_speed, r.final_lat) for r in want[k]]


@pytest.mark.parametrize("block_rows", [5, 13])
def test_blocks_equal_whole_tracks(spark, block_rows):
    df = spark.createDataFrame(drives(0.15, seed=7), SENSORS).withColumn("t", F.when(F.rand(1) > 0.03, F.round("t", 0)))  # equal and missing times
    df = df.withColumn("track_id", F.when(F.col("track_id") != "b", F.col("track_id")))
    key = ["track_id", "row_idx"]

    def both(f, *columns):
        a, b = (sorted((tuple(r) for r in f(n).select(*key, *columns).collect()), key=repr) for n in (None, block_rows))
        same = lambda x, y: abs(x - y) <= 1e-9 * max(1.0, abs(x)) if isinstance(x, float) and isinstance(y, float) else x == y
        assert len(a) == len(b) and all(same(*p) for x, y in zip(a, b, strict=True) for p in zip(x, y, strict=True))
        return a

    modes = both(lambda n: fusion.mode_fsm(df, block_rows=n), "mode")
    assert modes == sorted((tuple(r) for r in fusion.mode_fsm_fold(df.withColumns({"confidence": F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0)), "is_anomalous": F.coalesce("is_anomalous", F.lit(False))})).select(*key, "mode").collect()), key=repr)
    both(lambda n: fusion.low_pass(df, ["ax", "gz"], block_rows=n), "ax_low", "gz_low")
    both(lambda n: fusion.high_pass(df, ["ax", "gz"], block_rows=n), "ax_high", "gz_high")
    both(lambda n: fusion.orientation_track(df, block_rows=n), "track_yaw", "track_pitch")
    both(lambda n: fusion.ins_track(df, block_rows=n), "ins_lat", "ins_speed", "zero_velocity")
    both(lambda n: fusion.track_filter(df, block_rows=n), "fused_lat", "position_error")
    for gap in (0.0, 1.0, 4.5):
        both(lambda n: fusion.throttle(df, gap, block_rows=n))


def folded(xs, alpha, high):
    """The passes, one value at a time."""
    f, last, out = (0.0 if high else math.nan), math.nan, []
    for x in xs:
        if x is not None and not math.isnan(x):
            if high:
                f = 0.0 if math.isnan(last) else alpha * (f + x - last)
            else:
                f = x if math.isnan(f) else alpha * f + (1 - alpha) * x
            last = x
        out.append(None if math.isnan(f) else f)
    return out


def test_passes_and_throttle_equal_loops(spark):
    df = spark.createDataFrame(drives(0.2, seed=9), SENSORS)
    got = by_track(fusion.high_pass(fusion.low_pass(df, ["ax"], 0.8, block_rows=6), ["ax"], block_rows=9))
    for rows in got.values():
        for name, alpha, high in (("ax_low", 0.8, False), ("ax_high", 0.98, True)):
            assert [r[name] for r in rows] == pytest.approx(folded([r.ax for r in rows], alpha, high), abs=1e-12)
    for gap in (0.0, 0.1, 0.15, 1.0):
        kept = {k: [r.row_idx for r in rows] for k, rows in by_track(fusion.throttle(df, gap, block_rows=8)).items()}
        for k, rows in got.items():
            want, last = [], -math.inf
            for r in rows:
                if r.t - last >= gap:
                    want.append(r.row_idx)
                    last = r.t
            assert kept[k] == want


def test_one_track_of_a_million_rows_is_many_tasks(spark):
    n = 1_000_000
    df = spark.range(0, n, 1, 4).select(F.lit("a").alias("track_id"), F.col("id").alias("row_idx"), (F.col("id") / 64.0).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("confidence"), (F.col("id") % 7 == 0).alias("is_anomalous"), F.when(F.col("id") % 501 == 0, "DENIED").otherwise("WEAK").alias("navigation_mode"), (F.col("id") % 10).cast("double").alias("x"))
    d = tracks.deal(df, "track_id", "t", "row_idx")
    sizes = [r["count"] for r in d.rows.groupBy("__block").count().collect()]
    assert d.blocks == len(sizes) == 5 and max(sizes) < 1.1 * tracks.BLOCK_ROWS
    got = fusion.mode_fsm(df).groupBy("mode").count().collect()
    pdf = df.toPandas()
    state, want = 0, np.zeros(len(fusion.MODE_STATES), int)
    for i in fusion.mode_inputs(pdf).tolist():
        state = fusion.MODE_TABLE[i, state]
        want[state] += 1
    assert {r["mode"]: r["count"] for r in got} == {m: int(want[fusion.MODE_NAMES == m].sum()) for m in set(fusion.MODE_NAMES) if want[fusion.MODE_NAMES == m].any()}
    assert fusion.throttle(df, 5 / 64).count() == n // 5
    low = fusion.low_pass(df, ["x"]).orderBy(F.desc("row_idx")).first()
    assert low.x_low == pytest.approx(folded((pdf["x"]).tolist()[-2000:], 0.9, False)[-1])


def test_empty_tables(spark):
    df = spark.createDataFrame([], SENSORS)
    for f in (fusion.mode_fsm, fusion.ins_track, fusion.track_filter, fusion.fusion_pipeline, fusion.orientation_track, fusion.throttle, lambda d: fusion.low_pass(d, ["ax"])):
        assert f(df).collect() == []


def test_motion_presets(spark):
    rows = [("a", i, i * 0.1, a, g, f) for i, (a, g, f) in enumerate([(G + 0.3, 0.06, 0.0), (G, 0.0, -3.0), (G, 0.0, -6.0), (G, 0.3, 0.0), (G + 3, 2.0, 0.0), (G, 0.0, 1.2)])]
    df = spark.createDataFrame(rows, "track_id string, row_idx int, t double, accel_magnitude double, gz double, vehicle_ax double").withColumns({"gx": F.lit(0.0), "gy": F.lit(0.0), "motion_std": F.lit(0.5)})
    states = lambda limits: [r.motion_state for r in fusion.motion_state(df, limits=limits).orderBy("row_idx").collect()]
    assert states(fusion.MOTION) == ["NORMAL", "BRAKING", "BRAKING", "NORMAL", "PHONE_DISTURBANCE", "NORMAL"]
    assert states(fusion.PHONE_MOTION) == ["STATIONARY", "STATIONARY", "STATIONARY", "TURNING", "TURNING", "STATIONARY"]
