"""Reference tracks, dead reckoning and error labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, scalar
from .features import in_order

EPSILON = 1e-12


def linear_interpolate(df: DataFrame, columns: list[str], by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Missing values on the line between their neighbours by row number; beyond the ends the nearest value."""
    w = in_order(by, on, row)
    out = df.withColumn("__n", F.row_number().over(w))
    running = (Window.unboundedPreceding, 0)  # a frame to the end would be gone through again for every row, so look back in reverse
    back, ahead = (Window.partitionBy(by).orderBy(n).rowsBetween(*running) for n in (F.asc("__n"), F.desc("__n")))
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("x"), F.col("__n").alias("n")))
        out = out.withColumns({"__a": F.last(known, ignorenulls=True).over(back), "__b": F.last(known, ignorenulls=True).over(ahead)})
        a, b = F.col("__a"), F.col("__b")
        between = a["x"] + (b["x"] - a["x"]) * (F.col("__n") - a["n"]) / F.nullif(b["n"] - a["n"], F.lit(0))
        out = out.withColumn(c, F.coalesce(F.col(c), between, a["x"], b["x"]))
    return out.drop("__n", "__a", "__b")


def reference_velocity(df: DataFrame, x: str = "ref_x", y: str = "ref_y", by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Adds ref_vx and ref_vy: central differences over the valid points, one-sided at the ends, null for no time."""
    w = in_order(by, on, row)
    back, ahead = (Window.partitionBy(by).orderBy(n).rowsBetween(Window.unboundedPreceding, -1) for n in (F.asc("__n"), F.desc("__n")))
    good = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(on).isNotNull()
    here = F.when(good, F.struct(F.col(on).alias("t"), F.col(x).alias("x"), F.col(y).alias("y")))
    out = df.withColumns({"__p": here, "__n": F.row_number().over(w)}).withColumns({"__a": F.last("__p", ignorenulls=True).over(back), "__b": F.last("__p", ignorenulls=True).over(ahead)})
    a, b = F.coalesce("__a", "__p"), F.coalesce("__b", "__p")
    dt = b["t"] - a["t"]
    ok = F.col("__p").isNotNull() & (dt > EPSILON)
    return out.withColumns({f"ref_v{k}": F.when(ok, (b[k] - a[k]) / F.nullif(dt, F.lit(0.0))) for k in "xy"}).drop("__p", "__n", "__a", "__b")


def dead_reckon(df: DataFrame, ax: str = "ax", ay: str = "ay", yaw: str | None = None, by: str = "sequence_id", on: str = "t", row: str = "row_idx", max_dt: float = 0.5) -> DataFrame:
    """Adds imu_vx, imu_vy, imu_x, imu_y from accelerations: v += a dt, p += v dt + a dt^2 / 2.

    A step without time, not forward or longer than ``max_dt`` sets the velocity to 0 and keeps the position; a
    missing acceleration holds both. Running sums within stretches between resets, no loop.
    """
    w = in_order(by, on, row)
    dt = F.col(on) - F.lag(on).over(w)
    reset = F.coalesce((dt <= 0) | (dt > max_dt), F.lit(True))
    out = df.withColumns({"__dt": dt, "__reset": reset.cast("int")})
    turned = scalar.rotate_xy(ax, ay, yaw) if yaw else F.struct(F.col(ax).alias("x"), F.col(ay).alias("y"))
    moving = (F.col("__reset") == 0) & turned["x"].isNotNull() & turned["y"].isNotNull()
    out = out.withColumns({"__go": moving, "__ax": F.when(moving, turned["x"]).otherwise(0.0), "__ay": F.when(moving, turned["y"]).otherwise(0.0), "__step": F.when(moving, F.col("__dt")).otherwise(0.0)})
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("__stretch", F.sum("__reset").over(running))
    within = Window.partitionBy(by, "__stretch").orderBy(F.asc_nulls_last(on), row).rowsBetween(Window.unboundedPreceding, 0)
    for k in "xy":
        out = out.withColumn(f"imu_v{k}", F.sum(F.col(f"__a{k}") * F.col("__step")).over(within))
        before = F.col(f"imu_v{k}") - F.col(f"__a{k}") * F.col("__step")
        out = out.withColumn(f"imu_{k}", F.sum(before * F.col("__step") + 0.5 * F.col(f"__a{k}") * F.pow("__step", F.lit(2.0))).over(running))
    return out.drop("__dt", "__reset", "__go", "__ax", "__ay", "__step", "__stretch")


def error_labels(df: DataFrame) -> DataFrame:
    """Adds position_error_m, velocity_error_m_s and label_valid from imu_* and ref_* columns."""
    position = F.sqrt(F.pow(F.col("imu_x") - F.col("ref_x"), 2) + F.pow(F.col("imu_y") - F.col("ref_y"), 2))
    speed = lambda p: F.sqrt(F.pow(F.col(f"{p}_vx"), 2) + F.pow(F.col(f"{p}_vy"), 2))
    out = df.withColumns({"position_error_m": position, "velocity_error_m_s": F.abs(speed("imu") - speed("ref"))})
    return out.withColumn("label_valid", F.col("position_error_m").isNotNull() & F.col("velocity_error_m_s").isNotNull())


def local_reference(df: DataFrame, lat: str = "lat", lon: str = "lon", by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Adds ref_x, ref_y: metres from the sequence's first position."""
    whole = in_order(by, on, row).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fix = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    out = df.withColumn("__0", F.first(fix, ignorenulls=True).over(whole))
    p = geo.project(lat, lon, F.col("__0.lat"), F.col("__0.lon"))
    return out.withColumns({"ref_x": p["x"], "ref_y": p["y"]}).drop("__0")


def label_report(labels: DataFrame, by: str = "sequence_id") -> DataFrame:
    stats = [f(c).alias(f"{n}_{c}") for c in ("position_error_m", "velocity_error_m_s") for n, f in (("mean", F.avg), ("median", F.median), ("max", F.max))]
    return labels.groupBy(by).agg(F.count("*").alias("rows"), F.count_if("label_valid").alias("valid"), F.count_if(~F.col("label_valid")).alias("invalid"), *stats)


def error_targets(aligned: DataFrame, s_lat: str, s_lon: str, v_lat: str, v_lon: str, s_speed: str, v_speed: str) -> DataFrame:
    """Adds position_error_m (between both sides' positions) and velocity_error_m_s (of speeds in km/h)."""
    return aligned.withColumns({"position_error_m": geo.haversine_m(s_lat, s_lon, v_lat, v_lon), "velocity_error_m_s": F.abs(F.col(s_speed) - F.col(v_speed)) / 3.6})


def persistence(df: DataFrame, actual: str, by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> Column:
    """The value before, within the sequence."""
    return F.lag(actual).over(in_order(by, on, row))


def blackout_error(truth: DataFrame, estimate: DataFrame, run: str = "run_id", on: str = "t", limit_pct: float = 10.0) -> DataFrame:
    """Distance of the estimate from the truth at each run's end, in metres and per cent of the way; passed below ``limit_pct``."""
    w = Window.partitionBy(run).orderBy(on)
    step = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    way = truth.withColumn("__s", step).groupBy(run).agg(F.sum("__s").alias("distance_m"), F.max_by(F.struct("lat", "lon"), on).alias("end"))
    last = estimate.groupBy(run).agg(F.max_by(F.struct("lat", "lon"), on).alias("guess"))
    out = way.join(last, run).withColumn("error_m", geo.haversine_m(F.col("guess.lat"), F.col("guess.lon"), F.col("end.lat"), F.col("end.lon")))
    pct = F.col("error_m") * 100 / F.nullif(F.col("distance_m"), F.lit(0.0))
    return out.select(run, "distance_m", "error_m", pct.alias("error_pct"), (pct < limit_pct).alias("passed"))
