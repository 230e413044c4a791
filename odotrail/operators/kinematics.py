"""Orientation, inertial dead reckoning and unscented filtering of many tracks at once.

All functions work on arrays with a row a track; states are arrays of doubles in which NaN stands for what is not known yet. The
batch operators, the folds over blocks and the streams all run these same steps.

Missing measurements: a position needs latitude and longitude; without one nothing is set to it. The inertial track begins with the first
position and moves from the first heading on; the filter begins with the first position (with speed and heading 0 where they are
missing), predicts in every row, and is corrected by those of position, speed and heading that a row has. An accuracy that is missing counts
as ``UNKNOWN_ACCURACY``, a missing confidence or weight as 0 (so that the row hardly counts). A missing sensor value is 0. A row without a time moves nothing.
"""

from __future__ import annotations

import numpy as np

from ..functions import geo

#: Gravity (fixed value).
G = 9.80665
#: Forward acceleration below which the speed is held at 0 (fixed value).
BRAKING = -2.5
UNKNOWN_ACCURACY = 50.0


def quaternion_of(yaw, pitch, roll) -> np.ndarray:
    """(..., 4): w, x, y, z of Euler angles in degrees."""
    y, p, r = (np.radians(v) / 2 for v in (yaw, pitch, roll))
    cy, sy, cp, sp, cr, sr = np.cos(y), np.sin(y), np.cos(p), np.sin(p), np.cos(r), np.sin(r)
    return np.stack([cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy], -1)


def euler_of(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """yaw, pitch, roll in degrees."""
    w, x, y, z = np.moveaxis(q, -1, 0)
    pitch = np.degrees(np.arcsin(np.clip(2 * (w * y - z * x), -1.0, 1.0)))
    return np.degrees(np.arctan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), pitch, np.degrees(np.arctan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)))


def turn(q: np.ndarray, rate: np.ndarray, dt) -> np.ndarray:
    """The orientation after turning at ``rate`` (rad/s) for ``dt``."""
    x, y, z = np.moveaxis(rate * np.expand_dims(dt, -1) / 2, -1, 0)
    w0, x0, y0, z0 = np.moveaxis(q, -1, 0)
    new = np.stack([w0 - x0 * x - y0 * y - z0 * z, w0 * x + x0 + y0 * z - z0 * y, w0 * y - x0 * z + y0 + z0 * x, w0 * z + x0 * y - y0 * x + z0], -1)
    size = np.linalg.norm(new, axis=-1, keepdims=True)
    return np.where(size > 1e-9, new / np.where(size > 1e-9, size, 1.0), np.array([1.0, 0.0, 0.0, 0.0]))


def matrix_of(q: np.ndarray) -> np.ndarray:
    """(..., 3, 3): rotation from the body's to the level frame."""
    w, x, y, z = np.moveaxis(q, -1, 0)
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    return np.stack([np.stack(r, -1) for r in rows], -2)


def gyro_step(dt: np.ndarray) -> np.ndarray:
    """Seconds to integrate: steps without time or over 0.2 s count as a 50th of a second."""
    return np.where((dt > 0) & (dt <= 0.2), dt, 0.02)


#: Share of the gyroscope when gravity corrects pitch and roll, and the sizes of it that are trusted (fixed values).
GYRO_SHARE = 0.98
TRUSTED_G = (0.65 * G, 1.35 * G)


def level_by_gravity(q: np.ndarray, accel: np.ndarray) -> np.ndarray:
    """The orientation with pitch and roll drawn to the measured direction of gravity; unchanged if that is no likely gravity."""
    x, y, z = np.moveaxis(accel, -1, 0)
    size = np.linalg.norm(accel, axis=-1)
    yaw, pitch, roll = euler_of(q)
    blend = lambda turned, seen: GYRO_SHARE * turned + (1 - GYRO_SHARE) * np.degrees(seen)
    drawn = quaternion_of(yaw, blend(pitch, np.arctan2(-x, np.hypot(y, z))), blend(roll, np.arctan2(y, z)))
    return np.where(((size >= TRUSTED_G[0]) & (size <= TRUSTED_G[1]))[..., None], drawn, q)


def destination(lat, lon, distance, bearing, radius: float = geo.EQUATORIAL_RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Position after ``distance`` metres along ``bearing`` (radians)."""
    arc, phi = distance / radius, np.radians(lat)
    phi2 = np.arcsin(np.clip(np.sin(phi) * np.cos(arc) + np.cos(phi) * np.sin(arc) * np.cos(bearing), -1.0, 1.0))
    step = np.arctan2(np.sin(bearing) * np.sin(arc) * np.cos(phi), np.cos(arc) - np.sin(phi) * np.sin(phi2))
    return np.degrees(phi2), (lon + np.degrees(step) + 540) % 360 - 180


def wrap(a):
    """Radians to [-pi, pi)."""
    return (a + np.pi) % (2 * np.pi) - np.pi


def _aligned(q: np.ndarray, heading: np.ndarray) -> np.ndarray:
    return (heading - euler_of(q)[0] + 180) % 360 - 180


#: Columns of an inertial state: orientation, last time, heading, yaw offset, velocity, displacement, origin.
Q, LAST, HEADING, OFFSET, V, D, ORIGIN = slice(0, 4), 4, 5, 6, slice(7, 10), slice(10, 13), slice(13, 15)
INS_WIDTH = 15
INS_FIELDS = ("ins_lat", "ins_lon", "ins_speed", "ins_distance", "ins_yaw", "vehicle_ax", "zero_velocity")


def ins_start(n: int) -> np.ndarray:
    s = np.full((n, INS_WIDTH), np.nan)
    s[:, OFFSET], s[:, V], s[:, D] = 0.0, 0.0, 0.0
    return s


def ins_fix(s: np.ndarray, which: np.ndarray, lat: np.ndarray, lon: np.ndarray, heading: np.ndarray, speed: np.ndarray) -> None:
    """Set position, heading and speed of the tracks ``which`` from outside, as far as they are known."""
    here = which & ~np.isnan(lat) & ~np.isnan(lon)
    s[here, 13], s[here, 14], s[here, D] = lat[here], lon[here], 0.0
    course = which & ~np.isnan(heading)
    s[course, HEADING] = heading[course]
    turned = course & ~np.isnan(s[:, 0])
    s[turned, OFFSET] = _aligned(s[turned, Q], heading[turned])
    moving = which & ~np.isnan(speed)
    s[moving, V] = 0.0
    s[moving, 7] = np.maximum(0.0, speed[moving])


def ins_enter(s: np.ndarray, lat: np.ndarray, lon: np.ndarray, heading: np.ndarray, speed: np.ndarray) -> None:
    """The first position of a track, and a first heading that comes later, are fixes."""
    new = np.isnan(s[:, 13]) & ~np.isnan(lat) & ~np.isnan(lon)
    ins_fix(s, new, lat, lon, heading, speed)
    none = np.full(len(s), np.nan)
    ins_fix(s, np.isnan(s[:, HEADING]) & ~np.isnan(s[:, 13]), none, none, heading, none)


def ins_step(s: np.ndarray, t: np.ndarray, accel: np.ndarray, gyro: np.ndarray, angles: np.ndarray, still: np.ndarray, grade_pct: np.ndarray) -> np.ndarray:
    """One row of each track: (tracks x INS_FIELDS); ``s`` is changed. No NaN in accel, gyro, angles, grade_pct."""
    dt = t - s[:, LAST]
    new, known = np.isnan(s[:, 0]), ~np.isnan(s[:, HEADING])
    q = np.where(new[:, None], quaternion_of(*angles.T), turn(np.nan_to_num(s[:, Q]), gyro, gyro_step(dt)))
    held = ~new & np.isnan(t)
    q[held] = s[held, Q]
    s[:, Q] = q
    first = new & known
    s[first, OFFSET] = _aligned(q[first], s[first, HEADING])
    s[:, LAST] = np.where(np.isnan(t), s[:, LAST], t)
    yaw, pitch, roll = euler_of(q)
    moving = known & ~np.isnan(dt)
    free = accel - G * matrix_of(q)[:, 2, :]
    level = (matrix_of(quaternion_of(s[:, OFFSET], -pitch, -roll)) @ free[:, :, None])[:, :, 0]
    level[:, 0] -= G * np.sin(np.arctan(grade_pct / 100))  # the grade comes in per cent, its angle is the arc tangent
    forward = np.where(moving, level[:, 0], 0.0)
    h = np.clip(np.nan_to_num(dt), 0.001, 0.2)[:, None]
    zero = still & moving
    v = np.where(zero[:, None], 0.0, s[:, V] + level * h)
    v[:, 0] = np.where(~zero & (forward < BRAKING) & (v[:, 0] < 0), 0.0, v[:, 0])
    s[moving, V] = v[moving]
    s[moving, D] += (v * h)[moving]
    course = np.radians(yaw + s[:, OFFSET])
    d = s[:, D]
    north, east = d[:, 0] * np.cos(course) - d[:, 1] * np.sin(course), d[:, 0] * np.sin(course) + d[:, 1] * np.cos(course)
    lat, lon = destination(s[:, 13], s[:, 14], np.hypot(north, east), np.arctan2(east, north))
    lat, lon = np.where(known, lat, np.nan), np.where(known, lon, np.nan)
    return np.stack([lat, lon, np.linalg.norm(s[:, V], axis=1), np.linalg.norm(d, axis=1), yaw, forward, zero.astype(float)], 1)


#: Unscented filter of x, y, speed and heading (radians); constant speed and heading between rows. Columns of a state: origin, last time, mean, covariance.
N = 4
UKF_WIDTH = 3 + N + N * N
ALPHA, KAPPA, BETA, NOISE = 0.1, 0.0, 2.0, 0.01
SPREAD = ALPHA * ALPHA * (N + KAPPA)
MEAN_WEIGHTS = np.array([(SPREAD - N) / SPREAD, *[1 / (2 * SPREAD)] * (2 * N)])
COV_WEIGHTS = MEAN_WEIGHTS + np.array([1 - ALPHA * ALPHA + BETA, *[0.0] * (2 * N)])
UKF_FIELDS = ("fused_lat", "fused_lon", "fused_speed", "fused_heading", "position_error", "position_confidence", "drift_warning")
#: Variances of measurements are held below this.
LARGEST_VARIANCE = 1e15


def roots(p: np.ndarray) -> np.ndarray:
    """Lower roots of symmetric matrices; one that is not positive is first lifted to the nearest that is."""
    try:
        return np.linalg.cholesky(p)
    except np.linalg.LinAlgError:
        out = np.empty_like(p)
        for i, m in enumerate(p):
            try:
                out[i] = np.linalg.cholesky(m)
            except np.linalg.LinAlgError:
                values, vectors = np.linalg.eigh(m)
                least = max(1e-12, 1e-12 * float(values.max()))
                out[i] = np.linalg.cholesky((vectors * np.maximum(values, least)) @ vectors.T + np.eye(N) * least)
        return out


def _points(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    s = np.swapaxes(roots((p + np.swapaxes(p, 1, 2)) / 2 * SPREAD + np.eye(N) * 1e-12), 1, 2)
    return np.concatenate([x[:, None], x[:, None] + s, x[:, None] - s], 1)


def _mean(points: np.ndarray) -> np.ndarray:
    return np.einsum("i,bij->bj", MEAN_WEIGHTS, points)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.swapaxes(a * COV_WEIGHTS[None, :, None], 1, 2) @ b


def filter_start(n: int) -> np.ndarray:
    return np.full((n, UKF_WIDTH), np.nan)


def filter_step(s: np.ndarray, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, heading: np.ndarray, accuracy: np.ndarray, confidence: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row of each track: (tracks x UKF_FIELDS), NaN before the first position; ``s`` is changed."""
    out = np.full((len(s), len(UKF_FIELDS)), np.nan)
    here = ~np.isnan(lat) & ~np.isnan(lon)
    new = np.isnan(s[:, 0]) & here
    if new.any():
        s[new, 0], s[new, 1], s[new, 2] = lat[new], lon[new], t[new]
        s[new, 3:5], s[new, 5], s[new, 6] = 0.0, np.nan_to_num(speed[new]), np.radians(np.nan_to_num(heading[new]) % 360)
        s[new, 7:] = np.eye(N).ravel()
    i = np.flatnonzero(~np.isnan(s[:, 0]))
    if not len(i):
        return out
    lat0, lon0 = s[i, 0], s[i, 1]
    dt = np.clip(np.nan_to_num(t[i] - s[i, 2]), 0.0, 1.0)
    s[i, 2] = np.where(np.isnan(t[i]), s[i, 2], t[i])
    x, p = s[i, 3:7], s[i, 7:].reshape(-1, N, N)
    around = np.cos(np.radians(lat0))
    z = np.stack([np.radians(lon[i] - lon0) * geo.MEAN_RADIUS * around, np.radians(lat[i] - lat0) * geo.MEAN_RADIUS, speed[i], np.radians(heading[i] % 360)], 1)
    z[~here[i], :2] = np.nan

    points = _points(x, p)
    speeds, courses = points[:, :, 2], points[:, :, 3]
    points[:, :, 0] += speeds * np.cos(courses) * dt[:, None]
    points[:, :, 1] += speeds * np.sin(courses) * dt[:, None]
    x = _mean(points)
    away = points - x[:, None]
    away[:, :, 3] = wrap(away[:, :, 3])
    p = _product(away, away) + np.eye(N) * NOISE

    measured = ~np.isnan(z)
    bound = lambda v: np.clip(np.nan_to_num(v), 1e-6, 1.0)
    variance = np.minimum(np.maximum(np.where(np.isnan(accuracy[i]), UNKNOWN_ACCURACY, accuracy[i]), 1.0) / (bound(confidence[i]) * bound(weight[i])), LARGEST_VARIANCE)
    points = _points(x, p)
    seen = _mean(points)
    dz, dx = points - seen[:, None], points - x[:, None]
    dx[:, :, 3] = wrap(dx[:, :, 3])
    cov = _product(dz, dz) + np.eye(N) * variance[:, None, None]
    cross = _product(dx, dz)
    # what is not measured has no part in the correction
    cov = np.where(measured[:, :, None] & measured[:, None, :], cov, np.eye(N))
    gain = np.where(measured[:, None, :], cross, 0.0) @ np.linalg.inv(cov)
    x = x + (gain @ np.where(measured, z - seen, 0.0)[:, :, None])[:, :, 0]
    x[:, 3] = wrap(x[:, 3])
    p = p - gain @ cov @ np.swapaxes(gain, 1, 2)
    s[i, 3:7], s[i, 7:] = x, p.reshape(-1, N * N)

    trace = np.trace(p, axis1=1, axis2=2)
    error = np.sqrt(np.maximum(0.0, trace))
    out[i] = np.stack([lat0 + np.degrees(x[:, 1] / geo.MEAN_RADIUS), lon0 + np.degrees(x[:, 0] / (geo.MEAN_RADIUS * around)), x[:, 2], np.degrees(x[:, 3]) % 360, error, 1 / (1 + error), trace > 50], 1)
    return out
