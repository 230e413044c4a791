"""Scalar column functions on telemetry values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Road type ranks, fixed values of the two matcher presets; other types have the last number.
GRAPH_RANKS = {"motorway": 6, "trunk": 5, "primary": 5, "secondary": 4, "tertiary": 3, "residential": 2, "unclassified": 2, "service": 1, "living_street": 1}
MOBILE_RANKS = {"motorway": 6, "trunk": 5, "primary": 4, "secondary": 3, "tertiary": 2, "unclassified": 1, "residential": 1}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """A double without NaN and infinities (null instead)."""
    x = _c(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_numeric(x, first_number: bool = False) -> Column:
    """Text to a finite double, else null; ``first_number`` takes the first number within the text."""
    x = _c(x).cast("string")
    if first_number:
        x = F.nullif(F.regexp_extract(x, r"(-?\d+(?:\.\d+)?)", 1), F.lit(""))
    return finite(F.trim(x).try_cast("double"))


def seconds_since_midnight(text) -> Column:
    """``YYYY-MM-DD HH:MM:SS:mmm`` (or ``_mmm``; one to three digits) as seconds of the day; else null."""
    pattern = r"^\s*\d{4}-\d{2}-\d{2}\s+(\d{2}):(\d{2}):(\d{2})[:_](\d{1,3})\s*$"
    part = lambda i: F.regexp_extract(_c(text), pattern, i)
    number = lambda i: part(i).try_cast("int")
    return number(1) * 3600 + number(2) * 60 + number(3) + F.rpad(part(4), 3, "0").try_cast("int") / 1000.0


def colon_millis_to_timestamp(text) -> Column:
    """``YYYY-MM-DD HH:MM:SS:393`` (one to six digits) as a timestamp; other texts as they parse; else null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(_c(text)), r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}):(\d{1,6})$", r"$1.$2"))


def time_seconds(s_seconds, s_millis=None, date_elapsed=None, v_seconds=None) -> Column:
    """One time in seconds: S seconds, else milliseconds, else elapsed date, else V seconds."""
    choices = [s_seconds, None if s_millis is None else _c(s_millis) / 1000.0, date_elapsed, v_seconds]
    return F.coalesce(*[finite(c) for c in choices if c is not None])


def vector_magnitude(x, y, z) -> Column:
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))


def gps_valid(lat, lon) -> Column:
    return F.coalesce(_c(lat).between(-90, 90) & _c(lon).between(-180, 180), F.lit(False))


def at_least_zero(x) -> Column:
    return F.coalesce(_c(x) >= 0, F.lit(False))


def missing_sensor_flag(*axes) -> Column:
    flag = F.lit(False)
    for a in axes:
        flag = flag | _c(a).isNull()
    return flag


def sensor_quality_score(gps, accuracy, satellites, missing) -> Column:
    """Mean of three validity flags and of completeness."""
    as_number = lambda c: _c(c).cast("double")
    return (as_number(gps) + as_number(accuracy) + as_number(satellites) + (1 - as_number(missing))) / 4


def parse_maxspeed(text, strict: bool = False) -> Column:
    """Digits and dots of a speed limit as a double, else null; ``strict`` takes whole numbers only as they stand."""
    return _c(text).try_cast("double") if strict else F.regexp_replace(_c(text), r"[^0-9.]", "").try_cast("double")


def one_way(tag, only_yes: bool = False) -> Column:
    return F.coalesce(_c(tag).isin(["yes"] if only_yes else ["yes", "1", "true"]), F.lit(False))


def road_rank(road_type, preset: str = "graph") -> Column:
    ranks, other = (GRAPH_RANKS, 1) if preset == "graph" else (MOBILE_RANKS, 0)
    table = F.create_map(*[F.lit(x) for k, v in ranks.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(table, _c(road_type)), F.lit(float(other)))


def slope_pct(e1, e2, length) -> Column:
    """Percent; null if an elevation is missing or the length is 0."""
    return F.when(_c(length) > 0, 100.0 * (_c(e2) - _c(e1)) / F.when(_c(length) > 0, _c(length)))


#: Reasons of a bad fix.
WIDE_REASON, LOST_REASON = "accuracy_exceeds_50m", "satellite_lock_lost"


def gnss_quality(accuracy, satellites, anomalous=None) -> Column:
    """struct(reasons, anomalous, mode, confidence) of a fix: over 50 m denies it, no satellite or the first makes it anomalous."""
    accuracy = _c(accuracy)
    wide, lost = F.coalesce(accuracy > 50, F.lit(False)), F.coalesce(_c(satellites) == 0, F.lit(False))
    odd = wide | lost if anomalous is None else wide | lost | _c(anomalous)
    mode = F.when(wide, "DENIED").when(odd, "ANOMALOUS").when(accuracy < 10, "STRONG").otherwise("WEAK")
    share = accuracy / 50
    share = F.when(share > 1, 1.0).when(share < 0, 0.0).otherwise(share)
    confidence = 1.0 - F.when(odd, 0.3).otherwise(0.0) - 0.4 * share
    reasons = F.array_compact(F.array(F.when(wide, F.lit(WIDE_REASON)), F.when(lost, F.lit(LOST_REASON))))
    return F.struct(reasons.alias("reasons"), odd.alias("anomalous"), mode.alias("mode"), confidence.alias("confidence"))


def linear_acceleration(a, gravity) -> Column:
    return _c(a) - _c(gravity)


def rotate_xy(x, y, yaw_deg) -> Column:
    """struct(x, y): a vector of the sensor's frame turned by ``yaw_deg``."""
    yaw = F.radians(_c(yaw_deg))
    return F.struct((_c(x) * F.cos(yaw) - _c(y) * F.sin(yaw)).alias("x"), (_c(x) * F.sin(yaw) + _c(y) * F.cos(yaw)).alias("y"))


def kmh_to_ms(x) -> Column:
    return _c(x) / 3.6


def ms_to_kmh(x) -> Column:
    return _c(x) * 3.6


def ai_weight(error) -> Column:
    w = 1.0 / (1.0 + _c(error) / 10.0)
    return F.when(w > 1, 1.0).when(w < 0, 0.0).otherwise(w)


def position_confidence(error) -> Column:
    return 1.0 / (1.0 + _c(error))


def standardize(x, median, mean, std) -> Column:
    return (F.coalesce(_c(x), _c(median)) - _c(mean)) / _c(std)


def unstandardize(z, mean, std) -> Column:
    return _c(z) * _c(std) + _c(mean)


def feature_status(missing_pct, infinite, constant, near_constant) -> Column:
    return F.when((_c(infinite) > 0) | (_c(missing_pct) >= 100), "FAIL").when((_c(missing_pct) > 0) | _c(constant) | _c(near_constant), "WARNING").otherwise("PASS")


def drift_decision(position_error, velocity_error=None, position_limits=(10.0, 20.0), velocity_limits=(1.0, 2.0)) -> Column:
    """NORMAL, WARNING or ABNORMAL by the larger of the two classes; position alone if no velocity error is given."""
    over = lambda i: (_c(position_error) >= position_limits[i]) if velocity_error is None else (_c(position_error) >= position_limits[i]) | (_c(velocity_error) >= velocity_limits[i])
    return F.when(over(1), "ABNORMAL").when(over(0), "WARNING").otherwise("NORMAL")
