"""Queries on synchronisation, features, labels and fusion over the telemetry view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, headers, scalar
from ..operators import features, fusion, kinematics, labels, metrics, online, preparation, sync
from . import views
from .book import Book, r

book = Book()
TOLERANCE = 7200.0
W = "(partition by sequence_id order by t, row_idx)"
ROLL = "(partition by sequence_id order by t, row_idx rows between 9 preceding and current row)"

ALIGNED_SQL = f"""{views.SIDES_SQL}, v1 as (select * from v_side qualify row_number() over (partition by sequence_id, t order by row_idx) = 1),
aligned as (select s.*, v.t as v_t, v.row_idx as v_row, v.lat as v_lat, v.lon as v_lon, v.speed as v_speed, abs(v.t - s.t) as time_difference, v.t is not null as synchronization_valid
  from s_side s left join v1 v on v.sequence_id = s.sequence_id and abs(v.t - s.t) <= {TOLERANCE}
  qualify row_number() over (partition by s.row_idx order by abs(v.t - s.t), v.t desc) = 1)"""


def aligned(spark, d) -> DataFrame:
    s, v = views.sides(spark, d)
    return sync.asof_nearest(s, v, tolerance=TOLERANCE, columns=["row_idx", "lat", "lon", "speed"])


@book.add(f"{ALIGNED_SQL} select sequence_id, row_idx, v_row, {r('time_difference')} as time_difference, synchronization_valid from aligned")
def asof_nearest(spark, d):
    return aligned(spark, d).select("sequence_id", "row_idx", F.col("V_row_idx").alias("v_row"), "time_difference", "synchronization_valid")


REPORT_SQL = f"""{ALIGNED_SQL}, report as (select sequence_id, count(*) as rows, count(*) filter (synchronization_valid) as matched, count(*) filter (not synchronization_valid) as unmatched,
  avg(time_difference) as mean_difference, quantile_cont(time_difference, 0.5) as median_difference, max(time_difference) as max_difference, min(time_difference) as min_difference,
  count(t) - count(distinct t) as repeated_times, count(*) filter (synchronization_valid) * 100.0::double / count(*) as match_pct from aligned group by sequence_id)"""


@book.add(f"{REPORT_SQL} select sequence_id, rows, matched, unmatched, {r('mean_difference')} as mean_difference, {r('median_difference')} as median_difference, {r('max_difference')} as max_difference, {r('min_difference')} as min_difference, repeated_times, {r('match_pct')} as match_pct from report")
def sync_report(spark, d):
    return sync.sync_report(aligned(spark, d))


@book.add(f"{REPORT_SQL} select count(*) as sequences, sum(rows)::bigint as rows, sum(matched)::bigint as matched, {r('sum(matched) * 100.0::double / sum(rows)')} as match_pct, {r('sum(mean_difference * matched) / sum(matched)')} as mean_difference, {r('max(max_difference)')} as max_difference from report")
def sync_total(spark, d):
    return sync.sync_total(sync.sync_report(aligned(spark, d)))


@book.add(f"{views.SIDES_SQL}, a as (select distinct sequence_id, true as has_s from s_side), b as (select distinct sequence_id, true as has_v from v_side) select sequence_id, coalesce(has_s, false) as has_s, coalesce(has_v, false) as has_v, case when has_s is null then 'MISSING_S' when has_v is null then 'MISSING_V' else 'COMPLETE' end as status from a full join b using (sequence_id)")
def pair_files(spark, d):
    return sync.pair_files(*views.sides(spark, d))


FILES_SQL = f"{views.TEL_SQL}, files as (select distinct sequence_id * 13 + satellites as sequence_id, event_type, case when event_type in {views.S_TYPES} then 'S' else 'V' end as kind from tel)"


def files(spark, d):
    """A file for each kind of event of a drive's stretch with one number of satellites."""
    return views.tel(spark, d).select((F.col("sequence_id") * 13 + F.col("satellites")).alias("sequence_id"), "event_type", F.expr(f"case when event_type in {views.S_TYPES} then 'S' else 'V' end").alias("kind")).distinct()


@book.add(f"{FILES_SQL}, n as (select sequence_id, count(*) filter (kind = 'S') as n_s, count(*) filter (kind = 'V') as n_v from files group by 1) select *, case when n_s = 1 and n_v = 1 then 'COMPLETE' when n_s = 1 and n_v = 0 then 'S_ONLY' when n_s = 0 and n_v = 1 then 'V_ONLY' else 'AMBIGUOUS' end as status from n")
def pair_files_ambiguous(spark, d):
    return sync.pair_files_ambiguous(files(spark, d))


@book.add(f"{views.SIDES_SQL}, s as (select *, row_number() over {W} as n from s_side), v as (select *, row_number() over {W} as n from v_side) select s.sequence_id, s.n::bigint as n, s.row_idx, v.row_idx as v_row_idx, {r('v.t - s.t')} as lag_seconds from s join v on s.sequence_id = v.sequence_id and s.n = v.n")
def rownum_align(spark, d):
    s, v = (sync.with_row_number(x.select("sequence_id", "row_idx", "t")) for x in views.sides(spark, d))
    return sync.rownum_align(s, v, row="n", prefix="v_").select("sequence_id", F.col("n").cast("long").alias("n"), "row_idx", "v_row_idx", (F.col("v_t") - F.col("t")).alias("lag_seconds"))


SPLIT_SQL = f"""{views.TEL_SQL}, ranked as (select sequence_id, row_number() over (order by (sequence_id * 2654435761) % 4294967296, sequence_id) as k, count(*) over () as n from (select distinct sequence_id from tel)),
counts as (select *, round_even(n * 0.7::double, 0) as a, round_even(n * 0.15::double, 0) as b from ranked),
split as (select sequence_id, case when k <= a then 'train' when k <= a + case when a + b >= n then greatest(1, n - a - 1) else b end then 'validation' else 'test' end as split from counts)"""


def split(spark, d):
    return preparation.split_sequences(views.tel(spark, d).select("sequence_id"), F.expr("(sequence_id * 2654435761) % 4294967296"))


@book.add(f"{SPLIT_SQL} select split, count(*) as rows, count(distinct sequence_id) as sequences from tel join split using (sequence_id) group by split")
def split_summary(spark, d):
    return preparation.split_summary(sync.attach_split(views.tel(spark, d), split(spark, d)))


LEAK_SQL = f"{SPLIT_SQL}, leaky as (select distinct sequence_id, case when row_idx % 97 = 0 then 'test' else split end as split from tel join split using (sequence_id))"


def leaky(spark, d):
    return sync.attach_split(views.tel(spark, d), split(spark, d)).select("sequence_id", F.when(F.col("row_idx") % 97 == 0, "test").otherwise(F.col("split")).alias("split")).distinct()


@book.add(f"{LEAK_SQL} select sequence_id, count(distinct split) as n_splits from leaky group by 1 having count(distinct split) > 1")
def split_leakage(spark, d):
    return sync.split_leakage(leaky(spark, d))


@book.add(f"{LEAK_SQL} select sequence_id from leaky where split = 'train' intersect select sequence_id from leaky where split = 'test'")
def split_overlap(spark, d):
    return sync.split_overlap(leaky(spark, d), "train", "test")


@book.add(f"{SPLIT_SQL} select sequence_id, split from split where sequence_id not in (select sequence_id from tel where event_type = 'signup' and ax is null)")
def missing_inputs(spark, d):
    return sync.missing_inputs(split(spark, d), views.tel(spark, d).filter("event_type = 'signup' and ax is null"))


@book.add(f"{FILES_SQL}, s as (select distinct sequence_id from files where event_type = 'click'), v as (select distinct sequence_id from files where event_type = 'purchase') select sequence_id, case when v.sequence_id is null then 'only_s' when s.sequence_id is null then 'only_v' else 'both' end as side from (select sequence_id from s union select sequence_id from v) left join s using (sequence_id) left join v using (sequence_id)".replace("v.sequence_id is null", "not exists (select 1 from v where v.sequence_id = q.sequence_id)").replace("s.sequence_id is null", "not exists (select 1 from s where s.sequence_id = q.sequence_id)").replace("from (select sequence_id from s union select sequence_id from v) left join s using (sequence_id) left join v using (sequence_id)", "from (select sequence_id from s union select sequence_id from v) q"))
def sequence_sets(spark, d):
    f = files(spark, d)
    return sync.sequence_sets(f.filter("event_type = 'click'"), f.filter("event_type = 'purchase'"))


@book.add(f"{views.SIDES_SQL}, a as (select sequence_id, min(t) as s_start, max(t) as s_end from s_side group by 1), b as (select sequence_id, min(t) as v_start, max(t) as v_end from v_side group by 1) select sequence_id, {r('s_start')} as s_start, {r('s_end')} as s_end, {r('v_start')} as v_start, {r('v_end')} as v_end, {r('case when s_end is null or v_end is null then 0 else greatest(0, least(s_end, v_end) - greatest(s_start, v_start)) end')} as overlap_seconds from a full join b using (sequence_id)")
def overlap(spark, d):
    return sync.overlap(*views.sides(spark, d))


def canonical(spark, d) -> DataFrame:
    """The telemetry under its canonical names."""
    names = {"t": "timestamp", "ax": "accel_x", "ay": "accel_y", "az": "accel_z", "gx": "gyro_yaw", "gy": "gyro_pitch", "gz": "gyro_roll", "mx": "mag_x", "my": "mag_y", "mz": "mag_z", "yaw": "orientation_yaw", "pitch": "orientation_pitch", "roll": "orientation_roll", "lat": "gps_latitude", "lon": "gps_longitude", "speed": "gps_speed", "accuracy": "gps_accuracy", "satellites": "gps_satellites"}
    return views.tel(spark, d).drop("event_type").withColumnsRenamed(names)


BASE_SQL = f"""{views.TEL_SQL}, f0 as (select *, t - first_value(t) over {W} as elapsed, greatest(t - lag(t) over {W}, 0) as dt, sqrt(ax * ax + ay * ay + az * az) as am, sqrt(gx * gx + gy * gy + gz * gz) as gm, sqrt(mx * mx + my * my + mz * mz) as mm from tel),
f1 as (select *, abs(am - lag(am) over {W}) as ac, (am - lag(am) over {W}) / nullif(dt, 0) as ar, abs(gm - lag(gm) over {W}) as gc, (gm - lag(gm) over {W}) / nullif(dt, 0) as gr, abs(mm - lag(mm) over {W}) as mc, abs(speed - lag(speed) over {W}) as sc, (speed - lag(speed) over {W}) / nullif(dt, 0) as sr,
  ((yaw - lag(yaw) over {W} + 180) % 360 + 360) % 360 - 180 as yc from f0),
med as (select sequence_id, quantile_cont(dt, 0.5) as m from f1 where dt > 0 group by 1), dev as (select sequence_id, any_value(m) as m, quantile_cont(abs(dt - m), 0.5) as mad from f1 join med using (sequence_id) where dt > 0 group by 1),
lim as (select sequence_id, greatest(3 * m, m + 6 * mad, m + 0.05) as gap from dev)"""


@book.add(f"""{BASE_SQL} select sequence_id, row_idx, {r('elapsed')} as elapsed_time, case when lag(t) over {W} is null then null else {r('dt')} end as delta_time, coalesce(dt > gap and lag(t) over {W} is not null, false) as time_gap_flag,
 {r('am')} as accel_magnitude, {r('gm')} as gyro_magnitude, {r('ac')} as accel_change, {r('ar')} as accel_change_rate, {r('gc')} as gyro_change, {r('mc')} as magnetic_field_change, {r('sc')} as speed_change, {r('sr')} as speed_change_rate, {r('yc')} as yaw_change,
 {r('(yc - lag(yc) over ' + W + ') / nullif(dt, 0)')} as yaw_change_rate, ax is null as missing_sensor_flag, {r('(3.0::double + case when ax is null then 0 else 1 end) / 4')} as sensor_quality_score,
 {r('avg(am) over ' + ROLL)} as accel_magnitude_rolling_mean, {r('stddev_pop(am) over ' + ROLL)} as accel_magnitude_rolling_std, {r('max(am) over ' + ROLL + ' - min(am) over ' + ROLL)} as accel_magnitude_rolling_range, {r('min(speed) over ' + ROLL)} as gps_speed_rolling_min, {r('max(sc) over ' + ROLL)} as speed_change_rolling_max
 from f1 left join lim using (sequence_id)""")
def engineered_features(spark, d):
    out = features.engineer(canonical(spark, d))
    return out.select("sequence_id", "row_idx", "elapsed_time", "delta_time", "time_gap_flag", "accel_magnitude", "gyro_magnitude", "accel_change", "accel_change_rate", "gyro_change", "magnetic_field_change", "speed_change", "speed_change_rate", "yaw_change", "yaw_change_rate", "missing_sensor_flag", "sensor_quality_score", "accel_magnitude_rolling_mean", "accel_magnitude_rolling_std", "accel_magnitude_rolling_range", "gps_speed_rolling_min", "speed_change_rolling_max")


#: Rolled features and their columns in ``BASE_SQL``; there is no gravity in the view, so seven of eight.
_ROLLED = {"accel_magnitude": "am", "gyro_magnitude": "gm", "mag_magnitude": "mm", "gps_speed": "speed", "accel_change": "ac", "gyro_change": "gc", "speed_change": "sc"}
_STATS = {"mean": "avg({0}) over " + ROLL, "std": "stddev_pop({0}) over " + ROLL, "min": "min({0}) over " + ROLL, "max": "max({0}) over " + ROLL, "range": "max({0}) over " + ROLL + " - min({0}) over " + ROLL}


@book.add(f"{BASE_SQL} select sequence_id, row_idx, " + ", ".join(f"{r(e.format(x))} as {name}_rolling_{stat}" for name, x in _ROLLED.items() for stat, e in _STATS.items()) + " from f1")
def rolling_features(spark, d):
    """All rolling statistics."""
    return features.engineer(canonical(spark, d)).select("sequence_id", "row_idx", *[f"{name}_rolling_{stat}" for name in _ROLLED for stat in _STATS])


def _turn(x: str) -> str:
    return f"((({x} - lag({x}) over {W} + 180) % 360 + 360) % 360 - 180)"


@book.add(f"""{BASE_SQL}, f2 as (select *, {_turn('pitch')} as pc, {_turn('roll')} as rc, (mm - lag(mm) over {W}) / nullif(dt, 0) as mr from f1)
select sequence_id, row_idx, {r('ax')} as accel_x, {r('gz')} as gyro_roll, {r('mm')} as mag_magnitude, {r('gr')} as gyro_change_rate, {r('mr')} as magnetic_field_change_rate, {r('pc')} as pitch_change, {r('rc')} as roll_change, {r('(pc - lag(pc) over ' + W + ') / nullif(dt, 0)')} as pitch_change_rate, {r('(rc - lag(rc) over ' + W + ') / nullif(dt, 0)')} as roll_change_rate,
 lat between -90 and 90 and lon between -180 and 180 as gps_valid, accuracy >= 0 as gps_accuracy_valid, satellites >= 0 as satellite_count_valid, {r('speed')} as gps_speed from f2""")
def remaining_features(spark, d):
    """The features that ``engineered_features`` and ``rolling_features`` leave out, and some of the sources."""
    out = features.engineer(canonical(spark, d))
    return out.select("sequence_id", "row_idx", "accel_x", "gyro_roll", "mag_magnitude", "gyro_change_rate", "magnetic_field_change_rate", "pitch_change", "roll_change", "pitch_change_rate", "roll_change_rate", "gps_valid", "gps_accuracy_valid", "satellite_count_valid", "gps_speed")


FEATURE_REPORT_SQL = f"""{BASE_SQL}, g as (select *, case when lag(t) over {W} is null then null else dt end as step, coalesce(dt > gap and lag(t) over {W} is not null, false) as is_gap from f1 left join lim using (sequence_id)),
report as (select sequence_id, count(*) as rows, 3 as features, count(*) filter (ax is null) * 100.0::double / (count(*) * 3) as missing_pct, avg(step) as dt_mean, quantile_cont(step, 0.5) as dt_median, stddev_samp(step) as dt_std, min(step) as dt_min, max(step) as dt_max,
 count(*) filter (is_gap) as gaps, count(t) - count(distinct t) as repeated_times, 100.0::double as gps_valid_pct, avg((3.0::double + case when ax is null then 0 else 1 end) / 4) as quality_mean, min((3.0::double + case when ax is null then 0 else 1 end) / 4) as quality_min, max((3.0::double + case when ax is null then 0 else 1 end) / 4) as quality_max from g group by 1)"""
_REPORT_COLUMNS = "sequence_id, rows, features, " + r("missing_pct") + " as missing_pct, " + ", ".join(f"{r(c)} as {c}" for c in ("dt_mean", "dt_median", "dt_std", "dt_min", "dt_max")) + ", gaps, repeated_times, gps_valid_pct, " + ", ".join(f"{r(c)} as {c}" for c in ("quality_mean", "quality_min", "quality_max"))


@book.add(f"{FEATURE_REPORT_SQL} select {_REPORT_COLUMNS} from report")
def feature_report(spark, d):
    return features.feature_report(features.engineer(canonical(spark, d)), features=["accel_x", "accel_y", "accel_z"])


@book.add(f"{FEATURE_REPORT_SQL} select count(*) as sequences, sum(rows)::bigint as rows, {r('sum(missing_pct * rows) / sum(rows)')} as missing_pct, sum(gaps)::bigint as gaps from report")
def feature_report_total(spark, d):
    return features.report_total(features.feature_report(features.engineer(canonical(spark, d)), features=["accel_x", "accel_y", "accel_z"]))


@book.add(f"{views.TEL_SQL}, m as (select *, t < lag(t) over (partition by sequence_id order by row_idx) as back from tel) select sequence_id, count(*) filter (back) as steps_back, count(t) - count(distinct t) as repeated_times, count(*) filter (t is null) as missing_times, count(*) filter (back) = 0 as is_monotonic from m group by 1")
def monotonic_report(spark, d):
    return features.monotonic_report(views.tel(spark, d))


INTERPOLATED_SQL = f"""{views.TEL_SQL}, n as (select *, row_number() over {W} as n from tel),
k as (select *, max(case when ax is not null then n end) over {W} as na, min(case when ax is not null then n end) over (partition by sequence_id order by t, row_idx rows between current row and unbounded following) as nb from n)"""


@book.add(f"""{INTERPOLATED_SQL} select k.sequence_id, k.row_idx, {r('coalesce(k.ax, a.ax + (b.ax - a.ax) * (k.n - k.na)::double / nullif(k.nb - k.na, 0), a.ax, b.ax)')} as ax from k left join n a on a.sequence_id = k.sequence_id and a.n = k.na left join n b on b.sequence_id = k.sequence_id and b.n = k.nb""")
def linear_interpolate(spark, d):
    return labels.linear_interpolate(views.tel(spark, d), ["ax"]).select("sequence_id", "row_idx", "ax")


@book.add(f"""{views.TEL_SQL}, v as (select *, lag(t) over {W} as t0, lag(ax) over {W} as x0, lag(ay) over {W} as y0, lead(t) over {W} as t1, lead(ax) over {W} as x1, lead(ay) over {W} as y1 from tel where ax is not null),
c as (select sequence_id, row_idx, coalesce(t1, t) - coalesce(t0, t) as dt, coalesce(x1, ax) - coalesce(x0, ax) as dx, coalesce(y1, ay) - coalesce(y0, ay) as dy from v)
select tel.sequence_id, tel.row_idx, {r('1000 * case when dt > 1e-12 then dx / dt end')} as vx, {r('1000 * case when dt > 1e-12 then dy / dt end')} as vy from tel left join c using (sequence_id, row_idx)""")
def reference_velocity(spark, d):
    out = labels.reference_velocity(views.tel(spark, d), "ax", "ay")
    return out.select("sequence_id", "row_idx", (F.col("ref_vx") * 1000).alias("vx"), (F.col("ref_vy") * 1000).alias("vy"))


SCALE = 100000.0  # seconds of the view's drives to tenths of seconds
RECKON_SQL = f"""{views.TEL_SQL}, k as (select *, (t - lag(t) over {W}) / {SCALE} as dt from tel), g as (select *, case when dt is null or dt <= 0 or dt > 0.5 then 1 else 0 end as reset from k),
s as (select *, reset = 0 and ax is not null as go, sum(reset) over {W} as stretch from g), a as (select *, case when go then dt else 0 end as h, case when go then ax else 0 end as qx, case when go then ay else 0 end as qy from s),
v as (select *, sum(qx * h) over (partition by sequence_id, stretch order by t, row_idx) as vx, sum(qy * h) over (partition by sequence_id, stretch order by t, row_idx) as vy from a),
p as (select *, sum((vx - qx * h) * h + 0.5 * qx * h * h) over {W} as x, sum((vy - qy * h) * h + 0.5 * qy * h * h) over {W} as y from v)"""


def reckoned(spark, d):
    return labels.dead_reckon(views.tel(spark, d).withColumn("t", F.col("t") / SCALE))


@book.add(f"{RECKON_SQL} select sequence_id, row_idx, {r('vx')} as imu_vx, {r('vy')} as imu_vy, {r('x')} as imu_x, {r('y')} as imu_y from p")
def dead_reckon(spark, d):
    return reckoned(spark, d).select("sequence_id", "row_idx", "imu_vx", "imu_vy", "imu_x", "imu_y")


def labelled(spark, d):
    out = reckoned(spark, d).withColumns({"ref_x": F.col("speed"), "ref_y": F.col("ay"), "ref_vx": F.col("ax"), "ref_vy": F.col("az")})
    return labels.error_labels(out)


LABEL_SQL = f"{RECKON_SQL}, l as (select *, sqrt(pow(x - speed, 2) + pow(y - ay, 2)) as pe, abs(sqrt(vx * vx + vy * vy) - sqrt(ax * ax + az * az)) as ve from p)"


@book.add(f"{LABEL_SQL} select sequence_id, row_idx, {r('pe')} as position_error_m, {r('ve')} as velocity_error_m_s, pe is not null and ve is not null as label_valid from l")
def error_labels(spark, d):
    return labelled(spark, d).select("sequence_id", "row_idx", "position_error_m", "velocity_error_m_s", "label_valid")


@book.add(f"{LABEL_SQL} select sequence_id, count(*) as rows, count(*) filter (pe is not null and ve is not null) as valid, count(*) filter (pe is null or ve is null) as invalid, " + ", ".join(f"{r(f'{g}({c})')} as {n}_{k}" for c, k in (("pe", "position_error_m"), ("ve", "velocity_error_m_s")) for n, g in (("mean", "avg"), ("median", "median"), ("max", "max"))) + " from l group by 1")
def label_report(spark, d):
    return labels.label_report(labelled(spark, d))


@book.add(f"""{ALIGNED_SQL} select sequence_id, row_idx, {r("2 * 6371000 * asin(sqrt(pow(sin(radians(v_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(v_lat)) * pow(sin(radians(v_lon - lon) / 2), 2)))")} as position_error_m, {r('abs(speed - v_speed) / 3.6')} as velocity_error_m_s from aligned where synchronization_valid""")
def error_targets(spark, d):
    out = labels.error_targets(aligned(spark, d).filter("synchronization_valid"), "lat", "lon", "V_lat", "V_lon", "speed", "V_speed")
    return out.select("sequence_id", "row_idx", "position_error_m", "velocity_error_m_s")


@book.add(f"""{views.TEL_SQL}, w as (select sequence_id, row_idx, ay, count(*) over (partition by sequence_id order by t, row_idx rows between 29 preceding and current row) as n, sum(ay) over (partition by sequence_id order by t, row_idx rows between 29 preceding and current row) as s, first_value(az) over (partition by sequence_id order by t, row_idx rows between 29 preceding and current row) as z, ax from tel)
select sequence_id, row_idx, {r('s')} as window_sum, {r('z')} as first_az, {r('ax')} as ax from w where n = 30 and ax is not null""")
def temporal_windows(spark, d):
    out = features.temporal_windows(views.tel(spark, d), ["ay", "az"], ["ax"])
    return out.select("sequence_id", "row_idx", F.aggregate("window", F.lit(0.0), lambda a, v: a + v[0]).alias("window_sum"), F.col("window")[0][1].alias("first_az"), "ax")


@book.add(f"{views.TEL_SQL} select sequence_id, greatest(count(*) - 29, 0) as windows from tel where ax is not null group by 1")
def window_count(spark, d):
    return features.window_count(views.tel(spark, d).filter("ax is not null"))


@book.add(f"{views.TEL_SQL}, w as (select sequence_id, row_idx, coalesce(stddev_samp(ay) over (partition by sequence_id order by t, row_idx rows between 49 preceding and current row), 0) as s from tel) select sequence_id, row_idx, {r('s')} as motion_std, {r('least(s / 2.5, 1)')} as vibration from w")
def motion_window_std(spark, d):
    return fusion.motion_window_std(views.tel(spark, d), x="ay", track="sequence_id").select("sequence_id", "row_idx", "motion_std", "vibration")


@book.add(f"""{views.TEL_SQL}, q as (select *, accuracy > 50 as wide, satellites = 0 as lost from tel) select row_idx, wide or lost as anomalous, case when wide then 'DENIED' when lost then 'ANOMALOUS' when accuracy < 10 then 'STRONG' else 'WEAK' end as mode,
{r('1 - case when wide or lost then 0.3 else 0 end - 0.4 * least(accuracy / 50, 1)')} as confidence, concat_ws(',', case when wide then 'accuracy_exceeds_50m' end, case when lost then 'satellite_lock_lost' end) as reasons from q""")
def gnss_quality(spark, d):
    return views.tel(spark, d).select("row_idx", scalar.gnss_quality("accuracy", "satellites").alias("q")).select("row_idx", "q.anomalous", "q.mode", "q.confidence", F.concat_ws(",", "q.reasons").alias("reasons"))


@book.add(f"""{views.TEL_SQL} select row_idx, case when speed >= 20 or ay >= 2 then 'ABNORMAL' when speed >= 10 or ay >= 1 then 'WARNING' else 'NORMAL' end as state, case when speed >= 20 then 'ABNORMAL' when speed >= 10 then 'WARNING' else 'NORMAL' end as position_state, {r('1 / (1 + speed / 10)')} as ai_weight, {r('1 / (1 + speed)')} as position_confidence from tel""")
def drift_decision(spark, d):
    return views.tel(spark, d).select("row_idx", scalar.drift_decision("speed", "ay").alias("state"), scalar.drift_decision("speed").alias("position_state"), scalar.ai_weight("speed").alias("ai_weight"), scalar.position_confidence("speed").alias("position_confidence"))


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ':' || (event_id % 1000)::varchar"


@book.add(f"select event_id, {r('extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) + rpad((event_id % 1000)::varchar, 3, chr(48))::int / 1000.0::double')} as seconds, epoch_us(date_trunc('second', ts)) // 1000000 as whole_second from events")
def time_texts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("text", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(":"), (F.col("event_id") % 1000).cast("string")))
    return e.select("event_id", scalar.seconds_since_midnight("text").alias("seconds"), F.floor(F.unix_micros(scalar.colon_millis_to_timestamp("text")) / 1000000).alias("whole_second"))


_NAME = "case when p_partkey % 3 = 0 then 'S-' when p_partkey % 3 = 1 then 'V-' else 's_' end || case p_partkey % 4 when 0 then 'Vta' || (p_partkey % 50)::varchar when 1 then 'Vx' || (p_partkey % 9)::varchar || 'a' when 2 then 'M' || (p_partkey % 5)::varchar else 'Long Drive' end"


@book.add(f"""names as (select p_partkey, '/data/logs/' || {_NAME} || '.csv' as path, {_NAME} as stem from part), c as (select *, lower(regexp_replace(stem, '^[sSvV][-_ ]+', '')) as n from names)
select p_partkey, regexp_replace(lower(stem), '^[sv]-', '') as normalized_id,
case when regexp_matches(n, 'v(fa|ta|tb|w)[0-9]+[a-z]?') then regexp_extract(n, 'v(fa|ta|tb|w)[0-9]+[a-z]?') when regexp_matches(n, '^v[a-z]*[0-9]+[a-z]?$') then n when regexp_matches(n, '^m[0-9]*$') then n else replace(n, ' ', '_') end as sequence_id,
case when lower(stem)[1] = 's' then 'S' when lower(stem)[1] = 'v' then 'V' else 'UNKNOWN' end as kind from c""")
def file_names(spark, d):
    stem = F.expr(_NAME.replace("::varchar", "").replace("(p_partkey % 50)", "cast(p_partkey % 50 as string)").replace("(p_partkey % 9)", "cast(p_partkey % 9 as string)").replace("(p_partkey % 5)", "cast(p_partkey % 5 as string)"))
    names = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(F.lit("/data/logs/"), stem, F.lit(".csv")).alias("path"))
    return names.select("p_partkey", headers.normalize_sequence_id(F.col("path")).alias("normalized_id"), headers.extract_sequence_id(F.col("path")).alias("sequence_id"), headers.classify_by_path(F.col("path")).alias("kind"))


@book.add(f"""{views.TEL_SQL}, p as (select *, lag(lat) over {W} as lat1, lag(lon) over {W} as lon1, lag(yaw) over {W} as yaw1 from tel)
select row_idx, {r("2 * 6371000 * asin(sqrt(pow(sin(radians(lat - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat)) * pow(sin(radians(lon - lon1) / 2), 2)))")} as distance_m,
{r("(degrees(atan2(sin(radians(lon - lon1)) * cos(radians(lat)), cos(radians(lat1)) * sin(radians(lat)) - sin(radians(lat1)) * cos(radians(lat)) * cos(radians(lon - lon1)))) + 360) % 360")} as bearing,
{r("case when abs(yaw - yaw1) % 360 <= 180 then abs(yaw - yaw1) % 360 else 360 - abs(yaw - yaw1) % 360 end")} as turn, {r("radians(lon - lon1) * cos(radians(lat1)) * 6371000")} as east_m, {r("radians(lat - lat1) * 6371000")} as north_m from p where lat1 is not null""")
def geodesy(spark, d):
    w = features.in_order()
    p = views.tel(spark, d).withColumns({f"{c}1": F.lag(c).over(w) for c in ("lat", "lon", "yaw")}).filter("lat1 is not null").withColumn("xy", geo.project("lat", "lon", "lat1", "lon1"))
    return p.select("row_idx", geo.haversine_m("lat1", "lon1", "lat", "lon").alias("distance_m"), geo.initial_bearing_deg("lat1", "lon1", "lat", "lon").alias("bearing"), geo.angular_diff_deg("yaw", "yaw1").alias("turn"), F.col("xy.x").alias("east_m"), F.col("xy.y").alias("north_m"))


@book.add(f"""{views.TEL_SQL}, a as (select sequence_id, min(t) as t0 from tel group by 1) select sequence_id, count(*) as samples, {r('avg(ay)')} as ay_bias, {r('avg(gz)')} as gz_bias from tel join a using (sequence_id) where t - t0 < 200000 group by 1""")
def imu_calibration(spark, d):
    return fusion.imu_calibration(views.tel(spark, d), ["ay", "gz"], seconds=200000.0, track="sequence_id")


def states(spark, d) -> DataFrame:
    """Sensor states of the telemetry, its seconds scaled to those of a drive."""
    tel = views.tel(spark, d).withColumns({"t": F.col("t") / SCALE, "speed": F.col("speed") / 3.6, "heading": F.col("yaw")}).withColumnRenamed("sequence_id", "track_id")
    out = fusion.sensor_states(tel)
    return out.withColumns({"still": F.col("speed") < 1, "reset": (F.col("navigation_mode") == "STRONG") & ~F.col("is_anomalous")})


MODES_SQL = f"""recursive {views.TEL_SQL}, st as (select sequence_id as track_id, row_idx, row_number() over {W} as n, accuracy > 50 or satellites = 0 as bad, case when accuracy > 50 then 'DENIED' when satellites = 0 then 'ANOMALOUS' when accuracy < 10 then 'STRONG' else 'WEAK' end as nav,
  1 - case when accuracy > 50 or satellites = 0 then 0.3 else 0 end - 0.4 * least(accuracy / 50, 1) as c from tel),
m as (select track_id, n - 1 as n, null::bigint as row_idx, 'GNSS_DOMINANT' as mode, 0 as k, false as bad from st where n = 1
 union all select st.track_id, st.n, st.row_idx,
  case when m.mode = 'GNSS_DENIED' then case when nav <> 'DENIED' and c > 0.1 then 'RECOVERY' else 'GNSS_DENIED' end
   when m.mode = 'RECOVERY' then case when k < 10 then 'RECOVERY' when st.bad or c < 0.3 then 'GNSS_DEGRADED' when c > 0.8 then 'GNSS_DOMINANT' else 'HYBRID' end
   when nav = 'DENIED' or c < 0.05 then 'GNSS_DENIED' when m.mode = 'GNSS_DEGRADED' then case when not st.bad and c > 0.4 then 'HYBRID' else 'GNSS_DEGRADED' end
   when st.bad or nav = 'ANOMALOUS' or c < case when m.mode = 'GNSS_DOMINANT' then 0.3 else 0.2 end then 'GNSS_DEGRADED'
   when m.mode = 'GNSS_DOMINANT' then case when c < 0.7 then 'HYBRID' else 'GNSS_DOMINANT' end else case when c > 0.8 then 'GNSS_DOMINANT' else 'HYBRID' end end,
  case when m.mode = 'RECOVERY' and k < 10 then k + 1 when m.mode = 'RECOVERY' then 0 when m.mode = 'GNSS_DENIED' and nav <> 'DENIED' and c > 0.1 then 0 else k end, st.bad
  from m join st on st.track_id = m.track_id and st.n = m.n + 1)"""


@book.add(f"with {MODES_SQL} select track_id, row_idx, mode from m where row_idx is not null")
def mode_fsm(spark, d):
    return fusion.mode_fsm(states(spark, d)).select("track_id", "row_idx", "mode")


@book.add(f"""with {MODES_SQL}, o as (select *, case when mode <> lag(mode) over (partition by track_id order by n) then 1 else 0 end as fresh from m where row_idx is not null), u as (select *, sum(fresh) over (partition by track_id order by n) as run from o)
select track_id, row_idx, {r("case when mode = 'RECOVERY' then least(row_number() over (partition by track_id, run order by n) / 10.0::double, 1) when mode = 'GNSS_DENIED' then 0 when bad then 0.5 else 1 end")} as gnss_weight from u""")
def gnss_weight_ramp(spark, d):
    return fusion.gnss_weight_ramp(fusion.mode_fsm(states(spark, d))).select("track_id", "row_idx", "gnss_weight")


@book.add()
def mode_fsm_fold(spark, d):
    return fusion.mode_fsm_fold(states(spark, d)).select("track_id", "row_idx", "mode")


LOW_SQL = f"""recursive {views.TEL_SQL}, n as (select *, row_number() over {W} as n from tel), f as (select sequence_id, row_idx, n, ay as f from n where n = 1 union all select n.sequence_id, n.row_idx, n.n, 0.9::double * f.f + (1 - 0.9::double) * n.ay from f join n on n.sequence_id = f.sequence_id and n.n = f.n + 1)"""


@book.add(f"with {LOW_SQL} select sequence_id, row_idx, {r('f')} as ay_low from f")
def low_pass(spark, d):
    return fusion.low_pass(views.tel(spark, d), ["ay"], track="sequence_id").select("sequence_id", "row_idx", "ay_low")


@book.add(f"""with recursive {views.TEL_SQL}, n as (select *, row_number() over {W} as n from tel), f as (select sequence_id, row_idx, n, 0.0::double as f, gz from n where n = 1 union all select n.sequence_id, n.row_idx, n.n, 0.98::double * (f.f + n.gz - f.gz), n.gz from f join n on n.sequence_id = f.sequence_id and n.n = f.n + 1) select sequence_id, row_idx, {r('f')} as gz_high from f""")
def high_pass(spark, d):
    return fusion.high_pass(views.tel(spark, d), ["gz"], track="sequence_id").select("sequence_id", "row_idx", "gz_high")


@book.add(f"""with recursive {views.TEL_SQL}, n as (select *, row_number() over {W} as n from tel), f as (select sequence_id, row_idx, n, t as kept, true as ok from n where n = 1 union all select n.sequence_id, n.row_idx, n.n, case when n.t - f.kept >= 20000 then n.t else f.kept end, n.t - f.kept >= 20000 from f join n on n.sequence_id = f.sequence_id and n.n = f.n + 1) select sequence_id, row_idx from f where ok""")
def throttle(spark, d):
    return fusion.throttle(views.tel(spark, d), min_gap=20000.0, track="sequence_id").select("sequence_id", "row_idx")


MOTION_SQL = f"""{views.TEL_SQL}, a as (select *, t / {SCALE} as ts, sqrt(coalesce(ax, 0) * coalesce(ax, 0) + ay * ay + az * az) as am, sqrt(gx * gx + gy * gy + gz * gz) as gm from tel),
m as (select *, ts - lag(ts) over {W} as dt, am - lag(am) over {W} as da, coalesce(stddev_samp(am) over (partition by sequence_id order by t, row_idx rows between 49 preceding and current row), 0) as sd from a),
j as (select *, abs(am - {fusion.G}) as off, case when dt > 0.001 then abs(da) / dt else 0 end as jerk from m)"""


@book.add(f"""{MOTION_SQL} select sequence_id as track_id, case when gm > 1.5 and off > 2.5 then 'PHONE_DISTURBANCE' when off > 5 and jerk > 150 then 'POTHOLE' when off < 0.15 and gm < 0.05 and sd < 0.04 then 'STATIONARY' when coalesce(ax, 0) < -2.5 then 'BRAKING' when abs(gz) > 0.4 then 'TURNING' when coalesce(ax, 0) > 1.5 then 'ACCELERATING' else 'NORMAL' end as motion_state, count(*) as rows from j group by all""")
def motion_states(spark, d):
    s = states(spark, d).withColumn("accel_magnitude", scalar.vector_magnitude(F.coalesce("ax", F.lit(0.0)), "ay", "az"))
    return fusion.motion_state(fusion.motion_window_std(s), vehicle_accel="ax").groupBy("track_id", "motion_state").agg(F.count("*").alias("rows"))


@book.add(f"""{MOTION_SQL} select sequence_id as track_id, row_idx, case when gm > 4.0 and off > 2.5 then 'PHONE_DISTURBANCE' when off > 5 and jerk > 25 then 'POTHOLE' when off < 0.35 and gm < 0.08 and sd < 0.7 then 'STATIONARY' when coalesce(ax, 0) < -5 then 'BRAKING' when abs(gz) > 0.25 then 'TURNING' when coalesce(ax, 0) > 1 then 'ACCELERATING' else 'NORMAL' end as motion_state from j""")
def phone_motion(spark, d):
    """Row by row, by the phone module's limits."""
    s = states(spark, d).withColumn("accel_magnitude", scalar.vector_magnitude(F.coalesce("ax", F.lit(0.0)), "ay", "az"))
    return fusion.motion_state(fusion.motion_window_std(s), vehicle_accel="ax", limits=fusion.PHONE_MOTION).select("track_id", "row_idx", "motion_state")


@book.add(f"""{views.TEL_SQL}, v as (select *, t / {SCALE} as ts, least(coalesce(stddev_samp(ay) over (partition by sequence_id order by t, row_idx rows between 49 preceding and current row), 0) / 2.5, 1) as vib, last_value(case when accuracy < 10 and satellites <> 0 then t / {SCALE} end ignore nulls) over (partition by sequence_id order by t, row_idx rows between unbounded preceding and current row) as seen from tel)
select sequence_id as track_id, row_idx, {r('case when seen is null then 0 else (1 - 0.45 * vib) * case when ts - seen > 60 then exp(-(ts - seen - 60) / 60) else 1 end end')} as imu_confidence from v""")
def imu_confidence(spark, d):
    s = fusion.motion_window_std(states(spark, d), x="ay").withColumn("gnss_heading", F.when(F.col("reset"), F.col("heading")))
    return fusion.imu_confidence(s).select("track_id", "row_idx", "imu_confidence")


@book.add()
def orientation_track(spark, d):
    return fusion.orientation_track(states(spark, d)).select("track_id", "row_idx", "track_yaw", "track_pitch", "track_roll")


@book.add()
def ins_track(spark, d):
    return fusion.ins_track(states(spark, d)).select("track_id", "row_idx", *kinematics.INS_FIELDS)


@book.add()
def track_filter(spark, d):
    return fusion.track_filter(states(spark, d).withColumn("gnss_weight", F.lit(1.0))).select("track_id", "row_idx", *kinematics.UKF_FIELDS)


@book.add()
def fusion_pipeline(spark, d):
    return fusion.fusion_pipeline(states(spark, d)).select("track_id", "row_idx", *fusion.FUSED)


@book.add(f"""{views.TEL_SQL}, w as (select *, lag(lat) over {W} as lat1, lag(lon) over {W} as lon1, lead(t) over {W} is null as is_last from tel), g as (select sequence_id as run_id, sum(2 * 6371000 * asin(sqrt(pow(sin(radians(lat - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat)) * pow(sin(radians(lon - lon1) / 2), 2)))) as distance_m from w group by 1),
e as (select sequence_id as run_id, 2 * 6371000 * asin(sqrt(pow(sin(radians(0.001) / 2), 2))) as error_m from w where is_last)
select run_id, {r('distance_m')} as distance_m, {r('error_m')} as error_m, {r('error_m * 100 / distance_m')} as error_pct, error_m * 100 / distance_m < 10 as passed from g join e using (run_id)""")
def blackout_error(spark, d):
    truth = views.tel(spark, d).select(F.col("sequence_id").alias("run_id"), "t", "lat", "lon")
    return labels.blackout_error(truth, truth.withColumn("lat", F.col("lat") + 0.001))


@book.add(f"{views.TEL_SQL}, p as (select *, lag(ay) over {W} as previous from tel) select sequence_id, {r('avg(abs(ay - previous))')} as mae, {r('sqrt(avg(pow(ay - previous, 2)))')} as rmse from p where previous is not null group by 1")
def persistence_baseline(spark, d):
    tel = views.tel(spark, d)
    out = metrics.regression_metrics(tel.withColumn("previous", labels.persistence(tel, "ay")), "previous", "ay", ["sequence_id"], small_groups=True)
    return out.select("sequence_id", "mae", "rmse")


_YAW = "radians(yaw)"


@book.add(f"""{views.TEL_SQL} select row_idx, {r('ay - az')} as linear, {r(f'ay * cos({_YAW}) - az * sin({_YAW})')} as east, {r(f'ay * sin({_YAW}) + az * cos({_YAW})')} as north, {r('coalesce(ax, mx / 1000.0)')} as seconds, {r('speed / 3.6')} as ms, {r('speed * 3.6')} as kmh, {r('gx * 5 + 2')} as raw from tel""")
def vehicle_frame(spark, d):
    """Gravity taken off, vectors turned, one time of several, units."""
    turned = scalar.rotate_xy("ay", "az", "yaw")
    return views.tel(spark, d).select("row_idx", scalar.linear_acceleration("ay", "az").alias("linear"), turned["x"].alias("east"), turned["y"].alias("north"), scalar.time_seconds("ax", "mx").alias("seconds"), scalar.kmh_to_ms("speed").alias("ms"), scalar.ms_to_kmh("speed").alias("kmh"), scalar.unstandardize("gx", F.lit(2.0), F.lit(5.0)).alias("raw"))


_ARC, _PHI = "(speed * 1000 / 6371000)", "radians(lat)"


@book.add(f"""{views.TEL_SQL}, a as (select *, asin(sin({_PHI}) * cos({_ARC}) + cos({_PHI}) * sin({_ARC}) * cos({_YAW})) as phi from tel) select row_idx, {r('degrees(phi) * 100')} as lat, {r(f'(lon + degrees(atan2(sin({_YAW}) * sin({_ARC}) * cos({_PHI}), cos({_ARC}) - sin({_PHI}) * sin(phi)))) * 100')} as lon,
 {r('(lat + degrees(ay * 1000 / 6371000)) * 100')} as flat_lat, {r('(lon + degrees(az * 1000 / (6371000 * cos(radians(lat))))) * 100')} as flat_lon from a""")
def destination_points(spark, d):
    """Hundredfold degrees of the points reached by a bearing and a distance, and by metres east and north."""
    p = views.tel(spark, d).withColumns({"to": geo.destination_point("lat", "lon", "yaw", F.col("speed") * 1000), "flat": geo.inverse_project(F.col("az") * 1000, F.col("ay") * 1000, "lat", "lon")})
    return p.select("row_idx", *[(F.col(c) * 100).alias(n) for c, n in (("to.lat", "lat"), ("to.lon", "lon"), ("flat.lat", "flat_lat"), ("flat.lon", "flat_lon"))])


@book.add(f"{views.TEL_SQL} select sequence_id, row_idx as \"V_row_idx\", satellites as \"V_satellites\" from tel")
def prefix_columns(spark, d):
    return headers.prefix_columns(views.tel(spark, d).select("sequence_id", "row_idx", "satellites"), "V_", ("sequence_id",))


_HEADERS = ["gps latitude", "gps speed", "gravity x", "velocity", "gear", "engine speed"]


def _count_sql(words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(header, w)))"


@book.add(f"""h as (select p_partkey, concat_ws(' ', {', '.join(f"case when (p_partkey >> {i}) % 2 = 1 then '{w}' end" for i, w in enumerate(_HEADERS))}, lower(p_type)) as header from part), c as (select *, {_count_sql(headers.S_WORDS)} as s, {_count_sql(headers.V_WORDS)} as v from h)
select p_partkey, case when s > v and s >= 2 then 'S' when v > s and v >= 2 then 'V' else 'UNKNOWN' end as kind from c""")
def file_headers(spark, d):
    """Kinds of files by their headers: words by the bits of the part's number."""
    words = [F.when(F.shiftright("p_partkey", i).bitwiseAND(F.lit(1)) == 1, w) for i, w in enumerate(_HEADERS)]
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select("p_partkey", headers.classify_by_columns(F.concat_ws(" ", *words, F.lower("p_type"))).alias("kind"))


#: The sensor states that the online features are made of, as the view has them.
_ONLINE = f"""{views.TEL_SQL}, o as (select sequence_id, row_idx, row_number() over {W} as step, t, sqrt(ax * ax + ay * ay + az * az) as accel, sqrt(gx * gx + gy * gy + gz * gz) as gyro, sqrt(mx * mx + my * my + mz * mz) as field, speed / 3.6 * 3.6 as kmh, gz, t - lag(t) over {W} as gap from tel),
c as (select *, case when gap > 0 then gap else 0.1 end as dt, case when step = 1 then 0 else accel - lag(accel) over {W} end as accel_change, case when step = 1 then 0 else gz - lag(gz) over {W} end as yaw_change, t - first_value(t) over {W} as elapsed,
  avg(kmh) over f as kmh_mean, stddev_pop(gyro) over f as gyro_std, min(field) over f as field_min, max(accel) over f - min(accel) over f as accel_range from o window f as (partition by sequence_id order by t, row_idx rows between 29 preceding and current row))"""


def online_states(spark, d):
    return views.tel(spark, d).withColumns({"speed": F.col("speed") / 3.6, "heading": F.col("yaw")})


@book.add(f"""{_ONLINE} select sequence_id, row_idx, step, {r('dt')} as delta_time, {r('elapsed')} as elapsed_time, {r('accel')} as accel_magnitude, {r('field')} as mag_magnitude, {r('9.8066::double')} as gravity_magnitude, {r('accel_change')} as accel_change, {r('accel_change / dt')} as accel_change_rate, {r('yaw_change')} as yaw_change,
{r('kmh_mean')} as gps_speed_rolling_mean, {r('gyro_std')} as gyro_magnitude_rolling_std, {r('field_min')} as mag_magnitude_rolling_min, {r('accel_range')} as accel_magnitude_rolling_range from c""")
def online_vectors(spark, d):
    out = online.online_vectors(online_states(spark, d), track="sequence_id")
    names = ("delta_time", "elapsed_time", "accel_magnitude", "mag_magnitude", "gravity_magnitude", "accel_change", "accel_change_rate", "yaw_change", "gps_speed_rolling_mean", "gyro_magnitude_rolling_std", "mag_magnitude_rolling_min", "accel_magnitude_rolling_range")
    return out.select("sequence_id", "row_idx", F.col("step").cast("long").alias("step"), *[F.col("vector")[features.DEPLOYABLE_FEATURES.index(n)].alias(n) for n in names])


@book.add(f"""{_ONLINE}, k as (select sequence_id, row_idx, step, lag(gyro, 29) over {W} as oldest_gyro, lag(kmh_mean, 29) over {W} as oldest_kmh_mean, field as newest_field from c)
select sequence_id, row_idx, 30::bigint as steps, {r('oldest_gyro')} as oldest_gyro, {r('oldest_kmh_mean')} as oldest_kmh_mean, {r('newest_field')} as newest_field from k where step >= 59""")
def online_windows(spark, d):
    at = features.DEPLOYABLE_FEATURES.index
    out = online.online_windows(online_states(spark, d), track="sequence_id")
    return out.select("sequence_id", "row_idx", F.size("window").cast("long").alias("steps"), F.col("window")[0][at("gyro_magnitude")].alias("oldest_gyro"), F.col("window")[0][at("gps_speed_rolling_mean")].alias("oldest_kmh_mean"), F.col("window")[29][at("mag_magnitude")].alias("newest_field"))
