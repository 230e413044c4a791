"""Queries on data quality, audits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, gates, metrics, preparation, quality, ranks, sync
from . import views
from .book import Book, r
from .telemetry_queries import ALIGNED_SQL, SPLIT_SQL, aligned, canonical, split

book = Book()
COLUMNS = ["ax", "ay", "az", "yaw", "speed", "accuracy"]


def long_sql(columns, keys="") -> str:
    return " union all ".join(f"select {keys}'{c}' as feature, {c}::double as value from tel" for c in columns)


@book.add("select (select count(*) from part) as rows, 6 as columns, * from (values (0, 'p_partkey', 'bigint'), (1, 'p_name', 'string'), (2, 'p_brand', 'string'), (3, 'p_type', 'string'), (4, 'p_size', 'int'), (5, 'p_retailprice', 'double')) as c(position, \"column\", dtype)")
def shape_report(spark, d):
    return quality.shape_report(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))


MISSING_SQL = f"{views.TEL_SQL}, report as (select feature, count(*) as rows, count(*) filter (value is null) as missing, round(count(*) filter (value is null) * 100.0::double / count(*), 4) as missing_pct from ({long_sql(COLUMNS)}) group by 1)"


@book.add(f"{MISSING_SQL} select feature, rows, missing, {r('missing_pct')} as missing_pct from report")
def missing_report(spark, d):
    return quality.missing_report(views.tel(spark, d), COLUMNS)


@book.add(f"{views.TEL_SQL}, l as ({long_sql(COLUMNS[:3], 'sequence_id, ')}) select sequence_id, feature, count(*) as rows, count(*) filter (value is null) as missing, {r('round(count(*) filter (value is null) * 100.0::double / count(*), 4)')} as missing_pct from l group by 1, 2")
def missing_by_sequence(spark, d):
    return quality.missing_report(views.tel(spark, d), COLUMNS[:3], "sequence_id")


@book.add(f"{views.TEL_SQL} select sequence_id, " + ", ".join(f"{r(f'round(count(*) filter ({c} is null) * 100.0::double / count(*), 4)')} as {c}" for c in ("ax", "ay")) + " from tel group by 1")
def missing_pivot(spark, d):
    return quality.missing_pivot(quality.missing_report(views.tel(spark, d), ["ax", "ay"], "sequence_id"), ["ax", "ay"])


@book.add(f"{MISSING_SQL} select " + ", ".join(f"count(*) filter ({c}) as {n}" for n, c in (("none", "missing_pct = 0"), ("to_1", "missing_pct > 0 and missing_pct <= 1"), ("to_5", "missing_pct > 1 and missing_pct <= 5"), ("to_10", "missing_pct > 5 and missing_pct <= 10"), ("to_25", "missing_pct > 10 and missing_pct <= 25"), ("over_25", "missing_pct > 25"), ("all_missing", "missing_pct >= 100"))) + " from report")
def missing_buckets(spark, d):
    return quality.missing_buckets(quality.missing_report(views.tel(spark, d), COLUMNS))


@book.add("g as (select l_orderkey, l_linenumber, count(*) as n from lineitem group by all) select coalesce(sum(n) filter (n > 1), 0)::bigint as all_members, coalesce(sum(n - 1), 0)::bigint as extra_members from g")
def duplicate_rows(spark, d):
    return quality.duplicate_rows(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@book.add(f"{views.TEL_SQL}, g as (select sequence_id, floor(t / 86400) as day, count(*) as n from tel group by all) select sequence_id, coalesce(sum(n) filter (n > 1), 0)::bigint as all_members, coalesce(sum(n - 1), 0)::bigint as extra_members from g group by 1")
def duplicate_timestamps(spark, d):
    return quality.duplicate_timestamps(views.tel(spark, d).withColumn("day", F.floor(F.col("t") / 86400)), on="day")


@book.add("select 'p_type' as feature, count(*) as invalid, list_sort(list(distinct p_type))[1:5] as samples from part where p_type is not null and try_cast(trim(p_type) as double) is null having count(*) > 0")
def invalid_numeric_report(spark, d):
    return quality.invalid_numeric_report(spark.read.parquet(f"{d}/part.parquet"), ["p_type", "p_size"])


@book.add("select 'ratio' as feature, count(*) filter (l_discount = 0) as infinite from lineitem having count(*) filter (l_discount = 0) > 0")
def infinite_report(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(F.when(F.col("l_discount") == 0, float("inf")).otherwise(1 / F.col("l_discount")).alias("ratio"), "l_tax")
    return quality.infinite_report(x, ["ratio", "l_tax"])


@book.add(f"{views.TEL_SQL} select feature, {r('min(value)')} as min, {r('max(value)')} as max from ({long_sql(COLUMNS)}) group by 1")
def min_max_report(spark, d):
    return quality.min_max_report(views.tel(spark, d), COLUMNS)


@book.add(f"{views.TEL_SQL} select count(*) filter (ay < -90 or ay > 90) as invalid_latitude, count(*) filter (yaw < -180 or yaw > 180) as invalid_longitude from tel")
def latlon_validity(spark, d):
    return quality.latlon_validity(views.tel(spark, d), "ay", "yaw")


@book.add(f"{views.TEL_SQL}, g as (select sequence_id, t - lag(t) over (partition by sequence_id order by t, row_idx) as d from tel) select sequence_id, {r('avg(d) filter (d > 0)')} as mean_step, {r('stddev_samp(d) filter (d > 0)')} as std_step, {r('min(d) filter (d > 0)')} as min_step, {r('max(d) filter (d > 0)')} as max_step, {r('1 / avg(d) filter (d > 0)')} as hz, count(*) filter (d <= 0) as non_positive from g group by 1")
def sampling_info(spark, d):
    return quality.sampling_info(views.tel(spark, d))


@book.add(f"{views.TEL_SQL} select sequence_id, {r('max(t) - min(t)')} as duration from tel group by 1")
def time_range(spark, d):
    return quality.time_range(views.tel(spark, d)).select("sequence_id", "duration")


RULES = [("latitude_invalid", "lat < -90 or lat > 90"), ("longitude_invalid", "lon < -180 or lon > 180"), ("gps_speed_invalid", "speed < 0 or speed > 300"), ("gps_accuracy_invalid", "accuracy < 0 or accuracy > 1000"), ("altitude_invalid", "false"), ("accelerometer_outlier", "sqrt(ax * ax + ay * ay + az * az) > 100"), ("gyroscope_outlier", "abs(gx) > 50"), ("magnetometer_outlier", "sqrt(mx * mx + my * my + mz * mz) > 1000"), ("orientation_outlier", "abs(yaw) > 720")]


@book.add(f"{views.TEL_SQL} select sequence_id, " + ", ".join(f"count(*) filter ({c}) as {n}" for n, c in RULES) + " from tel group by 1")
def range_flags(spark, d):
    return quality.range_flags(features.engineer(canonical(spark, d)))


STATS_SQL = f"""{views.TEL_SQL}, l as ({long_sql(['ax', 'ay', 'gx', 'satellites'])}), b as (select feature, count(*) as rows, count(*) filter (value is null) as missing, 0::bigint as infinite, count(value) as finite, count(distinct value) as "distinct", min(value) as min, max(value) as max, avg(value) as mean, quantile_cont(value, 0.5) as median, stddev_pop(value) as std from l group by 1),
o as (select feature, max(n) as dominant from (select feature, value, count(*) as n from l where value is not null group by all) group by 1),
s as (select *, missing * 100.0::double / rows as missing_pct, "distinct" <= 1 as is_constant, dominant >= 0.99 * finite or "distinct" <= greatest(2, floor(finite * 0.01)) as is_near_constant from b join o using (feature))"""


@book.add(f"""{STATS_SQL} select feature, rows, missing, infinite, finite, "distinct", dominant, {r('min')} as min, {r('max')} as max, {r('mean')} as mean, {r('median')} as median, {r('std')} as std, {r('missing_pct')} as missing_pct, is_constant, is_near_constant,
 case when missing_pct >= 100 then 'FAIL' when missing_pct > 0 or is_constant or is_near_constant then 'WARNING' else 'PASS' end as status, case when missing > 0 then 'to be inspected' else 'None' end as cause from s""")
def feature_statistics(spark, d):
    out = quality.feature_statistics(views.tel(spark, d), ["ax", "ay", "gx", "satellites"])
    return out.withColumns({c: F.col(c).cast("long") for c in ("rows", "missing", "infinite", "finite", "dominant")})


@book.add(f"""{STATS_SQL} select feature, {r('mean')} as mean from s where feature in ('gx', 'gy')""")
def feature_subset(spark, d):
    return quality.feature_subset(quality.feature_statistics(views.tel(spark, d), ["ax", "ay", "gx", "satellites"]), ["gx", "gy"]).select("feature", "mean")


QUALITY_SQL = f"""{views.TEL_SQL}, m as (select *, t < lag(t) over (partition by sequence_id order by row_idx) as back from tel), q as (select sequence_id, count(*) as rows, count(*) filter (ax is null) * 100.0::double / (2 * count(*)) as missing_pct, count(*) filter (back) as steps_back, count(t) - count(distinct t) as repeated_times,
 (coalesce(min(ax) = max(ax), false)::int + coalesce(min(ay) = max(ay), false)::int) as constant_features from m group by 1)"""


@book.add(f"""{QUALITY_SQL}, i as (select *, concat_ws('; ', case when missing_pct > 0 then 'missing values' end, case when steps_back > 0 then 'time not in order' end, case when repeated_times > 0 then 'repeated times' end, case when constant_features > 0 then 'constant features' end) as issues from q)
select sequence_id, rows, {r('missing_pct')} as missing_pct, steps_back, repeated_times, constant_features, 0 as out_of_range, issues, case when issues = '' then 'PASS' else 'WARNING' end as status from i""")
def sequence_quality(spark, d):
    return quality.sequence_quality(views.tel(spark, d), ["ax", "ay"])


@book.add(f"""{STATS_SQL} select count(*) filter (missing_pct >= 100) as failed_features, 0::bigint as infinite, 0::bigint as failed_sequences, (select count(*) from (select sequence_id from tel group by 1 having count(*) filter (ax is null) > 0 or count(distinct t) < count(t) or min(ay) = max(ay) or min(ax) = max(ax) union select sequence_id from (select sequence_id, t < lag(t) over (partition by sequence_id order by row_idx) as back from tel) where back)) as warned_sequences, 'READY' as verdict from s""")
def audit_verdict(spark, d):
    tel = views.tel(spark, d)
    out = quality.audit_verdict(quality.feature_statistics(tel, ["ax", "ay", "gx", "satellites"]), quality.sequence_quality(tel, ["ax", "ay"]))
    return out.withColumn("infinite", F.col("infinite").cast("long"))


#: The telemetry with infinite, missing and repeated values: each rule of the audit has something to find.
BROKEN_SQL = f"""{views.TEL_SQL}, bt as (select sequence_id, row_idx, case when row_idx % 17 = 0 then null when sequence_id % 3 = 0 then floor(t / 86400) else t end as t, case when row_idx % 29 = 0 then 'infinity'::double else ay end as ay, null::double as gap_free,
  case when sequence_id % 2 = 0 then 5.0::double else gx end as gx, row_idx % 13 = 0 as time_gap_flag from tel)"""


def broken(spark, d):
    r = F.col("row_idx")
    t = F.when(r % 17 != 0, F.when(F.col("sequence_id") % 3 == 0, F.floor(F.col("t") / 86400).cast("double")).otherwise(F.col("t")))
    out = views.tel(spark, d).withColumns({"t": t, "ay": F.when(r % 29 == 0, float("inf")).otherwise(F.col("ay")), "gap_free": F.lit(None).cast("double"), "gx": F.when(F.col("sequence_id") % 2 == 0, 5.0).otherwise(F.col("gx")), "time_gap_flag": r % 13 == 0})
    return out.select("sequence_id", "row_idx", "t", "ay", "gap_free", "gx", "time_gap_flag")


@book.add(f"""{BROKEN_SQL}, o as (select *, lag(t) over (partition by sequence_id order by row_idx) as prior from bt), dup as (select sequence_id, sum(n - 1)::bigint as repeated_rows from (select sequence_id, t, ay, gap_free, gx, time_gap_flag, count(*) as n from bt group by all) group by 1)
select sequence_id, count(*) as rows, count(*) filter (t < prior) as steps_back, count(t) - count(distinct t) as repeated_times, count(*) filter (t is null) as missing_times, count(*) filter (time_gap_flag) as time_gaps, count(*) filter (isinf(ay)) as infinite_values, any_value(repeated_rows) as repeated_rows,
 1 + case when count(distinct gx) <= 1 then 1 else 0 end + case when count(distinct ay) <= 1 then 1 else 0 end as constant_features, '' as unexpected_text, false as gyro_bug, 'WARNING' as status from o join dup using (sequence_id) group by 1""")
def sequence_audit_broken(spark, d):
    """The audit where every rule but the gyroscope's finds something."""
    out = quality.sequence_audit(broken(spark, d), ["ay", "gap_free", "gx"])
    return out.select("sequence_id", "rows", "steps_back", "repeated_times", "missing_times", "time_gaps", "infinite_values", "repeated_rows", F.col("constant_features").cast("int").alias("constant_features"), "unexpected_text", "gyro_bug", "status")


@book.add(f"""{BROKEN_SQL}, c as (select count(*) filter (isinf(ay)) as infinite, 1 + case when count(*) filter (isinf(ay)) > 0 then 1 else 0 end as failed_features from bt) select failed_features, infinite, case when failed_features > 0 or infinite > 0 then 'REQUIRES CORRECTION' else 'READY' end as verdict from c""")
def audit_verdict_broken(spark, d):
    """The verdict's other branch: a feature that is wholly missing, and one with infinities."""
    tel = broken(spark, d)
    out = quality.audit_verdict(quality.feature_statistics(tel, ["ay", "gap_free", "gx"]), quality.sequence_audit(tel, ["ay", "gap_free", "gx"]))
    return out.select("failed_features", F.col("infinite").cast("long").alias("infinite"), "verdict")


COLUMNS_SQL = f"{views.TEL_SQL}, c as (select distinct sequence_id, unnest([event_type, event_type || '_' || satellites]) as column_name from tel)"


def columns_of(spark, d):
    """A drive's columns: its kinds of event, each alone and by number of satellites."""
    names = F.array("event_type", F.concat_ws("_", "event_type", F.col("satellites").cast("string")))
    return views.tel(spark, d).select("sequence_id", F.explode(names).alias("column_name"), F.lit(True).alias("is_numeric")).distinct()


@book.add(f"{COLUMNS_SQL} select column_name, count(distinct sequence_id) as held_by, count(distinct sequence_id) = (select count(distinct sequence_id) from c) as is_common from c group by 1")
def schema_variation(spark, d):
    return quality.schema_variation(columns_of(spark, d), "sequence_id", "column_name")


@book.add(f"{COLUMNS_SQL}, n as (select column_name, count(distinct sequence_id) as held from c group by 1) select column_name, case column_name when 'view' then 0 when 'click_1' then 1 when 'click' then 2 else 3 end as position from n where held = (select count(distinct sequence_id) from c) and column_name in ('view', 'click_1', 'click', 'error')")
def common_features(spark, d):
    return quality.common_features(columns_of(spark, d), ["view", "click_1", "click", "error"], column="column_name")


@book.add(f"{views.TEL_SQL}, a as (select feature, count(*) filter (value is null) * 100.0::double / count(*) as p from ({long_sql(COLUMNS)}) group by 1), b as (select feature, count(*) filter (value is null) * 100.0::double / count(*) as p from ({long_sql(COLUMNS).replace('from tel', "from (select * replace (case when event_type = 'view' then coalesce(ax, ay) else ax end as ax) from tel)")}) group by 1) select feature, {r('round(a.p, 4)')} as before, {r('round(b.p, 4)')} as after, {r('round(b.p, 4) - round(a.p, 4)')} as change from a join b using (feature)")
def before_after(spark, d):
    tel = views.tel(spark, d)
    return quality.before_after(quality.missing_report(tel, COLUMNS), quality.missing_report(tel.withColumn("ax", F.when(F.col("event_type") == "view", F.coalesce("ax", "ay")).otherwise(F.col("ax"))), COLUMNS))


@book.add(f"{ALIGNED_SQL} select 'V_lat' as feature, count(*) filter (v_lat is null) as missing, {r('round(count(*) filter (v_lat is null) * 100.0::double / count(*), 4)')} as missing_pct, 'unmatched row' as cause from aligned union all select 'yaw', 0, 0.0, 'None' from (select 1)")
def missing_causes(spark, d):
    return quality.missing_causes(aligned(spark, d), ["V_lat", "yaw"])


#: Features by name, each missing in the rows whose number its divisor divides (0: in none), so that every rule names one.
_GAPS = {"gyro_magnitude": 5, "gyro_change_rate": 9, "delta_time": 7, "accel_change": 11, "speed": 13, "speed_rolling_mean": 17, "ay": 0, "ay_rolling_std": 19, "turn_rate": 23, "S_level": 29, "timestamp": 31, "other": 37}


@book.add(f"""{ALIGNED_SQL}, c as (select count(*) as n, count(*) filter (v_lat is null) as u, {', '.join(f"{f'count(*) filter (row_idx % {k} = 0)' if k else '0::bigint'} as {name}" for name, k in _GAPS.items())} from aligned),
l as (unpivot (select n, u, u as V_lat, {', '.join(_GAPS)} from c) on V_lat, {', '.join(_GAPS)} into name feature value missing)
select feature, missing, {r('round(missing * 100.0::double / n, 4)')} as missing_pct, case when missing = 0 then 'None' when regexp_matches(feature, '^gyro_(magnitude|change)') then 'gyroscope axes' when regexp_matches(feature, '(delta_time|_change|_change_rate)$') then 'first difference'
 when contains(feature, 'rolling') then case when (select b.missing from l b where b.feature = regexp_replace(l.feature, '_rolling_(mean|std|min|max|range)$', '')) > 0 then 'inherited from the rolled source' else 'rolling window start' end
 when ends_with(feature, '_rate') then 'division by zero' when starts_with(feature, 'V_') and u > 0 then 'unmatched row' when regexp_matches(feature, '^[SV]_') then 'sensor or source' when feature in ('timestamp', 'elapsed_time') then 'no synchronised time' else 'to be inspected' end as cause from l""")
def missing_causes_all(spark, d):
    """Every rule of the causes."""
    table = aligned(spark, d).withColumns({name: F.when(F.col("row_idx") % k != 0, 1.0) if k else F.lit(1.0) for name, k in _GAPS.items()} | {f"gyro_{a}": F.lit(0.0) for a in ("yaw", "pitch", "roll")})
    return quality.missing_causes(table, ["V_lat", *_GAPS])


PARAMS_SQL = f"""{SPLIT_SQL}, train as (select * from tel join split using (sequence_id) where split = 'train'), l as ({long_sql(['ax', 'ay', 'speed']).replace('from tel', 'from train')}), m as (select feature, quantile_cont(value, 0.5) as median from l group by 1),
params as (select feature, any_value(median) as median, avg(coalesce(value, median)) as mean, stddev_pop(coalesce(value, median)) as std from l join m using (feature) group by 1)"""


def params(spark, d):
    return preparation.fit_preprocess(sync.attach_split(views.tel(spark, d), split(spark, d)).filter("split = 'train'"), ["ax", "ay", "speed"])


@book.add(f"{PARAMS_SQL} select feature, {r('median')} as median, {r('mean')} as mean, {r('std')} as std from params")
def fit_preprocess(spark, d):
    return params(spark, d)


@book.add(f"{PARAMS_SQL} select row_idx, " + ", ".join(f"{r(f'(coalesce({c}, (select median from params where feature = {chr(39)}{c}{chr(39)})) - (select mean from params where feature = {chr(39)}{c}{chr(39)})) / (select std from params where feature = {chr(39)}{c}{chr(39)})')} as {c}" for c in ("ax", "ay", "speed")) + " from tel")
def apply_preprocess(spark, d):
    return preparation.apply_preprocess(views.tel(spark, d), params(spark, d), ["ax", "ay", "speed"]).select("row_idx", "ax", "ay", "speed")


@book.add(f"{SPLIT_SQL}, s as (select * from tel join split using (sequence_id)) select split, 1 as missing_features, count(*) filter (ax is null) as bad_values from s group by 1")
def feature_check(spark, d):
    s = sync.attach_split(views.tel(spark, d), split(spark, d))
    return preparation.feature_check({k: s.filter(F.col("split") == k) for k in ("train", "validation", "test")}, ["ax", "ay", "absent"])


@book.add(f"{views.TEL_SQL}, i as (select sequence_id, row_number() over (order by sequence_id) as k, count(*) over () as n from (select distinct sequence_id from tel)) select sequence_id from i where k in (1, n // 2 + 1, n)")
def representative_sequences(spark, d):
    return preparation.representative_sequences(views.tel(spark, d))


# Scores: the view's acceleration stands for a score, its 99th percentile over validation rows for the threshold.
SCORED_SQL = f"{SPLIT_SQL}, th as (select quantile_cont(ax, 0.99) as threshold from tel join split using (sequence_id) where split = 'validation'), scored as (select tel.*, split, threshold, ax >= threshold as drift_detected from tel join split using (sequence_id), th where ax is not null)"


def scored(spark, d):
    from ..operators import isolation

    s = sync.attach_split(views.tel(spark, d), split(spark, d)).filter("ax is not null").withColumn("drift_score", F.col("ax"))
    return isolation.anomaly_flag(s, isolation.select_threshold(s.filter("split = 'validation'")))


@book.add(f"{SCORED_SQL} select split, count(*) as rows, count(*) filter (drift_detected) as detected, {r('count(*) filter (drift_detected) * 100.0::double / count(*)')} as detected_pct, {r('min(ax)')} as min_score, {r('max(ax)')} as max_score, {r('avg(ax)')} as mean_score, {r('median(ax)')} as median_score, {r('max(threshold)')} as threshold from scored group by 1")
def score_summary(spark, d):
    return metrics.score_summary(scored(spark, d))


@book.add(f"{SCORED_SQL} select sequence_id, count(*) as rows, count(*) filter (drift_detected) as detected, {r('avg(ax)')} as mean_score, {r('max(ax)')} as max_score, {r('median(ax)')} as median_score, {r('count(*) filter (drift_detected) * 100.0::double / count(*)')} as detected_pct from scored group by 1")
def sequence_drift(spark, d):
    return metrics.sequence_drift(scored(spark, d))


@book.add(f"{SCORED_SQL}, g as (select sequence_id, count(*) filter (drift_detected) * 100.0::double / count(*) as detected_pct from scored group by 1) select sequence_id, {r('detected_pct')} as detected_pct from g order by g.detected_pct desc, sequence_id limit 10")
def top_sequences(spark, d):
    return metrics.top(metrics.sequence_drift(scored(spark, d)), 10, "detected_pct", "sequence_id").select("sequence_id", "detected_pct")


@book.add(f"{SCORED_SQL}, l as (" + " union all ".join(f"select drift_detected as dd, '{c}' as feature, {c}::double as value from scored" for c in ("ay", "speed")) + f"), a as (select feature, avg(value) filter (not dd) as nm, avg(value) filter (dd) as am, stddev_samp(value) filter (not dd) as ns, stddev_samp(value) filter (dd) as sd from l group by 1) select feature, {r('nm')} as normal_mean, {r('am')} as anomaly_mean, {r('ns')} as normal_std, {r('sd')} as anomaly_std, {r('case when ns > 1e-12 then abs(am - nm) / ns else 0 end')} as abnormality from a")
def feature_abnormality(spark, d):
    return metrics.feature_abnormality(scored(spark, d), ["ay", "speed"])


@book.add(f"{SCORED_SQL}, e as (select min(ax) as lo, max(ax) as hi from scored) select least(floor((ax - lo) / (hi - lo) * 100) + 1, 100)::int as bin, count(*) as rows from scored, e group by 1")
def score_histogram(spark, d):
    return metrics.histogram(scored(spark, d), "ax")


@book.add(f"{SCORED_SQL} select row_idx, {r('ax')} as drift_score from scored where drift_detected")
def anomalies(spark, d):
    return metrics.anomalies(scored(spark, d)).select("row_idx", "drift_score")


# Predictions: speed stands for the actual error, a linear form of accuracy for the prediction.
PREDICTED_SQL = f"{SPLIT_SQL}, p as (select *, accuracy * 1.5 + 10 as guess, accuracy * 1.5 + 10 - speed as e from tel join split using (sequence_id))"


def predictions(spark, d):
    return sync.attach_split(views.tel(spark, d), split(spark, d)).withColumn("guess", F.col("accuracy") * 1.5 + 10)


def _metric_sql(limits=()) -> str:
    out = [("mae", "avg(abs(e))"), ("rmse", "sqrt(avg(e * e))"), ("mean_error", "avg(e)"), ("std_error", "stddev_pop(e)"), ("median_error", "median(e)"), ("max_abs_error", "max(abs(e))"), ("p95_abs_error", "quantile_cont(abs(e), 0.95)"), ("p99_abs_error", "quantile_cont(abs(e), 0.99)")]
    return ", ".join(f"{r(x)} as {n}" for n, x in [*out, *[(f"over_{x}_pct", f"avg((abs(e) > {x})::int) * 100") for x in limits]])


@book.add(f"{PREDICTED_SQL} select split, count(*) as n, {_metric_sql()} from p group by 1")
def regression_metrics(spark, d):
    return metrics.regression_metrics(predictions(spark, d), "guess", "speed", ["split"])


@book.add(f"{PREDICTED_SQL} select sequence_id, count(*) as n, {_metric_sql((50, 100))} from p group by 1")
def per_sequence_metrics(spark, d):
    return metrics.regression_metrics(predictions(spark, d), "guess", "speed", ["sequence_id"], (50.0, 100.0), small_groups=True)


@book.add(f"{PREDICTED_SQL}, g as (select sequence_id, avg(abs(e)) as mae from p group by 1) select sequence_id, {r('mae')} as mae from g order by g.mae desc, sequence_id limit 5")
def worst_sequences(spark, d):
    return metrics.worst_sequences(metrics.regression_metrics(predictions(spark, d), "guess", "speed", ["sequence_id"], small_groups=True)).select("sequence_id", "mae")


@book.add(f"{views.TEL_SQL} select " + ", ".join(f"{r(f'avg((abs(speed) > {x})::int) * 100')} as over_{x}_pct" for x in (20, 50, 100)) + " from tel")
def large_error_rates(spark, d):
    return metrics.large_error_rates(views.tel(spark, d), "speed", (20.0, 50.0, 100.0))


@book.add(f"""{PREDICTED_SQL}, tm as (select median(speed) as m from p where split = 'train'), b as (select e, m - speed as me, lag(speed) over (partition by sequence_id order by t, row_idx) - speed as pe from p, tm), k as (select * from b where pe is not null),
g as (select 'model' as baseline, count(*) as n, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse from k union all select 'median', count(*), avg(abs(me)), sqrt(avg(me * me)) from k union all select 'persistence', count(*), avg(abs(pe)), sqrt(avg(pe * pe)) from k)
select baseline, n, {r('mae')} as mae, {r('rmse')} as rmse, {r("(mae - (select mae from g where baseline = 'model')) * 100 / mae")} as improvement_pct from g""")
def baseline_compare(spark, d):
    p = predictions(spark, d)
    median = ranks.percentiles(p.filter("split = 'train'"), F.col("speed"), {"train_median": 0.5})
    return metrics.baseline_compare(p.join(F.broadcast(median), F.lit(True)), "guess", "speed", F.col("train_median"))


_TARGETS = [("mean", "avg(value)"), ("median", "median(value)"), ("std", "stddev_pop(value)"), ("min", "min(value)"), ("max", "max(value)"), ("p90", "quantile_cont(value, 0.9)"), ("p95", "quantile_cont(value, 0.95)"), ("p99", "quantile_cont(value, 0.99)")]
TARGET_SQL = f"{SPLIT_SQL}, l as ({long_sql(['ax', 'speed'], 'sequence_id, ')}), st as (select sequence_id, feature as target, count(value) as n, " + ", ".join(f"{x} as {n}" for n, x in _TARGETS) + " from l group by 1, 2)"


@book.add(f"{TARGET_SQL} select sequence_id, target, n, " + ", ".join(f"{r(n)} as {n}" for n, _ in _TARGETS) + " from st where n > 0")
def target_statistics(spark, d):
    return metrics.target_statistics(views.tel(spark, d), ["ax", "speed"])


@book.add(f"{TARGET_SQL} select split, target, count(*) as sequences, sum(n)::bigint as valid_rows, " + ", ".join(f"{r(f'avg({n})')} as mean_of_{n}" for n, _ in _TARGETS) + " from st join split using (sequence_id) where n > 0 group by 1, 2")
def split_target_summary(spark, d):
    return metrics.split_target_summary(metrics.target_statistics(views.tel(spark, d), ["ax", "speed"]), split(spark, d))


@book.add(f"{ALIGNED_SQL} select 'column sequence_id' as rule, 0::bigint as violations union all select 'column time_difference', 0 union all select 'column synchronization_valid', 0 union all select 'negative difference', count(*) filter (time_difference < 0) from aligned union all select 'match without difference', count(*) filter (synchronization_valid and time_difference is null) from aligned")
def validate_aligned(spark, d):
    return gates.validate_aligned(aligned(spark, d))


@book.add(f"""{views.TEL_SQL}, k as (select *, t < lag(t) over (partition by sequence_id order by row_idx) as back from tel) select c as rule, (c = 'column absent')::bigint as violations from (values ('column sequence_id'), ('column t'), ('column inverse'), ('column absent')) as x(c)
 union all select 'no sequence', count(*) filter (sequence_id is null) from k union all select 'time not in order', count(*) filter (back) from k union all select 'infinite value', count(*) filter (satellites = 0) from k""")
def validate_features(spark, d):
    tel = views.tel(spark, d).withColumn("inverse", F.when(F.col("satellites") == 0, float("inf")).otherwise(1.0 / F.col("satellites")))
    return gates.validate_features(tel, ["inverse", "absent"], on="t")


@book.add(f"{views.TEL_SQL} select 'column ' || c as rule, 0::bigint as violations from (values ('gyro_yaw'), ('gyro_pitch'), ('gyro_roll')) as x(c) union all select 'empty ' || c, (select (count(gx) = 0)::bigint from tel) from (values ('gyro_yaw'), ('gyro_pitch'), ('gyro_roll')) as x(c)")
def gyro_gate(spark, d):
    return gates.gyro_gate(canonical(spark, d))


@book.add(f"{ALIGNED_SQL} select 11 as gate, count(*) filter (synchronization_valid) as matched, count(*) filter (synchronization_valid) > 0 as passed from aligned where sequence_id = 11")
def pipeline_gate(spark, d):
    return gates.pipeline_gate(aligned(spark, d), 11)


@book.add(f"{views.TEL_SQL}, bad as (select distinct sequence_id, case when speed > 128 then 'too fast' when accuracy > 68 then 'too wide' end as p from tel where speed > 128 or accuracy > 68) select sequence_id, list_sort(list(distinct p)) as problems, 'FAIL' as status from bad group by 1")
def isolate_failures(spark, d):
    problem = F.when(F.col("speed") > 128, "too fast").when(F.col("accuracy") > 68, "too wide")
    return gates.isolate_failures(views.tel(spark, d), problem)[1]


@book.add(f"{views.SIDES_SQL}, a as (select sequence_id, min(t) as s0, max(t) as s1, count(t) - count(distinct t) as sd, count(*) filter (ay > 90 or ay < -90) as sl from s_side group by 1), b as (select sequence_id, min(t) as v0, max(t) as v1, count(t) - count(distinct t) as vd, count(*) filter (ay > 90 or ay < -90) as vl from v_side group by 1) select sequence_id, list_filter([case when sd > 0 then 'S repeated times' end, case when sl > 0 then 'S latitude out of range' end, case when vd > 0 then 'V repeated times' end, case when vl > 0 then 'V latitude out of range' end, case when s1 is null or v1 is null or least(s1, v1) < greatest(s0, v0) then 'no shared time' end], lambda x: x is not null) as warnings from a full join b using (sequence_id)")
def sync_warnings(spark, d):
    return gates.sync_warnings(*views.sides(spark, d), lat="ay")


AUDIT_SQL = f"""{QUALITY_SQL}, l as ({long_sql(['ax', 'ay', 'satellites'], 'sequence_id, ')}), n as (select sequence_id, feature, value, count(*) as n from l group by all),
f as (select sequence_id, feature, count(value) as "distinct", coalesce(sum(n) filter (value is not null), 0) as valid, max(n) filter (value is not null) as dominant from n group by all),
v as (select sequence_id, count(*) filter ("distinct" <= 1) as constant_features, count(*) filter (valid > 0 and (dominant >= 0.99 * valid or "distinct" <= greatest(2, floor(valid * 0.01)))) as near_constant_features from f group by 1),
d as (select sequence_id, sum(n - 1)::bigint as repeated_rows from (select sequence_id, ax, ay, satellites, day, count(*) as n from (select *, floor(t / 86400) as day from tel) group by all) group by 1),
x as (select sequence_id, count(*) as rows, count(*) filter (ax is null) * 100.0::double / (3 * count(*)) as missing_pct, count(*) filter (floor(t / 86400) < prior) as steps_back, count(t) - count(distinct floor(t / 86400)) as repeated_times from (select *, lag(floor(t / 86400)) over (partition by sequence_id order by row_idx) as prior from tel) group by 1),
j as (select sequence_id, rows, missing_pct, steps_back, repeated_times, constant_features, near_constant_features, repeated_rows from x join v using (sequence_id) join d using (sequence_id))"""


def audited(spark, d):
    """Days, in place of times, and few columns, so that rows repeat."""
    tel = views.tel(spark, d).select("sequence_id", "row_idx", F.floor(F.col("t") / 86400).cast("double").alias("t"), "ax", "ay", "satellites")
    return quality.sequence_audit(tel, ["ax", "ay", "satellites"])


@book.add(f"""{AUDIT_SQL} select sequence_id, rows, {r('missing_pct')} as missing_pct, steps_back, repeated_times, constant_features, near_constant_features, repeated_rows, 0::bigint as infinite_values,
 concat_ws('; ', case when missing_pct > 0 then 'missing values' end, case when steps_back > 0 then 'time not in order' end, case when repeated_times > 0 then 'repeated times' end, case when repeated_rows > 0 then 'repeated rows' end, case when constant_features > 0 then 'constant features' end, case when near_constant_features > 0 then 'near-constant features' end) as issues from j""")
def sequence_audit(spark, d):
    return audited(spark, d).select("sequence_id", "rows", "missing_pct", "steps_back", "repeated_times", "constant_features", "near_constant_features", "repeated_rows", "infinite_values", "issues")


@book.add(f"{views.TEL_SQL}, g as (select sequence_id, event_type in {views.S_TYPES} as is_s, event_type, satellites, count(*) - 1 as extra from tel group by all), w as (select sequence_id, coalesce(sum(extra) filter (is_s), 0) as s, coalesce(sum(extra) filter (not is_s), 0) as v from g group by 1) select sequence_id, list_filter([case when s > 0 then 'S repeated rows' end, case when v > 0 then 'V repeated rows' end], lambda x: x is not null) as warnings from w")
def repeated_warnings(spark, d):
    s, v = (x.select("sequence_id", "row_idx", "event_type", "satellites") for x in views.sides(spark, d))
    return gates.repeated_warnings(s, v)


@book.add(f"{views.TEL_SQL}, i as (select sequence_id, max(speed) as top_speed from tel group by 1) select sequence_id, {r('top_speed')} as top_speed from i where top_speed <= 128")
def passed_sequences(spark, d):
    inventory = views.tel(spark, d).groupBy("sequence_id").agg(F.max("speed").alias("top_speed"))
    return sync.filter_pass(inventory.withColumn("status", F.when(F.col("top_speed") <= 128, "PASS").otherwise("FAIL"))).select("sequence_id", "top_speed")


@book.add(f"{views.SIDES_SQL} select sequence_id, row_idx, {r('ax')} as ax, null::double as az from s_side union all select sequence_id, row_idx, null, {r('az')} from v_side")
def union_sequences(spark, d):
    s, v = views.sides(spark, d)
    return sync.union_sequences(s.select("sequence_id", "row_idx", "ax"), v.select("az", "row_idx", "sequence_id"))
