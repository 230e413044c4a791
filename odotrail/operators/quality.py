"""Data quality: missingness, repeats, ranges, statistics, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from .ranks import weighted_medians

#: Name of a count: column, rule. Fixed values.
RANGE_RULES = {
    "latitude_invalid": ("gps_latitude", lambda x: (x < -90) | (x > 90)),
    "longitude_invalid": ("gps_longitude", lambda x: (x < -180) | (x > 180)),
    "gps_speed_invalid": ("gps_speed", lambda x: (x < 0) | (x > 300)),
    "gps_accuracy_invalid": ("gps_accuracy", lambda x: (x < 0) | (x > 1000)),
    "altitude_invalid": ("gps_altitude", lambda x: (x < -1000) | (x > 10000)),
    "accelerometer_outlier": ("accel_magnitude", lambda x: x > 100),
    "gyroscope_outlier": ("gyro_yaw", lambda x: F.abs(x) > 50),
    "magnetometer_outlier": ("mag_magnitude", lambda x: x > 1000),
    "orientation_outlier": ("orientation_yaw", lambda x: F.abs(x) > 720),
}


def range_flags(df: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Per sequence, how many values break each rule (0 if there is no such column)."""
    return df.groupBy(by).agg(*[(F.count_if(rule(scalar.finite(c))) if c in df.columns else F.lit(0).cast("long")).alias(name) for name, (c, rule) in RANGE_RULES.items()])


def melt(df: DataFrame, features: list[str], keys: list[str] = ()) -> DataFrame:
    """Long form: keys, feature, value (double)."""
    return df.select(*keys, *[F.col(f"`{f}`").cast("double").alias(f) for f in features]).unpivot(list(keys), features, "feature", "value")


def shape_report(df: DataFrame) -> DataFrame:
    """Rows, columns, and each column's position and type."""
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(t).alias("dtype")) for i, (c, t) in enumerate(df.dtypes)])
    return df.agg(F.count("*").alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"), F.inline(names))


def missing_report(df: DataFrame, features: list[str], by: str | None = None) -> DataFrame:
    """Missing values and their percentage (4 digits) of each column, over all rows or per sequence."""
    keys = [by] if by else []
    counted = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{f}`").isNull()).alias(f) for f in features])
    long = counted.unpivot([*keys, "rows"], features, "feature", "missing")
    return long.select(*keys, "feature", "rows", "missing", F.round(F.col("missing") * 100.0 / F.col("rows"), 4).alias("missing_pct"))


def missing_pivot(report: DataFrame, features: list[str], by: str = "sequence_id") -> DataFrame:
    """Sequence x feature matrix of missing percentages."""
    return report.groupBy(by).pivot("feature", features).agg(F.first("missing_pct"))


def missing_buckets(report: DataFrame) -> DataFrame:
    """Features by missing percentage; a wholly missing one counts under 100 and over 25."""
    p = F.col("missing_pct")
    rules = {"none": p == 0, "to_1": (p > 0) & (p <= 1), "to_5": (p > 1) & (p <= 5), "to_10": (p > 5) & (p <= 10), "to_25": (p > 10) & (p <= 25), "over_25": p > 25, "all_missing": p >= 100}
    return report.agg(*[F.count_if(r).alias(k) for k, r in rules.items()])


def duplicate_rows(df: DataFrame, columns: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Rows with an equal: all members, and those beyond the first of each group."""
    columns = columns or df.columns
    groups = df.groupBy(*dict.fromkeys([*([by] if by else []), *columns])).agg(F.count("*").alias("n"))
    return groups.groupBy(*([by] if by else [])).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("all_members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_members"))


def duplicate_timestamps(df: DataFrame, by: str = "sequence_id", on: str = "t") -> DataFrame:
    return duplicate_rows(df.filter(F.col(on).isNotNull()).select(by, on), [on], by)


def infinite_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Columns that hold infinities, with their number."""
    counted = df.agg(*[F.count_if(F.abs(F.col(f"`{f}`").cast("double")) == float("inf")).alias(f) for f in features])
    return counted.unpivot([], features, "feature", "infinite").filter("infinite > 0")


def invalid_numeric_report(df: DataFrame, features: list[str], samples: int = 5) -> DataFrame:
    """Texts that are no numbers: how many, and the first few distinct ones in order."""
    long = df.select(*[F.col(f"`{f}`").cast("string").alias(f) for f in features]).unpivot([], features, "feature", "value")
    bad = long.filter(F.col("value").isNotNull() & F.trim("value").try_cast("double").isNull()).groupBy("feature", "value").count()
    first = Window.partitionBy("feature").orderBy("value")
    return bad.withColumn("n", F.row_number().over(first)).groupBy("feature").agg(F.sum("count").alias("invalid"), F.array_sort(F.collect_list(F.when(F.col("n") <= samples, F.col("value")))).alias("samples"))


def min_max_report(df: DataFrame, features: list[str]) -> DataFrame:
    return melt(df, features).groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"))


def latlon_validity(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.agg(F.count_if((F.col(lat) < -90) | (F.col(lat) > 90)).alias("invalid_latitude"), F.count_if((F.col(lon) < -180) | (F.col(lon) > 180)).alias("invalid_longitude"))


def sampling_info(df: DataFrame, by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Positive time steps: mean, sample deviation, least, greatest, rate; and the number of other steps."""
    d = df.select(by, (F.col(on) - F.lag(on).over(Window.partitionBy(by).orderBy(F.asc_nulls_last(on), row))).alias("d"))
    p = F.when(F.col("d") > 0, F.col("d"))
    return d.groupBy(by).agg(F.avg(p).alias("mean_step"), F.stddev_samp(p).alias("std_step"), F.min(p).alias("min_step"), F.max(p).alias("max_step"), (1 / F.avg(p)).alias("hz"), F.count_if(F.col("d") <= 0).alias("non_positive"))


def time_range(df: DataFrame, by: str = "sequence_id", on: str = "t") -> DataFrame:
    return df.groupBy(by).agg(F.min(on).alias("start"), F.max(on).alias("end"), (F.max(on) - F.min(on)).alias("duration"))


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature over all rows: counts, distinct values, constancy, moments, exact median, status, likely cause.

    Values are first counted by (feature, value), so a value that fills a column is one row of what follows.
    """
    v = F.col("value")
    ok = scalar.finite("value")
    values = melt(df, features).groupBy("feature", "value").agg(F.count("*").alias("n"))
    good = F.when(ok.isNotNull(), F.col("n")).otherwise(0)
    stats = values.groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(v.isNull() | F.isnan(v), F.col("n")).otherwise(0)).alias("missing"),
        F.sum(F.when(F.abs(v) == float("inf"), F.col("n")).otherwise(0)).alias("infinite"),
        F.sum(good).alias("finite"),
        F.count(ok).alias("distinct"),
        F.max(good).alias("dominant"),
        F.min(ok).alias("min"),
        F.max(ok).alias("max"),
        (F.sum(ok * F.col("n")) / F.nullif(F.sum(good), F.lit(0))).alias("mean"),
    )
    median = weighted_medians(values.select("feature", ok.alias("value"), "n"), "value", F.col("n"), ["feature"])
    spread = values.join(stats.select("feature", "mean", "finite"), "feature").groupBy("feature").agg(F.sqrt(F.sum(F.pow(ok - F.col("mean"), 2) * F.col("n")) / F.nullif(F.max("finite"), F.lit(0))).alias("std"))
    constant = (F.col("finite") > 0) & (F.col("distinct") <= 1)
    near = (F.col("finite") > 0) & ((F.col("dominant") >= 0.99 * F.col("finite")) | (F.col("distinct") <= F.greatest(F.lit(2), F.floor(F.col("finite") * 0.01))))
    out = stats.join(spread, "feature").join(median, "feature", "left").withColumns({"missing_pct": F.col("missing") * 100.0 / F.col("rows"), "is_constant": constant, "is_near_constant": near})
    return out.withColumns({"status": scalar.feature_status("missing_pct", "infinite", "is_constant", "is_near_constant"), "cause": F.when(F.col("missing") > 0, short_missing_reason(F.col("feature"))).otherwise("None")})


def _gyro_derived(f: Column) -> Column:
    return (f == "gyro_magnitude") | f.startswith("gyro_magnitude_") | f.isin("gyro_change", "gyro_change_rate") | f.startswith("gyro_change_")


def short_missing_reason(feature: Column) -> Column:
    """Likely cause of missing values by the feature's name."""
    return (
        F.when(_gyro_derived(feature), "gyroscope axes")
        .when((feature == "delta_time") | feature.endswith("_change") | feature.endswith("_change_rate"), "first difference or division by zero")
        .when(F.contains(feature, F.lit("rolling")), "rolling window or its source")
        .when(feature.startswith("S_") | feature.startswith("V_"), "source or unmatched row")
        .otherwise("to be inspected")
    )


def missing_reason(feature: Column, missing: Column, has_gyro_axes: Column, base_missing: Column, unmatched: Column) -> Column:
    """Likely cause by name and context, first rule first. ``base_missing``: missing values of a rolling feature's source; ``unmatched``: rows without a V side."""
    return (
        F.when(missing == 0, "None")
        .when(_gyro_derived(feature) & has_gyro_axes, "gyroscope axes")
        .when(feature.endswith("delta_time") | feature.endswith("_change") | feature.endswith("_change_rate"), "first difference")
        .when(F.contains(feature, F.lit("rolling")) & (base_missing > 0), "inherited from the rolled source")
        .when(F.contains(feature, F.lit("rolling")), "rolling window start")
        .when(feature.endswith("_rate"), "division by zero")
        .when(feature.startswith("V_") & (unmatched > 0), "unmatched row")
        .when(feature.startswith("S_") | feature.startswith("V_"), "sensor or source")
        .when(feature.isin("timestamp", "elapsed_time"), "no synchronised time")
        .otherwise("to be inspected")
    )


def missing_causes(df: DataFrame, features: list[str], valid: str = "synchronization_valid") -> DataFrame:
    """missing_report of the whole table with the likely cause of each."""
    report = missing_report(df, features)
    base = report.select(F.col("feature").alias("base"), F.col("missing").alias("base_missing"))
    unmatched = df.agg(F.count_if(~F.col(valid)).alias("unmatched")) if valid in df.columns else df.sparkSession.range(1).select(F.lit(0).alias("unmatched"))
    out = report.withColumn("base", F.regexp_replace("feature", r"_rolling_(mean|std|min|max|range)$", "")).join(base, "base", "left").join(F.broadcast(unmatched), F.lit(True))  # one row
    gyro = F.lit({"gyro_yaw", "gyro_pitch", "gyro_roll"} <= set(df.columns))
    return out.select("feature", "missing", "missing_pct", missing_reason(F.col("feature"), F.col("missing"), gyro, F.coalesce("base_missing", F.lit(0)), F.col("unmatched")).alias("cause"))


def feature_subset(report: DataFrame, names: list[str]) -> DataFrame:
    return report.filter(F.col("feature").isin(names))


def sequence_quality(df: DataFrame, features: list[str], by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """One audit row a sequence: missing share, repeats, order, constants, broken ranges, issues, status."""
    w = Window.partitionBy(by).orderBy(row)
    missing = reduce(lambda a, b: a + b, [F.col(f"`{f}`").isNull().cast("int") for f in features])
    constant = reduce(lambda a, b: a + b, [F.coalesce(F.min(f"`{f}`") == F.max(f"`{f}`"), F.lit(False)).cast("int") for f in features])
    rules = {k: (c, r) for k, (c, r) in RANGE_RULES.items() if c in df.columns}
    broken = reduce(lambda a, b: a + b, [F.count_if(r(scalar.finite(c))) for c, r in rules.values()], F.lit(0))
    out = df.withColumn("__back", F.col(on) < F.lag(on).over(w)).groupBy(by).agg(F.count("*").alias("rows"), (F.sum(missing) * 100.0 / (F.count("*") * len(features))).alias("missing_pct"), F.count_if("__back").alias("steps_back"), (F.count(on) - F.count_distinct(on)).alias("repeated_times"), constant.alias("constant_features"), broken.alias("out_of_range"))
    issue = lambda c, text: F.when(c, F.lit(text))
    issues = F.concat_ws("; ", issue(F.col("missing_pct") > 0, "missing values"), issue(F.col("steps_back") > 0, "time not in order"), issue(F.col("repeated_times") > 0, "repeated times"), issue(F.col("constant_features") > 0, "constant features"), issue(F.col("out_of_range") > 0, "out of range"))
    return out.withColumn("issues", issues).withColumn("status", F.when(F.col("issues") == "", "PASS").otherwise("WARNING"))


#: Parts of names that columns of text may have.
TEXT_COLUMN_WORDS = ("sequence_id", "date")


def sequence_audit(df: DataFrame, features: list[str], by: str = "sequence_id", on: str = "t", row: str = "row_idx", gap: str = "time_gap_flag", text_words: tuple[str, ...] = TEXT_COLUMN_WORDS) -> DataFrame:
    """``sequence_quality`` with what it leaves out: repeated_rows (equal but for ``row``, beyond the first of each group), infinite
    values, constant and near-constant features (also wholly missing ones are constant), missing_times, time_gaps (rows flagged by
    ``gap``, if there is such a column), gyro_bug (axes, but no magnitude), unexpected_text (columns of text by an unknown name).

    Values are counted by (sequence, feature, value) first, so a value that fills a drive is one row. Null sequences are one group.
    """
    base = sequence_quality(df, features, by, on, row).drop("issues", "status", "constant_features")
    v = F.col("value")
    counts = melt(df, features, [by]).groupBy(by, "feature", "value").agg(F.count("*").alias("n")).groupBy(by, "feature").agg(F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("valid"), F.max(F.when(v.isNotNull(), F.col("n"))).alias("dominant"), F.coalesce(F.sum(F.when(F.abs(v) == float("inf"), F.col("n"))), F.lit(0)).alias("infinite"))
    near = (F.col("valid") > 0) & ((F.col("dominant") >= 0.99 * F.col("valid")) | (F.col("distinct") <= F.greatest(F.lit(2), F.floor(F.col("valid") * 0.01))))
    values = counts.groupBy(by).agg(F.sum("infinite").alias("infinite_values"), F.count_if(F.col("distinct") <= 1).alias("constant_features"), F.count_if(near).alias("near_constant_features"))
    repeats = duplicate_rows(df, [c for c in df.columns if c not in (by, row)], by).select(by, F.col("extra_members").alias("repeated_rows"))
    axes = {"gyro_yaw", "gyro_pitch", "gyro_roll"} <= set(df.columns)
    bug = F.count("gyro_magnitude") == 0 if axes and "gyro_magnitude" in df.columns else F.lit(axes)
    gaps = F.count_if(gap) if gap in df.columns else F.lit(0).cast("long")
    more = df.groupBy(by).agg(F.count_if(F.col(on).isNull()).alias("missing_times"), gaps.alias("time_gaps"), bug.alias("gyro_bug"))
    out = base
    for part in (values, repeats, more):
        other = part.withColumnRenamed(by, "__by")
        out = out.join(other, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    text = [c for c, t in df.dtypes if t == "string" and not any(w in c.lower() for w in text_words)]
    rules = {"missing_pct": "missing values", "steps_back": "time not in order", "repeated_times": "repeated times", "missing_times": "missing times", "time_gaps": "time gaps", "repeated_rows": "repeated rows", "infinite_values": "infinite values", "constant_features": "constant features", "near_constant_features": "near-constant features", "out_of_range": "out of range"}
    issues = F.concat_ws("; ", *[F.when(F.col(c) > 0, F.lit(t)) for c, t in rules.items()], F.when(F.col("gyro_bug"), F.lit("gyroscope magnitude missing")), F.lit("unexpected text") if text else F.lit(None).cast("string"))
    return out.withColumns({"unexpected_text": F.lit("; ".join(text)), "issues": issues}).withColumn("status", F.when(F.col("issues") == "", "PASS").otherwise("WARNING"))


def schema_variation(columns: DataFrame, file: str = "file", column: str = "column") -> DataFrame:
    """Every column with the files that have it: common to all, or varying."""
    files = columns.agg(F.count_distinct(file).alias("files"))
    held = columns.groupBy(column).agg(F.count_distinct(file).alias("held_by"))
    return held.join(F.broadcast(files), F.lit(True)).select(column, "held_by", (F.col("held_by") == F.col("files")).alias("is_common"))  # one row


def common_features(columns: DataFrame, allowed: list[str], file: str = "sequence_id", column: str = "column") -> DataFrame:
    """Columns that every sequence has as numbers, in the order of ``allowed``."""
    order = columns.sparkSession.createDataFrame([(c, i) for i, c in enumerate(allowed)], f"{column} string, position int")
    common = schema_variation(columns.filter("is_numeric"), file, column).filter("is_common")
    return common.join(order, column).select(column, "position")


def before_after(old: DataFrame, new: DataFrame, key: str = "feature", value: str = "missing_pct") -> DataFrame:
    out = old.select(key, F.col(value).alias("before")).join(new.select(key, F.col(value).alias("after")), key, "full")
    return out.withColumn("change", F.col("after") - F.col("before"))


def audit_verdict(statistics: DataFrame, sequences: DataFrame) -> DataFrame:
    """READY, or REQUIRES CORRECTION if a feature fails, holds infinities, a sequence fails or (with ``sequence_audit``) has the
    gyroscope bug."""
    a = statistics.agg(F.count_if(F.col("status") == "FAIL").alias("failed_features"), F.sum("infinite").alias("infinite"))
    bug = [F.count_if("gyro_bug").alias("gyro_bugs")] if "gyro_bug" in sequences.columns else []
    b = sequences.agg(F.count_if(F.col("status") == "FAIL").alias("failed_sequences"), F.count_if(F.col("status") == "WARNING").alias("warned_sequences"), *bug)
    out = a.join(F.broadcast(b), F.lit(True))  # one row each
    bad = (F.col("failed_features") > 0) | (F.col("infinite") > 0) | (F.col("failed_sequences") > 0)
    if bug:
        bad = bad | (F.col("gyro_bugs") > 0)
    return out.withColumn("verdict", F.when(bad, "REQUIRES CORRECTION").otherwise("READY"))
