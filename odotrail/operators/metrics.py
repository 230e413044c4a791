"""Scores, errors and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalar
from .quality import melt
from .ranks import attach_percentiles, percentiles, percentiles_of


def score_summary(scored: DataFrame, group: str = "split", score: str = "drift_score") -> DataFrame:
    """Per split: rows, detections, their share, and the scores' range, mean, median and the threshold."""
    x = F.col(score)
    out = scored.groupBy(group).agg(F.count("*").alias("rows"), F.count_if("drift_detected").alias("detected"), (F.count_if("drift_detected") * 100.0 / F.count("*")).alias("detected_pct"), F.min(x).alias("min_score"), F.max(x).alias("max_score"), F.avg(x).alias("mean_score"), F.max("threshold").alias("threshold"))
    return attach_percentiles(out, percentiles(scored, x, {"median_score": 0.5}, [group]), [group])


def sequence_drift(scored: DataFrame, by: str = "sequence_id", score: str = "drift_score") -> DataFrame:
    x = F.col(score)
    out = scored.groupBy(by).agg(F.count("*").alias("rows"), F.count_if("drift_detected").alias("detected"), F.avg(x).alias("mean_score"), F.max(x).alias("max_score"), F.median(x).alias("median_score"))
    return out.withColumn("detected_pct", F.col("detected") * 100.0 / F.col("rows")).orderBy(F.desc("detected_pct"), by)


def feature_abnormality(scored: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: means of normal and anomalous rows, normal sample deviation, and the shift in such deviations."""
    long = melt(scored, features, ["drift_detected"])
    normal, odd = F.when(~F.col("drift_detected"), F.col("value")), F.when(F.col("drift_detected"), F.col("value"))
    out = long.groupBy("feature").agg(F.avg(normal).alias("normal_mean"), F.avg(odd).alias("anomaly_mean"), F.stddev_samp(normal).alias("normal_std"), F.stddev_samp(odd).alias("anomaly_std"))
    shift = F.when(F.col("normal_std") > 1e-12, F.abs(F.col("anomaly_mean") - F.col("normal_mean")) / F.when(F.col("normal_std") > 1e-12, F.col("normal_std"))).otherwise(0.0)
    return out.withColumn("abnormality", shift).orderBy(F.desc("abnormality"), "feature")


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Rows in equal bins from the least to the greatest value (bin 1 to ``bins``; the last one holds its upper end)."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    out = df.filter(F.col(column).isNotNull()).select(column).join(F.broadcast(ends), F.lit(True))  # one row
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    b = F.least(F.floor((F.col(column) - F.col("lo")) / width * bins) + 1, F.lit(bins))
    return out.select(F.coalesce(b, F.lit(1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("rows"))


def errors(predicted: str, actual: str) -> Column:
    """Predicted minus actual, where both are finite."""
    return scalar.finite(predicted) - scalar.finite(actual)


def regression_metrics(df: DataFrame, predicted: str, actual: str, by: list[str] = (), limits: tuple[float, ...] = (), small_groups: bool = False) -> DataFrame:
    """Finite pairs, MAE, RMSE, mean, population deviation and median of the error, p95, p99 and greatest absolute error,
    and the share (per cent) of absolute errors over each limit. ``small_groups``: a group's errors fit in a task (one drive's),
    so that one pass gives the percentiles too."""
    e = df.withColumn("__e", errors(predicted, actual)).filter("__e is not null")
    a = F.abs("__e")
    over = [(F.avg((a > x).cast("double")) * 100).alias(f"over_{x:g}_pct") for x in limits]
    within = [F.median("__e").alias("median_error"), F.percentile(a, F.lit(0.95)).alias("p95_abs_error"), F.percentile(a, F.lit(0.99)).alias("p99_abs_error")] if small_groups else []
    out = e.groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("mae"), F.sqrt(F.avg(F.pow("__e", F.lit(2.0)))).alias("rmse"), F.avg("__e").alias("mean_error"), F.stddev_pop("__e").alias("std_error"), F.max(a).alias("max_abs_error"), *within, *over)
    if small_groups:
        return out
    return attach_percentiles(out, percentiles_of(e, {"median_error": (F.col("__e"), 0.5), "p95_abs_error": (a, 0.95), "p99_abs_error": (a, 0.99)}, by), by)


def large_error_rates(df: DataFrame, error: str, limits: tuple[float, ...]) -> DataFrame:
    a = F.abs(scalar.finite(error))
    return df.agg(*[(F.avg((a > x).cast("double")) * 100).alias(f"over_{x:g}_pct") for x in limits])


def baseline_compare(df: DataFrame, predicted: str, actual: str, train_median: Column, by: str = "sequence_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """MAE and RMSE of the model, of the train median and of the previous value, over rows that have all three;
    improvement: the model's gain over each, in per cent of its MAE."""
    before = F.lag(actual).over(Window.partitionBy(by).orderBy(F.asc_nulls_last(on), row))
    e = df.withColumns({"__median": train_median, "__previous": before}).select(*[errors(c, actual).alias(n) for n, c in (("model", predicted), ("median", "__median"), ("persistence", "__previous"))]).dropna()
    long = e.unpivot([], e.columns, "baseline", "error")
    out = long.groupBy("baseline").agg(F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.pow("error", F.lit(2.0)))).alias("rmse"))
    model = out.filter("baseline = 'model'").select(F.col("mae").alias("__m"))
    return out.join(F.broadcast(model), F.lit(True)).withColumn("improvement_pct", (F.col("mae") - F.col("__m")) * 100 / F.nullif(F.col("mae"), F.lit(0.0))).drop("__m")


def target_statistics(df: DataFrame, targets: list[str], by: str = "sequence_id") -> DataFrame:
    long = melt(df, targets, [by]).withColumn("value", scalar.finite("value")).filter("value is not null")
    x = F.col("value")
    q = F.percentile(x, F.array(*map(F.lit, (0.9, 0.95, 0.99))))
    out = long.groupBy(by, "feature").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("q"))
    return out.select(by, F.col("feature").alias("target"), "n", "mean", "median", "std", "min", "max", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((90, 95, 99))])


def split_target_summary(statistics: DataFrame, split: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Per split and target: sequences, valid rows, and plain means of the sequences' statistics."""
    keys = ["mean", "median", "std", "min", "max", "p90", "p95", "p99"]
    return statistics.join(split, by).groupBy("split", "target").agg(F.count("*").alias("sequences"), F.sum("n").alias("valid_rows"), *[F.avg(k).alias(f"mean_of_{k}") for k in keys])


def worst_sequences(per_sequence: DataFrame, n: int = 5, by: str = "sequence_id", metric: str = "mae") -> DataFrame:
    return per_sequence.orderBy(F.desc(metric), by).limit(n)


def top(df: DataFrame, n: int, metric: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(metric), key).limit(n)


def anomalies(scored: DataFrame, score: str = "drift_score", keys: tuple[str, ...] = ("sequence_id", "row_idx")) -> DataFrame:
    """All anomalous rows, worst first."""
    return scored.filter("drift_detected").orderBy(F.desc(score), *keys)
