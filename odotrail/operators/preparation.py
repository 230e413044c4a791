"""Splits, samples and train-only preprocessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .ranks import percentiles, running_counts


def split_counts(n: int, train: float = 0.7, validation: float = 0.15) -> tuple[int, int]:
    """Sequences in TRAIN and VALIDATION (the rest is TEST), rounded half to even."""
    a, b = round(n * train), round(n * validation)
    if a + b >= n:
        b = max(1, n - a - 1)
    return a, b


def split_sequences(ids: DataFrame, rank_by: Column | None = None, seed: int = 42, by: str = "sequence_id", train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Whole sequences to train, validation or test, by the order of a hash (or of ``rank_by``)."""
    one = ids.select(by).distinct()
    a, b = split_counts(one.count(), train, validation)
    key = F.xxhash64(by, F.lit(seed)) if rank_by is None else rank_by
    ranked = running_counts(one, [key, F.col(by)])
    return ranked.select(by, F.when(F.col("__upto") <= a, "train").when(F.col("__upto") <= a + b, "validation").otherwise("test").alias("split"))


def split_summary(df: DataFrame, by: str = "sequence_id") -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(by).alias("sequences"))


def capped_sample(df: DataFrame, n: int, seed: int = 42, keys: tuple[str, ...] = ("sequence_id", "row_idx")) -> DataFrame:
    """A repeatable sample of ``n`` rows: those with the smallest hashes (a sampling operator)."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def fit_preprocess(train: DataFrame, features: list[str]) -> DataFrame:
    """Per feature: exact median, and mean and population deviation after filling with it (a deviation under 1e-8 is 1)."""
    long = train.select(*[scalar.finite(f"`{f}`").alias(f) for f in features]).unpivot([], features, "feature", "value")
    median = percentiles(long, F.col("value"), {"median": 0.5}, ["feature"]).fillna(0.0, ["median"])
    filled = F.coalesce("value", "median")
    out = long.join(median, "feature").groupBy("feature").agg(F.max("median").alias("median"), F.avg(filled).alias("mean"), F.stddev_pop(filled).alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-8, 1.0).otherwise(F.col("std")))


def apply_preprocess(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """Features filled and standardised. The parameters are one row a feature, and so a small table."""
    p = {r["feature"]: r for r in params.collect()}
    return df.withColumns({f: scalar.standardize(scalar.finite(f"`{f}`"), *[F.lit(p[f][k]) for k in ("median", "mean", "std")]) for f in features})


def feature_check(splits: dict[str, DataFrame], features: list[str]) -> DataFrame:
    """Per split: features it lacks, and values that are null or not finite."""
    out = None
    for name, df in splits.items():
        have = [f for f in features if f in df.columns]
        bad = df.agg(*[F.count_if(scalar.finite(f"`{f}`").isNull()).alias(f) for f in have]).unpivot([], have, "feature", "bad")
        one = bad.agg(F.sum("bad").alias("bad_values")).select(F.lit(name).alias("split"), F.lit(len(features) - len(have)).alias("missing_features"), "bad_values")
        out = one if out is None else out.unionByName(one)
    return out


def representative_sequences(ids: DataFrame, by: str = "sequence_id") -> DataFrame:
    """The first, the middle and the last sequence."""
    one = ids.select(by).distinct()
    n = one.count()
    return running_counts(one, [F.col(by)]).filter(F.col("__upto").isin(1, n // 2 + 1, n)).select(by)
