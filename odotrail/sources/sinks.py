"""Writing sequences and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sequences(df: DataFrame, path: str, by: str = "sequence_id", fmt: str = "parquet") -> None:
    """One folder a sequence; rows are dealt by sequence first, so that each is written by few tasks."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).format(fmt).save(path)


def without_non_finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null."""
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`") & (F.abs(F.col(f"`{c}`")) != float("inf")), F.col(f"`{c}`")) for c, t in df.dtypes if t in ("double", "float")})


def write_report(df: DataFrame, path: str) -> None:
    """A report table as CSV and as JSON, in two folders."""
    clean = without_non_finite(df)
    flat = clean.select(*[F.to_json(f"`{c}`").alias(c) if t.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, t in clean.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    clean.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/json")
