"""Gates: assertions as tables of (rule, violations), and the isolation of failing sequences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.headers import normalized
from .quality import duplicate_rows


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    counted = df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()])
    return counted.unpivot([], list(rules), "rule", "violations")


def _absent(df: DataFrame, columns: list[str]) -> list[tuple[str, int]]:
    return [(f"column {c}", int(c not in df.columns)) for c in columns]


def _with_absent(df: DataFrame, columns: list[str], rules: dict[str, Column]) -> DataFrame:
    out = df.sparkSession.createDataFrame(_absent(df, columns), "rule string, violations long")
    return out.unionByName(_rules(df, rules)) if rules else out


def validate_aligned(df: DataFrame) -> DataFrame:
    """Required columns, their types, and no negative or missing difference where a row is matched."""
    need = ["sequence_id", "time_difference", "synchronization_valid"]
    types = dict(df.dtypes)
    wrong = [(f"type of {c}", int(types[c] not in kinds)) for c, kinds in (("time_difference", ("double", "float")), ("synchronization_valid", ("boolean",))) if c in types]
    rules = {"negative difference": F.col("time_difference") < 0, "match without difference": F.col("synchronization_valid") & F.col("time_difference").isNull()} if set(need) <= set(df.columns) else {}
    if any(n for _, n in wrong):
        return _with_absent(df, need, {}).unionByName(df.sparkSession.createDataFrame([w for w in wrong if w[1]], "rule string, violations long"))
    return _with_absent(df, need, rules)


#: Rolling columns that engineered features must have (fixed values).
ROLLING = ["accel_magnitude_rolling_mean", "gyro_magnitude_rolling_mean"]


def validate_features(df: DataFrame, features: list[str], by: str = "sequence_id", on: str = "timestamp", row: str = "row_idx", window: int | None = None) -> DataFrame:
    """Columns present; a sequence id everywhere; time not falling in the order of ``row`` (rows without time are passed over); no
    infinities. With ``window``, the length of the rolling windows: it is at least 1, and rolling columns are there and are numbers."""
    have = [f for f in features if f in df.columns]
    infinite = reduce(lambda a, b: a | b, [F.abs(F.col(f"`{f}`").cast("double")) == float("inf") for f in have], F.lit(False))
    before = Window.partitionBy(by).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__back", F.col(on) < F.last(on, ignorenulls=True).over(before))
    rules = _with_absent(out, [by, on, *features], {"no sequence": F.col(by).isNull(), "time not in order": F.col("__back"), "infinite value": infinite})
    if window is None:
        return rules
    texts = [(f"not a number {c}", 1) for c, t in df.dtypes if "rolling" in c and t not in ("double", "float")]
    more = [*_absent(df, [c for c in ROLLING if c not in features]), ("window too short", int(window < 1)), *texts]
    return rules.unionByName(df.sparkSession.createDataFrame(more, "rule string, violations long"))


def gyro_gate(df: DataFrame) -> DataFrame:
    """The gyroscope's axes are there, and nothing derived from them is wholly missing."""
    axes = ["gyro_yaw", "gyro_pitch", "gyro_roll"]
    derived = [c for c in df.columns if c.startswith("gyro_")]
    counted = df.agg(F.count("*").alias("__n"), *[F.count(c).alias(c) for c in derived])
    empty = counted.unpivot(["__n"], derived, "rule", "n").select(F.concat(F.lit("empty "), "rule").alias("rule"), ((F.col("n") == 0) & (F.col("__n") > 0)).cast("long").alias("violations")) if derived else None
    out = df.sparkSession.createDataFrame(_absent(df, axes), "rule string, violations long")
    return out if empty is None else out.unionByName(empty)


def pipeline_gate(aligned: DataFrame, sequence, by: str = "sequence_id") -> DataFrame:
    """One row: whether the chosen sequence (the first, if it is not there) has a match."""
    first = aligned.agg(F.coalesce(F.min(F.when(F.col(by) == sequence, F.col(by))), F.min(by)).alias("gate"))
    return aligned.join(F.broadcast(first), F.col(by) == F.col("gate")).groupBy("gate").agg(F.count_if("synchronization_valid").alias("matched")).withColumn("passed", F.col("matched") > 0)


def isolate_failures(df: DataFrame, problem: Column, by: str = "sequence_id") -> tuple[DataFrame, DataFrame]:
    """(rows of sequences without a problem, one FAIL row with its problems for each other sequence)."""
    failed = df.withColumn("__p", problem).filter("__p is not null").groupBy(by).agg(F.array_sort(F.collect_set("__p")).alias("problems")).withColumn("status", F.lit("FAIL"))
    return df.join(failed.select(by), by, "left_anti"), failed


def repeated_warnings(s: DataFrame, v: DataFrame, by: str = "sequence_id", row: str = "row_idx") -> DataFrame:
    """Per sequence: warnings of rows that are equal but for their number, and of S and V columns that would have one name in the
    output (equal but for case or signs)."""
    extra = lambda df, p: duplicate_rows(df, [c for c in df.columns if c not in (by, row)], by).select(by, F.col("extra_members").alias(p))
    out = extra(s, "s").join(extra(v, "v"), by, "full")
    names = [normalized(c) for c in s.columns if c not in (by, row)], [normalized(c) for c in v.columns if c not in (by, row)]
    clash = [f"{p} repeated columns" for p, have in zip("SV", names, strict=True) if len(set(have)) < len(have)]
    rows = [F.when(F.col(p) > 0, F.lit(f"{p.upper()} repeated rows")) for p in "sv"]
    return out.select(by, F.array_compact(F.array(*rows, *map(F.lit, clash))).alias("warnings"))


def sync_warnings(s: DataFrame, v: DataFrame, by: str = "sequence_id", on: str = "t", lat: str = "lat", row: str = "row_idx") -> DataFrame:
    """Per sequence: warnings of rows without time, repeated times, bad latitudes, and no shared time."""
    of = lambda df, p: df.groupBy(by).agg(F.count_if(F.col(on).isNull()).alias(f"{p}_untimed"), (F.count(on) - F.count_distinct(on)).alias(f"{p}_repeated"), F.count_if((F.col(lat) < -90) | (F.col(lat) > 90)).alias(f"{p}_latitude"), F.min(on).alias(f"{p}_start"), F.max(on).alias(f"{p}_end"))
    out = of(s, "s").join(of(v, "v"), by, "full")
    apart = F.coalesce(F.least("s_end", "v_end") < F.greatest("s_start", "v_start"), F.lit(True))
    say = lambda c, text: F.when(c, F.lit(text))
    warnings = [say(F.col(f"{p}_{k}") > 0, f"{p.upper()} {text}") for p in "sv" for k, text in (("untimed", "rows without time"), ("repeated", "repeated times"), ("latitude", "latitude out of range"))]
    return out.select(by, F.array_compact(F.array(*warnings, say(apart, "no shared time"))).alias("warnings"))


def run_gated(gate: DataFrame, then: Callable[[], DataFrame]) -> DataFrame:
    """``then()`` if the gate's one row has passed."""
    row = gate.first()
    if not row or not row["passed"]:
        raise ValueError("the gate has not passed")
    return then()
