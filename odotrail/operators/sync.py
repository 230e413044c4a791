"""Pairing and synchronising the two sensor sides of a drive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filter_pass(inventory: DataFrame, sequence: str | None = None, by: str = "sequence_id") -> DataFrame:
    """Rows with status PASS (of one sequence), ordered by id."""
    out = inventory.filter(F.col("status") == "PASS")
    return (out if sequence is None else out.filter(F.col(by) == sequence)).orderBy(by)


def pair_files(s: DataFrame, v: DataFrame, by: str = "sequence_id") -> DataFrame:
    """One row a sequence of either side: has_s, has_v, status COMPLETE / MISSING_S / MISSING_V."""
    a = s.select(by).distinct().withColumn("has_s", F.lit(True))
    b = v.select(by).distinct().withColumn("has_v", F.lit(True))
    out = a.join(b, by, "full").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_s", "has_v")})
    return out.withColumn("status", F.when(~F.col("has_s"), "MISSING_S").when(~F.col("has_v"), "MISSING_V").otherwise("COMPLETE"))


def pair_files_ambiguous(files: DataFrame, by: str = "sequence_id", kind: str = "kind") -> DataFrame:
    """Files counted by kind for each sequence: COMPLETE (one of each), S_ONLY, V_ONLY, else AMBIGUOUS."""
    out = files.groupBy(by).agg(F.count_if(F.col(kind) == "S").alias("n_s"), F.count_if(F.col(kind) == "V").alias("n_v"))
    s, v = F.col("n_s"), F.col("n_v")
    return out.withColumn("status", F.when((s == 1) & (v == 1), "COMPLETE").when((s == 1) & (v == 0), "S_ONLY").when((s == 0) & (v == 1), "V_ONLY").when(s + v == 0, "NONE").otherwise("AMBIGUOUS"))


def asof_nearest(left: DataFrame, right: DataFrame, by: str = "sequence_id", on: str = "t", tolerance: float = 0.05, order: str = "row_idx", prefix: str = "V_", columns: list[str] | None = None) -> DataFrame:
    """Every left row with the right row nearest in time, if it is at most ``tolerance`` away (inclusive).

    A tie goes to the later right row; of right rows with one time the smallest ``order`` counts. Left rows
    without a time or match stay, with nulls. Adds ``time_difference`` and ``synchronization_valid``. Both sides
    are shuffled and sorted once: the neighbours come from running windows over their union. The windows run over
    stretches of a thousand tolerances, to which right rows near an edge are sent twice, so that one very long
    sequence is many tasks.
    """
    if tolerance < 0:
        raise ValueError("tolerance must not be negative")
    columns = [c for c in right.columns if c not in (by, on)] if columns is None else columns
    first = Window.partitionBy(by, on).orderBy(order)
    payload = F.struct(F.col(on).alias("__t"), *[F.col(f"`{c}`") for c in columns])
    r = right.filter(F.col(on).isNotNull()).withColumn("__n", F.row_number().over(first)).filter("__n = 1").select(by, on, payload.alias("__right"))
    stretch = (lambda c: F.floor(c / (1000.0 * tolerance)).cast("long")) if tolerance else lambda c: F.lit(0).cast("long")
    r = r.withColumn("__stretch", F.explode(F.sequence(stretch(F.col(on) - tolerance), stretch(F.col(on) + tolerance))))
    both = left.withColumns({"__left": F.lit(True), "__stretch": stretch(F.col(on))}).unionByName(r, allowMissingColumns=True)
    timed = both.filter(F.col(on).isNotNull())
    order_by = [F.col(on), F.col("__left").isNotNull()]  # right rows first, so that equal times match on the earlier side
    before = F.last("__right", ignorenulls=True).over(Window.partitionBy(by, "__stretch").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__right", ignorenulls=True).over(Window.partitionBy(by, "__stretch").orderBy(*[c.desc() for c in order_by]).rowsBetween(Window.unboundedPreceding, 0))
    timed = timed.withColumns({"__before": before, "__after": after}).filter("__left")
    back, ahead = F.col(on) - F.col("__before.__t"), F.col("__after.__t") - F.col(on)
    pick = F.when(back.isNull() | (ahead <= back), F.col("__after")).otherwise(F.col("__before"))
    timed = timed.withColumn("__pick", pick).withColumn("__d", F.abs(F.col("__pick.__t") - F.col(on)))
    timed = timed.withColumn("__pick", F.when(F.col("__d") <= tolerance, F.col("__pick")))
    untimed = both.filter(F.col(on).isNull() & F.col("__left")).withColumn("__pick", F.lit(None).cast(timed.schema["__pick"].dataType)).withColumn("__d", F.lit(None).cast("double"))
    keep = [c for c in left.columns]
    out = timed.select(*keep, "__pick", "__d").unionByName(untimed.select(*keep, "__pick", "__d"))
    matched = F.col("__pick").isNotNull()
    return out.select(*keep, F.when(matched, F.col("__d")).alias("time_difference"), matched.alias("synchronization_valid"), F.col("__pick.__t").alias(f"{prefix}{on}"), *[F.col(f"__pick.`{c}`").alias(prefix + c) for c in columns])


def rownum_align(s: DataFrame, v: DataFrame, by: str = "sequence_id", row: str = "row_idx", prefix: str = "V_") -> DataFrame:
    """Rows of equal number within a sequence; the longer side is cut off."""
    other = v.select(by, row, *[F.col(f"`{c}`").alias(prefix + c) for c in v.columns if c not in (by, row)])
    return s.join(other, [by, row])


def with_row_number(df: DataFrame, by: str = "sequence_id", order: tuple[str, ...] = ("t", "row_idx"), name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def attach_split(df: DataFrame, split: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Rows with the split of their sequence; sequences without one fall out. (Spark broadcasts the small side by its size.)"""
    return df.join(split.select(by, "split"), by)


def split_leakage(split: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Sequences that are in more than one split."""
    return split.groupBy(by).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def missing_inputs(split: DataFrame, files: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Split sequences without a file."""
    return split.join(files.select(by).distinct(), by, "left_anti")


def split_overlap(split: DataFrame, a: str, b: str, by: str = "sequence_id") -> DataFrame:
    """Sequences in both splits."""
    return split.filter(F.col("split") == a).select(by).intersect(split.filter(F.col("split") == b).select(by))


def union_sequences(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def sequence_sets(s: DataFrame, v: DataFrame, by: str = "sequence_id") -> DataFrame:
    """Every id with the set it belongs to: both, only_s or only_v."""
    a, b = s.select(by), v.select(by)
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("only_s"))).unionByName(b.subtract(a).withColumn("side", F.lit("only_v")))


def overlap(a: DataFrame, b: DataFrame, by: str = "sequence_id", on: str = "t") -> DataFrame:
    """Time ranges of both sides and the seconds they share."""
    of = lambda df, p: df.groupBy(by).agg(F.min(on).alias(f"{p}_start"), F.max(on).alias(f"{p}_end"))
    out = of(a, "s").join(of(b, "v"), by, "full")
    shared = F.least("s_end", "v_end") - F.greatest("s_start", "v_start")
    both = F.col("s_end").isNotNull() & F.col("v_end").isNotNull()
    return out.withColumn("overlap_seconds", F.when(both, F.greatest(shared, F.lit(0.0))).otherwise(0.0))


def sync_report(aligned: DataFrame, by: str = "sequence_id", on: str = "t") -> DataFrame:
    """Per sequence: rows, matches, their share and time differences, repeated times."""
    n = aligned.groupBy(by).agg(
        F.count("*").alias("rows"),
        F.count_if("synchronization_valid").alias("matched"),
        F.count_if(~F.col("synchronization_valid")).alias("unmatched"),
        F.avg("time_difference").alias("mean_difference"),
        F.percentile("time_difference", F.lit(0.5)).alias("median_difference"),
        F.max("time_difference").alias("max_difference"),
        F.min("time_difference").alias("min_difference"),
        (F.count(on) - F.count_distinct(on)).alias("repeated_times"),
    )
    return n.withColumn("match_pct", F.col("matched") * 100.0 / F.col("rows"))


def sync_total(report: DataFrame) -> DataFrame:
    """Totals over sequences; the mean difference is weighted by matches."""
    rows, matched = F.sum("rows"), F.sum("matched")
    return report.agg(F.count("*").alias("sequences"), rows.alias("rows"), matched.alias("matched"), (matched * 100.0 / rows).alias("match_pct"), (F.sum(F.col("mean_difference") * F.col("matched")) / matched).alias("mean_difference"), F.max("max_difference").alias("max_difference"))
