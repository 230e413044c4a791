"""Exact percentiles of large groups, without a group's values in one task's memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written

#: Accuracy of the first pass: a bracket holds about a share of 4 / ACCURACY of its group's rows.
ACCURACY = 10_000


def percentiles(df: DataFrame, value: Column, wanted: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``percentiles_of`` one value."""
    return percentiles_of(df, {name: (value, p) for name, p in wanted.items()}, by)


def percentiles_of(df: DataFrame, wanted: dict[str, tuple[Column, float]], by: list[str] = ()) -> DataFrame:
    """by and one column a name of ``wanted`` (a value and a share of 0 to 1): the exact percentile, interpolated between neighbours.

    An approximate pass brackets each percentile. A second one counts the rows below and above the brackets, and the values
    within them, each value once; a window that can spill orders these. Nulls are left out; a group of nulls alone
    gives nulls, an empty table without ``by`` one row of nulls.
    """
    by, shares = list(by), [p for _, p in wanted.values()]
    x = df.select(*by, *[value.cast("double").alias(f"__v{k}") for k, (value, _) in enumerate(wanted.values())])
    ends = [[max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY)] for p in shares]
    rough = x.groupBy(*by).agg(*[c for k, e in enumerate(ends) for c in (F.count(f"__v{k}").alias(f"__n{k}"), F.approx_percentile(f"__v{k}", e, ACCURACY).alias(f"__e{k}"))])

    many, groups = range(len(shares)), [f"__by{i}" for i in range(len(by))]
    v, e = (lambda k: F.col(f"__v{k}")), (lambda k: F.col(f"__e{k}"))
    below, above = (lambda k: v(k) < e(k)[0]), (lambda k: v(k) > e(k)[1])
    joined = attach_percentiles(x, rough, by).withColumns({f"__at{k}": F.when(~below(k) & ~above(k), v(k)) for k in many})
    # rows outside all brackets are one group of counts; few values are within one
    sums = [c for k in many for c in (F.count_if(below(k)).alias(f"__b{k}"), F.max(F.when(below(k), v(k))).alias(f"__top{k}"), F.count_if(above(k)).alias(f"__a{k}"), F.min(F.when(above(k), v(k))).alias(f"__low{k}"), F.max(f"__n{k}").alias(f"__n{k}"))]
    counted = joined.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], *[f"__at{k}" for k in many]).agg(F.count("*").alias("__c"), *sums)

    def zones(k: int) -> list[Column]:
        made = lambda zone, at, c, value: F.struct(F.lit(k).alias("k"), F.lit(zone).alias("zone"), at.cast("double").alias("at"), c.alias("c"), value.cast("double").alias("v"), F.col(f"__n{k}").alias("n"))
        at, none = F.col(f"__at{k}"), F.lit(None)
        return [made(-1, none, F.col(f"__b{k}"), F.col(f"__top{k}")), made(0, at, F.when(at.isNotNull(), F.col("__c")).otherwise(F.lit(0)), at), made(1, none, F.col(f"__a{k}"), F.col(f"__low{k}")), made(2, none, F.lit(0).cast("long"), none)]

    placed = counted.select(*groups, F.explode(F.array(*[z for k in many for z in zones(k)])).alias("z")).select(*groups, "z.*").filter("c > 0 or zone = 2")
    counted = placed.groupBy(*groups, "k", "zone", "at").agg(F.sum("c").alias("c"), F.max("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("top"))
    upto = F.sum("c").over(Window.partitionBy(*groups, "k").orderBy("zone", "at").rowsBetween(Window.unboundedPreceding, 0))
    at = (F.col("n") - 1) * F.array(*map(F.lit, map(float, shares)))[F.col("k")]
    ranked = counted.withColumns({"upto": upto, "place": at, "value": F.when(F.col("zone") < 0, F.col("top")).otherwise(F.col("low"))})
    holds = lambda rank: (rank > F.col("upto") - F.col("c")) & (rank <= F.col("upto"))
    found = []
    for k in range(len(shares)):
        mine = F.col("k") == k
        found += [F.max(F.when(mine & holds(F.floor("place") + 1), F.col("value"))).alias(f"a{k}"), F.max(F.when(mine & holds(F.ceil("place") + 1), F.col("value"))).alias(f"b{k}"), F.max(F.when(mine, F.col("place") - F.floor("place"))).alias(f"f{k}")]
    hit = ranked.groupBy(*groups).agg(*found)
    between = lambda k: F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * F.col(f"f{k}")
    return hit.select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=True)], *[between(k).alias(name) for k, name in enumerate(wanted)])


def attach_percentiles(summary: DataFrame, exact: DataFrame, by: list[str] = ()) -> DataFrame:
    """``summary`` (one row a group) with the columns of ``percentiles`` of the same groups."""
    if not by:
        return summary.join(F.broadcast(exact), F.lit(True))  # one row each
    other = exact.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return summary.join(other, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by], "left").drop(*[f"__by_{c}" for c in by])


def running_counts(df: DataFrame, order: list[Column], by: list[str] = (), weight: Column | None = None) -> DataFrame:
    """``df`` with __upto: the sum of ``weight`` (1 a row) over the rows up to this one in the order of ``order``, in all or in each group of ``by``.

    Rows are dealt to partitions by ranges of their order and written with their partition's number; windows add up within partitions, and the sums of the
    partitions before come from a table of one row a partition and group. No task orders all rows of a group. Rows should differ in ``order``."""
    by, keys = list(by), [f"__k{i}" for i in range(len(order))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({**{k: c for k, c in zip(keys, order, strict=True)}, "__w": F.lit(1) if weight is None else weight})
    dealt = written(dealt.repartitionByRange(parts, *by, *keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*by, "__part").agg(F.sum("__w").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)) if by else F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))  # a row a partition
    joined = dealt.join(sums, [dealt["__part"] == sums["__p"], *[F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]])
    within = F.sum("__w").over(Window.partitionBy(*by, "__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("__upto", F.col("__before") + within).select(*[F.col(f"`{c}`") for c in df.columns], "__upto")


def weighted_medians(df: DataFrame, value: str, weight: Column, by: list[str]) -> DataFrame:
    """by and median: the median of ``value``, each as often as ``weight`` says; a value may come once in a group. Groups without any are left out."""
    counted = running_counts(df.filter(F.col(value).isNotNull()).select(*by, F.col(value), weight.cast("long").alias("__n")).filter("__n > 0"), [F.col(value)], by, F.col("__n"))
    total = counted.groupBy(*by).agg(F.max("__upto").alias("__total")).withColumnsRenamed({c: f"__t_{c}" for c in by})
    joined = counted.join(total, [F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in by])
    holds = lambda rank: (rank > F.col("__upto") - F.col("__n")) & (rank <= F.col("__upto"))
    low, high = F.floor((F.col("__total") + 1) / 2), F.ceil((F.col("__total") + 1) / 2)
    picked = joined.groupBy(*by).agg(F.max(F.when(holds(low), F.col(value))).alias("a"), F.max(F.when(holds(high), F.col(value))).alias("b"))
    return picked.select(*by, ((F.col("a") + F.col("b")) / 2).alias("median"))
