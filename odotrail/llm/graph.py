"""Connected components of a table of links, by alternating large-star and small-star rounds.

(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.) Links stay in Spark; each round's
links are written to the shared folder, which cuts the lineage.

Cases: a link with a null end, or of a node to itself, says nothing and is left out, so its nodes are only in the
result if another link holds them. Repeated links count once. Without links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Links that one task of a round writes.
TASK_LINKS = 500_000
#: At most this many keys are held by so many rows each that they are joined by broadcast.
HOT_KEYS = 10_000


def hot_limit(rows: int) -> int:
    """More rows than this make a key hot. Of ``rows`` rows, no more than ``HOT_KEYS`` keys can have as many."""
    return max(64, -(-rows // HOT_KEYS))


def join_counted(rows: DataFrame, counted: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` joined with ``counted``: one row a ``key`` and ``n``, the number of the key's rows. Keys of more than ``limit``
    rows, of which ``hot_limit`` bounds the number (``HOT_KEYS``), are joined by broadcast, so that no task gets all rows of one."""
    hot = [r[0] for r in counted.filter(F.col("n") > limit).select(key).collect()]
    counted = counted.drop("n")
    if not hot:
        return rows.join(counted, key)
    is_hot = F.col(key).isin(hot)
    return rows.filter(is_hot).join(F.broadcast(counted.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(counted.filter(~is_hot), key))


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """links: columns a, b of any one orderable type. -> node, component (the smallest node of it), for all nodes of links between two different nodes."""
    down = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    count = down.count()
    tasks, limit = 8 + count // TASK_LINKS, hot_limit(2 * count)  # rounds never add links; few links make few files
    state = None
    for _ in range(max_rounds):
        both = down.select("u", "v").union(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both.filter("v > u"), least, "u", limit).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        large = materialize(large.coalesce(tasks), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", limit).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        small = materialize(small.coalesce(tasks), "small-star")
        discard(large)
        discard(down)
        down, before = small, state
        state = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).union(down.select("v", "v").distinct())
