"""Deterministic telemetry views of the test tables, in Spark and in DuckDB SQL.

Integer arithmetic only, so that both dialects give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEL_COLUMNS = [
    ("user_id", "sequence_id"),
    ("event_id", "row_idx"),
    ("event_type", "event_type"),
    ("case when event_id % 11 = 0 then null else value end", "ax"),
    ("cast((event_id * 37) % 101 as double)", "ay"),
    ("cast((event_id * 53) % 89 as double)", "az"),
    ("cast((event_id * 67) % 360 as double)", "yaw"),
    ("cast((event_id * 41) % 180 as double) - 90", "pitch"),
    ("cast((event_id * 29) % 360 as double) - 180", "roll"),
    ("cast((event_id * 17) % 7 as double) / 4", "gx"),
    ("cast((event_id * 19) % 5 as double) / 4", "gy"),
    ("cast((event_id * 23) % 9 as double) / 8", "gz"),
    ("cast((event_id * 31) % 61 as double)", "mx"),
    ("cast((event_id * 43) % 67 as double)", "my"),
    ("cast((event_id * 47) % 71 as double)", "mz"),
    ("cast((event_id * 59) % 130 as double)", "speed"),
    ("cast((event_id * 61) % 70 as double)", "accuracy"),
    ("(event_id * 7) % 13", "satellites"),
    ("cast(12.9 as double) + cast((event_id * 7919) % 10000 as double) / 100000", "lat"),
    ("cast(77.5 as double) + cast((event_id * 104729) % 10000 as double) / 100000", "lon"),
]
S_TYPES, V_TYPES = "('click', 'view', 'error')", "('purchase', 'signup')"

TEL_SQL = "tel as (select epoch_us(ts)::double / 1000000 as t, " + ", ".join(f"{e} as {n}" for e, n in TEL_COLUMNS) + " from events)"
SIDES_SQL = f"{TEL_SQL}, s_side as (select * from tel where event_type in {S_TYPES}), v_side as (select * from tel where event_type in {V_TYPES})"


def tel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry: one drive a user, one sample an event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0
    return events.select(t.alias("t"), *[F.expr(e).alias(n) for e, n in TEL_COLUMNS])


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The phone's and the vehicle's samples."""
    every = tel(spark, sf_dir)
    return every.filter(f"event_type in {S_TYPES}"), every.filter(f"event_type in {V_TYPES}")


ROAD_TYPES = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "unclassified", "service", "track"]
_TYPE_SQL = "case p_size % 9 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(ROAD_TYPES)) + " end"
NODES = [("p_partkey", "node_id"), ("cast(12.9 as double) + floor(p_partkey / 50.0) * cast(0.001 as double)", "lat"), ("cast(77.5 as double) + cast(p_partkey % 50 as double) * cast(0.001 as double)", "lon"), ("case when p_partkey % 4 = 0 then null else p_retailprice end", "elevation"), ("p_size", "p_size"), (_TYPE_SQL, "road_type")]
NODES_SQL = "road_nodes as (select " + ", ".join(f"{e} as {n}" for e, n in NODES) + " from part)"
#: Ways of two nodes: along a row and up a column of the grid; both ways unless one-way.
WAYS_SQL = NODES_SQL + """, ways as (
  select node_id as u, node_id + 1 as v, 'r' as way, road_type, p_size % 5 = 0 as one_way from road_nodes where node_id % 50 < 49
  union all select node_id, node_id + 50, 'c', road_type, p_size % 5 = 0 from road_nodes),
directed as (select way || cast(u as varchar) as way_id, u, v, road_type, one_way from ways union all select way || cast(u as varchar), v, u, road_type, one_way from ways where not one_way)"""


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(*[F.expr(e).alias(n) for e, n in NODES])


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way_id, nodes (array of ids), tags (map)."""
    nodes = road_nodes(spark, sf_dir)
    tags = F.create_map(F.lit("highway"), F.col("road_type"), F.lit("oneway"), F.when(F.col("p_size") % 5 == 0, "yes").otherwise("no"), F.lit("maxspeed"), F.concat(F.col("p_size").cast("string"), F.lit(" mph")))
    row = nodes.filter("node_id % 50 < 49").select(F.concat(F.lit("r"), F.col("node_id").cast("string")).alias("way_id"), F.array(F.col("node_id"), F.col("node_id") + 1).alias("nodes"), tags.alias("tags"))
    column = nodes.select(F.concat(F.lit("c"), F.col("node_id").cast("string")).alias("way_id"), F.array(F.col("node_id"), F.col("node_id") + 50).alias("nodes"), tags.alias("tags"))
    return row.unionByName(column)
