"""Road graphs: nodes, directed edges, curvature, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scalar


def edges_with_nodes(ways: DataFrame, nodes: DataFrame, preset: str = "graph") -> DataFrame:
    """Directed edges from ways (way_id, nodes, tags) and nodes (node_id, lat, lon, elevation).

    Neighbours on a way become an edge, and another one backwards unless it is one-way; pairs with an unknown
    node fall out. ``graph`` names segments way:u->v and calls slopes without elevation null; ``mobile`` names
    them way_i and way_i_rev and takes missing elevations as 0.
    """
    if preset not in ("graph", "mobile"):
        raise ValueError(f"unknown preset {preset}")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    pairs = ways.select("way_id", F.coalesce(tag("highway"), F.lit("unclassified")).alias("road_type"), scalar.one_way(tag("oneway"), preset == "mobile").alias("one_way"), scalar.parse_maxspeed(tag("maxspeed"), preset == "mobile").alias("max_speed"), tag("junction").alias("junction"), tag("name").alias("name"), F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("u"), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("v"))).alias("i", "p"))
    pairs = pairs.select("*", "p.*").drop("p")
    back = pairs.filter(~F.col("one_way")).withColumns({"u": F.col("v"), "v": F.col("u"), "reverse": F.lit(True)})
    both = pairs.withColumn("reverse", F.lit(False)).unionByName(back)
    a = nodes.select(F.col("node_id").alias("u"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("elevation").alias("e1"))
    b = nodes.select(F.col("node_id").alias("v"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("elevation").alias("e2"))
    e = both.join(a, "u").join(b, "v").withColumn("length_m", geo.haversine_m("lat1", "lon1", "lat2", "lon2"))
    name = F.concat_ws("", "way_id", F.lit(":"), "u", F.lit("->"), "v") if preset == "graph" else F.concat_ws("", "way_id", F.lit("_"), "i", F.when(F.col("reverse"), "_rev").otherwise(""))
    heights = (F.col("e1"), F.col("e2")) if preset == "graph" else (F.coalesce("e1", F.lit(0.0)), F.coalesce("e2", F.lit(0.0)))
    slope = scalar.slope_pct(*heights, F.col("length_m"))
    known = F.col("e1").isNotNull() & F.col("e2").isNotNull()
    return e.select(name.alias("segment_id"), "way_id", "u", "v", "lat1", "lon1", "lat2", "lon2", "length_m", geo.initial_bearing_deg("lat1", "lon1", "lat2", "lon2").alias("bearing"), "road_type", "one_way", "max_speed", "junction", "name", F.coalesce(slope, F.lit(0.0)).alias("slope_pct"), (known & (F.col("length_m") > 0)).alias("slope_available"))


def edge_curvature(edges: DataFrame) -> DataFrame:
    """Adds curvature_deg: the sharpest turn from an edge arriving at the start node (not from the end node) onto the edge; 0 without one."""
    arriving = edges.groupBy(F.col("v").alias("__at")).agg(F.collect_list(F.struct(F.col("u").alias("from"), "bearing")).alias("__in"))
    turns = F.transform(F.filter("__in", lambda e: e["from"] != F.col("v")), lambda e: geo.curvature_deg(e["bearing"], "bearing"))
    return edges.join(arriving, F.col("u") == F.col("__at"), "left").withColumn("curvature_deg", F.coalesce(F.array_max(turns), F.lit(0.0))).drop("__at", "__in")


def sharp_bends(edges: DataFrame, min_deg: float = 60.0) -> DataFrame:
    return edges.filter(F.col("curvature_deg") > min_deg)


def cells(lat: Column, lon: Column, size: float) -> tuple[Column, Column]:
    return F.floor(lat / size), F.floor(lon / size)


#: Rows and columns of cells in a tile.
TILE = 256


def _tile() -> list[Column]:
    return [F.floor(F.col(c) / TILE).alias(c.replace("__", "__tile_")) for c in ("__i", "__j")]


def in_tiles_of(placed: DataFrame, points: DataFrame) -> DataFrame:
    """Those of ``placed`` (edges in cells) in tiles that hold any of ``points`` (with __i and __j), before they are shuffled. A tile is some
    kilometres wide, so that there are few, however many points there are."""
    tiles = points.select(*_tile()).distinct().withColumnsRenamed({"__tile_i": "__a", "__tile_j": "__b"})
    i, j = _tile()
    return placed.join(F.broadcast(tiles), (i == F.col("__a")) & (j == F.col("__b")), "left_semi")


def nearby_edges(points: DataFrame, edges: DataFrame, radius_deg: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with every edge whose bounding box comes within ``radius_deg`` of them (both coordinates).

    Edges are entered in all grid cells that their widened box touches, points in their own: an equi-join by cell
    with each pair found once. Points in dense cells are dealt on by Spark's skew handling.
    """
    size = 2 * radius_deg
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - radius_deg) / size), F.floor((F.greatest(a, b) + radius_deg) / size))
    placed = edges.withColumn("__i", F.explode(span("lat1", "lat2"))).withColumn("__j", F.explode(span("lon1", "lon2")))
    i, j = cells(F.col(lat), F.col(lon), size)
    celled = points.withColumns({"__i": i, "__j": j})
    out = celled.join(in_tiles_of(placed, celled), ["__i", "__j"])
    near = lambda x, a, b: F.col(x).between(F.least(a, b) - radius_deg, F.greatest(a, b) + radius_deg)
    return out.filter(near(lat, "lat1", "lat2") & near(lon, "lon1", "lon2")).drop("__i", "__j")


def _narrow(lat: Column) -> Column:
    return F.greatest(F.cos(F.least(lat, F.lit(90.0)) * geo.DEGREE), F.lit(0.01))


def _cell(metres: float) -> float:
    """Height of a cell in degrees: twice the distance (no degree of latitude is shorter than 110,500 metres)."""
    return 2 * metres / 110500


def cell_of(lat: Column, lon: Column, metres: float) -> tuple[Column, Column]:
    """Row and column of a point's cell."""
    size = _cell(metres)
    i = F.floor(lat / size)
    return i, F.floor(lon / (size / _narrow(F.abs(i * size))))


def placed_edges(edges: DataFrame, metres: float) -> DataFrame:
    """Edges with __i, __j: each in every cell that its box, widened by ``metres``, touches; and __reach, that distance in degrees of longitude."""
    size, radius = _cell(metres), _cell(metres) / 2
    reach = radius / _narrow(F.greatest(F.abs("lat1"), F.abs("lat2")))
    rows = F.sequence(F.floor((F.least("lat1", "lat2") - radius) / size), F.floor((F.greatest("lat1", "lat2") + radius) / size))
    placed = edges.withColumn("__reach", reach).withColumn("__i", F.explode(rows))
    w = size / _narrow(F.abs(F.col("__i") * size))
    return placed.withColumn("__j", F.explode(F.sequence(F.floor((F.least("lon1", "lon2") - F.col("__reach")) / w), F.floor((F.greatest("lon1", "lon2") + F.col("__reach")) / w))))


def edges_within(points: DataFrame, edges: DataFrame, metres: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with every edge whose bounding box comes within ``metres`` of them (and some a little farther).

    As ``nearby_edges``, but degrees of longitude, which shrink towards the poles, are widened for each edge by the cosine of its
    own latitude (at least a hundredth: to 89.4 degrees), and cells by that of their row, so that a box is as wide as it is high.
    """
    i, j = cell_of(F.col(lat), F.col(lon), metres)
    celled = points.withColumns({"__i": i, "__j": j})
    out = celled.join(in_tiles_of(placed_edges(edges, metres), celled), ["__i", "__j"])
    near = lambda x, a, b, r: F.col(x).between(F.least(a, b) - r, F.greatest(a, b) + r)
    return out.filter(near(lat, "lat1", "lat2", _cell(metres) / 2) & near(lon, "lon1", "lon2", F.col("__reach"))).drop("__i", "__j", "__reach")


def road_cells(edges: DataFrame, metres: float, points: DataFrame | None = None) -> DataFrame:
    """__i, __j and roads: all edges of each cell of ``placed_edges`` as an array, for joins that may not multiply rows (streams). A cell's edges are
    those within a few times ``metres``. With ``points`` (a table with __i and __j) only cells in their tiles."""
    placed = placed_edges(edges, metres)
    placed = placed if points is None else in_tiles_of(placed, points)
    return placed.groupBy("__i", "__j").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in edges.columns])).alias("roads"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, in and out."""
    return edges.select(F.col("u").alias("node_id")).unionAll(edges.select(F.col("v").alias("node_id"))).groupBy("node_id").agg(F.count("*").alias("degree"))


def neighborhood_features(nodes: DataFrame, edges: DataFrame, hops: int = 1) -> DataFrame:
    """Per node: centred latitude and longitude, degree, and their means over neighbours, hop by hop (f0, f1, ...)."""
    mean = nodes.agg(F.avg("lat").alias("__lat"), F.avg("lon").alias("__lon"))
    base = nodes.join(F.broadcast(mean), F.lit(True)).join(node_degrees(edges), "node_id", "left")  # one row
    out = base.select("node_id", (F.col("lat") - F.col("__lat")).alias("dlat0"), (F.col("lon") - F.col("__lon")).alias("dlon0"), F.coalesce("degree", F.lit(0)).cast("double").alias("degree0"))
    links = edges.select(F.col("u").alias("node_id"), F.col("v").alias("other")).unionAll(edges.select(F.col("v").alias("node_id"), F.col("u").alias("other"))).distinct()
    for h in range(1, hops + 1):
        last = out.select(F.col("node_id").alias("other"), *[F.col(f"{x}{h - 1}") for x in ("dlat", "dlon", "degree")])
        around = links.join(last, "other").groupBy("node_id").agg(*[F.avg(f"{x}{h - 1}").alias(f"{x}{h}") for x in ("dlat", "dlon", "degree")])
        out = out.join(around, "node_id", "left").fillna(0.0, [f"{x}{h}" for x in ("dlat", "dlon", "degree")])
    return out
