"""Map matching: candidates, scores, confidences, results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, scalar
from . import roads


@dataclass(frozen=True)
class MatchConfig:
    """Constants of a matcher. preset: rank table and distance; ``keep``: candidates kept (None: all)."""

    preset: str = "graph"
    max_distance: float = 30.0
    off_road: float = 20.0
    heading_weight: float = 0.15
    rank_weight: float = 0.5
    one_way_limit: float = 120.0
    one_way_penalty: float = 50.0
    keep: int | None = 5


GRAPH = MatchConfig()
MOBILE = MatchConfig("mobile", rank_weight=1.0, one_way_limit=90.0, keep=None)


def match_points(points: DataFrame, edges: DataFrame, config: MatchConfig = GRAPH, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Candidates: points with every edge at most ``max_distance`` metres away (up to 89.4 degrees of latitude)."""
    method = "ellipsoid" if config.preset == "graph" else "equirectangular"
    near = roads.edges_within(points, edges, config.max_distance, lat, lon)
    return near.withColumn("distance_m", geo.point_to_segment_m(lat, lon, "lat1", "lon1", "lat2", "lon2", method)).filter(F.col("distance_m") <= config.max_distance)


def score_candidates(candidates: DataFrame, config: MatchConfig = GRAPH, heading: str = "heading") -> DataFrame:
    """Adds heading_diff, one_way_violation and score (lower is better)."""
    diff = geo.angular_diff_deg(heading, "bearing")
    out = candidates.withColumn("heading_diff", diff).withColumn("one_way_violation", F.col("one_way") & (F.col("heading_diff") > config.one_way_limit))
    score = F.col("distance_m") + config.heading_weight * F.col("heading_diff") - config.rank_weight * scalar.road_rank("road_type", config.preset) + F.when(F.col("one_way_violation"), config.one_way_penalty).otherwise(0.0)
    return out.withColumn("score", F.round(score, 6))  # so that equal candidates tie whatever the last bits


def rank_candidates(scored: DataFrame, point: str = "point_id", config: MatchConfig = GRAPH) -> DataFrame:
    """Adds rank (ties by segment) and keeps the best ones."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(point).orderBy("score", "segment_id")))
    return out if config.keep is None else out.filter(F.col("rank") <= config.keep)


def match_confidence(ranked: DataFrame, point: str = "point_id", config: MatchConfig = GRAPH) -> DataFrame:
    """Adds confidence. ``graph``: 1 / (1 + excess score), normalised, 3 digits; off the road 0.4 for the best and 0
    for others. ``mobile``: exp(-excess / 10), normalised; off the road the best has at most 0.4."""
    every = Window.partitionBy(point)
    first = every.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    excess = F.col("score") - F.min("score").over(every)
    off = F.first("distance_m").over(first) > config.off_road
    out = ranked.withColumns({"__w": 1 / (1 + excess) if config.preset == "graph" else F.exp(-excess / 10), "__off": off})
    share = F.col("__w") / F.sum("__w").over(every)
    if config.preset == "graph":
        c = F.when(F.col("__off"), F.when(F.col("rank") == 1, 0.4).otherwise(0.0)).otherwise(F.round(share + 1e-9, 3))
    else:
        c = F.when(F.col("__off") & (F.col("rank") == 1), F.least(share, F.lit(0.4))).otherwise(share)
    return out.withColumn("confidence", c).drop("__w", "__off")


def ambiguous_match(ranked: DataFrame, point: str = "point_id", within: float = 15.0) -> DataFrame:
    """Points with at least two kept candidates within ``within`` metres."""
    return ranked.groupBy(point).agg(F.count_if(F.col("distance_m") <= within).alias("close")).withColumn("is_ambiguous", F.col("close") >= 2)


def match_result(ranked: DataFrame, point: str = "point_id", config: MatchConfig = GRAPH, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row a point: the best match and all kept candidates as an array, by rank. The reference point is the
    edge's start (``graph``) or the nearest point on it (``mobile``)."""
    at = F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")) if config.preset == "graph" else geo.snap_to_segment(lat, lon, "lat1", "lon1", "lat2", "lon2")
    one = ranked.withColumn("__at", at).select(point, F.struct("rank", "segment_id", F.col("confidence").alias("score"), F.col("__at.lat").alias("lat"), F.col("__at.lon").alias("lon"), F.col("bearing").alias("heading"), F.col("curvature_deg").alias("curvature"), F.col("slope_pct").alias("slope"), "slope_available", "one_way_violation").alias("c"))
    out = one.groupBy(point).agg(F.array_sort(F.collect_list("c")).alias("cs")).withColumn("b", F.col("cs")[0])
    fields = ["segment_id", "score", "lat", "lon", "heading", "curvature", "slope"]
    candidates = F.transform("cs", lambda c: F.struct(*[c[f].alias(f) for f in fields]))
    return out.select(point, F.col("b.lat").alias("matched_latitude"), F.col("b.lon").alias("matched_longitude"), F.col("b.segment_id").alias("road_segment_id"), F.col("b.heading").alias("road_heading"), F.col("b.curvature").alias("road_curvature"), F.col("b.slope").alias("road_slope"), F.col("b.score").alias("map_confidence"), candidates.alias("candidate_roads"), F.col("b.slope_available").alias("road_slope_available"), F.col("b.one_way_violation").alias("one_way_violation"))


def match(points: DataFrame, edges: DataFrame, config: MatchConfig = GRAPH, point: str = "point_id", heading: str = "heading") -> DataFrame:
    """Points (point, lat, lon, heading) matched to edges: ``match_result`` for those with a candidate."""
    ranked = rank_candidates(score_candidates(match_points(points, edges, config), config, heading), point, config)
    return match_result(match_confidence(ranked, point, config), point, config)


#: What ``best_match`` adds.
BEST = ("road_segment_id", "map_confidence", "map_distance_m", "matched_latitude", "matched_longitude", "road_heading", "road_curvature", "map_grade_pct", "one_way_violation")


def best_match(points: DataFrame, edges: DataFrame, config: MatchConfig = GRAPH, lat: str = "lat", lon: str = "lon", heading: str = "heading") -> DataFrame:
    """Every row of ``points``, a table or a stream, with ``BEST``: the best match of ``match`` (nulls where there is none). Rows meet their cell's
    edges as one array, so that this is one join without an aggregation. Edges need curvature_deg and slope_pct."""
    i, j = roads.cell_of(F.col(lat), F.col(lon), config.max_distance)
    celled = points.withColumns({"__i": i, "__j": j})
    used = edges.select("segment_id", "road_type", "one_way", "lat1", "lon1", "lat2", "lon2", "bearing", "curvature_deg", "slope_pct")
    cells = roads.road_cells(used, config.max_distance, None if points.isStreaming else celled)
    joined = celled.join(cells.withColumnRenamed("roads", "__roads"), ["__i", "__j"], "left")
    method = "ellipsoid" if config.preset == "graph" else "equirectangular"

    def rated(e: Column) -> Column:
        away = geo.point_to_segment_m(lat, lon, e["lat1"], e["lon1"], e["lat2"], e["lon2"], method)
        diff = geo.angular_diff_deg(heading, e["bearing"])
        wrong = e["one_way"] & (diff > config.one_way_limit)
        score = away + config.heading_weight * diff - config.rank_weight * scalar.road_rank(e["road_type"], config.preset) + F.when(wrong, config.one_way_penalty).otherwise(0.0)
        return F.struct(F.round(score, 6).alias("score"), e["segment_id"].alias("segment_id"), away.alias("away"), wrong.alias("wrong"), *[e[c].alias(c) for c in ("lat1", "lon1", "lat2", "lon2", "bearing", "curvature_deg", "slope_pct")])

    found = F.array_sort(F.filter(F.transform("__roads", rated), lambda c: c["away"] <= config.max_distance))
    found = found if config.keep is None else F.slice(found, 1, config.keep)
    out = joined.withColumn("__found", found).withColumn("__best", F.try_element_at("__found", F.lit(1)))
    best = F.col("__best")
    weight = (lambda c: 1 / (1 + c["score"] - best["score"])) if config.preset == "graph" else (lambda c: F.exp(-(c["score"] - best["score"]) / 10))
    share = 1 / F.aggregate(F.transform("__found", weight), F.lit(0.0), lambda a, x: a + x)
    off = best["away"] > config.off_road
    confidence = F.when(off, 0.4).otherwise(F.round(share + 1e-9, 3)) if config.preset == "graph" else F.when(off, F.least(share, F.lit(0.4))).otherwise(share)
    at = F.struct(best["lat1"].alias("lat"), best["lon1"].alias("lon")) if config.preset == "graph" else geo.snap_to_segment(lat, lon, best["lat1"], best["lon1"], best["lat2"], best["lon2"])
    values = (best["segment_id"], F.when(best.isNotNull(), confidence), best["away"], F.when(best.isNotNull(), at["lat"]), F.when(best.isNotNull(), at["lon"]), best["bearing"], best["curvature_deg"], best["slope_pct"], best["wrong"])
    return out.select(*[F.col(f"`{c}`") for c in points.columns if c not in BEST], *[v.alias(n) for n, v in zip(BEST, values, strict=True)])


def sticky_match(points: DataFrame, results: DataFrame, point: str = "point_id", track: str = "track_id", on: str = "t", row: str = "row_idx") -> DataFrame:
    """Every point's match: its own; else the track's last one with confidence 0.3 and no candidates; else its own position with confidence 0."""
    fields = [c for c in results.columns if c != point]
    joined = points.join(results.select(point, F.struct(*fields).alias("own")), point, "left")
    last = F.last("own", ignorenulls=True).over(Window.partitionBy(track).orderBy(on, row).rowsBetween(Window.unboundedPreceding, 0))
    out = joined.withColumn("last", last)
    use = lambda f: F.coalesce(F.col(f"own.{f}"), F.col(f"last.{f}"))
    found, held = F.col("own").isNotNull(), F.col("last").isNotNull()
    columns = {f: use(f) for f in fields} | {
        "matched_latitude": F.coalesce(use("matched_latitude"), "lat"),
        "matched_longitude": F.coalesce(use("matched_longitude"), "lon"),
        "road_segment_id": F.coalesce(use("road_segment_id"), F.lit("")),
        "map_confidence": F.when(found, F.col("own.map_confidence")).when(held, 0.3).otherwise(0.0),
        "candidate_roads": F.when(found, F.col("own.candidate_roads")),
        "source": F.when(found, "match").when(held, "last").otherwise("query"),
    }
    return out.select(point, track, on, row, *[c.alias(k) for k, c in columns.items()])


def label_candidates(candidates: DataFrame, truth: DataFrame, point: str = "point_id") -> DataFrame:
    """Adds label: 1 for the candidate on the true segment."""
    out = candidates.join(truth.select(point, "true_segment"), point, "left")
    return out.withColumn("label", F.coalesce((F.col("segment_id") == F.col("true_segment")).cast("int"), F.lit(0)))


def topk_accuracy(labelled: DataFrame, score: str = "score", ks: tuple[int, ...] = (1, 3), point: str = "point_id", descending: bool = False) -> DataFrame:
    """Share of points whose true candidate is among the first k; points without one are left out."""
    order = F.desc(score) if descending else F.asc(score)
    ranked = labelled.withColumn("__r", F.row_number().over(Window.partitionBy(point).orderBy(order, "segment_id")))
    at = ranked.filter("label = 1").groupBy(point).agg(F.min("__r").alias("r"))
    return at.agg(F.count("*").alias("points"), *[F.avg((F.col("r") <= k).cast("double")).alias(f"top_{k}") for k in ks])


def candidate_features(candidates: DataFrame, preset: str = "graph") -> DataFrame:
    """Adds features: heading difference, curvature, rank and distance, each brought to about 0 to 1."""
    return candidates.withColumn("features", F.array(F.col("heading_diff") / 180, F.col("curvature_deg") / 180, scalar.road_rank("road_type", preset) / 6, F.least("distance_m", F.lit(30.0)) / 30))


#: Fields a match must have, and ranges it must keep to.
REQUIRED = ["matched_latitude", "matched_longitude", "road_segment_id", "road_heading", "road_curvature", "road_slope", "map_confidence"]


def match_contract_check(results: DataFrame) -> DataFrame:
    """Adds ``problems``: what is wrong with each match (none: it is good); fills in the defaults of the optional flags."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"Missing {c}")) for c in REQUIRED]
    ranges = [F.when(~F.col("matched_latitude").between(-90, 90), F.lit("Invalid latitude")), F.when(~F.col("matched_longitude").between(-180, 180), F.lit("Invalid longitude")), F.when(~F.col("map_confidence").between(0, 1), F.lit("Confidence out of range"))]
    whole = F.coalesce(F.forall("candidate_roads", lambda c: c["segment_id"].isNotNull() & c["score"].isNotNull() & c["lat"].isNotNull() & c["lon"].isNotNull() & c["heading"].isNotNull() & c["curvature"].isNotNull() & c["slope"].isNotNull()), F.lit(True))
    out = results.withColumn("problems", F.array_compact(F.array(*missing, *ranges, F.when(~whole, F.lit("Candidate misses a field")))))
    return out.withColumns({"road_slope_available": F.coalesce("road_slope_available", F.lit(True)), "one_way_violation": F.coalesce("one_way_violation", F.lit(False))})
