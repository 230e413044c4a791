"""Queries on the road graph and map matching, over the grid view of parts and the telemetry's positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, roads
from ..functions import geo, scalar
from ..sources.scratch import written
from . import views
from .book import Book, r

book = Book()

HAVERSINE = "2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"
BEARING = "(degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360"
EDGES_SQL = f"""{views.WAYS_SQL}, e0 as (select w.way_id || ':' || u::varchar || '->' || v::varchar as segment_id, w.way_id, u, v, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2, {HAVERSINE} as length_m, {BEARING} as bearing, w.road_type, w.one_way, a.p_size as sz,
  a.elevation as e1, b.elevation as e2 from directed w join road_nodes a on a.node_id = w.u join road_nodes b on b.node_id = w.v),
edges as (select *, coalesce(100 * (e2 - e1) / length_m, 0) as slope_pct, e1 is not null and e2 is not null and length_m > 0 as slope_available from e0)"""
CURVED_SQL = f"""{EDGES_SQL}, turns as (select e.segment_id, max(case when abs(p.bearing - e.bearing) % 360 <= 180 then abs(p.bearing - e.bearing) % 360 else 360 - abs(p.bearing - e.bearing) % 360 end) as c from edges e join edges p on p.v = e.u and p.u <> e.v group by 1),
curved as (select edges.*, coalesce(c, 0) as curvature_deg from edges left join turns using (segment_id))"""


def edges(spark, d, preset="graph"):
    return roads.edges_with_nodes(views.ways(spark, d), views.road_nodes(spark, d), preset)


def curved(spark, d):
    return roads.edge_curvature(edges(spark, d))


@book.add(f"{EDGES_SQL} select segment_id, u, v, {r('length_m')} as length_m, {r('bearing')} as bearing, road_type, one_way, {r('slope_pct')} as slope_pct, slope_available, max_speed from (select e.*, n.p_size::double as max_speed from edges e join road_nodes n on n.node_id = substr(e.way_id, 2)::bigint)")
def road_edges(spark, d):
    return edges(spark, d).select("segment_id", "u", "v", "length_m", "bearing", "road_type", "one_way", "slope_pct", "slope_available", "max_speed")


@book.add(f"{CURVED_SQL} select segment_id, {r('curvature_deg')} as curvature_deg from curved")
def edge_curvature(spark, d):
    return curved(spark, d).select("segment_id", "curvature_deg")


@book.add(f"{CURVED_SQL} select segment_id from curved where curvature_deg > 60")
def sharp_bends(spark, d):
    return roads.sharp_bends(curved(spark, d)).select("segment_id")


RADIUS = 30.0 / 111000 / 0.25
_T = "case when (px * bx + py * wy) / (bx * bx + wy * wy) < 0 then 0 when (px * bx + py * wy) / (bx * bx + wy * wy) > 1 then 1 else (px * bx + py * wy) / (bx * bx + wy * wy) end"
RANK = "case road_type " + " ".join(f"when '{k}' then {v}" for k, v in scalar.GRAPH_RANKS.items()) + " else 1 end"
MOBILE_RANK = "case road_type " + " ".join(f"when '{k}' then {v}" for k, v in scalar.MOBILE_RANKS.items()) + " else 0 end"


def candidates_sql(preset: str) -> str:
    """Points with edges within 30 metres, by the plain join of all nearby pairs."""
    if preset == "graph":
        plane = "(lon - lon1) * 111412.84 * cos(radians((lat1 + lat2) / 2)) as px, (lat - lat1) * (111132.92 - 559.82 * cos(2 * radians((lat1 + lat2) / 2))) as py, (lon2 - lon1) * 111412.84 * cos(radians((lat1 + lat2) / 2)) as bx, (lat2 - lat1) * (111132.92 - 559.82 * cos(2 * radians((lat1 + lat2) / 2))) as wy"
    else:
        plane = "radians(lon - lon1) * cos(radians(lat1)) * 6371000 as px, radians(lat - lat1) * 6371000 as py, radians(lon2 - lon1) * cos(radians(lat1)) * 6371000 as bx, radians(lat2 - lat1) * 6371000 as wy"
    limit, weight, rank = (120, 0.5, RANK) if preset == "graph" else (90, 1.0, MOBILE_RANK)
    return f"""{CURVED_SQL}, {views.TEL_SQL}, pairs as (select row_idx as point_id, sequence_id, t, yaw as heading, lat, lon, curved.*, {plane} from tel join curved on lat between least(lat1, lat2) - {RADIUS} and greatest(lat1, lat2) + {RADIUS} and lon between least(lon1, lon2) - {RADIUS} and greatest(lon1, lon2) + {RADIUS}),
along as (select *, {_T} as q from pairs), far as (select *, sqrt(pow(px - q * bx, 2) + pow(py - q * wy, 2)) as distance_m, case when abs(heading - bearing) % 360 <= 180 then abs(heading - bearing) % 360 else 360 - abs(heading - bearing) % 360 end as heading_diff from along),
sc as (select *, one_way and heading_diff > {limit} as violation, round(distance_m + 0.15 * heading_diff - {weight} * ({rank}) + case when one_way and heading_diff > {limit} then 50 else 0 end, 6) as score from far where distance_m <= 30),
rk as (select *, row_number() over (partition by point_id order by score, segment_id) as rank from sc)"""


def conf_sql(preset: str) -> str:
    if preset == "graph":
        return f"{candidates_sql(preset)}, kp as (select *, 1 / (1 + score - min(score) over (partition by point_id)) as w, first_value(distance_m) over (partition by point_id order by rank) > 20 as off from rk where rank <= 5), cf as (select *, case when off then case when rank = 1 then 0.4 else 0 end else round(w / sum(w) over (partition by point_id) + 1e-9, 3) end as confidence from kp)"
    return f"{candidates_sql(preset)}, kp as (select *, exp(-(score - min(score) over (partition by point_id)) / 10) as w, first_value(distance_m) over (partition by point_id order by rank) > 20 as off from rk), cf as (select *, case when off and rank = 1 then least(0.4, w / sum(w) over (partition by point_id)) else w / sum(w) over (partition by point_id) end as confidence from kp)"


def points(spark, d):
    return views.tel(spark, d).select(F.col("row_idx").alias("point_id"), "sequence_id", "row_idx", "t", "lat", "lon", F.col("yaw").alias("heading"))


def ranked(spark, d, config=matching.GRAPH):
    near = matching.match_points(points(spark, d), curved(spark, d), config)
    out = matching.rank_candidates(matching.score_candidates(near, config), config=config)
    return matching.match_confidence(out, config=config)


@book.add(f"{candidates_sql('graph')} select point_id, count(*) as n_edges from pairs group by 1")
def nearby_edges(spark, d):
    return roads.nearby_edges(points(spark, d), edges(spark, d), RADIUS).groupBy("point_id").agg(F.count("*").alias("n_edges"))


def _candidate_columns(preset: str) -> str:
    return f"{conf_sql(preset)} select point_id, segment_id, rank::int as rank, {r('distance_m')} as distance_m, {r('score')} as score, violation as one_way_violation, {r('confidence')} as confidence from cf"


@book.add(_candidate_columns("graph"))
def ranked_candidates(spark, d):
    return ranked(spark, d).select("point_id", "segment_id", "rank", "distance_m", "score", "one_way_violation", "confidence")


@book.add(_candidate_columns("mobile"))
def ranked_candidates_mobile(spark, d):
    return ranked(spark, d, matching.MOBILE).select("point_id", "segment_id", "rank", "distance_m", "score", "one_way_violation", "confidence")


@book.add(f"{conf_sql('graph')} select point_id, count(*) filter (distance_m <= 15) as close, count(*) filter (distance_m <= 15) >= 2 as is_ambiguous from cf group by 1")
def ambiguous_match(spark, d):
    return matching.ambiguous_match(ranked(spark, d))


RESULT_SQL = f"{conf_sql('graph')}, res as (select point_id, count(*) as n_candidates, max_by(segment_id, -rank) as road_segment_id, max_by(lat1, -rank) as matched_latitude, max_by(bearing, -rank) as road_heading, max_by(curvature_deg, -rank) as road_curvature, max_by(slope_pct, -rank) as road_slope, max_by(confidence, -rank) as map_confidence, max_by(violation, -rank) as one_way_violation from cf group by 1)"


def results(spark, d):
    return matching.match_result(ranked(spark, d))


@book.add(f"{RESULT_SQL} select point_id, n_candidates, road_segment_id, {r('matched_latitude')} as matched_latitude, {r('road_heading')} as road_heading, {r('road_curvature')} as road_curvature, {r('road_slope')} as road_slope, {r('map_confidence')} as map_confidence, one_way_violation from res")
def match_result(spark, d):
    out = results(spark, d)
    return out.select("point_id", F.size("candidate_roads").cast("long").alias("n_candidates"), "road_segment_id", "matched_latitude", "road_heading", "road_curvature", "road_slope", "map_confidence", "one_way_violation")


@book.add(f"{RESULT_SQL} select tel.row_idx as point_id, road_segment_id, {r('map_confidence')} as map_confidence, {r('matched_latitude')} as matched_latitude, {r('road_heading')} as road_heading, {r('road_slope')} as map_grade_pct, one_way_violation from tel left join res on res.point_id = tel.row_idx")
def best_match(spark, d):
    out = matching.best_match(points(spark, d), curved(spark, d))
    return out.select("point_id", "road_segment_id", "map_confidence", "matched_latitude", "road_heading", "map_grade_pct", "one_way_violation")


@book.add(f"""{RESULT_SQL}, o as (select tel.row_idx, sequence_id, t, road_segment_id as own, map_confidence as c, last_value(road_segment_id ignore nulls) over (partition by sequence_id order by t, tel.row_idx rows between unbounded preceding and current row) as held from tel left join res on res.point_id = tel.row_idx)
select row_idx as point_id, coalesce(own, held, '') as road_segment_id, {r('case when own is not null then c when held is not null then 0.3 else 0 end')} as map_confidence, case when own is not null then 'match' when held is not null then 'last' else 'query' end as source from o""")
def sticky_match(spark, d):
    out = matching.sticky_match(points(spark, d), results(spark, d), track="sequence_id")
    return out.select("point_id", "road_segment_id", "map_confidence", "source")


# The true segment of a point: the nearest one; ranking by score is then judged.
TRUTH_SQL = "tr as (select point_id, arg_min(segment_id, (distance_m, segment_id)) as true_segment from sc group by 1)"


def scored(spark, d):
    """Candidates with what ranking, judging and features need, written, as all of these read them."""
    near = matching.score_candidates(matching.match_points(points(spark, d), curved(spark, d)))
    return written(near.select("point_id", "segment_id", "distance_m", "heading_diff", "curvature_deg", "road_type", "score"), "candidates")


def judged(near):
    truth = near.groupBy("point_id").agg(F.min_by("segment_id", F.struct("distance_m", "segment_id")).alias("true_segment"))
    return matching.label_candidates(near, truth)


@book.add(f"{candidates_sql('graph')}, {TRUTH_SQL}, j as (select rk.point_id, min(rank) as k from rk join tr on tr.point_id = rk.point_id and true_segment = segment_id group by 1) select count(*) as points, {r('avg((k <= 1)::int)')} as top_1, {r('avg((k <= 3)::int)')} as top_3 from j")
def topk_accuracy(spark, d):
    return matching.topk_accuracy(judged(scored(spark, d)))


@book.add(f"{candidates_sql('graph')}, {TRUTH_SQL} select point_id, segment_id, (segment_id = true_segment)::int as label, {r('heading_diff / 180')} as f0, {r('curvature_deg / 180')} as f1, {r(f'({RANK}) / 6.0::double')} as f2, {r('least(distance_m, 30) / 30')} as f3 from sc join tr using (point_id)")
def candidate_features(spark, d):
    out = matching.candidate_features(judged(scored(spark, d)))
    return out.select("point_id", "segment_id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(4)])


@book.add(f"{RESULT_SQL} select count(*) as results, count(*) filter (map_confidence < 0 or map_confidence > 1) as rejected from res")
def match_contract_check(spark, d):
    return matching.match_contract_check(results(spark, d)).agg(F.count("*").alias("results"), F.count_if(F.size("problems") > 0).alias("rejected"))


@book.add(f"""{EDGES_SQL}, mean as (select avg(lat) as mlat, avg(lon) as mlon from road_nodes), deg as (select node_id, count(*) as d from (select u as node_id from edges union all select v from edges) group by 1),
base as (select n.node_id, 1000 * (lat - mlat) as a, 1000 * (lon - mlon) as b, coalesce(d, 0)::double as d from road_nodes n join mean on true left join deg using (node_id)), links as (select u as x, v as y from edges union select v, u from edges),
one as (select x as node_id, avg(a) as a, avg(b) as b, avg(d) as d from links join base on base.node_id = y group by 1)
select base.node_id, {r('base.a')} as lat0, {r('base.b')} as lon0, {r('base.d')} as degree0, {r('coalesce(one.a, 0)')} as lat1, {r('coalesce(one.b, 0)')} as lon1, {r('coalesce(one.d, 0)')} as degree1 from base left join one using (node_id)""")
def neighborhood_features(spark, d):
    out = roads.neighborhood_features(views.road_nodes(spark, d), edges(spark, d))
    return out.select("node_id", *[e for h in "01" for e in ((F.col(f"dlat{h}") * 1000).alias(f"lat{h}"), (F.col(f"dlon{h}") * 1000).alias(f"lon{h}"), F.col(f"degree{h}"))])


@book.add(f"""{candidates_sql('mobile')}, nt as (select *, {_T} as along from pairs), dd as (select *, sqrt(pow(px - along * bx, 2) + pow(py - along * wy, 2)) as away from nt)
select point_id, way_id || '_0' || case when u > v then '_rev' else '' end as segment_id, {r('lat1 + degrees(along * wy / 6371000)')} as lat, {r('lon1 + degrees(along * bx / (6371000 * cos(radians(lat1))))')} as lon from dd where away <= 30""")
def snapped_points(spark, d):
    near = matching.match_points(points(spark, d), edges(spark, d, "mobile"), matching.MOBILE)
    return near.select("point_id", "segment_id", geo.snap_to_segment("lat", "lon", "lat1", "lon1", "lat2", "lon2").alias("s")).select("point_id", "segment_id", "s.lat", "s.lon")
