"""The navigation cycle in parts, matches by cell, ranks without one task, and samples by skips."""

import numpy as np
from pyspark.sql import functions as F

from odotrail.operators import fusion, isolation, matching, preparation, quality, ranks
from odotrail.streaming import cycle

from .test_operators import road
from .test_streaming import run, source
from .test_tracks import SENSORS, drives


def roads_of(spark):
    return road(spark).withColumn("slope_pct", F.coalesce("slope_pct", F.lit(2.5)))


def near_roads(spark, seed=31):
    """Drives whose positions lie about the test roads, some of them missing or far off."""
    r = np.random.default_rng(seed)
    df = spark.createDataFrame(drives(0.05, seed=seed), SENSORS).drop("gnss_weight", "grade_pct")
    return df.withColumns({"lat": F.when(F.col("lat").isNotNull(), 13.0 + (F.pmod(F.xxhash64("track_id", "row_idx"), F.lit(1200)) - 100) / 1e6 + float(r.uniform(0, 1e-6))), "lon": F.when(F.col("row_idx") % 9 != 0, 77.0 + (F.pmod(F.xxhash64("row_idx"), F.lit(500)) - 100) / 1e6)})


def test_best_match_equals_match(spark):
    points = near_roads(spark).withColumn("point_id", F.struct("track_id", "row_idx"))
    for config in (matching.GRAPH, matching.MOBILE):
        got = {r.point_id: r for r in matching.best_match(points, roads_of(spark), config).collect()}
        want = {r.point_id: r for r in matching.match(points.filter("lat is not null and lon is not null"), roads_of(spark), config).collect()}
        assert len(got) == points.count() and 20 < len(want) < len(got)
        for k, r in got.items():
            w = want.get(k)
            if w is None:
                assert r.road_segment_id is None and r.map_confidence is None and r.matched_latitude is None
            else:
                a = (r.matched_latitude, r.matched_longitude, r.road_heading, r.road_curvature, r.map_grade_pct, r.map_confidence)
                b = (w.matched_latitude, w.matched_longitude, w.road_heading, w.road_curvature, w.road_slope, w.map_confidence)
                assert r.road_segment_id == w.road_segment_id and r.one_way_violation == w.one_way_violation
                np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-9)


def test_cycle_of_a_stream_equals_a_table(spark, tmp_path):
    df, edges = near_roads(spark), roads_of(spark)
    parts = cycle.road_matcher(edges), cycle.constant_drift(12.0, 0.5)
    want = cycle.navigation_cycle(lambda: df, *parts).orderBy("track_id", "row_idx").collect()
    stream = source(spark, df, str(tmp_path / "in"))
    got = run(spark, cycle.navigation_cycle(stream, *parts), tmp_path, "cycle").orderBy("track_id", "row_idx").collect()
    assert got == want and {r.drift_state for r in want} == {"WARNING"} and abs(want[0].ai_weight - 1 / 2.2) < 1e-12
    plain = {(r.track_id, r.row_idx): r for r in fusion.fusion_pipeline(df).collect()}
    assert any(r.ins_speed != plain[r.track_id, r.row_idx].ins_speed for r in want)  # the grade enters the inertial step
    own = cycle.navigation_cycle(df, lambda s: s.withColumn("map_grade_pct", F.lit(None).cast("double")), lambda s: s.withColumn("predicted_position_error_m", F.when(F.col("row_idx") > 3, 25.0))).collect()
    assert all(r.ins_speed == plain[r.track_id, r.row_idx].ins_speed for r in own)
    assert all((r.ai_weight == 1.0 and r.drift_state is None and not r.drift_detected) if r.row_idx <= 3 else r.drift_detected for r in own)


def test_running_counts_and_weighted_medians(spark):
    r = np.random.default_rng(1)
    rows = [(g, float(v), int(w)) for g in ("a", "b", None) for v, w in zip(r.permutation(200), r.integers(1, 9, 200), strict=True)] + [("c", 5.0, 3), ("d", None, 2), ("e", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {(x.g, x.v): x["__upto"] for x in ranks.running_counts(df.filter("v is not null"), [F.col("v")], ["g"], F.col("w")).collect()}
    for g in ("a", "b", None, "c"):
        mine = sorted((v, w) for k, v, w in rows if k == g)
        assert [got[g, v] for v, _ in mine] == np.cumsum([w for _, w in mine]).tolist()
    medians = {x.g: x.median for x in ranks.weighted_medians(df, "v", F.col("w"), ["g"]).collect()}
    assert medians == {g: float(np.median(np.repeat([v for k, v, _ in rows if k == g], [w for k, _, w in rows if k == g]))) for g in ("a", "b", None, "c")}
    everything = ranks.running_counts(spark.range(1000), [F.col("id")]).collect()
    assert all(x["__upto"] == x.id + 1 for x in everything)


def test_no_window_over_everything(spark):
    ids = spark.range(100).select(F.col("id").cast("string").alias("sequence_id"))
    got = preparation.split_sequences(ids).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 70, "validation": 15, "test": 15}
    assert sorted(r[0] for r in preparation.representative_sequences(ids).collect()) == sorted(["0", sorted(map(str, range(100)))[50], "99"])
    stats = quality.feature_statistics(spark.createDataFrame([(1.0, None), (3.0, float("inf")), (3.0, None), (10.0, None)], "x double, y double"), ["x", "y"]).collect()
    assert {r.feature: r.median for r in stats} == {"x": 3.0, "y": None}


def test_samples_by_skips(spark):
    df = spark.range(30_000).select((F.col("id") % 7).cast("string").alias("sequence_id"), F.col("id").alias("row_idx"), F.col("id").cast("double").alias("x"))
    forest = isolation.isolation_forest_fit(df, ["x"], trees=200, psi=64)
    sizes = [r["size"] for r in forest.filter("node = 0").collect()]
    assert sizes == [64] * 200
    nodes = lambda f: sorted(tuple(r) for r in f.collect())
    assert nodes(forest) == nodes(isolation.isolation_forest_fit(df.repartition(7), ["x"], trees=200, psi=64))
    cuts = np.array([r.cut for r in forest.filter("node = 0").collect()])
    assert 10_000 < cuts.mean() < 20_000 and len(set(cuts)) > 190
    few = isolation.isolation_forest_fit(df.limit(20), ["x"], trees=5)
    assert [r["size"] for r in few.filter("node = 0").collect()] == [20] * 5
    assert isolation.isolation_forest_fit(df.limit(0), ["x"], trees=5).collect() == []
