"""Small cases with known results."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from odotrail.functions import geo, headers, scalar
from odotrail.operators import features, fusion, gates, isolation, labels, matching, preparation, quality, roads, sync


def test_headers():
    assert headers.clean_headers(["﻿ A ", "Â°C"]) == ["A", "°C"]
    assert headers.unique_headers(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    columns = ["S_GRAVITY X (m/s²)", "S_GRAVITY Y (m/s²)", "S_GYROSCOPE Yaw (rad/s)", "V_Velocity (km/hr)", "S_GPS SPEED (Kmh)"]
    found = headers.resolve_columns(columns)
    assert found["gravity_x"] == columns[0] and found["gravity_y"] == columns[1]  # whole words: "gravity" has a y
    assert found["gps_speed"] == columns[4] and found["gyro_yaw"] == columns[2]


def test_names(spark):
    df = spark.createDataFrame([("/d/S-Vta11.csv",), ("V-Vfa01.csv",), ("S-Vta11_features.csv",), ("/phone/My Drive.csv",)], "p string")
    got = df.select(headers.normalize_sequence_id(F.col("p")), headers.extract_sequence_id(F.col("p")), headers.classify_by_path(F.col("p"))).collect()
    assert [tuple(r) for r in got[:3]] == [("vta11", "vta11", "S"), ("vfa01", "vfa01", "V"), ("vta11", "vta11", "S")]
    assert got[3][2] == "S"
    text = "gps latitude gps longitude accelerometer x"
    assert spark.createDataFrame([(text,), ("velocity gear",), ("x",)], "t string").select(headers.classify_by_columns(F.col("t"))).collect() == [("S",), ("V",), ("UNKNOWN",)]


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:40:02", "50 mph", "12 of 14", "abc")], "d string, m string, s string, x string")
    r = df.select(scalar.seconds_since_midnight("d"), scalar.parse_maxspeed("m"), scalar.to_numeric("s", True), scalar.to_numeric("x"), scalar.seconds_since_midnight("x")).first()
    assert tuple(r) == (100.02, 50.0, 12.0, None, None)
    q = spark.createDataFrame([(60.0, 5), (5.0, 0), (5.0, 8), (20.0, 8)], "a double, n int").select(scalar.gnss_quality("a", "n").alias("q")).select("q.mode", "q.confidence", "q.reasons").collect()
    assert [x[0] for x in q] == ["DENIED", "ANOMALOUS", "STRONG", "WEAK"]
    assert q[0][1] == pytest.approx(0.3) and q[0][2] == ["accuracy_exceeds_50m"]
    states = spark.createDataFrame([(5.0, 0.5), (10.0, 0.0), (0.0, 2.0)], "p double, v double").select(scalar.drift_decision("p", "v")).collect()
    assert [s[0] for s in states] == ["NORMAL", "WARNING", "ABNORMAL"]


def test_geodesy(spark):
    one = spark.range(1)
    r = one.select(geo.haversine_m(52.0, -1.0, 52.0, -1.0), geo.initial_bearing_deg(0.0, 0.0, 1.0, 0.0), geo.angular_diff_deg(350.0, 10.0), geo.destination_point(0.0, 0.0, 90.0, 1000.0)["lon"], geo.point_to_segment_m(0.0, 0.0005, 0.0, 0.0, 0.0, 0.001), geo.point_to_segment_m(0.0, 0.0005, 0.0, 0.0, 0.0, 0.0, "equirectangular")).first()
    assert r[0] == 0 and r[1] == pytest.approx(0) and r[2] == 20
    assert math.radians(r[3]) * geo.MEAN_RADIUS == pytest.approx(1000)
    assert r[4] == pytest.approx(0) and r[5] == pytest.approx(55.6, abs=0.1)


def sides(spark):
    v = spark.createDataFrame([("a", i, 100.0 + 0.1 * i) for i in range(20)] + [("a", 20, 100.0)], "sequence_id string, row_idx int, t double")
    s = spark.createDataFrame([("a", i, 100.0 + 0.1 * i + 0.02) for i in range(18)] + [("a", 18, 500.0), ("a", 19, None), ("b", 20, 1.0)], "sequence_id string, row_idx int, t double")
    return s, v


def test_asof(spark):
    s, v = sides(spark)
    got = sync.asof_nearest(s, v, tolerance=0.05).orderBy("row_idx").collect()
    assert len(got) == 21 and sum(r.synchronization_valid for r in got) == 18
    assert [r.V_row_idx for r in got[:18]] == list(range(18)) and got[18].V_row_idx is None
    tie = spark.createDataFrame([("a", 0, 1.0)], s.schema)
    both = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 1.5)], v.schema)
    r = sync.asof_nearest(tie, both, tolerance=0.5).first()
    assert r.V_row_idx == 1 and r.time_difference == 0.5
    assert sync.asof_nearest(s.limit(0), v).count() == 0 and sync.asof_nearest(s, v.limit(0)).filter("synchronization_valid").count() == 0


def test_asof_against_search(spark):
    r = np.random.default_rng(3)
    left, right = np.sort(r.integers(0, 4000, 300)) / 10, np.unique(r.integers(0, 4000, 200)) / 10
    s = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate(left)], "sequence_id string, row_idx int, t double")
    v = spark.createDataFrame([("a", i, float(t)) for i, t in enumerate(right)], "sequence_id string, row_idx int, t double")
    got = {x.row_idx: x.V_row_idx for x in sync.asof_nearest(s, v, tolerance=0.7).collect()}
    for i, t in enumerate(left):
        d = np.abs(right - t)
        best = max(np.flatnonzero(d == d.min()))
        assert got[i] == (best if d[best] <= 0.7 else None)


def feature_rows(spark):
    rows = [("a", i, t, ax, 4.0, 0.0, 3.0, 4.0, 12.0, yaw, lat, -1.0, 5.0) for i, (t, ax, yaw, lat) in enumerate([(0.0, 3.0, 359.0, 52.0), (0.1, 3.0, 1.0, 52.0), (0.2, float("inf"), 359.0, 95.0), (2.0, 3.0, 0.0, 52.0)])]
    names = "sequence_id string, row_idx int, timestamp double, accel_x double, accel_y double, accel_z double, gyro_yaw double, gyro_pitch double, gyro_roll double, orientation_yaw double, gps_latitude double, gps_longitude double, gps_accuracy double"
    return spark.createDataFrame(rows, names)


def test_features(spark):
    got = features.engineer(feature_rows(spark), n=2).orderBy("row_idx").collect()
    assert [r.accel_magnitude for r in got] == [5.0, 5.0, None, 5.0] and got[0].gyro_magnitude == 13.0
    assert [r.yaw_change for r in got] == [None, 2.0, -2.0, 1.0]
    assert [r.gps_valid for r in got] == [True, True, False, True]
    assert [r.time_gap_flag for r in got] == [False, False, False, True]
    with pytest.raises(ValueError, match="gyroscope"):
        features.engineer(feature_rows(spark).drop("gyro_roll"))
    assert len(features.DEPLOYABLE_FEATURES) == 107 == len(set(features.DEPLOYABLE_FEATURES))


def test_rolling(spark):
    df = spark.createDataFrame([("a", i, float(i), x) for i, x in enumerate([1.0, 2.0, 100.0])], "sequence_id string, row_idx int, t double, x double")
    out = df.withColumns(features.rolling_stats("x", features.in_order(), 2)).orderBy("row_idx").collect()
    assert [r.x_rolling_mean for r in out] == [1.0, 1.5, 51.0]


def test_dead_reckoning(spark):
    r = np.random.default_rng(1)
    t = np.cumsum(r.choice([0.1, 0.2, 1.0, 0.0], 200))
    a = [None if r.random() < 0.1 else float(x) for x in r.normal(size=200)]
    df = spark.createDataFrame([("a", i, float(t[i]), a[i], a[i]) for i in range(200)], "sequence_id string, row_idx int, t double, ax double, ay double")
    got = labels.dead_reckon(df).orderBy("row_idx").collect()
    v = p = 0.0
    for i in range(200):
        dt = t[i] - t[i - 1] if i else -1
        if dt <= 0 or dt > 0.5:
            v = 0.0
        elif a[i] is not None:
            p += v * dt + 0.5 * a[i] * dt * dt
            v += a[i] * dt
        assert got[i].imu_vx == pytest.approx(v, abs=1e-9) and got[i].imu_x == pytest.approx(p, abs=1e-9)


def test_interpolation(spark):
    df = spark.createDataFrame([("a", i, float(i), x) for i, x in enumerate([None, 1.0, None, None, 4.0, None])], "sequence_id string, row_idx int, t double, x double")
    assert [r.x for r in labels.linear_interpolate(df, ["x"]).orderBy("row_idx").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_modes(spark):
    r = np.random.default_rng(2)
    rows = [("t", i, float(i), float(r.random()), bool(r.random() < 0.2), str(r.choice(["STRONG", "WEAK", "DENIED", "ANOMALOUS"]))) for i in range(300)]
    df = spark.createDataFrame(rows, "track_id string, row_idx int, t double, confidence double, is_anomalous boolean, navigation_mode string")
    a = [x.mode for x in fusion.mode_fsm(df).orderBy("row_idx").collect()]
    assert a == [x.mode for x in fusion.mode_fsm_fold(df).orderBy("row_idx").collect()]
    mode, n = fusion.DENIED, 0
    seen = []
    for _ in range(13):
        mode, n = fusion.next_mode(mode, n, 0.9, False, "STRONG")
        seen.append(mode)
    assert seen == [fusion.RECOVERY] * 11 + [fusion.DOMINANT] * 2


def test_filter_follows():
    f = fusion.TrackFilter()
    for i in range(100):
        out = f.step(i * 0.1, 52 + i * 1e-6, -1.5, 1.1, 0.0, 5.0, 0.9, 1.0)
    assert out[0] == pytest.approx(52 + 99e-6, abs=3e-5) and not out[6] and 0 < out[5] < 1


def test_inertial_still_and_straight():
    s = fusion.InertialState()
    s.fix(52.0, -1.5, 0.0, 0.0)
    for i in range(50):
        out = s.step(i * 0.1, np.array([1.0, 0.0, fusion.G]), np.zeros(3), np.zeros(3), False)
    assert out[2] == pytest.approx(4.9, abs=0.2) and out[1] == pytest.approx(-1.5) and out[0] == pytest.approx(52 + math.degrees(out[3] / geo.EQUATORIAL_RADIUS))
    assert s.step(5.0, np.zeros(3), np.zeros(3), np.zeros(3), True)[2] == 0


def road(spark):
    nodes = spark.createDataFrame([("a", 13.0, 77.0, 900.0), ("b", 13.001, 77.0, 950.0), ("c", 13.0, 77.0002, None), ("d", 13.0003, 76.9995, None)], "node_id string, lat double, lon double, elevation double")
    ways = spark.createDataFrame([("w1", ["a", "b"], {"highway": "primary"}), ("w2", ["d", "a", "x", "c"], {"oneway": "yes"})], "way_id string, nodes array<string>, tags map<string,string>")
    return roads.edge_curvature(roads.edges_with_nodes(ways, nodes))


def test_roads(spark):
    edges = {r.segment_id: r for r in road(spark).collect()}
    assert set(edges) == {"w1:a->b", "w1:b->a", "w2:d->a"}
    up = edges["w1:a->b"]
    assert up.slope_pct == pytest.approx(45, abs=0.1) and up.slope_available and up.bearing == pytest.approx(0)
    assert up.curvature_deg > 60 and edges["w2:d->a"].curvature_deg == 0 or edges["w2:d->a"].curvature_deg >= 0


def test_match_off_road_and_sticky(spark):
    points = spark.createDataFrame([("p1", "t", 0, 1.0, 13.0005, 77.00001, 0.0), ("p2", "t", 1, 2.0, 13.0005, 77.00023, 0.0), ("p3", "t", 2, 3.0, 14.0, 78.0, 0.0), ("p4", "u", 0, 1.0, 14.0, 78.0, 0.0)], "point_id string, track_id string, row_idx int, t double, lat double, lon double, heading double")
    results = matching.match(points, road(spark))
    got = {r.point_id: r for r in results.collect()}
    assert got["p1"].road_segment_id == "w1:a->b" and got["p1"].map_confidence > 0.5
    assert got["p2"].map_confidence == 0.4 and [c.score for c in got["p2"].candidate_roads][1:] == [0.0]
    sticky = {r.point_id: r for r in matching.sticky_match(points, results).collect()}
    assert (sticky["p3"].map_confidence, sticky["p3"].source, sticky["p3"].candidate_roads) == (0.3, "last", None)
    assert (sticky["p4"].map_confidence, sticky["p4"].road_segment_id, sticky["p4"].matched_latitude) == (0.0, "", 14.0)
    checked = matching.match_contract_check(results.withColumn("map_confidence", F.lit(1.5)))
    assert all(r.problems == ["Confidence out of range"] for r in checked.collect())


def test_split_and_preprocess(spark):
    assert preparation.split_counts(72) == (50, 11)
    ids = spark.createDataFrame([(f"s{i}",) for i in range(20)], "sequence_id string")
    split = preparation.split_sequences(ids)
    assert sync.split_leakage(split).count() == 0 and split.groupBy("split").count().count() == 3
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, y double")
    params = preparation.fit_preprocess(df, ["x", "y"])
    out = preparation.apply_preprocess(df, params, ["x", "y"]).collect()
    assert [r.x for r in out] == pytest.approx([-1.2247, 0, 1.2247], abs=1e-3) and [r.y for r in out] == [0, 0, 0]


def test_isolation_forest_finds_outlier(spark):
    r = np.random.default_rng(0)
    rows = [("a", i, *map(float, r.normal(size=2))) for i in range(400)] + [("a", 400, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "sequence_id string, row_idx int, x double, y double")
    forest = isolation.isolation_forest_fit(df, ["x", "y"], trees=40, psi=64)
    assert forest.select("tree").distinct().count() == 40
    scored = isolation.isolation_forest_score(df, forest, ["x", "y"]).orderBy(F.desc("drift_score")).collect()
    assert scored[0].row_idx == 400 and -0.5 <= scored[-1].drift_score <= scored[0].drift_score <= 0.5


def test_isolation_forest_scores_by_plain_walks(spark):
    r = np.random.default_rng(3)
    values = [[float(v) for v in r.normal(0, 1, 3)] for _ in range(300)]
    for i, v in enumerate([None, float("nan"), float("inf"), float("-inf")]):
        values[i * 7][i % 3] = v
    df = spark.createDataFrame([("s", i, *v) for i, v in enumerate(values)], "sequence_id string, row_idx int, x double, y double, z double")
    forest = isolation.isolation_forest_fit(df.filter("row_idx > 30"), ["x", "y", "z"], trees=20, psi=64)
    nodes = {(n.tree, n.node): n for n in forest.collect()}
    trees = {t for t, _ in nodes}

    def path(v, t):
        node, depth = nodes[t, 0], 0
        while node.feature >= 0:
            x = v[node.feature]
            node, depth = nodes[t, node.left if x is not None and x < node.cut else node.right], depth + 1
        return depth + float(isolation.average_path(node.size))

    for row in isolation.isolation_forest_score(df, forest, ["x", "y", "z"], psi=64).collect():
        mean = sum(path(values[row.row_idx], t) for t in trees) / len(trees)
        assert row.drift_score == pytest.approx(2 ** (-mean / float(isolation.average_path(64))) - 0.5, abs=1e-12)


def test_status_rule(spark):
    df = spark.createDataFrame([(0.0, 0, False, False), (2.0, 0, False, False), (100.0, 0, False, False), (0.0, 1, False, False)], "m double, i int, c boolean, n boolean")
    assert [r[0] for r in df.select(scalar.feature_status("m", "i", "c", "n")).collect()] == ["PASS", "WARNING", "FAIL", "FAIL"]
    empty = spark.createDataFrame([], "sequence_id string, row_idx int, t double, x double")
    assert quality.feature_statistics(empty, ["x"]).count() == 0 and quality.duplicate_rows(empty).first().extra_members == 0


def test_mode_machine_of_nulls_and_repeated_rows(spark):
    rows = [("a", 0, 0.0, None, False, "GNSS"), ("a", 1, 1.0, 0.9, None, None), ("a", 1, 1.0, 0.9, None, None), ("a", 2, 2.0, float("nan"), False, "GNSS"), ("a", 3, None, 0.9, False, "GNSS"), ("b", 0, 0.0, 0.5, False, "GNSS"), ("b", 0, 0.0, 0.5, False, "GNSS")]
    df = spark.createDataFrame(rows, "track_id string, row_idx int, t double, confidence double, is_anomalous boolean, navigation_mode string")
    got = [sorted((r.track_id, r.row_idx, str(r.t), r["mode"]) for r in f(df).collect()) for f in (fusion.mode_fsm, fusion.mode_fsm_fold)]
    assert len(got[0]) == len(rows) and [x[:2] + x[3:] for x in got[0]] == [x[:2] + x[3:] for x in got[1]]
    assert ("a", 0, "0.0", fusion.DENIED) in got[0] and fusion.mode_fsm(df).columns == [*df.columns, "mode"]


def test_windows_of_one_long_drive(spark):
    """One drive of many rows: running frames only, so that time grows with the rows, not with their square."""
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("sequence_id"), F.col("id").alias("row_idx"), (F.col("id") / 10.0).alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id") * 2.0).alias("x"))
    filled = labels.linear_interpolate(df, ["x"])
    assert filled.filter("row_idx <= 99000 and abs(x - 2 * row_idx) > 1e-6").count() == 0 and filled.filter("row_idx > 99000 and x <> 198000").count() == 0
    speed = labels.reference_velocity(filled.withColumn("y", F.col("x")), "x", "y")
    assert speed.filter("row_idx < 99000 and abs(ref_vx - 20) > 1e-6").count() == 0
    matched = sync.asof_nearest(df.drop("x"), df.filter("row_idx % 3 = 0"), tolerance=0.0)
    assert matched.filter("synchronization_valid").count() == -(-n // 3) and matched.count() == n


def test_deployable_vector(spark):
    row = feature_rows(spark).withColumn("elapsed_time", F.lit(1.5))
    got = features.deployable_vector(row).orderBy("row_idx").first().vector
    assert len(got) == 107 and got[features.DEPLOYABLE_FEATURES.index("elapsed_time")] == 1.5 and got[0] is None
    assert got[features.DEPLOYABLE_FEATURES.index("accel_x")] == 3.0


def test_percentiles_against_numpy(spark):
    from odotrail.operators import ranks

    r = np.random.default_rng(5)
    values = {"a": r.normal(size=30_000), "b": r.integers(0, 4, 5000).astype(float), "c": np.array([7.0]), "d": r.normal(size=3), None: r.normal(size=10), "e": np.r_[np.zeros(20_000), r.normal(size=19)]}
    rows = [(k, float(x)) for k, xs in values.items() for x in xs] + [("a", None), ("n", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    wanted = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p60": 0.6, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = {x.g: x for x in ranks.percentiles(df, F.col("x"), wanted, ["g"]).collect()}
    assert set(got) == {*values, "n"} and got["n"].p50 is None
    for k, xs in values.items():
        assert [got[k][n] for n in wanted] == pytest.approx(np.quantile(xs, list(wanted.values())).tolist(), abs=1e-12)
    whole = ranks.percentiles(df, F.col("x"), wanted).first()
    assert list(whole) == pytest.approx(np.quantile(np.concatenate(list(values.values())), list(wanted.values())).tolist(), abs=1e-12)
    assert ranks.percentiles(df.limit(0), F.col("x"), {"p": 0.5}).collect() == [(None,)]
    two = spark.createDataFrame([(1.0,), (2.0,)], "threshold double")
    with pytest.raises(Exception, match="one row"):
        isolation.anomaly_flag(df.withColumn("drift_score", F.col("x")), two).count()


def test_match_points_at_all_latitudes(spark):
    r = np.random.default_rng(6)
    at = [(lat0 + dlat * 3e-4, 10 + dlon * 3e-4 / max(0.02, math.cos(math.radians(lat0)))) for lat0 in (0.0, 45.0, -45.0, 80.0, 88.0) for dlat, dlon in r.normal(size=(12, 2))]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "point_id int, lat double, lon double")
    ends = [(at[i], at[(i // 12) * 12 + int(r.integers(12))]) for i in range(len(at))]
    edges = spark.createDataFrame([(i, *map(float, a + b)) for i, (a, b) in enumerate(ends)], "segment_id int, lat1 double, lon1 double, lat2 double, lon2 double")
    for config in (matching.GRAPH, matching.MOBILE):
        method = "ellipsoid" if config.preset == "graph" else "equirectangular"
        brute = points.crossJoin(edges).filter(geo.point_to_segment_m("lat", "lon", "lat1", "lon1", "lat2", "lon2", method) <= config.max_distance)
        pairs = lambda df: sorted((x.point_id, x.segment_id) for x in df.collect())
        want = pairs(brute)
        assert pairs(matching.match_points(points, edges, config)) == want and len(want) > len(at)


def test_sequence_audit(spark):
    inf = float("inf")
    rows = [("a", i, float(i), 1.0, inf if i == 3 else float(i), None, 1.0, 1.0, 1.0, i == 2) for i in range(5)] + [("a", 9, 4.0, 1.0, 4.0, None, 1.0, 1.0, 1.0, False), ("b", 0, None, 1.0, 2.0, 5.0, 1.0, 1.0, 1.0, False)]
    df = spark.createDataFrame(rows, "sequence_id string, row_idx int, t double, x double, y double, gyro_magnitude double, gyro_yaw double, gyro_pitch double, gyro_roll double, time_gap_flag boolean").withColumn("note", F.lit("n"))
    got = {r.sequence_id: r for r in quality.sequence_audit(df, ["x", "y"]).collect()}
    a, b = got["a"], got["b"]
    assert (a.repeated_rows, a.infinite_values, a.time_gaps, a.missing_times, a.gyro_bug, a.constant_features, a.unexpected_text) == (1, 1, 1, 0, True, 1, "note")
    assert (b.repeated_rows, b.missing_times, b.gyro_bug, b.constant_features, b.near_constant_features) == (0, 1, False, 2, 2)
    verdict = quality.audit_verdict(quality.feature_statistics(df, ["x"]), quality.sequence_audit(df, ["x"])).first()
    assert verdict.gyro_bugs == 1 and verdict.verdict == "REQUIRES CORRECTION"
    bad = {r.rule: r.violations for r in gates.validate_aligned(df.select("sequence_id", F.lit("x").alias("time_difference"), F.lit(True).alias("synchronization_valid"))).collect()}
    assert bad["type of time_difference"] == 1


def test_capped_sample_and_named_columns(spark):
    df = spark.range(500).select(F.lit("a").alias("sequence_id"), F.col("id").alias("row_idx"))
    one, two = ({r.row_idx for r in preparation.capped_sample(d, 50).collect()} for d in (df, df.repartition(7)))
    assert one == two and len(one) == 50
    assert headers.detect_time_columns(["S_Time (ms)", "x"]) == ["S_Time (ms)"] and headers.detect_label_columns(["Driver", "speed"]) == ["Driver"]


def test_gravity_levels_the_track(spark):
    rows = [("a", i, i * 0.02, 0.0, 0.0, 0.0, 0.0, 20.0, -30.0, 0.0, 0.0, fusion.G) for i in range(400)]
    df = spark.createDataFrame(rows, "track_id string, row_idx int, t double, gx double, gy double, gz double, yaw double, pitch double, roll double, ax double, ay double, az double")
    turned = fusion.orientation_track(df).orderBy(F.desc("row_idx")).first()
    level = fusion.orientation_track(df, accel=("ax", "ay", "az")).orderBy(F.desc("row_idx")).first()
    assert turned.track_pitch == pytest.approx(20) and turned.track_roll == pytest.approx(-30)
    assert abs(level.track_pitch) < 0.1 and abs(level.track_roll) < 0.1 and level.track_yaw == pytest.approx(0, abs=1e-6)
    free = fusion.orientation_track(df.withColumn("az", F.lit(0.5)), accel=("ax", "ay", "az")).orderBy(F.desc("row_idx")).first()
    assert free.track_pitch == pytest.approx(20)


def test_confidence_of_the_phone_module(spark):
    rows = [("a", 0, 0.0, 5.0, "NORMAL"), ("a", 1, 1.0, None, "NORMAL"), ("a", 2, 1.01, None, "TURNING"), ("a", 3, 1.02, None, "POTHOLE"), ("a", 4, 1.03, None, "PHONE_DISTURBANCE"), ("a", 5, 601.0, None, "NORMAL"), ("b", 0, 0.0, None, "NORMAL")]
    df = spark.createDataFrame(rows, "track_id string, row_idx int, t double, gnss_heading double, motion_state string").withColumn("vibration", F.lit(0.0))
    got = [r.imu_confidence for r in fusion.imu_confidence(df, long_seconds=300.0, low_rate_hz=20.0, motion="motion_state").orderBy("track_id", "row_idx").collect()]
    assert got == pytest.approx([1.0, 1.0, 0.9 * 0.55, 0.6, 0.1, math.exp(-301 / 300), 0.0])


def test_rules_of_features_and_folders(spark):
    df = spark.createDataFrame([("a", 0, 2.0, 1.0, "x"), ("a", 1, None, 1.0, "x"), ("a", 2, 1.0, 1.0, "x"), (None, 3, 0.0, float("inf"), "x")], "sequence_id string, row_idx int, timestamp double, x double, accel_magnitude_rolling_mean string")
    got = {r.rule: r.violations for r in gates.validate_features(df, ["x"], window=0).collect()}
    assert (got["time not in order"], got["no sequence"], got["infinite value"], got["window too short"]) == (1, 1, 1, 1)
    assert (got["column gyro_magnitude_rolling_mean"], got["not a number accel_magnitude_rolling_mean"]) == (1, 1)
    paths = spark.createDataFrame([("/S-Dataset/x.csv",), ("/v dataset/s1.csv",), ("/d/drive_s_1.csv",), ("/d/drive_s",), ("/d/vs.csv",)], "p string")
    assert [r[0] for r in paths.select(headers.classify_by_path(F.col("p"))).collect()] == ["S", "V", "S", "UNKNOWN", "V"]


def test_window_summaries_take_time_in_proportion_to_the_window(spark):
    """And are right for windows of different lengths, with missing values and missing windows."""
    from odotrail.operators import models

    r = np.random.default_rng(8)
    long = spark.range(60).select(F.transform(F.sequence(F.lit(1), F.lit(4000)), lambda i: F.array(i * 1.0, (i * 7 % 13) * 1.0)).alias("w"))
    began = time.time()
    got = long.select(models.window_summary("w", 2).alias("s")).distinct().collect()
    assert time.time() - began < 30
    i = np.arange(1, 4001)
    want = lambda x: [x[-1], x.mean(), x.std(), x.min(), x.max(), (x[-1] - x[0]) / max(len(x) - 1, 1)]
    assert len(got) == 1 and np.allclose(got[0].s, [*want(i * 1.0), *want(i * 7 % 13 * 1.0)])
    windows = [[[float(v), None if v > 1 else float(v)] for v in r.normal(size=n)] for n in (1, 3, 3, 7)]
    rows = spark.createDataFrame([(k, w) for k, w in enumerate([*windows, None, []])], "k int, w array<array<double>>").coalesce(1)
    found = {x.k: x.s for x in rows.select("k", models.window_summary("w", 2).alias("s")).collect()}
    assert found[4] is None and found[5] is None
    for k, w in enumerate(windows):
        x = np.array([[v or 0.0 for v in step] for step in w])
        assert np.allclose(found[k], [*want(x[:, 0]), *want(x[:, 1])])


def test_only_roads_in_tiles_of_points_are_shuffled(spark):
    """Roads far from all points fall out as they are placed, those near points are all there; the same candidates either way."""
    nodes = spark.range(4000).select(F.col("id").cast("string").alias("node_id"), (F.lit(13.0) + F.col("id") * 0.001).alias("lat"), F.lit(77.0).alias("lon"), F.lit(1.0).alias("elevation"))
    ways = spark.range(3999).select(F.concat(F.lit("w"), "id").alias("way_id"), F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string")).alias("nodes"), F.create_map(F.lit("highway"), F.lit("primary")).alias("tags"))
    edges = roads.edge_curvature(roads.edges_with_nodes(ways, nodes))
    points = spark.range(40).select(F.col("id").alias("point_id"), (F.lit(13.0005) + F.col("id") * 0.001).alias("lat"), F.lit(77.0001).alias("lon"), F.lit(0.0).alias("heading"))
    i, j = roads.cell_of(F.col("lat"), F.col("lon"), 30.0)
    celled, placed = points.withColumns({"__i": i, "__j": j}), roads.placed_edges(edges, 30.0)
    kept = roads.in_tiles_of(placed, celled)
    assert 0 < kept.count() < placed.count() / 4
    assert roads.road_cells(edges, 30.0, celled).count() == kept.select("__i", "__j").distinct().count()
    near = {(r.point_id, r.segment_id) for r in roads.edges_within(points, edges, 30.0).collect()}
    assert near == {(r.point_id, r.segment_id) for r in celled.join(placed, ["__i", "__j"]).filter("lat between least(lat1, lat2) - 0.0003 and greatest(lat1, lat2) + 0.0003").collect()}


def test_sharpest_turn_at_a_node(spark):
    """Over all edges that arrive, except from the end node; with loops, and with edges of one name."""
    rows = [("s1", "a", "b", 10.0), ("s2", "b", "a", 190.0), ("s3", "c", "a", 100.0), ("s4", "d", "a", 350.0), ("s5", "a", "c", 280.0), ("s6", "a", "a", 0.0), ("s7", "x", "y", 5.0)]
    got = {r.segment_id: r.curvature_deg for r in roads.edge_curvature(spark.createDataFrame(rows, "segment_id string, u string, v string, bearing double")).collect()}
    assert got == {"s1": 90.0, "s2": 0.0, "s3": 0.0, "s4": 0.0, "s5": 90.0, "s6": 170.0, "s7": 0.0}


def test_tracks_share_tasks_in_the_plain_fold(spark):
    """Short tracks are folded many a call, each from its own start."""
    df = spark.range(600).select((F.col("id") % 200).alias("track_id"), (F.col("id") / 200).cast("int").alias("row_idx"), F.col("id").cast("double").alias("t"))
    counted = fusion.fold_tracks(df, lambda pdf, starts: pdf.assign(n=len(starts), at=np.arange(len(pdf)) - np.repeat(starts, np.diff(np.append(starts, len(pdf))))), "track_id", "t", "row_idx", n="long", at="long").collect()
    assert len(counted) == 600 and all(x.at == x.row_idx for x in counted)
    assert len({x.n for x in counted}) <= 4 and sum({x.track_id: 1 / x.n for x in counted}.values()) <= 4.001
