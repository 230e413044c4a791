"""Streams give the same rows as tables."""

import time

import numpy as np
from pyspark.sql import functions as F

from odotrail.operators import fusion, matching, online, tracks
from odotrail.streaming import state

from .test_tracks import SENSORS, drives

SCHEMA = "track_id string, row_idx int, t double, confidence double, is_anomalous boolean, navigation_mode string"


def run(spark, stream, tmp_path, name="out"):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / name))


def source(spark, df, folder, by="t", parts=3):
    edges = np.linspace(0, df.count(), parts + 1)
    for a, b in zip(edges, edges[1:], strict=False):
        df.filter((F.col("row_idx") >= int(a)) & (F.col("row_idx") < int(b))).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_modes_and_throttle(spark, tmp_path):
    r = np.random.default_rng(4)
    df = spark.createDataFrame([("ab"[i % 2], i, i * 0.03, float(r.random()), bool(r.random() < 0.2), str(r.choice(["STRONG", "DENIED"]))) for i in range(60)], SCHEMA)
    stream = source(spark, df, str(tmp_path / "in"))
    got = run(spark, state.mode_fsm_stream(stream), tmp_path, "modes").orderBy("row_idx").collect()
    want = fusion.gnss_weight_ramp(fusion.mode_fsm(df)).orderBy("row_idx").collect()
    assert [(x.row_idx, x.mode, x.gnss_weight) for x in got] == [(x.row_idx, x.mode, x.gnss_weight) for x in want]
    kept = run(spark, state.throttle_stream(stream, 0.1), tmp_path, "throttled")
    assert {x.row_idx for x in kept.collect()} == {x.row_idx for x in fusion.throttle(df, 0.1).collect()}


def test_synchronised_streams(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "sequence_id string, row_idx int, ms long").withColumn("ts", F.timestamp_millis("ms"))
    s = source(spark, make([("a", i, 1000 * i) for i in range(40)]), str(tmp_path / "s"))
    v = source(spark, make([("a", i, 1000 * i + (20 if i % 2 else 80)) for i in range(40)]), str(tmp_path / "v"))
    got = run(spark, state.watermarked_sync_stream(s, v), tmp_path, "sync").collect()
    near, alone = [x for x in got if x.V_row_idx is not None], [x for x in got if x.V_row_idx is None]
    assert near and all(x.S_row_idx == x.V_row_idx and x.difference_us == 20000 for x in near)
    assert alone and all(x.S_row_idx % 2 == 0 and x.difference_us is None for x in alone)


def test_filters_orientation_and_cycle_equal_tables(spark, tmp_path):
    df = spark.createDataFrame(drives(0.1, seed=21, lost=("lat",)), SENSORS).drop("gnss_weight")
    stream = source(spark, df, str(tmp_path / "in"))
    key = ["track_id", "row_idx"]
    for name, streamed, table in (("ins", state.ins_stream, fusion.ins_track), ("orientation", state.orientation_stream, fusion.orientation_track), ("cycle", state.fusion_stream, fusion.fusion_pipeline)):
        got = run(spark, streamed(stream), tmp_path, name).orderBy(*key).collect()
        want = table(df).orderBy(*key).collect()
        assert got == want


class SideBySide(state.Carried):
    """Tells how many tracks each run had."""

    def run(self, pdf, starts, held):
        out, after = super().run(pdf, starts, held)
        return out.assign(confidence=float(len(starts))), after


def test_tracks_of_a_bucket_run_side_by_side(spark, tmp_path, monkeypatch):
    """Each with its own state, a null track too."""
    monkeypatch.setattr(state, "BUCKETS", 2)
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(i % 40 or None, i // 40, i * 0.03, float(r.random()), bool(r.random() < 0.2), str(r.choice(["STRONG", "DENIED"]))) for i in range(480)], SCHEMA.replace("track_id string", "track_id long"))
    for n in range(3):
        df.filter(F.floor(F.col("row_idx") / 4) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = ["track_id", "row_idx"]
    got = run(spark, state.mode_fsm_stream(stream), tmp_path, "modes").orderBy(*key).collect()
    assert [(*x[:2], x["mode"]) for x in got] == [(*x[:2], x["mode"]) for x in fusion.mode_fsm(df).orderBy(*key).collect()]
    schema = tracks.typed(df, mode="string", gnss_weight="double")
    counted = run(spark, state.stateful(stream, SideBySide(state.ModeFold()), schema, "track_id", "t", "row_idx"), tmp_path, "counted")
    sizes = {x.confidence for x in counted.collect()}
    assert len(sizes) <= 2 and sum(sizes) in (40, 20)


def test_state_of_a_table_goes_on_in_a_stream(spark, tmp_path):
    df = spark.createDataFrame(drives(0.1, seed=22), SENSORS).drop("gnss_weight")
    half = F.col("row_idx") < 20
    first = tracks.end_states(df.filter(half), fusion.FusionFold(), "track_id", "t", "row_idx", block_rows=9)
    stream = source(spark, df.filter(~half), str(tmp_path / "in"), parts=1)
    got = run(spark, state.fusion_stream(stream, initial=first), tmp_path, "cycle").orderBy("track_id", "row_idx").collect()
    assert got == [r for r in fusion.fusion_pipeline(df).orderBy("track_id", "row_idx").collect() if r.row_idx >= 20]


def test_late_rows_and_tracks_that_end(spark, tmp_path):
    """Rows of one batch that are older than those of the batch before are put in order; a track idle for long begins anew; what is later is dropped."""
    make = lambda rows: spark.createDataFrame([(k, i, ms / 1000, c, False, "STRONG", ms) for k, i, ms, c in rows], f"{SCHEMA}, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    low, good = 0.01, 0.9
    batches = [
        [("a", 0, 1000, good), ("a", 3, 4000, good), ("b", 0, 1000, low)],
        [("a", 1, 2000, low), ("a", 2, 3000, good), ("a", 4, 9000, good)],  # in between, and after
        [("c", 0, 60_000, good)],
        [("c", 1, 61_000, good), ("a", 9, 5000, low)],  # too late
        [("c", 2, 100_000, good)],
        [("b", 1, 101_000, good), ("c", 3, 130_000, good)],  # b was in denial, and has begun anew
        [("c", 4, 170_000, good)],
        [("c", 5, 210_000, good)],
    ]
    for n, rows in enumerate(batches):
        make(rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    frames = spark.readStream.schema(make(batches[0]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    import os

    for n in range(len(batches)):  # files are taken by age
        for f in (tmp_path / "in" / f"{n}").iterdir():
            os.utime(f, (1_600_000_000 + 10 * n, 1_600_000_000 + 10 * n))
    got = run(spark, state.mode_fsm_stream(frames, event_time="ts", late="5 seconds", idle_ms=20_000), tmp_path, "modes")
    seen = {(r.track_id, r.row_idx): r["mode"] for r in got.collect()}
    a = fusion.mode_fsm(make([r for b in batches for r in b if r[0] == "a" and r[1] != 9])).collect()
    assert {k: v for k, v in seen.items() if k[0] == "a"} == {("a", r.row_idx): r["mode"] for r in a}
    assert seen["b", 0] == fusion.DENIED and seen["b", 1] == fusion.DOMINANT
    assert len(got.collect()) == len(seen)


def test_state_of_idle_tracks_can_be_dropped_by_processing_time(spark, tmp_path):
    df = spark.createDataFrame([("a", i, i * 0.03, 0.5, False, "STRONG") for i in range(20)], SCHEMA)
    q = state.mode_fsm_stream(source(spark, df, str(tmp_path / "in")), ttl_ms=3_600_000).writeStream.format("parquet").option("path", str(tmp_path / "modes")).option("checkpointLocation", str(tmp_path / "state")).start()
    for _ in range(120):  # it goes on looking for idle tracks
        if sum(p.numInputRows for p in q.recentProgress) >= 20:
            break
        time.sleep(0.5)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "modes"))
    assert sorted((r.row_idx, r["mode"]) for r in got.collect()) == sorted((r.row_idx, r["mode"]) for r in fusion.mode_fsm(df).collect())


def test_sticky_matches(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [("ab"[i % 2], i, float(i), f"s{i}" if r.random() < 0.3 else None, 1.0 + i, 2.0 + i, 50.0 + i, 60.0 + i) for i in range(40)]
    df = spark.createDataFrame([(*x[:3], x[3], *((x[4], x[5], 0.8) if x[3] else (None,) * 3), *x[6:]) for x in rows], "track_id string, row_idx int, t double, road_segment_id string, matched_latitude double, matched_longitude double, map_confidence double, lat double, lon double")
    got = run(spark, state.sticky_match_stream(source(spark, df, str(tmp_path / "in"))), tmp_path, "sticky").orderBy("row_idx").collect()
    results = df.filter("road_segment_id is not null").select(F.col("row_idx").alias("point_id"), "road_segment_id", "matched_latitude", "matched_longitude", "map_confidence", F.array().cast("array<int>").alias("candidate_roads"))
    want = matching.sticky_match(df.select(F.col("row_idx").alias("point_id"), "track_id", "t", "row_idx", "lat", "lon"), results).orderBy("row_idx").collect()
    fields = ("row_idx", "road_segment_id", "matched_latitude", "matched_longitude", "map_confidence", "source")
    assert [[x[f] for f in fields] for x in got] == [[x[f] for f in fields] for x in want] and {x.source for x in got} == {"match", "last", "query"}


def test_online_windows(spark, tmp_path):
    df = spark.createDataFrame(drives(0.05, n=30, seed=23), SENSORS).withColumns({"gravity_x": F.when(F.col("row_idx") % 4 > 0, 0.1), "gravity_y": F.lit(0.2), "gravity_z": F.lit(9.7), "mx": F.when(F.col("row_idx") % 5 > 0, F.col("row_idx") * 1.0), "my": F.lit(3.0), "mz": F.lit(4.0), "altitude": F.lit(7.0)})
    want = online.online_windows(df, n=8).orderBy("track_id", "row_idx").collect()
    assert len(want) == sum(30 + k - 14 for k in range(4)) and all(len(r.window) == 8 and {len(v) for v in r.window} == {107} for r in want)
    got = run(spark, state.online_features(source(spark, df, str(tmp_path / "in"), parts=5), n=8), tmp_path, "windows").orderBy("track_id", "row_idx").collect()
    assert [(r.track_id, r.row_idx) for r in got] == [(r.track_id, r.row_idx) for r in want]
    plain = lambda rows: np.array([[[np.nan if v is None else v for v in line] for line in r.window] for r in rows], float)
    np.testing.assert_allclose(plain(got), plain(want), rtol=1e-9, atol=1e-9)
    filled = online.scaled(online.online_windows(df, n=8), [1.0] * 107, [2.0] * 107, [4.0] * 107).orderBy("track_id", "row_idx").collect()
    np.testing.assert_allclose(plain(filled), (np.where(np.isnan(plain(want)), 1.0, plain(want)) - 2.0) / 4.0)


def test_sensor_stream_and_json_lines(spark, tmp_path):
    from odotrail.sources import ingest

    df = spark.createDataFrame([("a", i, i * 0.1, 0.5, False, "STRONG") for i in range(30)], SCHEMA)
    source(spark, df, str(tmp_path / "in"))
    stream = ingest.sensor_stream(spark, str(tmp_path / "in"), df.schema)
    lines = run(spark, state.to_json_lines(stream), tmp_path, "lines")
    assert sorted(tuple(r) for r in state.from_json_lines(lines, SCHEMA).collect()) == sorted(tuple(r) for r in df.collect())
