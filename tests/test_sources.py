"""Reading and writing files."""

import json

from pyspark.sql import functions as F

from odotrail.sources import ingest, sinks


def test_csv_tree(spark, tmp_path):
    (tmp_path / "S").mkdir()
    (tmp_path / "V").mkdir()
    (tmp_path / "S" / "S-Vta11.csv").write_bytes(" ACCELEROMETER X (m/s²) ,GPS SPEED (Kmh),note\n1.5,10,a\n2.5,bad,b\n3,4\n".encode("cp1252"))
    (tmp_path / "V" / "V-Vta11.csv").write_bytes("﻿Velocity (km/hr), Time\n40,1\n".encode())
    files = ingest.scan_csv_tree(spark, str(tmp_path))
    kinds = {(r.sequence_id, r.kind): r for r in ingest.inventory(files).collect()}
    assert set(kinds) == {("vta11", "S"), ("vta11", "V")} and kinds["vta11", "S"].encoding == "cp1252" and kinds["vta11", "V"].columns == ["Velocity (km/hr)", "Time"]
    samples, rejects = ingest.read_sv_tables(files)
    assert samples.count() == 3 and [r.problem for r in rejects.collect()] == ["2 cells, 3 headers"]
    s = ingest.canonical(samples.filter("kind = 'S'"), ["ACCELEROMETER X (m/s²)", "GPS SPEED (Kmh)"]).orderBy("row_idx").collect()
    assert [(r.accel_x, r.gps_speed) for r in s] == [(1.5, 10.0), (2.5, None)]


def test_road_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nodes": {"1": {"lat": 1.0, "lon": 2.0}, "2": {"lat": 1.1, "lon": 2.0}}, "ways": [{"id": "w", "nodes": ["1", "2"], "tags": {"highway": "trunk"}}], "elevation_m": {"1": 5.0}}))
    (tmp_path / "b.json").write_text(json.dumps({"elements": [{"type": "node", "id": "9", "lat": 3.0, "lon": 4.0}, {"type": "way", "id": "v", "nodes": ["9"], "tags": {}}]}))
    (tmp_path / "c.json").write_text("{broken")
    nodes, ways = ingest.read_road_json(spark, str(tmp_path))
    assert {r.node_id: r.elevation for r in nodes.collect()} == {"1": 5.0, "2": None, "9": None}
    assert {r.way_id for r in ways.collect()} == {"w", "v"}


def test_split_layouts(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["S-Vta11_features"], "VALIDATION": {"sequences": ["vta12"]}, "test": {"ids": ["vta13"]}}))
    got = {r.sequence_id: r.split for r in ingest.read_split(spark, str(tmp_path / "s.json")).collect()}
    assert got == {"vta11": "train", "vta12": "validation", "vta13": "test"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "sequence_id string, x double")
    sinks.write_sequences(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("sequence_id = 'b'").count() == 1
    sinks.write_report(df.withColumn("l", F.array(F.lit(1))), str(tmp_path / "report"))
    assert '"x":null' in "".join(r.value for r in spark.read.text(str(tmp_path / "report/json")).collect())
    assert ingest.read_columns(spark, str(tmp_path / "out"), ["x", "absent"]).columns == ["x"]


def test_kind_by_headers_where_the_path_does_not_tell(spark, tmp_path):
    texts = {"drive1": "ACCELEROMETER X (m/s²),GYROSCOPE Yaw (rad/s),GPS SPEED (Kmh),MAGNETIC FIELD X (µT)\n1,2,3,4\n", "drive2": "Velocity (km/hr),Steering Angle,Engine Speed,Brake,Throttle,Latitude\n1,2,3,4,5,6\n", "drive3": "a,b\n1,2\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    files = ingest.scan_csv_tree(spark, str(tmp_path))
    kinds = {r.sequence_id: r.kind for r in ingest.read_sv_tables(files)[0].collect()}
    assert kinds == {r.sequence_id: r.kind for r in ingest.inventory(files).collect()}
    assert sorted(kinds.values()) == ["S", "UNKNOWN", "V"]
