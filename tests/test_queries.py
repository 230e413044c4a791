"""Every registered query of the library's own operators runs, and equals its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

from odotrail.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 3)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, records):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    relation = duck.sql(registry.SQL[name])
    want = rows(relation.columns, relation.fetchall())
    assert sorted(df.columns) == sorted(relation.columns)
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-3) for a, b in zip(g, w, strict=True))]
    assert not different[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_properties(spark, sf_dir, name):
    """What no SQL can say: rows are there, once each, and hold numbers."""
    found = registry.QUERIES[name](spark, sf_dir).collect()
    assert found
    numbers = [v for x in found for v in x if isinstance(v, float)]
    assert numbers or name == "mode_fsm_fold"
    assert all(map(math.isfinite, numbers))
    keys = [k for k in ("track_id", "sequence_id", "row_idx") if k in found[0].__fields__]
    if "row_idx" in keys:
        assert len({tuple(x[k] for k in keys) for x in found}) == len(found)
    if name.startswith(("fusion", "navigation")):
        by = {}
        for x in found:
            by.setdefault(x.track_id, []).append(x)
        for rows_of in by.values():
            first = [x.final_lat is None for x in rows_of]
            assert not all(first) and (name == "fusion_outage" or not any(first)) and all(x["mode"] for x in rows_of)
            assert all((x.final_lat is None) == (x.final_lon is None) and (x.final_lat is None or -90 <= x.final_lat <= 90) for x in rows_of)
    if name == "fusion_outage":
        assert any(x.lat is None and x.final_lat is not None for x in found)
    if name == "isolation_forest":
        assert all(-0.5 <= x.drift_score <= 0.5 for x in found) and any(x.drift_detected for x in found) and not all(x.drift_detected for x in found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
