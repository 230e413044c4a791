"""Hard-negative mining against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from odotrail.llm import hardneg

ROWS = "vec_id long, label int, embedding array<double>"


def brute(rows, anchors, k=5, take=3, low=50, high=95):
    """The contract, row by row, with Python's integers."""
    rows = [(i, lab, tuple(int(np.floor(256 * v)) for v in x)) for i, lab, x in dict.fromkeys((i, lab, None if x is None else tuple(x)) for i, lab, x in rows) if i is not None and lab is not None and x is not None and all(v is not None and np.isfinite(256 * v) for v in x)]
    out = []
    for a, label, x in rows:
        if not anchors(a):
            continue
        seen = [(max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(x, y, strict=True)))), i, lab) for i, lab, y in rows if len(y) == len(x)]
        once = lambda found: sorted({i: s for s, i in sorted(found)}.items(), key=lambda p: (-p[1], p[0]))
        for p, ps in once([(s, i) for s, i, lab in seen if lab == label and i != a])[:k]:
            inside = [(s, i) for s, i, lab in seen if lab != label and low * ps <= 100 * s <= high * ps]
            out += [(a, p, r + 1, n, ps, ns) for r, (n, ns) in enumerate(once(inside)[:take])]
    return sorted(out)


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, ROWS).withColumns({"id": F.lit("clash"), "score": F.lit(1)})
    return sorted(tuple(r) for r in hardneg.mine(df, anchors, **options).collect())


def test_products_of_all_widths():
    r = random.Random(2)
    for _ in range(60):
        d, bits = r.randint(1, 9), r.choice([1, 4, 9, 20, 40, 80])
        side = lambda: np.array([[r.randint(-(2**bits), 2**bits) + r.choice([0, 0, 2**bits]) for _ in range(d)] for _ in range(r.randint(1, 11))], object)
        a, c = side(), side()
        assert (hardneg.packed_products(a, c) == a @ c.T).all()
    assert hardneg.packed_products(np.zeros((2, 0), np.int64), np.zeros((3, 0), np.int64)).tolist() == [[0] * 3] * 2


def test_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = [(i, int(r.integers(0, 4)), r.normal(size=6).tolist()) for i in range(300)]
    rows += [(i, i % 3, [0.5, 0.25, 0.0, 0.0, 0.0, float(i % 2)]) for i in range(300, 400)]  # ties
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 100
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == want
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, group_bytes=800, slice_bytes=4000) == want


def test_one_vector_and_one_label_hold_most_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, 1 if i % 3 else 2, [1.0, 1.0]) for i in range(500)] + [(i, 1, r.normal(size=2).tolist()) for i in range(500, 900)]
    rows += [(i, 2, (r.normal(size=2) / 2 + 0.4).tolist()) for i in range(900, 950)]
    want = brute(rows, lambda i: i % 50 == 0)
    assert mined(spark, rows, F.col("vec_id") % 50 == 0) == want and len(want) > 50


def test_rows_that_take_no_part_and_repeats(spark):
    odd = [(None, 1, [1.0, 0.0]), (1, None, [1.0, 0.0]), (2, 1, None), (3, 1, [1.0, None]), (4, 1, [float("nan"), 0.0]), (5, 1, [float("inf"), 0.0]), (6, 1, [1e308, 0.0])]
    odd += [(7, 1, []), (8, 1, []), (9, 2, []), (10, 1, [1.0, 0.0, 0.0]), (11, 2, [0.6, 0.0, 0.0])]  # other lengths
    good = [(20, 1, [1.0, 0.0]), (21, 1, [0.9, 0.1]), (22, 2, [0.7, 0.0]), (23, 2, [0.6, 0.0]), (24, 2, [0.55, 0.5]), (25, 3, [0.95, 0.0])]
    again = good[:3] * 3 + [(22, 2, [0.8, 0.0]), (22, 1, [0.5, 0.0]), (20, 2, [0.6, 0.2]), (21, 1, [0.8, 0.0])]
    rows = odd + good + again
    want = brute(rows, lambda i: True)
    assert mined(spark, rows, F.lit(True)) == want and want
    assert mined(spark, odd[:7], F.lit(True)) == [] and mined(spark, [], F.lit(True)) == []


def test_huge_components(spark):
    r = np.random.default_rng(6)
    rows = [(i, i % 2, (r.normal(size=3) * 10.0 ** (i % 5 * 5)).tolist()) for i in range(80)]
    rows += [(100, 0, [1e200, 0.0, 0.0]), (101, 0, [1e150, 0.0, 0.0]), (102, 1, [-1e150, 0.0, 0.0])]
    want = brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, F.col("vec_id") % 5 == 0) == want and want
