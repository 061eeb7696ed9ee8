"""Exact top-k search and hard negatives against all pairs in plain Python, and their edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import exacttopk, grid, hardneg

VEC = "vec_id long, embedding array<float>, label int, uid string, v string, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, b, "x", "y", "z", "w") for i, e, b in rows], VEC)


def odd_rows(n=150, dims=11, seed=3):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.4))) for _ in range(dims)], r.randrange(3)) for i in range(n)]
    rows += [rows[10], rows[10], (200, rows[20][1], rows[20][2]), (None, rows[10][1], rows[10][2]), (None, rows[10][1], 1)]
    rows += [(300, None, 1), (310, [None] * dims, 1), (320, [math.nan] * dims, 1), (330, [math.inf] + [0.0] * (dims - 1), 0), (340, [], 1), (350, rows[3][1][:4], 1)]
    rows += [(360, [0.0] * dims, 2), (370, [1e30] + [0.0] * (dims - 1), 1), (380, rows[4][1], None), (390, [-0.001] * dims, 0), (400, [3.0] * dims, 0)]
    return rows


def whole(rows):
    fit = [(i, e, b) for i, e, b in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    hold = lambda x: max(-grid.BOUND, min(grid.BOUND, x))
    return [(i, [hold(math.floor(256 * float(np.float32(x)))) for x in e], b) for i, e, b in fit]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def order(row):
    return (-row[0], row[1] is None, row[1] or 0)


def test_exact_top_k(spark):
    rows = odd_rows()
    fit = whole(rows)
    want = []
    for a, (i, e, _) in enumerate(fit):
        if i is not None and i % 10 == 0:
            found = sorted([(dot(e, f), j) for b, (j, f, _) in enumerate(fit) if a != b], key=order)[:5]
            want += [(i, k + 1, j, s) for k, (s, j) in enumerate(found)]
    for small in ({}, {"query_numbers": 128, "row_numbers": 2048}):  # many blocks of both
        got = exacttopk.exact_top_k(table(spark, rows), F.col("vec_id") % 10 == 0, **small)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert exacttopk.exact_top_k(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert exacttopk.exact_top_k(table(spark, rows[:1]), F.col("vec_id") % 10 == 0).count() == 0  # no other row


def test_hard_negatives(spark):
    rows = odd_rows()
    fit = [r for r in whole(rows) if r[2] is not None]
    want = []
    for a, (i, e, label) in enumerate(fit):
        if i is None or i % 10:
            continue
        scored = [(dot(e, f), j, b) for k, (j, f, b) in enumerate(fit) if k != a]
        for p, j, b in sorted([x for x in scored if x[2] == label], key=order)[:5]:
            far = sorted([x for x in scored if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p], key=order)[:5]
            want += [(i, j, k + 1, x[1], p, x[0]) for k, x in enumerate(far)]
    assert len(want) > 20
    for small in ({}, {"query_numbers": 128, "row_numbers": 2048}):
        got = hardneg.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, **small)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert hardneg.hard_negatives(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_four_russians_scores():
    r = np.random.RandomState(1)
    for dims, most in ((1, 3), (8, 300), (13, 2**24), (64, 1)):
        rows, anchors = r.randint(-most, most + 1, (50, dims)), r.randint(-most, most + 1, (7, dims))
        assert (hardneg.look_up(hardneg.subset_sums(anchors), hardneg.bit_planes(rows)) == rows @ anchors.T).all()
        lists = exacttopk.postings(rows)
        assert all((exacttopk.accumulate(a, lists, 50) == rows @ a).all() for a in anchors)
    assert len(hardneg.bit_planes(np.array([[-256, 255]]))) == 9


def test_best_first_ties():
    scores, ids, unnamed = np.array([5, 9, 5, 9, 5]), np.array([4, 0, 2, 7, 1]), np.array([False, True, False, False, False])
    assert list(grid.best_first(scores, ids, unnamed, 3)) == [3, 1, 4]
    assert list(grid.best_first(scores, ids, unnamed, 9)) == [3, 1, 4, 2, 0]
