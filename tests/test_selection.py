"""Exact percentiles by selection against Spark's percentile()."""

import random

from pyspark.sql import functions as F

from lodestone.operators import selection

SHARES = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p100": 1.0}


def test_percentiles_equal_the_aggregate(spark):
    r = random.Random(1)
    rows = [("wide", 10.0 ** r.uniform(-9, 9), 1) for _ in range(700)] + [("equal", 4.25, 2) for _ in range(300)] + [("ties", float(r.randrange(4)), None) for _ in range(301)]
    rows += [("one", 7.0, 1), ("two", 1.0, 1), ("two", 2.0, None), ("none", None, 1), (None, 3.0, 1), (None, 9.0, 2), ("some", None, 1), ("some", -5.0, 1)]
    df = spark.createDataFrame(rows, "name string, x double, y int")
    wanted = {**{k: (F.col("x"), p) for k, p in SHARES.items()}, "y90": (F.col("y"), 0.9)}
    plain = df.groupBy("name").agg(*[F.percentile("x", F.lit(p)).alias(k) for k, p in SHARES.items()], F.percentile("y", F.lit(0.9)).alias("y90"))
    want = {x["name"]: tuple(x)[1:] for x in plain.collect()}
    for few, buckets in ((4096, 1024), (5, 4), (1, 2)):
        got = {x["name"]: tuple(x)[1:] for x in selection.percentiles(df, wanted, ["name"], buckets, few).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert all(a == b or abs(a - b) <= 1e-12 * abs(b) for a, b in zip(got[k], v, strict=True)), (k, got[k], v)


def test_percentiles_of_all_rows_and_with_aggregates(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("x"), (F.col("id") % 3).alias("g"))
    got = selection.with_percentiles(df, [F.count("*").alias("n")], {"p95": (F.col("x"), 0.95)}).first()
    assert (got.n, got.p95) == (1000, df.agg(F.percentile("x", F.lit(0.95))).first()[0])
    by = selection.with_percentiles(df, [F.count("*").alias("n")], {"p50": (F.col("x"), 0.5)}, ["g"]).collect()
    want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("x", F.lit(0.5)).alias("m")).collect()}
    assert {r.g: r.p50 for r in by} == want and sum(r.n for r in by) == 1000
    empty = selection.with_percentiles(df.filter("false"), [F.count("*").alias("n")], {"p50": (F.col("x"), 0.5)}).first()
    assert (empty.n, empty.p50) == (0, None)
