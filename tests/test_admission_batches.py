import random

from lodestone.streaming import jobs


def test_segments_go_on_over_batches_and_no_group_is_held(spark):
    pick, before = random.Random(3), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    hits = [(i, pick.choice([None, float("nan"), 1.0, 2.0]), pick.randrange(4000) / 10) for i in range(2000)]
    df = spark.createDataFrame(hits, "event_id long, client double, s double").selectExpr("event_id", "client", "timestamp_micros(cast(s * 1e6 as long)) as ts")
    want = {}
    for c in ("None", "nan", "1.0", "2.0"):
        own = sorted((round(t * 1e6), i) for i, k, t in hits if str(k) == c)
        want |= dict(zip([i for _, i in own], jobs.admit([t for t, _ in own], 3, 10_000_000)[0], strict=True))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = jobs.admission_batch(df, 3, 10.0)
        assert {r.event_id: r.allowed for r in out.collect()} == want and not all(want.values())
        plan = out._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "InPandas" not in plan  # no call for each segment
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
