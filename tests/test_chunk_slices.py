from pyspark.sql import functions as F

from lodestone.operators import chunking


def test_a_worker_holds_a_slice_of_long_texts(spark):
    texts = [None, "", "short", "é" * 50] + [f"{i} one\n{'two ' * (i % 40)}\n\nthree {i}\nfour" for i in range(1000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    got = rows.select("i", chunking.split_long(F.col("text"), 50, 9, rows=64).alias("parts"))
    want = {i: None if t is None else chunking.pack_paragraphs(t, 50, 9) for i, t in enumerate(texts)}
    assert {r.i: r.parts for r in got.collect()} == want
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()
