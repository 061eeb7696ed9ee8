from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.plans import texts

ODD = [None, "", " the ", "Été été ETE the", "ΑΣ ΑΣΒ İstanbul i̇stanbul", "Đường đường duong a b", "[EC_001] 1. of EC_002 x\n- 2) y z", "đ Đ d _ __ 12 १२", "à a ä the une"]


def test_sets_of_distinct_tokens_equal_those_of_whole_texts(spark):
    t = F.col("t")
    base = F.filter(text._without(text.tokens(F.trim(F.coalesce(t, F.lit("")))), texts.STOP), lambda w: F.length(w) > 1)
    plain = F.array_union(base, F.transform(base, text.fold_vowels))
    folded = F.array_distinct(F.filter(text._without(text.tokens(text.fold_vowels(F.coalesce(t, F.lit("")))), texts.STOP), lambda w: F.length(w) > 1))
    rows = spark.createDataFrame([(x,) for x in ODD], "t string").select(
        text.subject_tokens(t, texts.STOP, ()).alias("a"), plain.alias("b"), text.distinctive_tokens(t, texts.STOP, ()).alias("c"), folded.alias("d"), text.pairs_of(text.tokens(t)).alias("e"), text.runs_of(text.tokens(t), 2).alias("f")
    )
    assert [(r.a, r.c, r.e) for r in rows.collect()] == [(r.b, r.d, r.f) for r in rows.collect()]


def test_token_counts_cuts_the_texts_into_tokens_twice(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = texts.token_counts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2
