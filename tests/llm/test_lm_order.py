from lodestone.llm import kneser, queries


def test_op8_scores_with_two_words_of_context(spark, tmp_path):
    texts = ["a x b", "c x d", "a x b", "c x d", "a x b c", "d c x d"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_lm_scoring(spark, str(tmp_path)).collect()}
    train = docs.join(spark.createDataFrame([(i,) for i, r in got.items() if not r.held_out], "doc_id long"), "doc_id")
    want = {n: {r.doc_id: r.score for r in kneser.score(docs, kneser.train(train, order=n)).collect()} for n in (2, 3)}
    assert all(abs(got[i].score - want[3][i]) < 1e-9 for i in got)
    assert any(abs(got[i].score - want[2][i]) > 1e-3 for i in got)
