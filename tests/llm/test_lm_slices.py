import pyarrow as pa

from lodestone.llm import kneser


def test_slices_of_texts_have_the_tokens_of_the_texts():
    texts = pa.array([f"A{i} b{i % 7}\n C{'x' * (i % 3)}" for i in range(5000)])
    whole, sizes = kneser.hashes(texts)
    for begin in range(0, len(texts), 2000):
        some, n = kneser.hashes(texts.slice(begin, 2000))
        first = sizes[:begin].sum()
        assert n.tolist() == sizes[begin : begin + 2000].tolist()
        assert some.tolist() == whole[first : first + len(some)].tolist()


def test_a_task_with_more_rows_than_a_slice_counts_all_tokens(spark, tmp_path):
    texts = [f"Word{i % 50} other{i} end" for i in range(4500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = kneser.train(docs, order=3)
    assert (model.tokens, model.words) == (4 * 4500, 4500 + 52)
    assert {(r.n_tokens, r.n_known) for r in kneser.score(docs, model).collect()} == {(4, 4)}
