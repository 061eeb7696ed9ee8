from pyspark.sql import functions as F

from lodestone.llm import chat


def test_repeated_tied_and_null_turns_all_count(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "user", "long text"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, 2, "user", "c"),
        (2, None, "user", "lost"), (2, 0, "user", "d"), (2, None, "assistant", "also"),
        (None, 0, "user", "e"), (None, 0, "user", None),
    ]
    trees = chat.linear_parents(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_paths(chat.best_paths(trees)).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {r.tree: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == {
        1: [("user", "a"), ("assistant", "b"), ("assistant", "b"), ("user", "long text"), ("user", "c")],
        2: [("user", "d"), ("assistant", "also"), ("user", "lost")],
        None: [("user", ""), ("user", "e")],
    }
