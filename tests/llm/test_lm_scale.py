import os
import random

import numpy as np
import pytest

from lodestone.llm import kneser


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_an_n_gram_of_rare_words_takes_few_bytes():
    rng = np.random.RandomState(1)
    grams = np.sort(rng.randint(0, 1_000_000, (3, 20_000)), axis=1).astype(np.uint64)
    grams[[0, 2]] = rng.randint(0, 1_000_000, (2, 20_000))
    assert len(kneser._pack(grams, np.ones((1, 20_000), dtype=np.int64))) < 9 * 20_000


def test_a_shard_is_one_file(spark, tmp_path):
    r = random.Random(2)
    texts = [" ".join(f"w{r.randint(0, 400)}" for _ in range(30)) for _ in range(100)]
    kneser.train(_docs(spark, texts), order=3, shards=64, keep=f"file://{tmp_path}/model")
    assert len(os.listdir(f"{tmp_path}/model")) < 2 * 64


@pytest.mark.parametrize("order", [2, 3])
def test_spread_words_leave_the_scores_as_they_are(spark, monkeypatch, order):
    r = random.Random(order)
    texts = [" ".join(r.choice(["the", "of", f"w{r.randint(0, 200)}"]) for _ in range(r.randint(0, 40))) for _ in range(150)]
    asked = _docs(spark, [*texts, "the unseen of the w1 unseen unseen the", "of of of", "unseen", None, "the the unseen2 the"])
    found = []
    for wide in (1e9, 0.005):
        monkeypatch.setattr(kneser, "WIDE", wide)
        model = kneser.train(_docs(spark, texts), order=order, shards=40)
        assert bool(len(model.wide[0][0])) == (wide < 1)
        found.append((model.discounts, model.unigrams, sorted(map(tuple, kneser.score(asked, model).collect()))))
    assert found[0] == found[1]
