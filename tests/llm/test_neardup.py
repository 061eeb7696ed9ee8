import itertools
import random

import corpus_pipeline
import numpy as np
import pytest
from lodestone.llm import neardup

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(n=60, size=300):
    """Bases and for each a copy with single words replaced, from a similarity of 0.8 up to 0.95, and one below 0.7."""
    r = random.Random(5)
    rows = []
    for i in range(n):
        base = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
        near, far = list(base), list(base)
        least = 0.8 + 0.15 * i / (n - 1)
        for k in r.sample(range(size), size):
            more = [*near[:k], f"new{k}", *near[k + 1 :]]
            if alike(" ".join(base), " ".join(more)) < least:
                break
            near = more
        for k in r.sample(range(size), size // 10):
            far[k] = f"far{i}x{k}"
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    return rows


def test_near_copies_at_080_to_095_go_and_others_stay(spark):
    rows = planted()
    texts = dict(rows)
    assert all(0.8 <= alike(texts[i], texts[i + 1]) < 0.97 for i in range(0, len(rows), 3))
    assert all(alike(texts[i + k], texts[i + 2]) < 0.8 for i in range(0, len(rows), 3) for k in (0, 1))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOC)
    kept = sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect())
    assert kept == [i for i, _ in rows if i % 3 != 1]


def test_members_unlike_the_leader_are_still_compared(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(40):  # each differs from all before it a bit more: ends of the chain are unlike, neighbours alike
        base = list(base)
        base[r.randrange(200)] = f"c{i}"
        texts.append(" ".join(base))
    texts += ["", None, "one two", "ONE two", "q " * 50]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOC)
    groups = {r.doc_id: r.group for r in neardup.near_groups(docs).collect()}
    assert len(groups) == len(texts) and len({groups[i] for i in range(40)}) == 1
    assert groups[40] == groups[41] and groups[42] == groups[43] and len(set(groups.values())) == 4
    assert neardup.near_groups(docs.filter("false")).count() == 0


def test_masks_of_a_part_cover_its_radius():
    for width, radius in ((16, 2), (20, 3), (32, 3)):
        masks = neardup.part_masks(width, radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and all(0 < m < 1 << width for m in masks)
        assert all(any(not m & sum(1 << i for i in at) for m in masks) for at in itertools.combinations(range(width), radius))


@pytest.mark.parametrize(("n", "block"), [(1000, 4096), (20_000_000, 4096), (10**10, 4096), (1000, 32)])
def test_covers_of_any_size_find_pairs_at_the_threshold(spark, n, block):
    share, rng = neardup.differing(0.8), np.random.RandomState(8)
    cover = neardup.choose_cover(n, share, 0.01)
    one = rng.randint(0, 1 << 62, (500, cover.words))
    flips = (rng.rand(500, cover.words, 64) < share) @ (1 << np.arange(64, dtype=np.uint64))
    rows = [(int(2 * i + k), int(2 * i + k), *(x if k == 0 else (x.astype(np.uint64) ^ flips[i].astype(np.uint64)).astype(np.int64)).tolist()) for i, x in enumerate(one) for k in (0, 1)]
    nodes = spark.createDataFrame(rows, "node long, group long, " + ", ".join(f"f{i} long" for i in range(cover.words)))
    sets = spark.range(1000).selectExpr("id as node", "transform(sequence(0, 8), k -> if(k = 8 and id % 2 = 1, 3 * id + 1, 2 * id - 2 * (id % 2) + 1000000 * k)) as s")
    folder = neardup.scratch(spark, "sets")  # the sets of a pair have 8 of 10 in common
    neardup.write_sets(sets, folder, 7)
    for verify in (None, neardup.Verify(folder, 7, 0.8, neardup.tables(cover))):
        found = {(r.a, r.b) for r in neardup.candidate_pairs(nodes, cover, share, verify, block).collect()}
        assert len({(2 * i, 2 * i + 1) for i in range(500)} & found) >= 485 and len(found) < 600
    assert neardup.candidate_pairs(nodes, cover, share, neardup.Verify(folder, 7, 0.81, neardup.tables(cover)), block).count() == 0
