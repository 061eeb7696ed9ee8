"""Importance resampling against a plain version: every run of words hashed on its own, counted and ranked in Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, uid string, keys string, score string, weight string, n string"


def features(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(docs, target, buckets, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, features(text)[1]))
    for text in target:
        t.update(map(of, features(text)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        w, f = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(x)] for x in f)
        out.append([i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "straße", "日本", "x" * 70, "Y" * 200, "a\x00b", "UPPER", "don't", "7"]
    line = lambda n: r.choice([" ", "  ", ", "]).join(r.choice(vocabulary) for _ in range(n))
    shared = [line(r.randrange(0, 9)) for _ in range(6)]
    docs = [(i, "\n".join(r.choice([line(r.randrange(0, 12)), r.choice(shared), r.choice(shared)]) for _ in range(r.randrange(1, 9)))) for i in range(300)]
    docs += [docs[7], docs[7], (None, docs[8][1]), (None, docs[8][1]), (400, None), (401, ""), (402, "\n\n"), (403, "one"), (404, "one\ntwo"), (405, "one\ntwo\n\n;\nthree four"), (406, "a b\r\nc d"), (407, shared[0] * 3000)]
    return docs, [shared[1], shared[2], None, "w1 w2 w3\nw4 W5"]


@pytest.mark.parametrize("percent, buckets", [(5, 10_000), (60, 100_000), (100, 7)])
def test_resample(spark, percent, buckets):
    docs, target = corpus()
    table = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in docs], DOC)
    got = importance.resample(table, spark.createDataFrame([(t, 1) for t in target], "text string, n int"), buckets=buckets, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, target, buckets, percent, 20)


def test_empty_tables(spark):
    docs, target = corpus()
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(docs[:40], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    got = importance.resample(some, none.select("text"), percent=50)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs[:40], [], 10_000, 50, 20)


def test_checksums_of_joined_strings():
    r = np.random.RandomState(2)
    parts = [bytes(r.randint(0, 256, n).astype(np.uint8)) for n in (0, 1, 2, 63, 64, 65, 300, 5000)]
    for a in parts:
        first = np.full(len(parts), zlib.crc32(a), dtype=np.uint32)
        second = np.array([zlib.crc32(b) for b in parts], dtype=np.uint32)
        got = importance.joined_crc(first, second, np.array([len(b) for b in parts]))
        assert got.tolist() == [zlib.crc32(a + b) for b in parts]


def test_words_of_a_sliced_batch():
    texts = pa.array(["skip me", "ab cd", None, "", "ef", "gh-ij\nkl"])[1:]
    w = importance.Words(texts)
    assert [w.buffer[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == ["ab", "cd", "ef", "gh", "ij", "kl"]
    assert w.text.tolist() == [0, 0, 3, 4, 4, 4] and w.counts().tolist() == [2, 0, 0, 1, 3]
