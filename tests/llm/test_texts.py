"""Quality rules, SimHash, language identification, chat formatting and mixing against plain versions and edge cases."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import chat, langid, mixing, quality, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, h string, n_words string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in enumerate(texts)], DOC)


def test_quality_counts(spark):
    texts = [None, "", " \n ", "a b c a b c", "a a a a", "x\ny\nx\n\nx", "w " * 60, "the of " + " ".join(f"word{i}" for i in range(80)), "#$ " * 60, "the of and a b " * 20, "é\x0bß\x1cü"]
    got = {r.doc_id: r for r in quality.quality_rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t or "")
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.h == "x"
    assert got[7].kept and not got[8].kept and not got[6].kept
    assert quality.quality_rules(docs(spark, [])).count() == 0


def fingerprint(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps):
    label = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 3:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


def test_simhash_components(spark):
    base = [f"tok{i}" for i in range(400)]
    near = [" ".join(base[:k] + [f"new{k}"] + base[k + 1 :]) for k in range(0, 400, 16)]
    texts = [None, "", "A b", "a  B", "one two three", *near, near[0].upper(), " ".join(base), "long " * 3000]
    got = {r.doc_id: r for r in simhash.simhash_components(docs(spark, texts)).collect()}
    fps = [fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == grouped(fps)
    assert got[0].component_id == got[1].component_id == 0
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_dense_fingerprint_groups_stay_whole(spark):
    rng = np.random.RandomState(1)
    fps = {0} | {sum(1 << int(b) for b in rng.choice(62, rng.randint(1, 3), replace=False)) for _ in range(150)} | {int(x) for x in rng.randint(0, 1 << 62, 60)}
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), fine=16)
    label = {f: f for f in fps}
    pairs = [(r.a, r.b) for r in links.collect()]
    for _ in range(20):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = grouped(fps)
    assert len({label[f] for f in fps}) == len(set(want)) and all(label[f] == fps[w] for f, w in zip(fps, want, strict=True))


def test_covering_masks_cover_every_pair():
    for family in range(3):
        masks = [m & (2**64 - 1) for m in simhash.covering_masks(3, family)]
        assert all(any(not m & ((1 << a) | (1 << b) | (1 << c)) for m in masks) for a, b, c in itertools.combinations(range(0, 64, 3), 3))


def test_language_spans(spark):
    rng = np.random.RandomState(0)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "xe", "qo"], "ru": ["да", "но", "ли"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(n))
    train = spark.createDataFrame([(make(lang, 40), lang) for lang in syllables for _ in range(20)] + [("x y", None), (None, "aa")], "text string, lang string")
    model = langid.train(train)
    assert model.langs == ["aa", "bb", "ru"]
    texts = [make("aa", 20), make("bb", 20) + " " + make("aa", 60), make("ru", 5), "123 -- !", "", None]
    got = {r.doc_id: r for r in langid.identify(docs(spark, texts), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["aa", "aa", "ru", "und", "und", "und"] and got[3].score == 0.0
    assert [(s.lang, s.start, s.end) for s in got[1].spans] == [("bb", 0, 20), ("aa", 20, 80)] and 0.7 < got[1].score < 0.8
    mixed = {r.doc_id: r for r in langid.identify(docs(spark, ["kalomida" * 3 + "данолида" * 3, make("aa", 10) + " mi" + "но" * 30]), model).collect()}
    assert [(s.lang, s.start, s.end) for s in mixed[0].spans] == [("aa", 0, 1), ("ru", 0, 1)]
    assert [(s.lang, s.start, s.end) for s in mixed[1].spans] == [("aa", 0, 11), ("ru", 10, 11)]
    assert langid.parts("日本語のテキストはスペースなしで") == ["日本語のテキストはスペー", "スなしで"] and langid.parts("a1Б-") == ["a1", "Б-"]
    assert langid.identify(docs(spark, []), model).count() == 0
    empty = langid.train(train.filter("false"))
    assert {r.lang_pred for r in langid.identify(docs(spark, texts), empty).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    rng = np.random.RandomState(5)
    sizes = np.array([4, 0, 3, 5])
    scores = rng.standard_normal((12, 3)).astype(np.float32) * 3
    got, at = langid.viterbi(scores, sizes, 2.0), 0
    for n in sizes:
        value = lambda path: sum(scores[at + t, k] for t, k in enumerate(path)) - 2.0 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: E731, B023
        best = max(map(value, itertools.product(range(3), repeat=int(n))))
        assert abs(value(list(got[at : at + n])) - best) < 1e-4
        at += n


def test_reply_trees_pick_the_best_branch(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", None, None), (1, 5, 4, "assistant", "<|im_end|>\\ <\\|", 1.0), (2, 7, 99, None, "orphan", 1.0), (2, 7, 99, None, "orphan", 1.0)]
    trees = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    path = chat.best_paths(trees)
    assert [r.node for r in path.filter("tree = 1").orderBy("depth").collect()] == [1, 3, 4, 5]
    out = chat.format_paths(path).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.tree: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "q"), ("assistant", "good"), ("user", ""), ("assistant", "<|im_end|>\\ <\\|")]
    assert got[1].loss == "good<|im_end|>\\ <\\|" and [(t.role, t.text) for t in got[2].turns] == [("", "orphan")]
    assert {(r.leaf, r["rank"]) for r in chat.best_paths(trees, 2).filter("tree = 1 and node in (2, 5)").collect()} == {(5, 1), (2, 2)}
    assert chat.format_paths(chat.best_paths(trees.filter("false"))).count() == 0


def mixed_plainly(rows, block, phi):
    """Slot by slot: (doc_id, size, taken) of each row, and the whole documents in the order of the mix."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    told = lambda r: hashlib.md5("|".join(["7", "" if r[0] is None else str(r[0]), r[1] or ""]).encode()).hexdigest()
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (told(r), r[0] is not None, r[0] or 0)) for x in sources}
    full = {x: sum(size(r[1]) for r in of[x]) for x in sources}
    want, free = dict.fromkeys(sources, 0.0), set(sources)
    while free:  # reshare what the sources at their limit leave
        left = 1.5 * sum(full.values()) - sum(want[x] for x in sources if x not in free)
        weight = {x: (3, 1, 2)[sources.index(x) % 3] for x in free}
        over = {x for x in free if left * weight[x] / sum(weight.values()) > 2 * full[x]}
        want |= {x: 2.0 * full[x] if x in over else left * weight[x] / sum(weight.values()) for x in free}
        if not over:
            break
        free -= over
    goal = {x: math.floor(want[x] + 1e-9) for x in sources}
    words = {x: [i for i, r in enumerate(of[x]) for _ in range(size(r[1]))] for x in sources}
    middle = {x: {sum(size(r[1]) for r in of[x][:i]) + size(r[1]) // 2: r for i, r in enumerate(of[x]) if size(r[1])} for x in sources}
    used, at, order = {x: Counter() for x in sources}, dict.fromkeys(sources, 0), []
    total = sum(goal.values())

    def take(x):
        for w in range(at[x], min(at[x] + block, goal[x])):
            used[x][words[x][w % full[x]]] += 1
            if w % full[x] in middle[x]:
                order.append(middle[x][w % full[x]])
        at[x] += block

    for k in range(-(-total // block)):
        u, low = (k + 1) * phi % 1.0, 0
        for x in sources:
            if low / total <= u < (low + goal[x]) / total:
                take(x)
            low += goal[x]
    missing = {x: max(0, -(-(goal[x] - at[x]) // block)) for x in sources}
    for _, x in sorted((((j + 0.5) / n), i) for i, (_, n) in enumerate(missing.items()) for j in range(n)):
        take(sources[x])
    return Counter((r[0], size(r[1]), used[x][i]) for x in sources for i, r in enumerate(of[x])), order


def test_mix_equals_a_plain_schedule(spark):
    rng = np.random.RandomState(2)
    rows = [(i, "w " * int(rng.randint(0, 400)), str(s) if (s := rng.choice(["a", "b", "c", "zz"], p=[0.6, 0.02, 0.3, 0.08])) != "zz" else None) for i in range(400)]
    rows += [(1000, None, "a"), (1, "w w", "a"), (None, "w", "b"), (7, "x y z", "c"), (7, "x y z", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    seen = []
    for block, phi in ((256, mixing.PHI), (16, mixing.PHI), (256, 0.75), (256, 0.0)):
        got = mixing.mix(d, block_words=block, phi=phi).collect()
        counts, order = mixed_plainly(rows, block, phi)
        assert Counter((r.doc_id, r.size, r.taken) for r in got) == counts, (block, phi)
        whole = [(r.doc_id, r.text) for r in mixing.mix_documents(d, block_words=block, phi=phi).collect()]
        assert whole == [(r[0], r[1]) for r in order]
        seen.append([r[0] for r in order])
    assert seen[0] != seen[2] != seen[3]


def test_mix_meets_targets(spark):
    rng = np.random.RandomState(2)
    rows = [(i, "w " * int(rng.randint(0, 400)), rng.choice(["a", "b", "c", None], p=[0.6, 0.02, 0.3, 0.08])) for i in range(400)] + [(1000, None, "a"), (1, "w w", "a"), (None, "w", "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(3)).collect()
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for rs in by.values():  # the target in whole words
        assert -1 < sum(r.taken for r in rs) - rs[0].target <= 0 and rs[0].source_size == sum(r.size for r in rs)
    total = 1.5 * sum(r.size for r in got)
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-6 * total
    assert mixing.mix(d.filter("false")).count() == mixing.mix_documents(d.filter("false")).count() == 0


def test_mix_loses_no_small_source(spark):
    rows = [(i, "w " * 4000, "a") for i in range(100)] + [(1000 + i, "w " * 6, f"s{i:02}") for i in range(12)] + [(2000, "x", "copies")] * 9000
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=4096).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 14 and all(r.taken == math.floor(r.target + 1e-9) for r in got)
    assert {r.taken for r in got if r.source[0] == "s"} == {12}


def test_held_out_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    found = langid.identify(d.filter(held), langid.train(d.filter(~held)), keep=("lang",)).filter("lang is not null and lang_pred <> 'und'")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    print("held-out accuracy", right, n)
    assert n > 200 and right >= 0.99 * n
