"""Token counts, token files, pieces, n-gram scores and vector links against plain versions and edge cases."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import capfilter, editcount, kneser, pieces, tokenfile

TEXTS = [None, "", "  ", "Hello hello, world!\n\nHello", "İ ΣΑΣ á é don't <|endoftext|> 12,3 \x01 a\x01b", "日本語 😀 ▁x", "x" * 5000, "the cat the cat the dog " * 50, "the cat the cat the dog " * 50]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3, t, "z", "q") for i, t in enumerate(texts)], "doc_id long, text string, ids string, start string")


def test_edits_equal_a_full_count(spark):
    c = editcount.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(3)
    some = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "1", ".", "é", "日", "\x1c", "\x85", " the", "ll", "'ll"]
    draw = lambda n: "".join(r.choice(some) for _ in range(n))
    for _ in range(300):
        d = editcount.Document.build(draw(r.choice([0, 1, 5, 50, 200])), c, per_leaf=r.choice([1, 2, 8]))
        for _ in range(5):
            pos, gone, new = r.randint(-1, len(d.text) + 2), r.choice([0, 1, 3, 20]), draw(r.choice([0, 1, 4]))
            at = min(max(pos, 0), len(d.text))
            want = d.text[:at] + new + d.text[at + gone :]
            d.edit(pos, gone, new)
            assert d.text == want and d.n_tokens == len(c.encoding.encode_ordinary(want)) and d.chars[1] == len(want)
    from pyspark.sql import functions as F

    ranks = P.path("byte_bpe_50k.tiktoken")
    df = docs(spark).withColumn("edits", editcount.derived_edits(F.col("doc_id"), F.col("text")))
    out = editcount.apply_edits(editcount.build_trees(df, ranks, P.PATTERN, keep=("edits",)), ranks, P.PATTERN).collect()
    assert len(out) == len(TEXTS) and all(x.n_tokens == len(c.encoding.encode_ordinary(x.text)) for x in out)
    big = next(x for x in out if x.doc_id == 21)
    assert 0 < big.n_reencoded < big.n_tokens_before


def test_an_edit_after_a_large_insertion_is_cheap():
    c = editcount.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    d = editcount.Document.build("a short text to begin with", c)
    d.edit(7, 0, " many words" * 50_000)
    grown = d.encoded
    for k, pos in enumerate((300_000, 5, len(d.text) - 3, 123_456)):
        d.edit(pos, 1, "xy")
        assert d.encoded - grown < 200 * (k + 1)
    d.edit(0, len(d.text), "")
    d.edit(0, 0, "again")
    assert d.text == "again" and d.n_tokens == len(c.encoding.encode_ordinary("again"))


def test_edits_of_empty_tables_and_null_fields(spark):
    ranks = P.path("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "ab cd", [(None, None, "x"), (2, None, None), None]), (None, None, None), (2, "", [(5, 9, "new")])], f"doc_id long, text string, edits array<{editcount.EDIT}>")
    got = editcount.apply_edits(editcount.build_trees(df, ranks, P.PATTERN, keep=("edits",)), ranks, P.PATTERN)
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "xab cd"), (None, ""), (2, "new")}
    assert editcount.apply_edits(editcount.build_trees(df.filter("false"), ranks, P.PATTERN, keep=("edits",)), ranks, P.PATTERN).count() == 0


def test_token_files_round_trip(spark):
    path = P.path("word_bpe_49k.json")
    d = docs(spark).unionByName(docs(spark, ["twice"])).unionByName(docs(spark, ["none"]).selectExpr("cast(null as long) as doc_id", "text", "ids", "start"))
    words = tokenfile.survey(d, path, 2)
    blocks = tokenfile.write_blocks(d, path, 2, words, block_docs=3)
    got = tokenfile.read_index(blocks, words).orderBy("start").collect()
    whole, at = Tokenizer.from_file(path), 0
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda x: (x is not None, x)) and len(got) == len(TEXTS) + 2
    texts = defaultdict(list)
    for r in d.collect():
        texts[r.doc_id].append(whole.encode(r.text or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r.start == at and any(r.n_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in texts[r.doc_id])
        at += r.n_tokens
    b = blocks.filter("n_docs = 3").first()
    block = tokenfile.Block.open(b.data, tokenfile.Codec(words.dictionary))
    assert block.read(2).tolist() in texts[block.ids[2]]
    with pytest.raises(ValueError):
        tokenfile.Block.open(b.data, tokenfile.Codec(b""))
    none = d.filter("false")
    assert tokenfile.read_index(tokenfile.write_blocks(none, path, 2, tokenfile.survey(none, path, 2)), words).count() == 0
    parted = tokenfile.read_index(tokenfile.write_blocks(d, path, 2, words, part_bytes=(1000, 1000)), words).orderBy("start").collect()
    assert sorted((r.start, r.n_tokens) for r in parted) == sorted((r.start, r.n_tokens) for r in got)


def test_words_have_the_ids_of_whole_texts():
    r = random.Random(1)
    bits = ["a", "B", "Zq", "'s", "'S", "'", "re", "1", "é", "É", "İ", "ı", "日", "\x1c", "\x85", "\x01", " ", "  ", "\n", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "ß", "K", "H\u0331", "\u0331", "\xa0", "ǅ", "-", "...", "_", "Ⱥ", "ﬁ"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(5000)]
    for name, wordwise in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        e = tokenfile.WordEncoder(P.path(name))
        ids, sizes = e.encode(pa.array(texts), 2)
        assert e.wordwise == wordwise and [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_pieces_have_the_best_scores(spark):
    path = P.path("piece_bpe_32k.model")
    e = pieces.Encoder(pieces.Pieces.read(path))
    public = sentencepiece.SentencePieceProcessor(model_file=path)
    score = np.array(e.pieces.scores)
    r = random.Random(6)
    drawn = ["".join(r.choice("aeinrst  ▁\néß日😀\t.,Th") for _ in range(r.randint(1, 60))).replace("▁", "") for _ in range(150)]
    for t in ("hello there", "banana  split\n\tx", "ünïcode 日 ab", "weitergehende" * 400, *filter(None, drawn)):
        ids, text = e.encode(t), "▁" + t.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(text)  # every piece that ends at each place, by slices
        known = {p: s for p, s in zip(e.pieces.texts, e.pieces.scores, strict=True) if p}
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - 48), end):
                if text[begin:end] in known:
                    best[end] = max(best[end], best[begin] + known[text[begin:end]])
            if text[end - 1] not in e.single:
                best[end] = max(best[end], best[end - 1] + e.unknown_score)
        n_unknown = sum(c not in e.single for c in text)
        plain = [i for i in ids if i not in set(e.pieces.bytes_at)]
        assert abs(score[plain].sum() + n_unknown * e.unknown_score - best[-1]) < 1e-6 * abs(best[-1])
        assert public.decode(ids.tolist()) == t == e.decode(ids)
    got = {r.doc_id: r for r in pieces.encode_with_check(docs(spark), path).collect()}
    assert got[0].n_pieces == got[3].n_pieces == 0 and all(r.round_trip for r in got.values())
    assert pieces.encode_with_check(docs(spark, []), path).count() == pieces.encode(docs(spark, []), path).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs(spark), path), path).collect()}
    assert [back[i * 3] for i in range(len(TEXTS))] == [(t or "").replace("▁", " ") for t in TEXTS]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney_equals_a_plain_model(spark, order):
    r = random.Random(order)
    texts = [" ".join(r.choice("abcdefgh") + r.choice(["", "", "x", "y"]) for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, ""]
    model = kneser.train(docs(spark, texts), order=order)
    got = {x.doc_id: x for x in kneser.score(docs(spark, [*texts, "a b new words A"]), model).collect()}
    grams = [Counter() for _ in range(order + 1)]
    tokens = [[*(t or "").lower().split(), "</s>"] for t in texts]
    for w in tokens:
        padded = ["<s>"] * (order - 1) + w
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(w)))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discounts = [None]
    for g in grams[1:]:
        discounts.append((0, *kneser._discounts(*[sum(c == k for c in g.values()) for k in (1, 2, 3, 4)])))
    vocabulary = len({x for w in tokens for x in w})

    def p(gram):
        n = len(gram)
        ctx = [c for g, c in grams[n].items() if g[:-1] == gram[:-1]]
        lower = p(gram[1:]) if n > 1 else 1 / (vocabulary + 1)
        if not ctx:
            return lower
        d, c = discounts[n], grams[n][gram]
        return max(c - d[min(c, 3)], 0) / sum(ctx) + sum(d[min(x, 3)] for x in ctx) / sum(ctx) * lower

    for i, t in enumerate([*texts, "a b new words A"]):
        w = ["<s>"] * (order - 1) + [*(t or "").lower().split(), "</s>"]
        want = sum(math.log10(p(tuple(w[k : k + order]))) for k in range(len(w) - order + 1))
        assert abs(got[i * 3].score - want) < 1e-6 * max(1, abs(want)), (i, t)
    assert model.tokens == sum(map(len, tokens)) and model.words == vocabulary


def test_scores_are_finite_where_fours_are_more_than_threes(spark):
    texts = [f"a{i} b{i}" for i in range(40) for _ in range(4)] + ["c d", "c d", "c e", "f g", "h i j", "h i j", "h i j"]
    for order in (2, 3):
        model = kneser.train(docs(spark, texts), order=order)
        assert all(d > 0 for x in model.discounts for d in x)
        scores = [r.score for r in kneser.score(docs(spark, ["a1 b2", "a1 b1", "zzz", "c b7 d", None]), model).collect()]
        assert all(map(math.isfinite, scores)) and len(scores) == 5


def test_frequent_contexts_are_spread_and_counts_have_no_cap(spark, monkeypatch):
    r = random.Random(4)
    texts = ["the " + " ".join(r.choice(["the", f"w{r.randint(0, 300)}"]) for _ in range(40)) for _ in range(80)] + ["x x"] * 700
    want = kneser.score(docs(spark, texts), kneser.train(docs(spark, texts), order=3, shards=8, sample=1)).collect()
    monkeypatch.setattr(kneser, "WIDE", 0.005)
    model = kneser.train(docs(spark, texts), order=3, shards=8)
    assert all(len(h) for h, _ in model.wide)
    got = {x.doc_id: x.score for x in kneser.score(docs(spark, texts), model).collect()}
    assert all(abs(got[x.doc_id] - x.score) < 1e-9 * max(1, abs(x.score)) for x in want)
    many = np.array([[3, 1 << 40, 254, 255], [1, 2, 3, 4]])
    grams = np.arange(8, dtype=np.uint64).reshape(2, 4)
    back = kneser._unpack(kneser._pack(grams, many))
    assert (back[0] == grams).all() and (back[1] == many).all()
    none = docs(spark, [])
    assert kneser.score(docs(spark, [None, "a"]), kneser.train(none, order=3)).count() == 2 and kneser.score(none, model).count() == 0


def test_vector_links_equal_all_pairs(spark):
    rng = np.random.RandomState(4)
    base = rng.standard_normal((8, 32))
    rows = []
    for i in range(160):
        v = base[rng.randint(8)] + rng.standard_normal(32) * rng.choice([0.0, 0.08, 0.15, 1.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.randint(2))))
    odd = [(500, None, 1), (501, [], 1), (502, [0.0] * 32, 1), (503, [float("nan")] * 32, 1), (504, [1.0, None], 1), (505, rows[0][1], None), (506, rows[0][1], rows[0][2]), (507, [1.0] * 8, 1), (508, [1.0] * 8, 1), (0, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    for block in (512, 7):
        got = capfilter.near_vectors(df, block=block).collect()
        assert len(got) == len(rows) + len(odd)
        every = rows + odd
        links = defaultdict(set)
        for i, (_, a, la) in enumerate(every):
            for j, (_, b, lb) in enumerate(every):
                fit = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
                if i < j and la is not None and la == lb and fit(a) and fit(b) and len(a) == len(b):
                    x, y = np.float32(a).astype(float), np.float32(b).astype(float)
                    if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                        links[i].add(j)
                        links[j].add(i)
        want = Counter((every[i][0], len(links[i])) for i in range(len(every)))
        assert Counter((r.vec_id, r.n_links) for r in got) == want
        label = list(range(len(every)))
        for _ in range(30):
            for i in links:
                for j in links[i]:
                    label[i] = label[j] = min(label[i], label[j])
        least = {k: min(every[i][0] for i in range(len(every)) if label[i] == k) for k in set(label)}
        assert Counter((r.vec_id, r.component_id) for r in got) == Counter((every[i][0], least[label[i]]) for i in range(len(every)))
    assert capfilter.near_vectors(df.filter("false")).count() == 0
