"""Language identification of mixed-language texts.

A naive Bayes model over hashed character 1- to 4-grams gives each word a score per language. Words are cut where the
script of their letters changes, and runs without spaces every RUN characters, so spans can begin and end there. The
Unicode script of a part's letters narrows the languages that may claim it; Viterbi over the parts with a switching
penalty then labels spans. The training counts are summed in Spark; they have a fixed size (languages x buckets), as have the broadcast
tables made of them.

Edge cases: a null or empty text, or one without letters, is `und` with score 0; documents with a null language don't
train; with no training document at all every text is `und`; ties go to the first language in order; repeated rows are
labelled one by one and extra columns are dropped; texts of any length are labelled whole.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
ORDERS = (1, 2, 3, 4)
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "GEORGIAN", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "OTHER")


RUN = 12  # characters of a part of a word in a script that is written without spaces, at most
_SPACELESS = {SCRIPTS.index(s) for s in ("THAI", "HIRAGANA", "KATAKANA", "CJK")}


def parts(word: str) -> list[str]:
    """The word, cut where letters of another script begin (kana and ideographs count as one) and, in scripts without
    spaces, every RUN characters. What isn't a letter stays with what is before it."""
    out, begin, before = [], 0, -1
    for at, c in enumerate(word):
        k = _script(c)
        if k < 0:
            continue
        k = -2 if k in _SPACELESS else k
        if before != -1 and (k != before or k == -2 and at - begin >= RUN):
            out.append(word[begin:at])
            begin = at
        before = k
    return [*out, word[begin:]]


def _cut(words: list[bytes]) -> list[bytes]:
    """All parts of the words; ASCII words are whole."""
    return words if all(map(bytes.isascii, words)) else [x for w in words for x in ([w] if w.isascii() else (p.encode() for p in parts(w.decode("utf-8", "replace"))))]


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> int:
    """The number of a letter's script range, or -1 for what isn't a letter."""
    if not c.isalpha():
        return -1
    head = unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]
    return SCRIPTS.index(head) if head in SCRIPTS else len(SCRIPTS) - 1


class Vocabulary:
    """Numbers distinct words and keeps their letters, script and n-gram buckets' sums; bounded, then begun anew."""

    def __init__(self, table: np.ndarray | None, limit: int = 400_000) -> None:
        self.table, self.limit = table, limit
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.cuts: dict[bytes, list[bytes]] = {}  # of the words that aren't one part
        self.whole: set[bytes] = set()  # words not in ASCII that are one part
        self.letters = np.zeros(0, dtype=np.int32)
        self.script = np.zeros(0, dtype=np.int8)
        self.scores = np.zeros((0, 0 if self.table is None else self.table.shape[1]), dtype=np.float32)

    def cut(self, found: list[list[bytes]]) -> tuple[list[list[bytes]], list[np.ndarray] | None]:
        """The parts of the words of each text, and for each part the number of its word (None if all words are whole)."""
        odd = {w for w in set().union(*found) if not w.isascii()}
        if len(self.whole) + len(self.cuts) > self.limit:
            self.whole, self.cuts = set(), {}
        for w in odd.difference(self.whole, self.cuts):
            if len(p := _cut([w])) > 1:
                self.cuts[w] = p
            else:
                self.whole.add(w)
        if not odd.intersection(self.cuts):
            return found, None
        split = [[self.cuts.get(w, (w,)) for w in ws] for ws in found]
        return [[p for ps in x for p in ps] for x in split], [np.repeat(np.arange(len(x)), [len(ps) for ps in x]) for x in split]

    def add(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.number]
        if len(self.number) + len(new) > self.limit:
            self.clear()
            new = list(words)
        if not new:
            return
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        texts = [w.decode("utf-8", "replace").lower() for w in new]
        kinds = [[k for k in map(_script, t) if k >= 0] for t in texts]
        self.letters = np.concatenate([self.letters, np.array([len(k) for k in kinds], dtype=np.int32)])
        self.script = np.concatenate([self.script, np.array([max(set(k), key=k.count) if k else -1 for k in kinds], dtype=np.int8)])
        if self.table is not None:
            buckets, ends = ngram_buckets(texts)
            sums = np.zeros((len(texts), self.table.shape[1]), dtype=np.float32)
            full = np.flatnonzero(np.diff(ends))
            if len(full):
                sums[full] = np.add.reduceat(self.table[buckets], ends[:-1][full], axis=0)
            self.scores = np.concatenate([self.scores, sums])


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of each word, framed by spaces, word after word; and where each word's begin and end."""
    framed = [f" {t} " for t in texts]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in framed], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(ends[1:], sizes) - np.arange(len(codes))  # characters up to the end of the word
    grid = np.full((len(codes), len(ORDERS)), -1, dtype=np.int64)
    hashed = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        ahead = np.zeros_like(codes)
        ahead[: len(codes) - n + 1] = codes[n - 1 :]
        hashed = (hashed * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
        hashed ^= hashed >> np.uint64(29)
        if n in ORDERS:
            fits = left >= n
            grid[fits, ORDERS.index(n)] = (hashed[fits] % np.uint64(BUCKETS)).astype(np.int64)
    keep = grid >= 0
    per_word = np.add.reduceat(keep.sum(axis=1), ends[:-1]) if len(texts) else np.zeros(0, dtype=np.int64)
    return grid[keep], np.concatenate([[0], np.cumsum(per_word)])


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # buckets x languages: log probabilities
    scripts: np.ndarray  # scripts x languages: whether the language uses the script


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        scripts = np.zeros((len(langs), len(SCRIPTS)), dtype=np.int64)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, found = langs.index(lang), [w.decode("utf-8", "replace") for w in _cut(text.lower().encode("utf-8", "replace").split())]
                if not found:
                    continue
                buckets, _ = ngram_buckets(found)
                grams[at] += np.bincount(buckets, minlength=BUCKETS)
                kinds = np.array([_script(c) for c in "".join(found)])
                scripts[at] += np.bincount(kinds[kinds >= 0], minlength=len(SCRIPTS))
        for counts, base in ((grams, 0), (scripts, BUCKETS)):
            lang, bucket = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array((bucket + base).astype(np.int32)), pa.array(counts[lang, bucket])], names=["lang_no", "bucket", "n"])

    return run


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_docs: int = 20_000, max_langs: int = 256, alpha: float = 0.5, min_script: float = 0.01) -> Model:
    """Fits the model on about max_docs labelled documents (all, if there are fewer), those with the least text hashes."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = labelled.groupBy("lang").count().orderBy("lang").limit(max_langs + 1).collect()
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs, total = [r["lang"] for r in found], sum(r["count"] for r in found)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), dtype=np.float32), np.zeros((len(SCRIPTS), 0), dtype=bool))
    sample = labelled.filter(F.xxhash64("text") <= (max_docs << 64) // max(total, max_docs) - (1 << 63) - 1)
    rows = sample.mapInArrow(_count(langs), "lang_no int, bucket int, n long").groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    counts[rows["bucket"].to_numpy(), rows["lang_no"].to_numpy()] = rows["n"].to_numpy()
    grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    table = np.log((grams + alpha) / (grams.sum(axis=0) + alpha * BUCKETS))
    table -= table.max(axis=1, keepdims=True)  # only differences between languages count
    return Model(langs, table.astype(np.float32), scripts >= np.maximum(min_script * scripts.sum(axis=0), 1))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of scores (words x languages), text after text of the given sizes, with a penalty for
    each change of label inside a text. All texts advance together, longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), side="right")  # texts with a t-th word
    came = np.empty(scores.shape, dtype=np.int16)
    best = np.zeros((len(sizes), scores.shape[1]), dtype=np.float32)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t, n in enumerate(active):
        now = best[:n]
        top = now.argmax(axis=1)
        jump = now[np.arange(n), top] - np.float32(penalty)
        stay = now >= jump[:, None]
        came[starts[:n] + t] = np.where(stay, own[None, :], top[:, None])
        best[:n] = np.where(stay, now, jump[:, None]) + scores[starts[:n] + t]
    label = np.empty(len(scores), dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        label[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return label


_LOADED: dict[str, Vocabulary] = {}  # of the model that this worker used last


def _label(shared: Broadcast, token: str, penalty: float, damp: float, spans: bool, keep: tuple[str, ...], part: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        if token not in _LOADED:
            _LOADED.clear()
            _LOADED[token] = Vocabulary(model.table * np.float32(damp))
        vocabulary = _LOADED[token]
        may = np.concatenate([model.scripts, np.ones((1, len(model.langs)), dtype=bool)]) if model.langs else None
        if may is not None:
            may[~may.any(axis=1)] = True  # a script that no language uses tells nothing
        for whole in batches:
            for begin in range(0, whole.num_rows, part):
                yield label(whole.slice(begin, part), model, vocabulary, may)

    def label(b: pa.RecordBatch, model: Model, vocabulary: Vocabulary, may: np.ndarray | None) -> pa.RecordBatch:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        found, word_of = vocabulary.cut([t.split() if t else [] for t in texts])
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        langs, share = np.full(len(found), "und", dtype=object), np.zeros(len(found))
        runs: list[list[dict]] = [[] for _ in found]
        if model.langs and sizes.sum():
            vocabulary.add(set().union(*found))
            at = np.fromiter((vocabulary.number[w] for ws in found for w in ws), dtype=np.int64, count=sizes.sum())
            letters, script = vocabulary.letters[at], vocabulary.script[at]
            scores = vocabulary.scores[at]
            scores[~may[script]] -= 50.0
            scores[letters == 0] = 0.0
            labels = viterbi(scores, sizes, penalty)
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(found)), sizes)
            per = np.bincount(owner * len(model.langs) + labels, weights=letters, minlength=len(found) * len(model.langs)).reshape(len(found), -1)
            total = per.sum(axis=1)
            has = total > 0
            top = per.argmax(axis=1)
            langs[has] = np.array(model.langs, dtype=object)[top[has]]
            share[has] = per[np.arange(len(found)), top][has] / total[has]
            if spans:
                for k, (n, end) in enumerate(zip(sizes, ends, strict=True)):
                    mine = labels[end - n : end]
                    cuts = np.flatnonzero(np.diff(mine)) + 1
                    if n:
                        word = word_of[k] if word_of else np.arange(n)
                        runs[k] = [{"lang": model.langs[mine[s]], "start": int(word[s]), "end": int(word[e - 1]) + 1} for s, e in zip([0, *cuts], [*cuts, n], strict=True)]
        columns, names = [*b.columns[:1], pa.array(list(langs), type=pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"]
        if spans:
            columns.append(pa.array(runs, type=pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
            names.append("spans")
        return pa.RecordBatch.from_arrays([*columns, *(b.column(k) for k in keep)], names=[*names, *keep])

    return run


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", penalty: float = 15.0, damp: float = 0.5, spans: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score, spans, *keep) of each row. score: the share of the letters in spans of lang_pred. spans: the
    labelled word ranges, 0-based, end exclusive; a word cut between two spans is in both. penalty: log-odds that a change of language has to overcome. damp: weight
    of the n-grams, which overlap and so count a letter several times."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds[doc_id]}, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans + "".join(f", `{k}` {kinds[k]}" for k in keep)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *keep)
    return rows.mapInArrow(_label(spark.sparkContext.broadcast(model), uuid.uuid4().hex, penalty, damp, spans, keep), schema)
