"""Token counts that follow edits.

Each document keeps two segment trees over leaves of consecutive pre-tokens: sums of characters and sums of tokens. An
edit finds its leaf by descending the character sums, splits anew only from a boundary that the edit can't have moved to
the first old leaf boundary that the new split meets again, encodes those pre-tokens, and updates the sums above the
touched leaves. Splitting from a position depends only on the text from there on, and a boundary depends on the two
characters after it at most, so the result equals counting the edited text afresh. (That holds for the usual patterns of
byte-level BPE; a pattern whose boundaries look further ahead can't be used here.) Leaves that an insertion makes too
large are split and the sums built anew over all leaves, without encoding anything again.

Edge cases: a null text counts as empty and has one empty leaf; positions beyond the text's end mean its end, negative
ones its begin; a deletion stops at the end; null edit fields count as 0 or the empty text; edits apply in the order of
the list; repeated rows are edited each on its own; extra columns are dropped; empty tables give empty results; texts of
any length are kept whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT = "struct<pos:int,del:int,ins:string>"


class Counter:
    """Token counts of pre-tokens, remembered in a bounded table of the worker."""

    def __init__(self, ranks: str, pattern: str, limit: int = 500_000) -> None:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[str, int] = {}
        self.limit = limit

    def counts(self, parts: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in parts]
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for p in {p for p in parts if p not in known}:
                known[p] = len(self.encoding.encode_ordinary(p))
            return [known[p] for p in parts]


def _tree(leaves: np.ndarray) -> np.ndarray:
    """Sums in heap order: the root at 1, the leaves from half the length on."""
    half = 1 << max(0, int(len(leaves) - 1).bit_length())
    out = np.zeros(2 * half, dtype=np.int64)
    out[half : half + len(leaves)] = leaves
    while half > 1:
        half //= 2
        out[half : 2 * half] = out[2 * half : 4 * half].reshape(-1, 2).sum(axis=1)
    return out


class Document:
    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, counter: Counter, per_leaf: int = 16) -> None:
        self.text, self.chars, self.tokens, self.counter, self.per_leaf = text, chars, tokens, counter, per_leaf
        self.encoded = 0  # pre-tokens encoded by edits

    @classmethod
    def build(cls, text: str, counter: Counter, per_leaf: int = 16) -> Document:
        parts = counter.pattern.findall(text)
        counts, sizes = np.array(counter.counts(parts), dtype=np.int64), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        first = np.arange(0, len(parts), per_leaf)
        if not len(first):
            return cls(text, _tree(np.zeros(1, dtype=np.int64)), _tree(np.zeros(1, dtype=np.int64)), counter, per_leaf)
        return cls(text, _tree(np.add.reduceat(sizes, first)), _tree(np.add.reduceat(counts, first)), counter, per_leaf)

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def leaf(self, pos: int) -> tuple[int, int]:
        """The leaf that holds the character at pos (the last one that isn't empty, at the end), and where it begins."""
        node, begin, half = 1, 0, len(self.chars) // 2
        pos = max(0, min(pos, int(self.chars[1]) - 1))
        while node < half:
            node *= 2
            if pos - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - half, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + len(self.chars) // 2
        more, worth = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more
            self.tokens[node] += worth
            node //= 2

    def split(self, first: int, last: int, parts: list[str], counts: list[int]) -> None:
        """Puts new leaves of per_leaf pre-tokens in the place of the leaves first to last."""
        half, begins = len(self.chars) // 2, np.arange(0, len(parts), self.per_leaf)
        sums = [np.add.reduceat(np.array(x, dtype=np.int64), begins) for x in (list(map(len, parts)), counts)]
        kept = self.chars[half:] > 0  # leaves that are empty, or only fill the tree, go
        before, after = np.flatnonzero(kept[:first]), np.flatnonzero(kept[last + 1 :]) + last + 1
        self.chars, self.tokens = (_tree(np.concatenate([x[half + before], new, x[half + after]])) for x, new in zip((self.chars, self.tokens), sums, strict=True))

    def edit(self, pos: int, delete: int, insert: str) -> None:
        size, half = len(self.text), len(self.chars) // 2
        pos = min(max(pos, 0), size)
        delete = min(max(delete, 0), size - pos)
        first, begin = self.leaf(pos)
        while begin and begin + 2 > pos:  # the boundary before must not see the edit
            first, begin = self.leaf(begin - 1)
        if begin + 2 > pos:
            first, begin = 0, 0
        last, start = self.leaf(pos + delete)
        end = start + int(self.chars[half + last])  # an old leaf boundary at or behind the deletion's end
        shift = len(insert) - delete
        text = self.text[:pos] + insert + self.text[pos + delete :]
        safe, parts, at = pos + len(insert), [], begin
        if begin < len(text):
            for m in self.counter.pattern.finditer(text, begin):
                parts.append(m.group())
                at = m.end()
                while end < size and end + shift < max(at, safe):
                    last += 1
                    end += int(self.chars[half + last])
                if at >= safe and at == end + shift:
                    break
            else:
                last = half - 1
        else:
            last = half - 1
        counts = self.counter.counts(parts)
        self.encoded += len(parts)
        self.text = text
        leaves = list(range(first, last + 1))
        if len(parts) > 2 * self.per_leaf * len(leaves):
            self.split(first, last, parts, counts)
            return
        share = -(-len(parts) // len(leaves)) if parts else 1
        for k, leaf in enumerate(leaves):
            mine = slice(k * share, (k + 1) * share)
            self.put(leaf, sum(map(len, parts[mine])), sum(counts[mine]))


_LOADED: dict[tuple[str, str], Counter] = {}


def _counter(ranks: str, pattern: str) -> Counter:
    if (ranks, pattern) not in _LOADED:
        _LOADED[ranks, pattern] = Counter(ranks, pattern)
    return _LOADED[ranks, pattern]


def build_trees(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, chars, tokens, *keep): each row's text and its segment trees. ranks and pattern: the vocabulary file
    and split pattern of a byte-level BPE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks, pattern)
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                made = [Document.build(t or "", counter) for t in b.column("text").to_pylist()]
                columns = [b.column(0), pa.array([d.text for d in made], pa.string()), pa.array([d.chars for d in made], pa.list_(pa.int64())), pa.array([d.tokens for d in made], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *(b.column(k) for k in keep)], names=["doc_id", "text", "chars", "tokens", *keep])

    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep)
    return rows.mapInArrow(run, f"doc_id {kinds[doc_id]}, text string, chars array<bigint>, tokens array<bigint>" + "".join(f", {k} {kinds[k]}" for k in keep))


def apply_edits(trees: DataFrame, ranks: str, pattern: str, edits: str = "edits") -> DataFrame:
    """(doc_id, text, chars, tokens, n_tokens_before, n_tokens, n_reencoded) after the edits of each row: a list of
    (pos, del, ins), applied in order; positions are in characters of the text as it is by then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks, pattern)
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                b = whole.slice(begin, 500)
                out: list[tuple] = []
                for text, chars, tokens, todo in zip(b.column("text").to_pylist(), b.column("chars"), b.column("tokens"), b.column(edits).to_pylist(), strict=True):
                    d = Document(text or "", np.array(chars.values), np.array(tokens.values), counter)
                    before = d.n_tokens
                    for e in todo or []:
                        if e:
                            d.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                    out.append((d.text, d.chars, d.tokens, before, d.n_tokens, d.encoded))
                kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "text", "chars", "tokens", "n_tokens_before", "n_tokens", "n_reencoded"])

    schema = f"doc_id {dict(trees.dtypes)['doc_id']}, text string, chars array<bigint>, tokens array<bigint>, n_tokens_before bigint, n_tokens bigint, n_reencoded bigint"
    return trees.select("doc_id", "text", "chars", "tokens", edits).mapInArrow(run, schema)


def derived_edits(doc_id: Column, text: Column, n: int = 3) -> Column:
    """Edits that the data itself gives: at places drawn by hash, up to 23 characters go and up to 19 of the text come in."""
    size = F.char_length(F.coalesce(text, F.lit("")))
    draw = lambda k, m: F.pmod(F.xxhash64(doc_id, F.lit(k)), F.greatest(m, F.lit(1)).cast("long")).cast("int")
    one = lambda k: F.struct(
        draw(4 * k, size + 1).alias("pos"),
        draw(4 * k + 1, F.lit(24)).alias("del"),
        F.coalesce(F.substr(text, draw(4 * k + 2, size) + 1, draw(4 * k + 3, F.lit(20))), F.lit("")).alias("ins"),
    )
    return F.array(*[one(k) for k in range(n)])
