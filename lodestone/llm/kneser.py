"""Interpolated modified Kneser-Ney n-gram scores.

Training counts words first and numbers them, frequent ones first, so that a word takes few bytes from then on. Then tasks
sum their own n-grams and deal them by their last word but one. All contexts of an n-gram of two words or more end with
that word, and all its endings of two words or more hold it; so one task has all counts that the orders from the highest
down to 2 need, and the n-grams are shuffled once. What order 1 needs, for how many words a word is the next, is summed
by word. The distinct n-grams of a shard are written as one file.

Scoring deals the distinct n-grams of a few thousand texts in the same way. A shard's task reads the shard's file, once, and
answers each n-gram with its probability; the answers go back to the texts, whose words were kept as numbers. Work and disk
follow the texts: nothing is looked up in files of other shards but the counts of single words.

The number of shards follows the bytes of the texts. Words with more n-grams than WIDE average shards are spread over a grid
of shards, by the hashes of the words before and after them; their contexts' sums and their pairs' counts are added up over
a row or a column of the grid and written for it. Orders above 3 aren't spread. Which words these are changes where n-grams
lie, not the result. Counts are whole numbers of any size.

Words and n-grams are told by 64-bit hashes (XXH64 of words); two different ones meet with a probability of about n^2 / 2^65.
An answer is a multiple of 2^-34.

The discounts of counts 1, 2 and 3 or more are those of Chen and Goodman, with half of the smallest count as a floor
where the counts of counts give none, so that every context leaves something to the lower orders and no score is
infinite. N-grams that begin before the text are counted like others.

Files are written under a temporary name and renamed, so a task that runs twice leaves one file. They lie in the shared
folder; where that isn't a mounted path, workers fetch each file once through pyarrow's file systems. Scoring expects that
reading the texts again gives the same rows in each partition, as files do.

Edge cases: a null or empty text has the end token alone; without training texts all words have the same probability;
repeated rows count and are scored each; extra columns are dropped; texts of any length are scored whole; a null id is
kept.
"""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import discard, materialize, scratch

BEGIN, END = np.uint64(1), np.uint64(2)  # stand for the text's edges; no word's hash in practice
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
WIDE = 2.0
_STEP = float(1 << 34)


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct tokens (words of the lower-cased text, then an end), the tokens as places among them, and each
    text's number of tokens."""
    n = len(texts)
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
    words = pc.ascii_lower(split.flatten()).dictionary_encode()  # ascii_lower misreads a slice that was cast
    distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    known = np.fromiter((*map(xxhash.xxh64_intdigest, distinct), int(END)), dtype=np.uint64, count=len(distinct) + 1)
    which = words.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    empty = words.dictionary.index("").as_py()  # before and after the white space at a text's edges
    if empty >= 0:
        full = which != empty
        which, owner = which[full], owner[full]
    sizes = np.bincount(owner, minlength=n).astype(np.int64) + 1
    out = np.full(sizes.sum(), len(known) - 1, dtype=np.int64)
    place = np.ones(len(out), dtype=bool)
    place[np.cumsum(sizes) - 1] = False
    out[place] = which
    return known, out, sizes


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each text's number of tokens."""
    known, which, sizes = _coded(texts)
    return known[which], sizes


def _slices(batch: pa.RecordBatch, column: int, rows: int = 2000, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of up to `rows` rows and about `most` bytes of text."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = min(max(int(np.searchsorted(ends, before + most, side="right")), begin + 1), begin + rows, batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def ngrams(tokens: np.ndarray, sizes: np.ndarray, order: int, begin: int = BEGIN) -> np.ndarray:
    """order x tokens: each token in the last row, what precedes it above; begins stand before the text."""
    out = np.empty((order, len(tokens)), dtype=tokens.dtype)
    out[order - 1] = tokens
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for back in range(1, order):
        row = out[order - 1 - back]
        row[back:] = tokens[:-back] if back < len(tokens) else tokens[:0]
        row[at < back] = begin
    return out


def combine(grams: np.ndarray) -> np.ndarray:
    """One hash of each column of words."""
    out = np.zeros(grams.shape[1], dtype=np.uint64)
    for row in grams:
        out ^= row
        out *= _MIX
        out ^= out >> np.uint64(32)
        out *= _MIX2
    out ^= out >> np.uint64(29)
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """The stable order of the keys: they are sorted with their places in their low bits, where both fit."""
    low = max(len(keys) - 1, 1).bit_length()
    if int(keys.max(initial=0)).bit_length() + low > 64:
        return np.argsort(keys, kind="stable")
    return _places(keys.astype(np.uint64), low)


def _places(keys: np.ndarray, low: int) -> np.ndarray:
    """The stable order of keys that leave `low` bits free; keys is overwritten."""
    keys <<= np.uint64(low)
    keys |= np.arange(len(keys), dtype=np.uint64)
    keys.sort()
    keys &= np.uint64((1 << low) - 1)
    return keys.view(np.int64)


def _alike(hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of equal hashes that each belongs to, and the first place of each group."""
    low = np.uint64(max(len(hashed) - 1, 1).bit_length())
    order = _places(hashed >> low, int(low))
    found = hashed[order]
    apart = found[1:] ^ found[:-1]
    if ((apart > 0) & (apart >> low == 0)).any():  # told by the low bits alone
        order = np.argsort(hashed, kind="stable")
        found = hashed[order]
    del apart
    new = np.ones(len(found), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    which = np.empty(len(found), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return which, order[new]


def _sum(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of grams with the sums of their columns of counts."""
    which, first = _alike(combine(grams))
    return np.take(grams, first, axis=1), np.stack([np.bincount(which, c, len(first)).astype(np.int64) for c in counts])


def _narrow(x: np.ndarray, least: int = 8) -> np.ndarray:
    """Whole numbers from 0 on in the fewest bits that hold them, `least` or more."""
    return x.astype(np.min_scalar_type(max(int(x.max(initial=0)), (1 << least) - 1)))


def _pack(grams: np.ndarray, counts: np.ndarray) -> bytes:
    """The rows as whole numbers, each byte of theirs compressed apart; of the last row but one, which is mostly sorted, the
    steps."""
    rows, squeeze, planes = [*grams.astype(np.uint64), *counts.astype(np.uint64)], zstandard.ZstdCompressor(level=1).compress, []
    if len(grams):
        at = max(len(grams) - 2, 0)
        rows[at] = np.diff(rows[at], prepend=np.uint64(0))
    for row in rows:
        split = row.astype("<u8").view(np.uint8).reshape(-1, 8)
        width = (int(row.max(initial=0)).bit_length() + 7) // 8
        planes.append([squeeze(np.ascontiguousarray(split[:, b])) for b in range(width)])
    sizes = [len(p) for own in planes for p in own]
    head = struct.pack(f"<QBB{len(planes)}B{len(sizes)}Q", grams.shape[1], len(grams), len(counts), *map(len, planes), *sizes)
    return b"".join([head, *(p for own in planes for p in own)])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, order, kinds = struct.unpack_from("<QBB", blob)
    widths = struct.unpack_from(f"<{order + kinds}B", blob, 10)
    at = 10 + order + kinds
    sizes = iter(struct.unpack_from(f"<{sum(widths)}Q", blob, at))
    at += 8 * sum(widths)
    out, expand = np.zeros((order + kinds, n, 8), dtype=np.uint8), zstandard.ZstdDecompressor().decompress
    for row, width in zip(out, widths, strict=True):
        for b in range(width):
            size = next(sizes)
            row[:, b] = np.frombuffer(expand(blob[at : at + size]), np.uint8)
            at += size
    rows = out.reshape(order + kinds, -1).view("<u8")
    if order:
        rows[max(order - 2, 0)] = np.cumsum(rows[max(order - 2, 0)], dtype=np.uint64)
    return _narrow(rows[:order], 32), rows[order:].astype(np.int64)


def _unpack_all(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The columns of all blobs, and how many each has."""
    grams, counts = zip(*(_unpack(b.as_py()) for b in blobs), strict=True)
    return np.concatenate(grams, axis=1), np.concatenate(counts, axis=1), [g.shape[1] for g in grams]


def _cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of each run of equal parts."""
    ends = np.flatnonzero(np.diff(part, append=-1)) + 1
    for begin, end in zip([0, *ends[:-1]], ends, strict=False):
        yield int(part[begin]), begin, end


def _deal(kind: str, part: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> list[dict]:
    """A row for each part, with its keys in order and their counts."""
    by = _order(keys)
    by = by[_order(part[by])]
    part, keys, counts = part[by].astype(np.int64), keys[by], counts[:, by]
    return [{"kind": kind, "part": p, "blob": _pack(keys[None, b:e], counts[:, b:e]), "stats": None} for p, b, e in _cuts(part)]


_ROW = "kind string, part bigint, blob binary, stats array<bigint>"
_SCHEMA = pa.schema([("kind", pa.string()), ("part", pa.int64()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _told(stats: list[int], kind: str = "stats") -> dict:
    return {"kind": kind, "part": -1, "blob": None, "stats": [int(x) for x in stats]}


def save_array(folder: str, name: str, array: np.ndarray) -> None:
    """Writes the array under a temporary name and renames it."""
    system, base = fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    own = f"{base}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        np.lib.format.write_array(out, np.ascontiguousarray(array), allow_pickle=False)
    system.move(own, f"{base}/{name}.npy")


def mapped_array(system: fs.FileSystem, path: str) -> np.ndarray | None:
    """The array of a file, mapped into memory; None if there is no such file."""
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r") if os.path.exists(path) else None
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with tempfile.NamedTemporaryFile() as own:  # the name goes, the mapping stays
        with system.open_input_stream(path) as source:
            while chunk := source.read(1 << 22):
                own.write(chunk)
        own.flush()
        return np.load(own.name, mmap_mode="r")


def _load(folder: str, name: str) -> np.ndarray | None:
    system, base = fs.FileSystem.from_uri(folder)
    return mapped_array(system, f"{base}/{name}.npy")


def _save_packed(folder: str, name: str, blob: bytes) -> None:
    save_array(folder, name, np.frombuffer(blob, np.uint8))


# --- words -------------------------------------------------------------------


def _count_words(parts: int, most: int = 3_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def deal() -> pa.RecordBatch:
            words, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            which, first = _alike(words)
            words, counts = words[first], np.bincount(which, counts, len(first)).astype(np.int64)
            return pa.RecordBatch.from_pylist(_deal("words", words % np.uint64(parts), words, counts[None]), _SCHEMA)

        for whole in batches:
            for some in _slices(whole, 0):
                known, which, _ = _coded(some.column(0))
                counts = np.bincount(which, minlength=len(known))
                held.append((known[counts > 0], counts[counts > 0]))  # the empty word has none
                if sum(len(words) for words, _ in held) >= most:
                    yield deal()
                    held = []
        if held:
            yield deal()

    return run


def _write_words(folder: str, shards: int):
    """Writes the part's words in the order of their hashes, with their counts and their ranks among the part's words whose
    counts have as many bits. Returns the number of words of each number of bits, the tokens and the ends, and the words that
    may be wide ones."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        words, counts, _ = _unpack_all(table.column("blob"))
        which, first = _alike(words[0])
        words, counts = words[0][first], np.bincount(which, counts[0], len(first)).astype(np.int64)
        by = np.argsort(words)
        words, counts = words[by], counts[by]
        bits = np.frexp(counts.astype(np.float64))[1]
        order = _order(bits)
        sizes = np.bincount(bits, minlength=64)
        ranks = np.empty(len(words), dtype=np.int64)
        ranks[order] = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        save_array(folder, f"words-{part}", words)
        save_array(folder, f"ranks-{part}", _narrow(ranks))
        save_array(folder, f"occurs-{part}", _narrow(counts))
        rows = [_told([part, counts.sum(), counts[words == END].sum(), *sizes])]
        rows += [_told([part, bits[i], ranks[i], counts[i]], "wide") for i in np.flatnonzero(counts * shards > WIDE * counts.sum())]
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


class Words(NamedTuple):
    folder: str
    parts: int
    starts: np.ndarray  # number of the first word by number of bits of its count, and part
    words: int  # distinct ones
    tokens: int
    made: str  # a name of this training, as a folder may be written again

    @property
    def begin(self) -> int:
        return self.words

    @property
    def unknown(self) -> int:
        return self.words + 1

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and counts of words."""
        out, occurs = np.full(len(hashed), self.unknown, dtype=np.min_scalar_type(self.unknown)), np.zeros(len(hashed), dtype=np.int64)
        by = np.lexsort((hashed, hashed % np.uint64(self.parts)))
        for part, begin, end in _cuts((hashed[by] % np.uint64(self.parts)).astype(np.int64)):
            at = by[begin:end]
            known = _held(self, f"words-{part}")
            if known is None:
                continue
            place = np.minimum(np.searchsorted(known, hashed[at]), len(known) - 1)
            hit = known[place] == hashed[at]
            at, place = at[hit], place[hit]
            occurs[at] = _held(self, f"occurs-{part}")[place]
            out[at] = self.starts[np.frexp(occurs[at].astype(np.float64))[1], part] + _held(self, f"ranks-{part}")[place]
        return out, occurs


_HELD: dict[str, np.ndarray | None] = {}
_OF: list[str] = []


def _held(words: Words, name: str) -> np.ndarray | None:
    """A file's array, mapped when it is first needed, as long as this worker works with the same model."""
    if _OF != [words.made]:
        _HELD.clear()
        _OF[:] = [words.made]
    if name not in _HELD:
        _HELD[name] = _load(words.folder, name)
    return _HELD[name]


def _number(docs: DataFrame, folder: str, shards: int) -> tuple[Words, list[tuple[int, int]]]:
    """Counts and numbers the words of docs (text); also (number, count) of the wide ones."""
    parts = max(1, shards // 16)
    dealt = docs.mapInArrow(_count_words(parts), _ROW)
    done = materialize(dealt.groupBy("part").applyInArrow(_write_words(folder, shards), _ROW), "words")
    rows = done.select("kind", "stats").collect()
    discard(done)
    sizes = np.zeros((64, parts), dtype=np.int64)
    tokens = texts = 0
    for kind, found in rows:
        if kind == "stats":
            part, n, ends, *own = found
            tokens, texts, sizes[:, part] = tokens + n, texts + ends, own[:64]
    down = sizes[::-1].ravel()  # words with long counts first
    starts = (np.cumsum(down) - down).reshape(64, parts)[::-1]
    words = Words(folder, parts, starts, int(down.sum()), tokens, uuid.uuid4().hex)
    wide = [(int(starts[f[1], f[0]] + f[2]), f[3]) for kind, f in rows if kind == "wide"] + [(words.begin, texts)]
    return words, [(w, n) for w, n in wide if n * shards > WIDE * tokens]


# --- n-grams -----------------------------------------------------------------


class Grid(NamedTuple):
    """Where n-grams lie: by their last word but one, those of wide words (sorted) by the side of their own grid too."""

    shards: int
    unknown: int
    words: np.ndarray
    sides: np.ndarray

    def wide(self, words: np.ndarray) -> np.ndarray:
        """The place of each among the wide words, or -1."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def line(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The row or column of the wide words at these places where an n-gram with the word before or after it lies."""
        return (combine(words[None]) % self.sides[at].astype(np.uint64)).astype(np.int64)

    def part(self, at: np.ndarray, words: np.ndarray) -> np.ndarray:
        """A number for each row or column of each wide word."""
        return at * int(self.sides.max(initial=1)) + self.line(at, words)

    def shard(self, grams: np.ndarray) -> np.ndarray:
        if len(grams) == 1:
            return (grams[0] % np.uint64(self.shards)).astype(np.int64)
        middle, last = grams[-2], grams[-1]
        out = (np.where(middle == self.unknown, last, middle) % np.uint64(self.shards)).astype(np.int64)
        at = self.wide(middle)
        spread = np.flatnonzero(at >= 0)
        at = at[spread]
        cell = self.line(at, last[spread])
        if len(grams) == 3:
            cell += self.sides[at] * self.line(at, grams[0, spread])
        out[spread] = ((combine(middle[None, spread]) % np.uint64(self.shards)).astype(np.int64) + cell) % self.shards
        return out


def _cut(grams: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of shard and last word but one, and their shards; the group of equal ones that each of
    these was, and the group of each column of grams."""
    for row in range(len(grams) - 3, -1, -1):  # what comes before an unknown word doesn't matter
        grams[row][grams[row + 1] == grid.unknown] = grid.unknown
    which, first = _alike(combine(grams))
    shard = grid.shard(grams)
    by = _order((shard.astype(np.uint64) * np.uint64(grid.unknown + 1) + grams[max(len(grams) - 2, 0)])[first])
    at = first[by]
    return np.take(grams, at, axis=1), shard[at], by, which


def _numbers(words: Words, column: int, rows: Iterator[pa.RecordBatch], most: int, tell: Callable) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Slices of rows with about `most` tokens: what `tell` says of each of their parts, their tokens as numbers, and each
    text's number of tokens."""
    held: list[tuple] = []
    size = 0
    for whole in rows:
        for some in _slices(whole, column):
            known, which, sizes = _coded(some.column(column))
            numbers, occurs = words.find(known)
            held.append((tell(some, occurs, which, sizes), numbers[which], sizes))
            size += len(which)
            if size >= most:
                told, tokens, sizes = zip(*held, strict=True)
                held, size = [], 0
                yield list(told), np.concatenate(tokens), np.concatenate(sizes)
    if held:
        told, tokens, sizes = zip(*held, strict=True)
        yield list(told), np.concatenate(tokens), np.concatenate(sizes)


def _count(order: int, words: Words, grid: Grid, most: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, sizes in _numbers(words, 0, batches, most, lambda *_: None):
            grams, shard, group, which = _cut(ngrams(tokens, sizes, order, words.begin), grid)
            counts = np.bincount(which)[group]
            for part, begin, end in _cuts(shard):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_pack(grams[:, begin:end], counts[None, begin:end])], pa.binary())], names=["shard", "blob"])

    return run


def _sums(counts: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """4 x contexts: the sum of the counts, and how many are 1, 2 and more."""
    return np.stack([np.bincount(of, counts, n), *(np.bincount(of[x], minlength=n) for x in (counts == 1, counts == 2, counts >= 3))]).astype(np.float64)


class Level(NamedTuple):
    """The n-grams of one order among the endings of a shard's distinct columns."""

    which: np.ndarray  # of each column
    first: np.ndarray  # the first column of each
    counts: np.ndarray
    context: np.ndarray  # of each n-gram
    begin: np.ndarray  # the first column of each context
    sums: np.ndarray


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[Level]:
    """From the highest order down to 2: below the highest, counts are of different words before."""
    out, which = [], np.arange(grams.shape[1])
    first = which
    for row in range(len(grams) - 1):
        context, begin = _alike(combine(grams[row:-1, first]))
        out.append(Level(which, first, counts, context, first[begin], _sums(counts, context, len(begin))))
        if row < len(grams) - 2:
            below, at = _alike(combine(grams[row + 1 :, first]))
            counts = np.bincount(below[counts > 0], minlength=len(at))
            which, first = below[which], first[at]
    return out


def _tell(order: int, counts: np.ndarray) -> dict:
    return _told([order, *((counts == k).sum() for k in (1, 2, 3, 4)), counts.sum(), len(counts), (counts >= 3).sum()])


def _write_shard(order: int, folder: str, grid: Grid, parts: int):
    """Writes the distinct n-grams of a shard; returns the counts of counts of each order from 2 on, for how many words a word
    is the next, and the shares of wide words' contexts and pairs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        grams, counts, _ = _unpack_all(table.column("blob"))
        grams, counts = _sum(grams, counts)
        by = _order(grams[max(order - 2, 0)])
        grams, counts = grams[:, by], counts[0, by]
        _save_packed(folder, f"grams-{key[0].as_py()}", _pack(grams, counts[None]))
        if order == 1:
            return pa.Table.from_pylist(_deal("next", grams[0] % np.uint64(parts), grams[0], counts[None]), _SCHEMA)
        rows, wide = [], grid.wide(grams[-2])
        for k, level in zip(range(order, 1, -1), _levels(grams, counts), strict=True):
            whole = wide[level.first] < 0 if k < order else np.ones(len(level.first), dtype=bool)
            rows.append(_tell(k, level.counts[whole]))
            if k == 3 and order == 3:
                apart = np.flatnonzero(wide[level.begin] >= 0)
                before, at = grams[0, level.begin[apart]], wide[level.begin[apart]]
                rows += _deal("row", grid.part(at, before), before, level.sums[:, apart])
            if k == 2 and order == 3:
                apart = level.first[~whole]
                rows += _deal("column", grid.part(wide[apart], grams[-1, apart]), grams[-1, apart], level.counts[None, ~whole])
            if k == 2 and order == 2:
                rows += [_told([wide[level.begin[i]], *level.sums[:, i]], "wide") for i in np.flatnonzero(wide[level.begin] >= 0)]
            if k == 2:
                rows += _next(grams[-1, level.first[whole]], parts)
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


def _next(words: np.ndarray, parts: int) -> list[dict]:
    found, counts = np.unique(words, return_counts=True)
    return _deal("next", found % np.uint64(parts), found, counts[None])


def _write_lines(folder: str, side: int, parts: int):
    """Adds up a row or column of a wide word's grid and writes it; a column's pairs are counted here."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        kind, part = (k.as_py() for k in key)
        words, counts, _ = _unpack_all(table.column("blob"))
        words, counts = _sum(words, counts)
        by = _order(words[0])
        _save_packed(folder, f"{kind}-{part}", _pack(words[:, by], counts[:, by]))
        rows = []
        if kind == "column":
            rows = [_tell(2, counts[0]), _told([part // side, *_sums(counts[0], np.zeros(counts.shape[1], dtype=np.int64), 1)[:, 0]], "wide"), *_next(words[0], parts)]
        return pa.Table.from_pylist(rows, _SCHEMA)

    return run


def _write_next(folder: str, words: int, parts: int):
    """Writes the counts of the words whose number leaves a rest of `part`, by number."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        found, counts, _ = _unpack_all(table.column("blob"))
        every = np.bincount((found[0] // np.uint64(parts)).astype(np.int64), counts[0], (words - part + parts - 1) // parts).astype(np.int64)
        save_array(folder, f"next-{part}", _narrow(every))
        return pa.Table.from_pylist([_tell(1, every)], _SCHEMA)

    return run


class Model(NamedTuple):
    folder: str
    order: int
    numbers: Words
    grid: Grid
    parts: int  # of the counts of single words
    discounts: list[tuple[float, float, float]]  # of order 1, 2, ...
    tokens: int  # of the training texts
    words: int  # distinct ones
    unigrams: tuple[int, int, int, int]  # of the continuation counts: sum, and how many are 1, 2, more
    wide: list[tuple[np.ndarray, np.ndarray]]  # the wide words' numbers, and their sums as contexts


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney; halves where a count of counts is zero or a discount wouldn't be positive."""
    if not (n1 and n2):
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return tuple(min(d, float(k + 1)) if d > 0 else 0.5 for k, d in enumerate(found))


def train(docs: DataFrame, text: str = "text", order: int = 2, shards: int | None = None, keep: str | None = None, shard_bytes: int = 6_000_000, sample: int = 0) -> Model:
    """Counts all texts of docs and writes the model's arrays to a new folder of the shared one (or to keep). A shard stands
    for about shard_bytes of text. Nothing is sampled any more: `sample` has no effect."""
    spark = docs.sparkSession
    if not shards:
        shards = max(8, (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // shard_bytes)
    folder = keep or scratch(spark, "ngrams")
    texts, parts = docs.select(F.col(text).alias("text")), max(1, shards // 16)
    words, often = _number(texts, folder, shards)
    often = sorted(often) if order in (2, 3) else []
    share = np.array([n * shards / words.tokens for _, n in often])
    sides = np.maximum(np.ceil(share if order == 2 else np.sqrt(share)), 2).astype(np.int64)
    grid = Grid(shards, words.unknown, np.array([w for w, _ in often], dtype=np.uint64), sides)
    dealt = texts.mapInArrow(_count(order, words, grid), "shard int, blob binary")
    done = [materialize(dealt.groupBy("shard").applyInArrow(_write_shard(order, folder, grid, parts), _ROW), "shards", "none")]
    if often and order == 3:
        lines = done[0].filter(F.col("kind").isin("row", "column")).groupBy("kind", "part")
        done.append(materialize(lines.applyInArrow(_write_lines(folder, int(sides.max()), parts), _ROW), "lines", "none"))
    every = done[0] if len(done) == 1 else done[0].unionByName(done[1])
    done.append(materialize(every.filter("kind = 'next'").groupBy("part").applyInArrow(_write_next(folder, words.words, parts), _ROW), "next", "none"))
    told = every.unionByName(done[-1]).filter("stats is not null")
    stats = np.zeros((order + 1, 7), dtype=np.int64)
    for k, *found in told.filter("kind = 'stats'").groupBy(F.col("stats")[0]).agg(*[F.sum(F.col("stats")[i]) for i in range(1, 8)]).collect():
        stats[k] = found
    sums = np.zeros((4, len(often)))
    for at, *found in told.filter("kind = 'wide'").groupBy(F.col("stats")[0]).agg(*[F.sum(F.col("stats")[i]) for i in range(1, 5)]).collect():
        sums[:, at] = found
    for table in done:
        discard(table)
    low = [int(x) for x in stats[1]]
    discounts = [_discounts(*(int(x) for x in s[:4])) for s in stats[1:]]
    return Model(folder, order, words, grid, parts, discounts, words.tokens, words.words, (low[4], low[0], low[1], low[6]), [(grid.words, sums)])


# --- scores ------------------------------------------------------------------


def _ask(model: Model, add: float, folder: str, most: int = 1_000_000):
    """Writes the texts' numbers under the name of their slice, and deals their distinct n-grams."""

    def tell(some: pa.RecordBatch, occurs: np.ndarray, which: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        starts = np.cumsum(sizes) - sizes
        plain = np.add.reduceat(np.log10((occurs + add) / (model.tokens + add * (model.words + 1)))[which], starts)
        known = np.add.reduceat((occurs > 0)[which], starts, dtype=np.int64)
        return pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), pa.array(known), pa.array(plain)], names=["doc_id", "n_tokens", "n_known", "base_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for i, (told, tokens, sizes) in enumerate(_numbers(model.numbers, 1, batches, most, tell)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, told[0].schema) as out:
                for some in told:
                    out.write_batch(some)
            save_array(folder, f"texts-{task + i}", np.frombuffer(sink.getvalue(), np.uint8))
            _save_packed(folder, f"tokens-{task + i}", _pack(np.zeros((0, len(tokens))), tokens[None]))
            grams, shard, _, _ = _cut(ngrams(tokens, sizes, model.order, model.numbers.begin), model.grid)
            for part, begin, end in _cuts(shard):
                blob = _pack(grams[:, begin:end], np.zeros((0, end - begin)))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task + i], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "slice", "blob"])

    return run


def _line(model: Model, kind: str, at: np.ndarray, words: np.ndarray, kinds: int) -> np.ndarray:
    """The sums or counts of wide words (their places) with the words before or after them, 0 where there are none."""
    out = np.zeros((kinds, len(words)))
    part = model.grid.part(at, words)
    by = _order(part)
    for p, begin, end in _cuts(part[by]):
        found = _load(model.folder, f"{kind}-{p}")
        if found is not None:
            keys, counts = _unpack(found.tobytes())
            own = by[begin:end]
            place = np.minimum(np.searchsorted(keys[0], words[own]), keys.shape[1] - 1)
            out[:, own] = np.where(keys[0][place] == words[own], counts[:, place], 0)
    return out


def _probability(model: Model, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """p(last word | the words before) of each of a shard's distinct n-grams, which hold all of the model's."""
    total, *n = model.unigrams
    d = [np.array([0.0, *x]) for x in model.discounts]
    cut = lambda c, k: np.maximum(c - d[k - 1][np.minimum(c, 3).astype(np.int64)], 0.0)
    if not total:
        return np.full(grams.shape[1], 1.0 / (model.words + 1))
    follows = np.zeros(grams.shape[1])
    part = (grams[-1] % np.uint64(model.parts)).astype(np.int64)
    by = _order(part)
    by = by[: np.searchsorted(part[by], model.parts)]
    for p, begin, end in _cuts(part[by]):
        own = by[begin:end]
        own = own[grams[-1, own] < model.words]
        if len(own):
            follows[own] = _held(model.numbers, f"next-{p}")[(grams[-1, own] // np.uint64(model.parts)).astype(np.int64)]
    out = cut(follows, 1) / total + float(np.dot(d[0][1:], n)) / total / (model.words + 1)
    for k, level in enumerate(reversed(_levels(grams, counts)), 2):
        found, sums = level.counts.astype(np.float64), level.sums
        wide = model.grid.wide(grams[-2, level.first])
        if k == 2 and model.order == 3 and len(apart := np.flatnonzero(wide >= 0)):
            found[apart] = _line(model, "column", wide[apart], grams[-1, level.first[apart]], 1)[0]
        wide = model.grid.wide(grams[-2, level.begin])
        if len(apart := np.flatnonzero(wide >= 0)):
            if k == 2:
                sums[:, apart] = model.wide[0][1][:, wide[apart]]
            elif model.order == 3:
                sums[:, apart] = _line(model, "row", wide[apart], grams[0, level.begin[apart]], 4)
        lower, sums = out[level.first], sums[:, level.context]
        all_of = np.where(sums[0] > 0, sums[0], 1.0)
        out = np.where(sums[0] > 0, cut(found, k) / all_of + (d[k - 1][1:] @ sums[1:]) / all_of * lower, lower)[level.which]
    return out


def _answer(model: Model):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        grams, _, sizes = _unpack_all(table.column("blob"))
        counts = np.zeros(grams.shape[1], dtype=np.int64)
        known = _load(model.folder, f"grams-{shard}")
        if known is not None:
            own, n = _unpack(known.tobytes())
            grams, counts = np.concatenate([own, grams], axis=1), np.concatenate([n[0], counts])
        which, first = _alike(combine(grams))
        logs = np.rint(-_STEP * np.log10(_probability(model, grams[:, first], counts[first]))).astype(np.int64)
        which = which[len(which) - sum(sizes) :]
        ends = np.cumsum(sizes)
        blobs = [_pack(np.zeros((0, n)), logs[which[end - n : end]][None]) for n, end in zip(sizes, ends, strict=True)]
        return pa.table({"shard": pa.array([shard] * len(sizes), pa.int32()), "slice": table.column("slice"), "blob": pa.array(blobs, pa.binary())})

    return run


def _gather(model: Model, folder: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        rows = pa.ipc.open_stream(pa.BufferReader(_load(folder, f"texts-{name}").tobytes())).read_all()
        tokens, sizes = _unpack(_load(folder, f"tokens-{name}").tobytes())[1][0].astype(np.min_scalar_type(model.numbers.unknown)), rows.column("n_tokens").to_numpy()
        _, _, group, which = _cut(ngrams(tokens, sizes, model.order, model.numbers.begin), model.grid)
        logs = np.empty(len(group), dtype=np.int64)
        logs[group] = _unpack_all(table.sort_by("shard").column("blob"))[1][0]
        score = -np.add.reduceat(logs[which], np.cumsum(sizes) - sizes) / _STEP
        return rows.append_column("score", pa.array(score))

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", add: float = 0.1) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row: sums of log10 probabilities over the text's tokens, of
    the add-`add` unigram model and of the n-gram model. The perplexity is 10 ** (-score / n_tokens)."""
    folder = scratch(docs.sparkSession, "scored")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = rows.mapInArrow(_ask(model, add, folder), "shard int, slice bigint, blob binary")
    answers = asked.groupBy("shard").applyInArrow(_answer(model), "shard int, slice bigint, blob binary")
    return answers.groupBy("slice").applyInArrow(_gather(model, folder), f"doc_id {dict(docs.dtypes)[doc_id]}, n_tokens bigint, n_known bigint, base_score double, score double")
