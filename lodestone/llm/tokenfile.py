"""Token-id files: documents as separately compressed id arrays in ascending order of document id.

A file is a table of blocks, written by Spark. Each block is one binary value: a header with the width of the ids and
the SHA-256 of the shared zstandard dictionary, the offset index, the document ids, the token counts, and one zstandard
frame per document. Any document of a block is read by its offset alone. The dictionary is trained on the serialised
ids of a bounded sample of whole documents and travels with the table's readers.

A tokenizer with the WORDWISE rules drops white space and never joins across it, so a text's ids are its words' ids one
after the other; parts of words are encoded once per worker and remembered in a bounded table. With any other tokenizer
whole texts are encoded.

Edge cases: a null or empty text has only the end id; a null document id sorts first; rows with the same id follow each
other, ordered by their text's hash; an empty table gives an empty file; extra columns are dropped; texts of any length
are one frame.
"""

from __future__ import annotations

import hashlib
import json
import string
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.runtime import materialize

MAGIC = b"TIDB\x01"
HEAD = struct.Struct("<5sB32sI")
_APART = "\x01"
#: The rules of a tokenizer file by which white space goes, letters and marks are parted from each other, and
#: nothing is joined across them.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class WordEncoder:
    """Ids of texts, as arrays of the narrowest unsigned type that holds the vocabulary.

    The words of a batch are told apart by Arrow, and each different one is cut into a run of Latin letters, lower-cased,
    and the ASCII punctuation after it; other words stay whole. Only parts that the worker doesn't remember are encoded;
    the ids of all words are then gathered by index. This holds for tokenizers with WORDWISE rules only: others encode
    whole texts.
    """

    plain = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[!-/:-@\\[-`{-~]*$"
    marks = string.punctuation

    def __init__(self, path: str, part_limit: int = 800_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.format = "H" if self.width == 2 else "I"
        self.part_limit = part_limit
        self.known: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.wordwise = {k: told.get(k) for k in WORDWISE} == WORDWISE
        apart = self.tokenizer.encode(_APART, add_special_tokens=False).ids
        self.apart = apart[0] if len(apart) == 1 else None

    def serial(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.format}", *ids)

    def learn(self, parts: list[str]) -> None:
        """Encodes new parts: lower-case ASCII letters by the model alone, as the rules leave them as they are; others many
        in one call, where a control character between spaces, one token of its own, divides them; and those that hold such
        a string one by one."""
        joined, tokenize, form = [], self.model.tokenize, self.format
        for p in parts:
            if p.isascii() and p.isalpha() and p.islower():
                ids = [t.id for t in tokenize(p)]
                self.known[p] = struct.pack(f"<{len(ids)}{form}", *ids)
            elif self.apart is not None and _APART not in p and "<|" not in p:
                joined.append(p)
            else:
                self.known[p] = self.serial(self.tokenizer.encode(p, add_special_tokens=False).ids)
        for begin in range(0, len(joined), 2000):
            some = joined[begin : begin + 2000]
            ids = np.array(self.tokenizer.encode(f" {_APART} ".join(some), add_special_tokens=False).ids)
            at = 0
            for part, end in zip(some, [*np.flatnonzero(ids == self.apart).tolist(), len(ids)], strict=True):
                self.known[part] = ids[at:end].astype(f"<u{self.width}").tobytes()
                at = end + 1

    def parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of each word its letters, lower-cased, and its marks; of words that aren't such, the word and nothing."""
        plain = pc.match_substring_regex(words, self.plain)
        end = pc.if_else(plain, pc.utf8_ltrim(words, self.latin), "")
        core = pc.if_else(plain, pc.utf8_lower(pc.ascii_rtrim(words, self.marks)), words)
        return core, end

    latin = "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and (c.isascii() or 0xC0 <= ord(c) != 0x130))

    def found(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the different parts, one after the other; of each part where its ids begin and how many they are."""
        told = parts.dictionary_encode()
        each = told.dictionary.to_pylist()
        if len(self.known) > self.part_limit:
            self.known = {"": b""}
        self.learn([p for p in each if p not in self.known])
        ids = [self.known[p] for p in each]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.width
        which = told.indices.to_numpy(zero_copy_only=False)
        return np.frombuffer(b"".join(ids), f"<u{self.width}"), (np.cumsum(sizes) - sizes)[which], sizes[which]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and each text's number of them."""
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        if not self.wordwise:
            ids = [[*self.tokenizer.encode(t, add_special_tokens=False).ids, end] for t in texts.to_pylist()]
            return np.array([i for x in ids for i in x], dtype=f"<u{self.width}"), np.array([len(x) for x in ids], dtype=np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        (a, a_at, a_n), (b, b_at, b_n) = map(self.found, self.parts(words.dictionary))
        pool = np.concatenate([a, b, np.array([end], dtype=f"<u{self.width}")])
        which = words.indices.to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        # two segments of the pool for each word, and one for each text's end
        at, size = np.empty(2 * len(which) + n, dtype=np.int64), np.ones(2 * len(which) + n, dtype=np.int64)
        ends = np.cumsum(2 * counts + 1) - 1
        inside = np.ones(len(at), dtype=bool)
        inside[ends] = False
        at[ends] = len(pool) - 1
        at[inside] = np.stack([a_at[which], len(a) + b_at[which]], axis=1).ravel()
        size[inside] = np.stack([a_n[which], b_n[which]], axis=1).ravel()
        until = np.cumsum(size)
        ids = pool[np.repeat(at - until + size, size) + np.arange(until[-1] if len(until) else 0)]
        return ids, np.diff(until[ends], prepend=0) if n else np.zeros(0, dtype=np.int64)


_LOADED: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Runs of texts with about so many bytes, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        yield texts.slice(begin, end - begin)


def _payloads(encoder: WordEncoder, texts: pa.Array, end: int) -> Iterator[bytes]:
    """The serialised ids of each text."""
    for some in _slices(texts):
        ids, sizes = encoder.encode(some, end)
        data, until = memoryview(ids.tobytes()), (np.cumsum(sizes) * encoder.width).tolist()
        for begin, stop in zip([0, *until[:-1]], until, strict=True):
            yield bytes(data[begin:stop])


def serialised(docs: DataFrame, tokenizer: str, end: int, text: str = "text") -> DataFrame:
    """(payload): the serialised ids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_payloads(_encoder(tokenizer), b.column(0), end), type=pa.binary())], names=["payload"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "payload binary")


class Corpus(NamedTuple):
    """What one pass over the documents tells before they are written."""

    dictionary: bytes
    text_bytes: int


def survey(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text", sample: int = 400, longest: int = 1 << 16, size: int = 1 << 16) -> Corpus:
    """A zstandard dictionary, and the bytes of all texts. The dictionary is trained on about `sample` whole documents of up
    to `longest` bytes, those with the least hashes of id and text, each taken once; so it needs about sample * longest
    bytes at most, however many documents there are. Where training can't work it is raw content."""
    n, seen = docs.count(), Observation()
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"))
    most = (sample << 64) // max(n, sample) - (1 << 63) - 1
    drawn = rows.observe(seen, F.sum("bytes").alias("bytes")).filter((F.col("h") <= most) & (F.col("bytes") <= longest)).dropDuplicates(["h"])
    payloads = sorted(bytes(r.payload) for r in serialised(drawn, tokenizer, end).collect())
    total = seen.get["bytes"] or 0
    try:
        return Corpus(zstandard.train_dictionary(size, payloads).as_bytes(), total)
    except (zstandard.ZstdError, ValueError):
        return Corpus(b"".join(payloads)[-size:], total)


class Codec:
    def __init__(self, dictionary: bytes, level: int = 3) -> None:
        self.hash = hashlib.sha256(dictionary).digest()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        kinds = {"dict_data": shared} if shared else {}
        self.compressor, self.decompressor = zstandard.ZstdCompressor(level=level, **kinds), zstandard.ZstdDecompressor(**kinds)


def pack(ids: list[int | None], payloads: list[bytes], width: int, codec: Codec) -> bytes:
    """One block."""
    frames = [codec.compressor.compress(p) for p in payloads]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8")
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    numbers = np.array([i or 0 for i in ids], dtype="<i8")
    counts = np.array([len(p) // width for p in payloads], dtype="<u8")
    return b"".join([HEAD.pack(MAGIC, width, codec.hash, len(ids)), offsets.tobytes(), numbers.tobytes(), counts.tobytes(), known.tobytes(), *frames])


class Block(NamedTuple):
    ids: list[int | None]
    counts: np.ndarray
    offsets: np.ndarray
    width: int
    frames: memoryview
    codec: Codec

    @classmethod
    def open(cls, data: bytes, codec: Codec) -> Block:
        magic, width, digest, n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        if digest != codec.hash:
            raise ValueError("the block was written with another dictionary")
        at = HEAD.size
        offsets = np.frombuffer(data, "<u8", n + 1, at)
        numbers = np.frombuffer(data, "<i8", n, at + 8 * (n + 1))
        counts = np.frombuffer(data, "<u8", n, at + 8 * (2 * n + 1))
        known = np.frombuffer(data, np.uint8, n, at + 8 * (3 * n + 1))
        ids = [i if k else None for i, k in zip(numbers.tolist(), known, strict=True)]
        return cls(ids, counts, offsets, width, memoryview(data)[at + 8 * (3 * n + 1) + n :], codec)

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document, without touching the others."""
        begin, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self.codec.decompressor.decompress(self.frames[begin:end]), f"<u{self.width}")


def write_blocks(
    docs: DataFrame, tokenizer: str, end: int, corpus: Corpus, doc_id: str = "doc_id", text: str = "text", block_docs: int = 512, block_bytes: int = 4 << 20, part_bytes: tuple[int, int] = (16 << 20, 256 << 20)
) -> DataFrame:
    """Writes the file and returns its table: (part, seq, n_docs, n_tokens, data), in ascending order of document id by
    (part, seq). A block ends at block_docs documents or block_bytes of ids. Partitions follow the bytes of the texts: the
    smaller size up to 2,000 of them, then as many until they reach the larger size. Rows of one id are dealt by their
    text's hash, so an id with very many rows takes several partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, codec, part, seq = _encoder(tokenizer), Codec(corpus.dictionary), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        payloads: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            tokens = sum(map(len, payloads)) // encoder.width
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([tokens], pa.int64()), pa.array([pack(ids, payloads, encoder.width, codec)], pa.binary())],
                names=["part", "seq", "n_docs", "n_tokens", "data"],
            )

        for b in batches:
            for i, p in zip(b.column(0).to_pylist(), _payloads(encoder, b.column(1), end), strict=True):
                ids.append(i)
                payloads.append(p)
                held += len(p)
                if len(ids) >= block_docs or held >= block_bytes:
                    yield block()
                    ids, payloads, held, seq = [], [], 0, seq + 1
        if ids:
            yield block()

    least, most = part_bytes
    parts = max(1, min(2000, -(-corpus.text_bytes // least)), -(-corpus.text_bytes // most))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return materialize(dealt.mapInArrow(run, "part int, seq int, n_docs int, n_tokens bigint, data binary"), "token-ids", "none")


def read_index(blocks: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from its frame; start counts the ids of all documents before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(corpus.dictionary)
        for b in batches:
            for part, seq, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block.open(data, codec)
                ids = [block.read(k) for k in range(len(block.ids))]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                crcs = np.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], dtype=np.int64)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(block.ids, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crcs)],
                    names=["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    each = blocks.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = blocks.select("part", "seq", "n_tokens")
    prior = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each partition of the file
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", prior.alias("before_part"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "seq", inside.alias("before_block")).join(parts, "part").select("part", "seq", (F.col("before_part") + F.col("before_block")).alias("base"))
    return each.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
