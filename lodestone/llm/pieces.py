"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds all pieces. One pass over a text visits, at each position, every piece that ends there (the state
and its output links), and relaxes the best score at that position; following the best arrivals back gives the pieces
with the highest sum of scores. Characters that are no piece cost less than the worst piece and are written as byte
pieces (or as the unknown piece, where the model has no bytes). Between equal sums, the longer last piece wins.

If no piece holds a space mark after another character, a new segment can begin at each run of space marks; the
segments' ids are remembered in a bounded table of the worker, as words recur.

Edge cases: a null or empty text has no pieces and decodes to the empty text; a text that itself holds the mark U+2581
decodes with a space in its place, as in the public library; texts of any length are encoded whole; repeated rows are
encoded one by one; extra columns are dropped; empty tables give empty results.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_BELOW = 10.0  # as in the public library: below the least score of a piece


class Pieces(NamedTuple):
    texts: list[str]  # "" for control pieces
    scores: list[float]
    bytes_at: list[int]  # the ids of the 256 byte pieces; empty if there are none
    unknown: int
    prefix: bool  # whether a space mark is put before the text

    @classmethod
    def read(cls, path: str) -> Pieces:
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "\u00c5ﬁ  x\u0301\u3000Ａ "
        if p.normalize(probe).replace(MARK, " ").removeprefix(" ") != probe:
            raise ValueError("the model changes texts before it cuts them; only models without normalisation can be used")
        texts, bytes_at = [], {}
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                bytes_at[int(piece[3:5], 16)] = i
            texts.append("" if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else piece)
        probe = p.encode("a", out_type=str)
        return cls(texts, [p.get_score(i) for i in range(len(texts))], [bytes_at[b] for b in range(256)] if len(bytes_at) == 256 else [], p.unk_id(), "".join(probe).startswith(MARK))


class Encoder:
    def __init__(self, pieces: Pieces, limit: int = 400_000) -> None:
        self.pieces, self.limit = pieces, limit
        self.known: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(pieces.texts):
            if t:
                self.automaton.add_word(t, (len(t), pieces.scores[i], i))
        self.automaton.make_automaton()
        self.single = {t for t in pieces.texts if len(t) == 1}
        self.unknown_score = min(s for s, t in zip(pieces.scores, pieces.texts, strict=True) if t) - UNKNOWN_BELOW
        used = set("".join(pieces.texts))
        apart = "".join(c for c in "\n\t" if c not in used)
        whole = any(MARK in t.lstrip(MARK) for t in pieces.texts)
        self.segments = re.compile(r"[\s\S]+" if whole else f"{MARK}*[^{MARK}{apart}]+|{MARK}+" + f"|[{apart}]" * bool(apart))
        self.as_bytes = [t.replace(MARK, " ").encode() for t in pieces.texts]
        for b, i in enumerate(pieces.bytes_at):
            self.as_bytes[i] = bytes([b])
        self.as_bytes[pieces.unknown] = " ⁇ ".encode()

    def viterbi(self, text: str) -> list[int]:
        """The ids of the best pieces of a normalised text."""
        n = len(text)
        best, came, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        if n > 4096:  # 16 bytes for each character of a long run without spaces
            best, came, piece = array("d", best), array("i", came), array("i", piece)
        done, single, low = 0, self.single, self.unknown_score
        for last, (size, score, i) in self.automaton.iter(text):
            while done < last:  # what ends before this piece is final
                if text[done] not in single and best[done] + low > best[done + 1]:
                    best[done + 1], came[done + 1], piece[done + 1] = best[done] + low, done, -1
                done += 1
            total = best[last + 1 - size] + score
            if total > best[last + 1]:
                best[last + 1], came[last + 1], piece[last + 1] = total, last + 1 - size, i
        while done < n:
            if text[done] not in single and best[done] + low > best[done + 1]:
                best[done + 1], came[done + 1], piece[done + 1] = best[done] + low, done, -1
            done += 1
        out: list[int] = []
        while n:
            begin, i = came[n], piece[n]
            if i >= 0:
                out.append(i)
            elif self.pieces.bytes_at:
                out.extend(self.pieces.bytes_at[b] for b in reversed(text[begin:n].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.pieces.unknown)
            n = begin
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if self.pieces.prefix:
            text = " " + text
        found, known = self.segments.findall(text.replace(" ", MARK)), self.known
        try:
            ids = b"".join([known[s] for s in found])
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for s in {s for s in found if s not in known}:
                known[s] = np.array(self.viterbi(s), dtype="<i4").tobytes()
            ids = b"".join([known[s] for s in found])
        return np.frombuffer(ids, dtype="<i4")

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.as_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


_LOADED: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(Pieces.read(path))
    return _LOADED[path]


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row; model is the path of a model file that every worker can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                b = whole.slice(begin, 1000)
                ids = [encoder.encode(t) if t else np.zeros(0, dtype=np.int32) for t in b.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of the rows of encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [encoder.decode(flat[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def encode_with_check(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) of each row: encoded, and decoded again to be compared with the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                b = whole.slice(begin, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids = [encoder.encode(t) for t in texts]
                same = [encoder.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)]
                sizes = np.array([len(x) for x in ids], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(same)], names=["doc_id", "n_pieces", "ids", "round_trip"]
                )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[doc_id]}, n_pieces bigint, ids array<int>, round_trip boolean")
