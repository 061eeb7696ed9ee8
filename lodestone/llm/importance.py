"""Importance resampling towards a target distribution, with the counting done once for each distinct line.

Features are runs of one to three consecutive words, hashed to `buckets` buckets by CRC-32. A bucket's gain tells how much
more often the target has it than the raw corpus; a document's weight is the sum of its features' gains; a Gumbel number of
its id is added, and the documents with the highest scores are drawn without replacement.

Line breaks are separators, so a document's features are those inside its lines and the runs of two and three words that
cross a line's end. Lines repeat: the buckets of each distinct line are computed once, counted as often as the line occurs,
and its gain is summed once and joined back to the documents that hold it. Runs across lines are added for each document.

CRC-32 is linear: the checksum of two joined strings follows from theirs and the second one's length. So each word is
hashed once and runs are put together from their words' checksums, for whole Arrow batches at a time.

The corpus is read twice, lines are counted before they are shuffled, and tables of bounded size are all that passes through
the driver: two counts for each bucket. Ranks over all documents are taken by ranges of the order, so no task sorts them all.

Edge cases: a null text has no word, weight 0 and no features; an empty corpus gives an empty result, an empty target the
gains of smoothing alone; repeated rows are documents of their own, with the same weight; a null id counts as the empty
text in the Gumbel number and comes last in ties; words and lines may have any length; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.words import UPPER
from lodestone.runtime import materialize

#: Bytes of words: digits, small letters after folding, and all of characters beyond ASCII.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
_NEWLINE, SHORT = 10, 64


# --- checksums of runs ---------------------------------------------------------


@lru_cache(maxsize=1)
def _step_table() -> np.ndarray:
    """CRC-32 of each byte on a zero register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def _shift_by(tables: np.ndarray, at: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    out = tables[at, 0, crc & np.uint32(255)]
    for k in (1, 2, 3):
        out = out ^ tables[at, k, crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


@lru_cache(maxsize=1)
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables (length, byte of the register, its value) of what zero bytes do to a register: for 0 to SHORT zero bytes, and for
    1, 2, 4, ... of them."""
    step = _step_table()
    one = lambda t: step[t & np.uint32(255)] ^ (t >> np.uint32(8))
    short = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT):
        short.append(one(short[-1]))
    powers = [short[1]]
    for _ in range(40):
        powers.append(_shift_by(powers[-1][None], 0, powers[-1]))
    return np.stack(short), np.stack(powers)


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The checksums of first's strings followed by second's, which have that many bytes."""
    short, powers = _shifts()
    out = _shift_by(short, np.minimum(length, SHORT), first)
    for i in np.flatnonzero(length > SHORT):
        crc = first[i : i + 1]
        for bit in range(int(length[i]).bit_length()):
            if length[i] >> bit & 1:
                crc = _shift_by(powers, bit, crc)
        out[i] = crc[0]
    return out ^ second


def word_crcs(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The checksums of the words buffer[start:end]."""
    step, size = _step_table(), end - start
    order = np.argsort(-np.minimum(size, SHORT), kind="stable")
    begin, sizes = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(min(int(sizes.max(initial=0)), SHORT)):
        n = int(np.searchsorted(-np.minimum(sizes, SHORT), -k, side="left"))  # words of over k bytes
        crc[:n] = step[(crc[:n] ^ buffer[begin[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(buffer[start[i] : end[i]].tobytes())
    return out


class Words:
    """The words of a batch of texts: where they are, and the numbers of their texts and, in all of the batch, lines."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        self.n_texts, self.buffer = len(texts), _FOLD[raw]
        inside = _IN_WORD[self.buffer]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[:-1] = inside
        begins = edge.copy()
        begins[1:-1] &= ~inside[:-1]
        begins[offsets[:-1]] |= edge[offsets[:-1]]  # a text begins anew
        self.start = np.flatnonzero(begins)
        stop = np.zeros(len(inside) + 1, dtype=bool)
        stop[1:] = inside
        stop[:-1] &= ~inside | begins[:-1]
        self.end = np.flatnonzero(stop)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.line = np.searchsorted(np.flatnonzero(self.buffer == _NEWLINE), self.start)

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)

    def features(self, crossing: bool, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, their texts' numbers) of the runs inside texts; crossing: only of those that cross a line's end."""
        n = len(self.start)
        runs = [np.ones(max(n - k, 0), dtype=bool) for k in range(3)]
        for k in (1, 2):
            runs[k] = self.text[: max(n - k, 0)] == self.text[k:]
        if crossing:
            runs = [r & (self.line[: max(n - k, 0)] != self.line[k:]) for k, r in enumerate(runs)]
        first = [np.flatnonzero(r) for r in runs]
        used = np.zeros(n, dtype=bool)
        for k, at in enumerate(first):
            for i in range(k + 1):
                used[at + i] = True
        some = np.flatnonzero(used)
        crc, size = np.zeros(n, dtype=np.uint32), self.end - self.start
        crc[some] = word_crcs(self.buffer, self.start[some], self.end[some])
        space = np.uint32(zlib.crc32(b" "))
        found = []
        for k, at in enumerate(first):
            run = crc[at]
            for i in range(1, k + 1):
                run = joined_crc(joined_crc(run, space, np.ones(len(at), dtype=np.int64)), crc[at + i], size[at + i])
            found.append(run % np.uint32(buckets))
        owner = np.concatenate([self.text[at] for at in first])
        order = np.argsort(owner, kind="stable")
        return np.concatenate(found)[order], owner[order]


# --- passes over lines and documents -------------------------------------------


def _slices(b: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text; a longer text is a slice of its own."""
    ends = np.cumsum(b.column(column).cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pandas().str.len().to_numpy()) if b.num_rows else []
    begin = 0
    while begin < b.num_rows:
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield b.slice(begin, stop - begin)
        begin = stop


def _packed(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """For each of n rows its values, as 4-byte or, where they fit, 2-byte whole numbers."""
    ends = np.searchsorted(owner, np.arange(n), side="right")
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2") if buckets <= 65536 else np.dtype("<u4")


def _line_features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "line"):
                w = Words(b.column("line"))
                values, owner = w.features(False, buckets)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), _packed(values.astype(_kind(buckets)), owner, b.num_rows)], names=["key", "n", "features"])

    return run


def _crossing_features(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "text"):
                w = Words(b.column("text"))
                values, owner = w.features(True, buckets)
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("keys"), pa.array(w.counts(), type=pa.int64()), _packed(values.astype(_kind(buckets)), owner, b.num_rows)], names=["uid", "doc_id", "keys", "n_words", "features"])

    return run


def _flat(values: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed ones, and how many each row has."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    if not len(values) or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=kind), np.zeros(len(values), dtype=np.int64)
    raw = np.frombuffer(values.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind), np.diff(offsets).astype(np.int64) // kind.itemsize


def _count_buckets(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            values, sizes = _flat(b.column("features"), _kind(buckets))
            total += np.bincount(values, weights=np.repeat(b.column("n").to_numpy(), sizes), minlength=buckets).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return run


def _sum_gains(gains: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, sizes = _flat(b.column("features"), _kind(len(gains)))
            sums = np.concatenate([[0], np.cumsum(gains[values])])
            own = np.diff(sums[np.concatenate([[0], np.cumsum(sizes)])])
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(own.astype(np.int64))], names=[*keep, "weight"])

    return run


# --- the operator ----------------------------------------------------------------


def segment_features(docs: DataFrame, buckets: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: the distinct lines (key, n, features), with the number of times each occurs, and the documents
    (uid, doc_id, keys, n_words, features), with the keys of their lines in order and the features across lines."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    key = lambda x: F.unhex(F.md5(x.cast("binary")))
    distinct = rows.select(F.explode(lines).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    distinct = distinct.select(key(F.col("line")).alias("key"), "n", "line").mapInArrow(_line_features(buckets), "key binary, n bigint, features binary")
    own = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.transform(lines, key).alias("keys"), "text")
    own = own.mapInArrow(_crossing_features(buckets), f"uid bigint, doc_id {kind}, keys array<binary>, n_words bigint, features binary")
    return materialize(distinct, "lines"), materialize(own, "texts")


def bucket_counts(lines: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): the number of features of all texts in each bucket that has any."""
    both = lines.select("n", "features").unionByName(texts.select(F.lit(1).cast("long").alias("n"), "features"))
    return both.mapInArrow(_count_buckets(buckets), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) for each bucket, a table of that bounded size."""
    every = raw.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    every = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0)
    x = lambda c: c.cast("double")
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (x(F.col("t") + 1) * x(F.col("all_s") + buckets)) / (x(F.col("s") + 1) * x(F.col("all_t") + buckets))
    rows = every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")).collect()
    gains = np.zeros(buckets, dtype=np.int64)
    gains[[r["bucket"] for r in rows]] = [r["gain"] for r in rows]
    return gains


def ranked(scored: DataFrame, eligible: str, percent: int, score: str = "score", tie: str = "doc_id", uid: str = "uid") -> DataFrame:
    """scored with rank: 1, 2, ... for the floor(percent * N / 100) highest scores of the N eligible rows, ties to smaller ids
    (null ids last); null for all others. Rows are dealt by ranges of the order; ranks follow from the ranges' sizes."""
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(eligible), F.desc(score), F.asc_nulls_last(tie), F.asc(uid)]
    dealt = materialize(scored.repartitionByRange(max(tasks, scored.count() // 1_000_000), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.filter(eligible).groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = dealt.join(F.broadcast(sizes), "_range", "left").withColumn("rank", place.cast("long"))
    return rows.withColumn("rank", F.when(F.col(eligible) & (F.col("rank") <= F.floor(F.col("_all") * percent / 100)), F.col("rank"))).drop("_range", "_before", "_all")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 5, least_words: int = 20, seed: int = 42, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each document: rank, from 1, of those drawn, percent % of the
    documents with at least least_words words; null for all others."""
    lines, texts = segment_features(docs, buckets, doc_id, text)
    wanted = segment_features(target.select(F.lit(0).alias("no"), F.col(target_text).alias("text")), buckets, "no")
    gains = bucket_gains(bucket_counts(lines, texts, buckets), bucket_counts(*wanted, buckets), buckets)
    worth = lines.select("key", "features").mapInArrow(_sum_gains(gains, ["key"]), "key binary, weight bigint")
    held = texts.select("uid", F.explode("keys").alias("key")).join(worth, "key").groupBy("uid").agg(F.sum("weight").alias("inside"))
    kind = dict(texts.dtypes)["doc_id"]
    across = texts.select("uid", "doc_id", "n_words", "features").mapInArrow(_sum_gains(gains, ["uid", "doc_id", "n_words"]), f"uid bigint, doc_id {kind}, n_words bigint, weight bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = across.join(held, "uid", "left").withColumn("weight", F.col("weight") + F.coalesce("inside", F.lit(0)))
    n = F.col("n_words")
    rows = rows.select("uid", "doc_id", "n_words", (n + F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))).alias("n_features"), "weight", (F.col("weight") + noise).alias("score"))
    scored = materialize(rows.withColumn("_fit", n >= least_words), "scored")
    return ranked(scored, "_fit", percent).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
