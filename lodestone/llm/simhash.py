"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has one bit per position of the XXH64 hashes (seed 42) of a text's word shingles: set if over half of the
hashes have it. Fingerprints that differ in at most `radius` bits are linked. The tables of a covering family keep the
bits i with <m(i), v> = 1, for every non-zero v of radius + 1 bits and one fixed random m: for any `radius` positions
some v is orthogonal to all their m, so every pair within the radius agrees on the kept bits of some table. That is
exact, not probable.

Equal fingerprints are collapsed first. Buckets above `fine` distinct fingerprints are dealt again by a second, and
those left by a third family, each of which keeps the guarantee; three families leave so few free bits that a bucket
holds a bounded number of distinct fingerprints however many documents there are. Inside a bucket only links to the
least member of each local group leave the task.

Edge cases: a null or empty text has no word and the fingerprint 0, which is linked like any other; a text with fewer
words than a shingle is one shingle; repeated rows share a fingerprint and a component; rows with a null id
link others like any row and get the least id of their component (null if it holds none); extra columns are dropped; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.words import let, lower_ascii, words
from lodestone.operators.components import connected_components
from lodestone.runtime import materialize

#: For each byte, its 8 bits as the 8 bytes of one integer: sums of up to 255 such integers don't carry.
_SPREAD = np.array([sum(((x >> i) & 1) << (8 * i) for i in range(8)) for x in range(256)], dtype="<u8")


def shingle_hashes(text: Column, n: int = 3) -> Column:
    """array<bigint>: XXH64 with seed 42 of each n-word shingle, repeats included."""

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
        each = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))

    return let(words(lower_ascii(text)), of)


def majority_bits(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes (uint64); ends are the runs' ends."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    out = np.zeros(len(ends), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    blocks = -(-sizes[full] // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    within = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(starts[full], blocks) + 255 * within
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[raw[:, byte]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts = np.add.reduceat(sums, first, axis=0)
        bits = (2 * counts > sizes[full][:, None]).astype(np.uint64)
        for i in range(8):
            out[full] |= bits[:, i] << np.uint64(8 * byte + i)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint) of each row."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].view(np.uint64)
            fp = majority_bits(flat, (ends[1:] - ends[0]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    hashed = docs.select(F.col(doc_id).alias("doc_id"), shingle_hashes(F.col(text)).alias("h"))
    return hashed.mapInArrow(fold, f"doc_id {dict(docs.dtypes)[doc_id]}, fp bigint")


def covering_masks(radius: int, family: int, bits: int = 64) -> list[int]:
    """The 2^(radius+1) - 1 masks of one covering family, as signed 64-bit integers. Families differ in m."""
    size = 1 << (radius + 1)
    order = np.random.RandomState(1000 + family).permutation(bits)
    m = np.empty(bits, dtype=np.int64)
    m[order] = 1 + np.arange(bits) % (size - 1)
    masks = [sum(1 << i for i in range(bits) if bin(int(m[i]) & v).count("1") % 2) for v in range(1, size)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _local_links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[np.ndarray] = []
            for members in b.column(0):
                x = np.sort(np.array(members.values.to_numpy()))
                u = x.view(np.uint64)
                near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
                label = np.arange(len(x))
                while True:
                    least = np.where(near, label[None, :], len(x)).min(axis=1)
                    least = least[least]
                    if (least == label).all():
                        break
                    label = least
                away = np.flatnonzero(label != np.arange(len(x)))
                found.append(np.stack([x[away], x[label[away]]]))
            pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return link


def fingerprint_links(distinct: DataFrame, radius: int = 3, fine: int = 64, families: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints fp that connect all that are within the radius of each other."""
    rows = distinct.select("fp", F.lit("").alias("path"), F.lit(0).cast("long").alias("kept_bits"))
    parts = []
    for family in range(families):
        masks = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(m).alias("m")) for v, m in enumerate(covering_masks(radius, family))])
        dealt = rows.withColumn("x", F.explode(masks)).select(
            "fp", F.concat("path", F.lit("."), F.col("x.v").cast("string")).alias("path"), F.col("kept_bits").bitwiseOR(F.col("x.m")).alias("kept_bits")
        )
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(F.col("kept_bits")))
        counts = dealt.groupBy("path", "key").count().filter("count > 1")
        shared = materialize(dealt.join(counts, ["path", "key"]), "buckets")
        small = shared if family == families - 1 else shared.filter(F.col("count") <= fine)
        members = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        parts.append(members.mapInArrow(_local_links(radius), "a bigint, b bigint").distinct())
        rows = shared.filter(F.col("count") > fine).select("fp", "path", "kept_bits")
        if family < families - 1 and rows.isEmpty():
            break
    links = parts[0]
    for more in parts[1:]:
        links = links.unionByName(more)
    return links


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): the 16 hex digits, and the smallest doc_id that links reach."""
    fps = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    links = materialize(fingerprint_links(distinct, radius), "fingerprint-links")
    found = connected_components(links)
    rooted = materialize(distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")  # a plain join, which can be split
    groups = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(groups, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
