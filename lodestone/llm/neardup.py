"""Near-duplicate groups of texts, for pipelines: SimHash fingerprints by covering masks, verified on the texts.

Two texts are linked if their sets of word shingles have a Jaccard similarity of at least a threshold. At a similarity
of 0.8 two fingerprints differ in about 15 % of their bits: too many for the masks of a whole 64-bit fingerprint, whose
number doubles with each bit of radius. So the fingerprint (the majority bits of the shingles' hashes, as in simhash) is
wider and cut into parts, and each part has its own covering family: every pair that differs in at most `radius` bits
of a part agrees on the kept bits of one of the part's 2^(radius+1) - 1 masks. Width, radius and number of the parts
follow from the number of texts, so that a pair at the threshold is outside the radius of all parts with a probability
of `miss` at most (more similar pairs: far less), and tables and comparisons cost the least together.

Texts with equal sets are collapsed to one node first. Nodes in a bucket are compared by all bits of their fingerprints;
buckets above `block` nodes are compared block against block. In a first pass each node names only its nearest and its
least candidate, so a large group of near copies gives two candidate pairs for each member and bucket at most; they are
verified on the whole sets of shingles. In a second pass all candidate pairs whose ends are still in different groups are
verified where they meet first, on sets of shingles that the tasks map into memory from files in the shared folder; one
link between two groups leaves a task, not pairs. So no similar pair goes unseen, and no table of all pairs is made.

Edge cases: texts without a word (null, empty) are copies of each other; a text with fewer words than a shingle is one
shingle; rows keep all their columns, whatever their ids; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.kneser import mapped_array, save_array
from lodestone.llm.simhash import majority_bits, shingle_hashes
from lodestone.operators.components import connected_components
from lodestone.runtime import discard, materialize, scratch

_MIX = np.uint64(0x9E3779B97F4A7C15)
PAIR_NS, ROW_NS, WORD_NS = 3, 2_000, 30_000  # what a comparison, a row of a table and 64 bits of a fingerprint take, about


class Cover(NamedTuple):
    width: int  # bits of a part
    radius: int  # differing bits of a part that its masks cover
    parts: int

    @property
    def words(self) -> int:
        """64-bit words of the fingerprint; a part lies within one word, and there are two at least."""
        return max(2, -(-self.parts // (64 // self.width)))


def differing(similarity: float) -> float:
    """The share of fingerprint bits in which two sets of this Jaccard similarity differ, at most."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def choose_cover(n: int, share: float, miss: float) -> Cover:
    """The cheapest cover of n texts for pairs that differ in this share of the bits."""
    best = None
    for width in (16, 20, 24, 32, 40, 48):
        below = 0.0
        for radius in range(width // 3):
            below += math.comb(width, radius) * share**radius * (1 - share) ** (width - radius)
            parts = max(1, math.ceil(math.log(miss) / math.log(max(1 - below, 1e-12))))
            cover = Cover(width, radius, parts)
            cost = parts * (2 ** (radius + 1) - 1) * (ROW_NS + PAIR_NS * n / 2 ** (width / 2 + 1)) + cover.words * WORD_NS
            if best is None or cost < best[0]:
                best = cost, cover
    return best[1]


@lru_cache(maxsize=16)
def part_masks(width: int, radius: int, tries: int = 64) -> tuple[int, ...]:
    """The masks of a covering family over `width` bits: for each bit a vector of radius + 1 bits that isn't zero, and for
    each such vector v the bits whose vector has an odd inner product with v. Of `tries` draws of the bits' vectors, the
    one whose masks let the fewest random pairs meet."""
    size = 1 << (radius + 1)
    odd = np.bitwise_count(np.arange(size)[:, None] & np.arange(size)[None, 1:]) % 2  # vector x v
    rng, best = np.random.RandomState(width * 64 + radius), None
    for _ in range(tries):
        m = np.concatenate([1 + rng.permutation(size - 1) for _ in range(-(-width // (size - 1)))])[:width]
        kept = odd[m]
        meet = (0.5 ** kept.sum(axis=0)).sum()
        if best is None or meet < best[0]:
            best = (meet, kept)
    return tuple(sum(1 << i for i in np.flatnonzero(column).tolist()) for column in best[1].T)


def tables(cover: Cover) -> list[tuple[int, int]]:
    """(word, mask as a signed integer) of each table."""
    per_word = 64 // cover.width
    out = []
    for part in range(cover.parts):
        for mask in part_masks(cover.width, cover.radius):
            shifted = mask << (part % per_word * cover.width)
            out.append((part // per_word, shifted - (1 << 64) if shifted >> 63 else shifted))
    return out


def _signatures(words: int):
    """Replaces the last column, shingle hashes, by the node (hash of the set) and the words of the fingerprint of the set."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(b.num_columns - 1)
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
        sets = [np.unique(x) for x in np.split(flat, offsets[1:-1] - offsets[0])] if b.num_rows else []
        nodes = np.array([np.uint64(xxhash.xxh64_intdigest(x.tobytes())) if len(x) else np.uint64(0) for x in sets], dtype=np.uint64).view(np.int64)
        ends, h = np.cumsum([len(x) for x in sets], dtype=np.int64), np.concatenate([*sets, np.zeros(0, np.uint64)])
        prints = []
        for _ in range(words):
            prints.append(pa.array(majority_bits(h, ends).view(np.int64)))
            h = (h ^ (h >> np.uint64(31))) * _MIX
            h ^= h >> np.uint64(29)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(nodes), *prints], names=[*b.schema.names[:-1], "node", *(f"f{i}" for i in range(words))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                yield one(whole.slice(begin, 500))

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The sorted rows, a table for each run of equal values in the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != values[i, 0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(b.slice(begin, end - begin))
            if end < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Sets:
    """The shingle sets of nodes, mapped into memory from files of the shared folder."""

    def __init__(self, folder: str, shards: int) -> None:
        self.system, self.base = fs.FileSystem.from_uri(folder)
        self.shards, self.held = shards, {}

    def get(self, node: int) -> np.ndarray:
        shard = node % self.shards
        if shard not in self.held:
            if len(self.held) >= 512:
                self.held.pop(next(iter(self.held)))
            self.held[shard] = [mapped_array(self.system, f"{self.base}/{kind}-{shard}.npy") for kind in ("nodes", "ends", "sets")]
        nodes, ends, sets = self.held[shard]
        at = int(np.searchsorted(nodes, node))
        return sets[ends[at] : ends[at + 1]]


def write_sets(sets: DataFrame, folder: str, shards: int) -> None:
    """Writes (node, s) as files of sorted arrays, by node modulo shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a shard has about 2,000 sets
        if held:
            nodes = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held])
            sizes = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in held])
            shard = int(nodes[0]) % shards
            save_array(folder, f"nodes-{shard}", nodes)
            save_array(folder, f"ends-{shard}", np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            save_array(folder, f"sets-{shard}", np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in held]))
        yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])

    dealt = sets.select("node", F.array_sort("s").alias("s")).repartitionById(shards, F.pmod("node", F.lit(shards)).cast("int")).sortWithinPartitions("node")
    dealt.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


class Verify(NamedTuple):
    """How the second pass verifies: the files of the sets, the threshold, and all tables of the cover."""

    folder: str
    shards: int
    threshold: float
    tables: list[tuple[int, int]]

    def links(self, sets: Sets, t: int, f: list[np.ndarray], node: np.ndarray, group: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Of the pairs (i, j) that meet in table t for the first time, one similar pair for each two groups."""
        new = np.ones(len(i), dtype=bool)
        for w, m in self.tables[:t]:
            at = np.flatnonzero(new)
            new[at] = ((f[w][i[at]] ^ f[w][j[at]]) & np.uint64(m & 0xFFFFFFFFFFFFFFFF)) != 0
        i, j = i[new], j[new]
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for begin, end in zip(*_bounds(i), strict=True):
            mine, partners = sets.get(int(node[i[begin]])), j[begin:end]
            theirs = [sets.get(int(node[k])) for k in partners]
            sizes = np.array([len(x) for x in theirs])
            flat = np.concatenate(theirs)
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            for k in partners[common >= self.threshold * (len(mine) + sizes - common)]:
                ends = (int(node[i[begin]]), int(node[k]))
                out[int(group[i[begin]]), int(group[k])] = (min(ends), max(ends))
        return list(out.values())


def _bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.diff(sorted_values, prepend=-1))
    return begins, np.append(begins[1:], len(sorted_values))[: len(begins)]


def _candidates(words: int, most: int, most_first: int, cover: list[tuple[int, int]], verify: Verify | None, rows: int = 256):
    """Pairs of a bucket's nodes whose fingerprints differ in `most` bits or fewer (and the first words in most_first): those
    of each node with its nearest and its least such partner; or, with verify, similar ones of different groups."""
    all_pairs = verify is not None

    def near(f: list[np.ndarray], r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.bitwise_count(f[0][r][:, None] ^ f[0][c][None, :]) <= most_first)
        i, j = r[i], c[j]
        far = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in f)
        fit = (far <= most) & (i != j)
        return i[fit], j[fit], far[fit]

    def pairs(t: pa.Table, sets: Sets | None) -> np.ndarray:
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        node, group, block = (t.column(c).to_numpy() for c in ("node", "group", "block"))
        order = np.lexsort((node, group))
        node, group, block = node[order], group[order], block[order]
        f = [t.column(f"f{i}").to_numpy()[order].view(np.uint64) for i in range(words)]
        mine, theirs = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = [np.zeros((2, 0), dtype=np.int64)]
        for one, other in ((mine, theirs),) if all_pairs or low == high else ((mine, theirs), (theirs, mine)):
            for begin in range(0, len(one), rows):
                r, c = one[begin : begin + rows], other
                if all_pairs:
                    c = c[np.searchsorted(c, r[0]) :] if low == high else c
                    c = c[group[c] != group[r[0]]] if group[r[0]] == group[r[-1]] else c  # sorted by group
                    i, j, _ = near(f, r, c)
                    apart = group[i] != group[j]
                    links = verify.links(sets, t.column("t")[0].as_py(), f, node, group, i[apart], j[apart])
                    found.append(np.array(links, dtype=np.int64).reshape(-1, 2).T)
                    continue
                i, j, far = near(f, r, c)
                for order in (np.lexsort((node[j], far, i)), np.lexsort((node[j], i))):
                    x = i[order]
                    first = order[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else order
                    for w, m in cover[: t.column("t")[0].as_py()]:  # a pair is named where it meets first
                        first = first[((f[w][i[first]] ^ f[w][j[first]]) & np.uint64(m & 0xFFFFFFFFFFFFFFFF)) != 0]
                    found.append(np.stack([node[i[first]], node[j[first]]]))
        ends = np.concatenate(found, axis=1)
        return np.stack([ends.min(axis=0), ends.max(axis=0)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        sets = Sets(verify.folder, verify.shards) if verify else None
        for t in _runs(batches, 4):
            if t.num_rows > 1:
                held.append(pairs(t, sets))
                size += held[-1].shape[1]
            if size > 200_000 or len(held) > 1000:
                a, b = np.unique(np.concatenate(held, axis=1), axis=1)
                held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        if held:
            a, b = np.unique(np.concatenate(held, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def candidate_pairs(nodes: DataFrame, cover: Cover, share: float, verify: Verify | None = None, block: int = 4096) -> DataFrame:
    """(a, b): pairs of nodes (node, group, f0, f1, ...) that share a bucket and whose fingerprints are near enough: the
    nearest and the least of each node, or, with verify, verified links between groups."""
    words = [f"f{i}" for i in range(cover.words)]
    made = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(m).alias("m")) for t, (w, m) in enumerate(tables(cover))])
    dealt = nodes.withColumn("x", F.explode(made)).withColumn("key", F.element_at(F.array(*words), F.col("x.w") + 1).bitwiseAND(F.col("x.m")))
    dealt = dealt.select(F.col("x.t").alias("t"), "key", "node", "group", *words)
    large = materialize(dealt.groupBy("t", "key").count().filter(F.col("count") > block).select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("n")), "large")
    if large.isEmpty():  # the wide rows are then dealt once
        placed = dealt.withColumns({c: F.lit(0) for c in ("block", "low", "high")})
    else:
        placed = dealt.join(large, ["t", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", "t"), F.col("n")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    keys = ["t", "key", "low", "high"]
    sorted_rows = placed.select(*keys, "block", "node", "group", *words).repartition(*keys).sortWithinPartitions(*keys)
    bits, spread = 64 * cover.words, lambda n: math.ceil(share * n + 3.5 * math.sqrt(share * (1 - share) * n))
    return sorted_rows.mapInArrow(_candidates(cover.words, spread(bits), spread(64), tables(cover), verify), "a bigint, b bigint").distinct()


def _sets(pairs: DataFrame, nodes: DataFrame, signed: DataFrame, text: str, words: int) -> DataFrame:
    """(node, s): the shingle set of each node of the pairs. Texts are fetched by the number of one row of each node, so that
    the copies of a text stay where they are."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = nodes.select("node", "_row").join(ends, "node", "left_semi").select("_row")
    texts = signed.select("node", "_row", F.col(text).alias("text")).join(rows, "_row", "left_semi")
    return materialize(texts.select("node", F.array_distinct(shingle_hashes(F.col("text"), words)).alias("s")), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are as similar as the threshold."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return materialize(both.filter(F.col("common") >= threshold * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b"), "similar")


def _linked(docs: DataFrame, text: str, words: int, threshold: float, miss: float) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with a number _row and the node of their text, (node, component) of the nodes that are linked)."""
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    share = differing(threshold)
    cover = choose_cover(docs.count(), share, miss)
    prints = [f"f{i}" for i in range(cover.words)]
    types = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    hashed = docs.withColumn("_shingles", shingle_hashes(F.col(text), words))
    signed = materialize(hashed.mapInArrow(_signatures(cover.words), f"{types}, node bigint, " + ", ".join(f"{f} bigint" for f in prints)), "signatures")
    nodes = materialize(signed.filter("node <> 0").groupBy("node").agg(F.min("_row").alias("_row"), *[F.min(f).alias(f) for f in prints]), "nodes")
    pairs = materialize(candidate_pairs(nodes.withColumn("group", F.col("node")), cover, share), "pairs")
    sets = _sets(pairs, nodes, signed, text, words)
    links = _similar(pairs, sets, threshold)
    found = materialize(connected_components(links), "groups")
    # nodes without a candidate are near none
    grouped = materialize(nodes.join(sets.select("node"), "node", "left_semi").join(found, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component"), "grouped")
    shards, folder = max(8, grouped.count() // 2000), scratch(docs.sparkSession, "sets")
    write_sets(sets, folder, shards)
    across = materialize(candidate_pairs(grouped, cover, share, Verify(folder, shards, threshold, tables(cover))), "across")
    if not across.isEmpty():
        found = materialize(connected_components(links.unionByName(across)), "groups")
    for table in (nodes, pairs, sets, grouped, across):
        discard(table)
    return signed.drop(*prints), found


def near_groups(docs: DataFrame, text: str = "text", words: int = 5, threshold: float = 0.8, miss: float = 0.01) -> DataFrame:
    """The rows of docs with group (bigint): the same for all texts that a chain of similar texts connects."""
    signed, found = _linked(docs, text, words, threshold, miss)
    return signed.join(found, "node", "left").select(*docs.columns, F.coalesce("component", "node").alias("group"))


def near_unique(
    docs: DataFrame, ties: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, miss: float = 0.01
) -> DataFrame:
    """One row of docs for each group of near_groups: that with the least id (no id comes last), of equal ids the least hash of
    the columns in ties. The least rows are aggregated for each text and then for each group before anything is shuffled, and
    the rows are kept by a number that is written with them, so a group of any size is spread over all tasks."""
    signed, found = _linked(docs.withColumn("_tie", F.xxhash64(*ties)), text, words, threshold, miss)
    first = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("_tie"), F.col("_row"))
    texts = signed.groupBy("node").agg(F.min(first).alias("first")).join(found, "node", "left")
    kept = texts.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select("first._row")
    return signed.join(kept, "_row", "left_semi").select(*docs.columns)
