"""Hard negatives by exact scores from Four-Russians tables.

The components of a block's candidates are whole numbers in two's complement; each bit plane is packed, eight components to
a byte. For each anchor and each group of eight components a table holds the sums of all 256 subsets of the anchor's
components, made by doubling. A candidate's byte of a plane looks up what that plane adds for those eight components, and
from the sign plane down the sums are shifted and added up to the full inner product: exact, without a product.

Two passes over all rows, in blocks: the first finds each anchor's positives, among the rows of its label; the second the
rows of other labels whose score lies in the band below each positive's score. Both keep the few best of each block; a
ranking merges the blocks. The second pass knows all positives' scores, so nothing is cut before the band is applied.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; a vector without
components scores 0; vectors of different length are compared as if the shorter one went on with zeros; whole numbers
beyond 2^24 are held at it; repeated rows are rows of their own (an anchor's copy can be its positive, it itself can't); a
null vec_id comes last in ties; a positive with a negative score has no band; an anchor without a positive, or a positive
without a negative, gives no row; empty tables give empty results; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.grid import best_first, integer_vectors, matrix, named, rank_by, score_grid, width
from lodestone.runtime import materialize


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """planes x groups x rows, uint8: bit i of a byte is that plane's bit of component 8 * group + i; the last plane is the
    sign. As many planes as the numbers need."""
    most = int(max(rows.max(initial=0), -1 - rows.min(initial=0)))
    n = most.bit_length() + 1
    padded = np.zeros((len(rows), -(-max(rows.shape[1], 1) // 8) * 8), dtype=np.int64)
    padded[:, : rows.shape[1]] = rows
    out = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(n)]
    return np.ascontiguousarray(np.stack(out).transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """groups x 256 x anchors: the sum of the components of each subset of each eight of each anchor."""
    groups = -(-max(anchors.shape[1], 1) // 8)
    padded = np.zeros((len(anchors), groups * 8), dtype=np.int64)
    padded[:, : anchors.shape[1]] = anchors
    out = np.zeros((groups, 256, len(anchors)), dtype=np.int64)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + padded[:, i::8].T[:, None, :]
    return out


def look_up(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """rows x anchors: the inner products."""
    scores = np.zeros((planes.shape[2], tables.shape[2]), dtype=np.int64)
    for b in range(len(planes) - 1, -1, -1):
        scores <<= 1
        for table, codes in zip(tables, planes[b], strict=True):
            if b == len(planes) - 1:
                scores -= table[codes]  # the sign plane counts negative
            else:
                scores += table[codes]
    return scores


def _scored(asked: pa.Table, rows: pa.Table, same: bool, at_once: int = 32, step: int = 4096) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, candidates' places, their scores): those of the anchor's label, or all others."""
    n = width(asked["v"], rows["v"])
    anchors, vectors = matrix(asked["v"], n), matrix(rows["v"], n)
    mine, theirs = asked["label"].to_numpy(zero_copy_only=False).astype(str), rows["label"].to_numpy(zero_copy_only=False).astype(str)
    planes = bit_planes(vectors)
    for label in np.unique(mine):
        some = np.flatnonzero((theirs == label) == same)
        for part in np.split(at := np.flatnonzero(mine == label), range(at_once, len(at), at_once)):
            tables = subset_sums(anchors[part])
            scores = np.concatenate([np.zeros((0, len(part)), dtype=np.int64), *[look_up(tables, planes[:, :, some[i : i + step]]) for i in range(0, len(some), step)]])
            for place, column in zip(part, np.ascontiguousarray(scores.T), strict=True):
                yield place, some, column


def _table(asked: pa.Table, rows: pa.Table, found: list[tuple], bounded: bool) -> pa.Table:
    """found: (anchor's place, candidate's place, score) with, if bounded, the positive's score."""
    columns = [np.array(c, dtype=np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, dtype=np.int64)] * (3 + bounded)
    out = {"anchor": asked["uid"].take(columns[0]), "anchor_id": asked["vec_id"].take(columns[0]), "vec_id": rows["vec_id"].take(columns[1]), "score": columns[2]}
    return pa.table(out | ({"positive_score": columns[3]} if bounded else {}))


def _positives(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        own, (ids, unnamed), anchors = rows["uid"].to_numpy(), named(rows["vec_id"]), asked["uid"].to_numpy()
        found = []
        for place, some, scores in _scored(asked, rows, same=True):
            best = best_first(scores, ids[some], unnamed[some], k + 1)  # one more: the anchor itself may be among them
            found += [(place, some[b], scores[b]) for b in best[own[some[best]] != anchors[place]][:k]]
        return _table(asked, rows, found, False)

    return run


def _negatives(k: int, low: int, high: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        ids, unnamed = named(rows["vec_id"])
        bounds, found = asked["bounds"].to_pylist(), []
        for place, some, scores in _scored(asked, rows, same=False):
            for bound in bounds[place]:
                # whole numbers between bound * low / 100 and bound * high / 100
                inside = np.flatnonzero((scores >= -(-bound * low // 100)) & (scores <= bound * high // 100))
                best = inside[best_first(scores[inside], ids[some[inside]], unnamed[some[inside]], k)]
                found += [(place, some[b], scores[b], bound) for b in best]
        return _table(asked, rows, found, True)

    return run


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256, query_numbers: int = 2**20, row_numbers: int = 2**22
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row for which `anchor` (a condition
    on vec_id) holds and each of its first `positives` other rows of the same label, the first `negatives` rows of another
    label that score between low % and high % of the positive. Scores are inner products of floor(scale * x)."""
    rows = integer_vectors(vectors, vec_id, embedding, label, scale)
    anchors = rows.filter(anchor)
    near = score_grid(anchors, rows, _positives(positives), "anchor bigint, anchor_id bigint, vec_id bigint, score bigint", query_numbers, row_numbers)
    near = near.withColumn("place", rank_by(["anchor"], "score", "vec_id")).filter(F.col("place") <= positives)
    near = materialize(near.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    bounds = near.groupBy("anchor").agg(F.collect_set("positive_score").alias("bounds"))
    asked = materialize(anchors.join(bounds, anchors.uid == bounds.anchor).drop("anchor"), "anchors")
    far = score_grid(asked, rows, _negatives(negatives, low, high), "anchor bigint, anchor_id bigint, vec_id bigint, score bigint, positive_score bigint", query_numbers, row_numbers)
    far = far.withColumn("rank", rank_by(["anchor", "positive_score"], "score", "vec_id")).filter(F.col("rank") <= negatives)
    far = far.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(far, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
