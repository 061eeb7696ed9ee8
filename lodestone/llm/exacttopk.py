"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector of whole numbers is a sparse row: its components that aren't zero, with their weights. A block of rows is turned
into postings, for each component the places of the rows that have it and their weights. A query takes its components one
after another and scatters weight * posting weights into a dense array of scores, one for each row of the block; so every
row gets its full inner product. The k best of a block are chosen by partition, and a ranking by query merges the blocks.

Edge cases: vectors that are null or hold null or non-finite components take no part; a vector without components scores 0
with all; vectors of different length are compared as if the shorter one went on with zeros; whole numbers beyond 2^24 are
held at it; repeated rows are rows of their own (a query finds its own copies, not itself); a null vec_id comes last in
ties and is a query only if `query` says so; empty tables give empty results; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.grid import best_first, integer_vectors, matrix, named, rank_by, score_grid, width


def postings(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each component the places of the rows where it isn't zero, and their weights."""
    out = []
    for weights in np.ascontiguousarray(rows.T):
        at = np.flatnonzero(weights)
        out.append((at, weights[at]))
    return out


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The inner products of a query with the n rows that the postings are of."""
    scores = np.zeros(n, dtype=np.int64)
    for term in np.flatnonzero(query):
        at, weights = lists[term]
        if len(at) == n:
            scores += query[term] * weights
        else:
            scores[at] += query[term] * weights
    return scores


def _search(k: int):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        n = width(asked["v"], rows["v"])
        lists = postings(matrix(rows["v"], n))
        own, (ids, unnamed) = rows["uid"].to_numpy(), named(rows["vec_id"])
        found: list[np.ndarray] = []
        scores_of: list[np.ndarray] = []
        for uid, query in zip(asked["uid"].to_numpy(), matrix(asked["v"], n), strict=True):
            scores = accumulate(query, lists, len(own))
            best = best_first(scores, ids, unnamed, k + 1)  # one more: the query itself may be among them
            best = best[own[best] != uid][:k]
            found.append(best)
            scores_of.append(scores[best])
        at = np.repeat(np.arange(len(found)), [len(x) for x in found])
        best = np.concatenate([np.zeros(0, dtype=np.int64), *found])
        score = np.concatenate([np.zeros(0, dtype=np.int64), *scores_of])
        return pa.table({"query_uid": asked["uid"].take(at), "query_id": asked["vec_id"].take(at), "vec_id": rows["vec_id"].take(best), "score": score})

    return run


def exact_top_k(vectors: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256, query_numbers: int = 2**20, row_numbers: int = 2**22) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which `query` (a condition on vec_id) holds, the k other rows with the
    highest inner product of the vectors floor(scale * x)."""
    rows = integer_vectors(vectors, vec_id, embedding, scale=scale).drop("label")
    asked = rows.filter(query)
    found = score_grid(asked, rows, _search(k), "query_uid bigint, query_id bigint, vec_id bigint, score bigint", query_numbers, row_numbers)
    ranked = found.withColumn("rank", rank_by(["query_uid"], "score", "vec_id")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
