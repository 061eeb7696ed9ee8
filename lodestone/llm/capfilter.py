"""Near-duplicate vectors by spherical-cap filters.

Each vector, normalised and turned by a fixed random rotation, is cut into two halves; each half has a code of random
directions, and a filter is a pair of directions, one of each code. A vector is listed under all filters whose inner
product with it exceeds the cap threshold (and under its nearest few at least). The codes' sizes and the threshold
follow from the number of vectors, so that a vector is on about `lists` lists and a list holds about `bucket` vectors
that are not near each other. Vectors that share a filter are compared in double precision.

Lists above `block` vectors are compared block against block, so no task holds more than two blocks. A link is counted
in the least filter that its ends share, so only sums and links to local group leaders leave a task, not pairs. Inside the
computation a different vector of a label is named by a 64-bit hash of both; two meet with a probability of n^2 / 2^65.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link
with nothing; vectors of different length never link; equal vectors of a label are collapsed with their number and link
with each other; repeated vec_ids are different vectors that share an id; a null vec_id is counted but can't be a
component; empty tables give empty results; extra columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.runtime import materialize


@lru_cache(maxsize=8)
def _codes(dim: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rotation and the two codes for vectors of dim numbers; fixed by their sizes."""
    rng = np.random.RandomState(dim)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    half = max(1, dim // 2)
    codes = []
    for width in (half, max(1, dim - half)):
        c = rng.standard_normal((size, width))
        codes.append(c / (np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(2)))
    return turn, codes[0], codes[1]


def list_decode(x: np.ndarray, size: int, sigmas: float, least: int) -> list[np.ndarray]:
    """For each row of x (unit vectors), the sorted numbers of its filters: all above sigmas / sqrt(dim), or its best."""
    dim = x.shape[1]
    turn, one, two = _codes(dim, size)
    y = x @ turn
    a, b = y[:, : one.shape[1]] @ one.T, y[:, -two.shape[1] :] @ two.T
    cap = sigmas / math.sqrt(dim)
    row, i = np.nonzero(a >= (cap - b.max(axis=1))[:, None])  # only these can exceed the cap with some second direction
    hit, j = np.nonzero(b[row] >= (cap - a[row, i])[:, None])
    owner, filters = row[hit], i[hit] * size + j
    out = np.split(filters, np.searchsorted(owner, np.arange(1, len(x))))
    for k in np.flatnonzero(np.bincount(owner, minlength=len(x)) < least):
        top_a, top_b = np.argsort(-a[k])[:least], np.argsort(-b[k])[:least]  # the best sums lie among these
        sums = (a[k, top_a][:, None] + b[k, top_b][None, :]).ravel()
        best = np.argsort(-sums, kind="stable")[:least]
        out[k] = top_a[best // len(top_b)] * size + top_b[best % len(top_b)]
    return [np.sort(f).astype(np.int64) for f in out]


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decode(size: int, sigmas: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column("embedding")
            dims = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, -(-len(at) // 512)):
                    some = b.take(pa.array(part))
                    x = _unit(some.column("embedding").values.to_numpy(zero_copy_only=False).reshape(-1, dim))
                    lists = list_decode(x, size, sigmas, least)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists, type=pa.list_(pa.int64()))], names=[*b.schema.names, "filters"])

    return run


def _compare(threshold: float):
    def shared_before(mine: list, theirs: list, f: int, pairs: tuple) -> np.ndarray:
        """Which pairs share a filter below f."""
        known = np.unique(np.concatenate([x[x < f] for x in (*mine, *theirs)]))
        if not len(known):
            return np.zeros(len(pairs[0]), dtype=bool)

        def flags(lists: list) -> np.ndarray:
            out = np.zeros((len(lists), len(known)), dtype=np.float32)
            for r, x in enumerate(lists):
                out[r, np.searchsorted(known, x[x < f])] = 1
            return out

        return (flags(mine) @ flags(theirs).T)[pairs] > 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, last, f = pdf["low"].iat[0], pdf["high"].iat[0], int(pdf["filter"].iat[0])
        x = _unit(np.stack(pdf["embedding"].to_numpy()))
        ids, weight, lists = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), list(pdf["filters"])
        mine = np.flatnonzero(pdf["block"].to_numpy() == first)
        theirs = np.flatnonzero(pdf["block"].to_numpy() == last)
        near = (x[mine] @ x[theirs].T) >= threshold
        near &= ids[mine][:, None] != ids[theirs][None, :]
        r, c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(r):
            return pd.DataFrame({"rep": [], "links": [], "leader": []}).astype("int64")
        mine, theirs, near = mine[r], theirs[c], near[np.ix_(r, c)]
        pairs = np.nonzero(near)
        counted = near.copy()
        counted[pairs] = ~shared_before([lists[k] for k in mine], [lists[k] for k in theirs], f, pairs)
        n = len(pdf)
        sums, label = np.zeros(n, dtype=np.int64), np.arange(n)
        np.add.at(sums, mine, counted @ weight[theirs])
        if first != last:
            np.add.at(sums, theirs, counted.T @ weight[mine])
        while True:  # leaders of the local groups
            before = label.copy()
            np.minimum.at(label, mine, np.where(near, label[theirs][None, :], n).min(axis=1))
            np.minimum.at(label, theirs, np.where(near, label[mine][:, None], n).min(axis=0))
            if (label == before).all():
                break
        own = np.union1d(mine, theirs)
        return pd.DataFrame({"rep": ids[own], "links": sums[own], "leader": ids[label[own]]})

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", lists: int = 20, bucket: int = 32, least: int = 6, block: int = 512
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: links are pairs of one label with a cosine of threshold or more."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    good = rows.filter(fit).select("vec_id", "label", F.transform("embedding", lambda x: x + F.lit(0.0).cast("float")).alias("embedding"))
    same = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    same = materialize(same.withColumn("rep", F.xxhash64("label", "embedding")), "vectors")
    most = same.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    share = bucket / max(bucket * 8, most)  # of the vectors that pass a filter
    size = math.ceil(math.sqrt(lists / share))
    sigmas = -NormalDist().inv_cdf(share)
    schema = f"label {dict(same.dtypes)['label']}, rep bigint, n bigint, embedding {dict(same.dtypes)['embedding']}, filters array<bigint>"
    listed = materialize(same.select("label", "rep", "n", "embedding").mapInArrow(_decode(size, sigmas, least), schema), "lists")
    keyed = listed.select("label", F.size("embedding").alias("dim"), "rep", F.explode("filters").alias("filter"))
    counts = keyed.groupBy("label", "dim", "filter").agg(F.count("*").alias("members")).filter("members > 1")
    # narrow rows find out how many blocks each list has; the wide ones are dealt once
    blocks = F.ceil(F.col("members") / block).cast("int")
    places = keyed.join(counts.withColumn("blocks", blocks), ["label", "dim", "filter"]).groupBy("rep").agg(F.collect_list(F.struct("filter", "blocks")).alias("places"))
    dealt = (
        listed.join(places, "rep")
        .withColumns({"dim": F.size("embedding"), "place": F.explode("places")})
        .withColumns({"filter": F.col("place.filter"), "block": F.pmod("rep", F.col("place.blocks")).cast("int")})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("place.blocks") - 1)))
        .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    )
    pair = ["label", "dim", "filter", "low", "high"]
    found = dealt.select(*pair, "block", "rep", "n", "embedding", "filters").groupBy(*pair).applyInPandas(_compare(threshold), "rep bigint, links bigint, leader bigint")
    found = materialize(found, "found")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select("rep", "leader").distinct(), "rep", "leader")
    named = materialize(same.select(F.col("rep").alias("node"), "least").join(groups, "node"), "named")
    smallest = materialize(named.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")  # a plain join, which can be split
    named = named.join(smallest, "component").select(F.col("node").alias("rep"), "smallest")
    each = same.join(sums, "rep", "left").join(named, "rep", "left")
    each = each.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    linked = good.join(each, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
