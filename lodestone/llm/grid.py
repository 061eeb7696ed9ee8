"""Queries against all rows in blocks: integer vectors, and the grid of block pairs that exhaustive scoring runs over.

Queries and rows are dealt into blocks of bounded size by a hash of their row number; each pair of a block of queries and
a block of rows is one group of one Arrow call. A query is sent once to each block of rows and a row once to each block of
queries, so what is shuffled grows with rows * (queries / query_block), not with the pairs. Only the few best of each group
leave it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialize

#: Integer components are held within this bound, so that a score of up to 4096 components, times 5, fits a long.
BOUND = 2**24


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str | None = None, scale: int = 256) -> DataFrame:
    """A written table (uid, vec_id, label, v) of the rows whose vector is not null and holds finite numbers only (with
    label: whose label isn't null either): v = floor(scale * x), x as double. uid numbers the rows; label is text."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = lambda x: F.greatest(F.least(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(BOUND)), F.lit(-BOUND)).cast("int")
    name = F.lit("") if label is None else F.col(label).cast("string")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), name.alias("label"), F.col(embedding).alias("e"))
    fit = rows.filter(F.coalesce(F.forall("e", finite), F.lit(False)) & F.col("label").isNotNull())
    return materialize(fit.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.transform("e", whole).alias("v")), "integer-vectors")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def width(*columns: pa.ChunkedArray) -> int:
    return max((int(c.combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for c in columns if len(c)), default=0)


def best_first(scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, ties to smaller ids, rows without an id (unnamed) last: the k-th score is found by
    partition, and only the rows that reach it are sorted."""
    if len(scores) > k:
        reach = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        reach = np.arange(len(scores))
    return reach[np.lexsort((ids[reach], unnamed[reach], -scores[reach]))[:k]]


def named(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and which of them are null (0 there)."""
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy()


def score_grid(queries: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, query_numbers: int = 2**20, row_numbers: int = 2**22) -> DataFrame:
    """What run gives for each pair of a block of queries and a block of rows; both have columns uid and v. A block holds
    about so many components of queries, and of rows. All columns of schema are bigint."""
    n_queries = queries.count()
    n_rows, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = max(1, -(-n_queries * max(widest, 64) // query_numbers))
    r = max(1, -(-n_rows * max(widest, 64) // row_numbers), min(-(-n_rows // 1024), 2 * tasks))
    parts = max(tasks, min(q * r, 50_000))
    block = lambda n, salt: F.pmod(F.xxhash64("uid", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("_q", block(q, 1)).withColumn("_r", each(r)).repartition(parts, "_q", "_r").groupBy("_q", "_r")
    # columns of its own for the second side: with shared ones, as queries come of rows, Spark prunes what it needs in a count()
    dealt = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("_r", block(r, 2)).withColumn("_q", each(q)).repartition(parts, "_q", "_r").groupBy("_q", "_r")
    nothing = pa.schema([(c.split()[0], pa.int64()) for c in schema.split(",")]).empty_table()
    return asked.cogroup(dealt).applyInArrow(lambda a, b: run(a, b) if len(a) and len(b) else nothing, schema)


def rank_by(keys: list[str], score: str, vec_id: str) -> Column:
    """Ranks from 1 of rows with the same keys: higher scores first, ties to smaller ids, null ids last."""
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(vec_id)))
