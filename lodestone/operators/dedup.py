"""Exact and near-duplicate removal that decides in row order, as one pass over the rows would.

What a row's fate depends on is decided before it, and all that depends on nothing undecided is decided at once, in rounds
of joins; that gives the same result as one pass over all rows. Long chains, which would take many rounds, are cut off after
some and decided by connected component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import connected_components
from lodestone.runtime import materialize


def content_key(title: Column, content: Column) -> Column:
    return F.sha2(F.lower(F.trim(F.concat(F.coalesce(title, F.lit("")), F.lit("||"), F.coalesce(content, F.lit(""))))), 256)


def exact(docs: DataFrame, order: str = "row_index", doc_id: str = "document_id", title: str = "title", content: str = "content", rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed): a row goes if a kept row before it has its id or its content key; removed has order, id, reason
    (document_id before content). A null or empty id is no key.

    In each round the rows that are the first undecided ones of both their keys are kept, and the rows that share a key with
    them go; long runs of copies are decided in the first. Chains through alternating keys take a round for each of their
    links; those that are left after `rounds` of them are decided component by component.
    """
    key_a = F.when(F.coalesce(F.col(doc_id), F.lit("")) != "", F.col(doc_id))
    keyed = materialize(docs.select(F.col(order).alias("o"), key_a.alias("a"), content_key(F.col(title), F.col(content)).alias("b")), "dedup-keys")
    parts, open_rows = [], keyed
    for _ in range(rounds):
        # minima are aggregated before the shuffle and written, so that the joins are plain ones, whose hot keys can be split
        least = {k: materialize(open_rows.groupBy(F.col(k).alias("k")).agg(F.min("o").alias(f"f{k}")).filter("k is not null"), f"least-{k}") for k in ("a", "b")}
        both = open_rows
        for k, table in least.items():
            both = both.join(table, F.col(k) == F.col("k"), "left").drop("k").withColumn(f"f{k}", F.coalesce(f"f{k}", "o"))
        both = materialize(both, "dedup-first")
        sure = both.filter("o = fa and o = fb").select("o", "a", "b")
        parts.append(sure)
        rest = both.join(sure.select(F.col("o").alias("fa")), "fa", "left_anti").join(sure.select(F.col("o").alias("fb")), "fb", "left_anti")
        open_rows = materialize(rest.select("o", "a", "b"), "dedup-open")
        if open_rows.isEmpty():
            break
    else:
        parts.append(_keep_in_order(open_rows))
    kept = parts[0]
    for more in parts[1:]:
        kept = kept.unionByName(more)
    kept = materialize(kept, "dedup-kept")
    gone = keyed.join(kept.select("o"), "o", "left_anti").join(kept.select("a", F.col("o").alias("first")).filter("a is not null"), "a", "left")
    reason = F.when(F.col("first") < F.col("o"), "document_id").otherwise("content")
    removed = materialize(gone.select("o", "a", reason.alias("reason")), "dedup-removed")
    return docs.join(removed.select(F.col("o").alias(order)), order, "left_anti"), removed.toDF(order, doc_id, "reason")


def _keep_in_order(rows: DataFrame) -> DataFrame:
    """The rows (o, a, b) that one pass keeps, each component of rows with common keys on its own."""
    links = [rows.select("o", F.col(k).alias("k")).join(rows.groupBy(F.col(k).alias("k")).agg(F.min("o").alias("y")), "k").select(F.col("o").alias("x"), "y") for k in ("a", "b")]
    groups = connected_components(links[0].unionByName(links[1]), "x", "y")
    kinds = dict(rows.dtypes)

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, keys, out = set(), set(), []
        for r in pdf.sort_values("o").itertuples():
            if (r.a is None or r.a not in ids) and r.b not in keys:
                ids.add(r.a)
                keys.add(r.b)
                out.append((r.o, r.a, r.b))
        return pd.DataFrame(out, columns=["o", "a", "b"])

    joined = rows.join(groups, F.col("o") == F.col("node"), "left").withColumn("component", F.coalesce("component", "o"))
    return joined.select("o", "a", "b", "component").groupBy("component").applyInPandas(decide, f"o {kinds['o']}, a {kinds['a']}, b {kinds['b']}")


def first_per_document(hits: DataFrame, query: str = "query_id", doc: str = "document_id", rank: str = "rank") -> DataFrame:
    best = Window.partitionBy(query, doc).orderBy(rank)
    return hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


# --- near duplicates ---------------------------------------------------------


def _signatures(bands: int, bits: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, weights = {}, 1 << np.arange(bits)
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["unit"].map(len)):
                if dim not in planes:
                    planes[dim] = np.random.RandomState(seed).standard_normal((dim, bands * bits))
                signs = (np.stack(part["unit"].to_numpy()) @ planes[dim]) > 0
                keys = (signs.reshape(len(part), bands, bits) * weights).sum(axis=2)
                yield part.assign(keys=list(keys.astype(np.int64)))

    return run


def near_pairs(docs: DataFrame, threshold: float = 0.95, order: str = "row_index", embedding: str = "embedding", bands: int = 24, bits: int = 10, block: int = 1024, seed: int = 11) -> DataFrame:
    """(i, j, sim) with i < j: pairs of rows whose cosine is at least the threshold.

    Candidates share the signs of `bits` random projections in one of `bands` bands: at a cosine of 0.95 a pair agrees on
    a band with probability 0.34 and is missed with probability 0.00004. Large bands are compared block against block.
    Only vectors of the same length are compared; those that are null, zero or hold a null are near none.
    """
    fit = docs.filter(F.exists(embedding, lambda x: x != 0) & F.forall(embedding, lambda x: x.isNotNull())).select(F.col(order).alias("o"), F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    units = fit.select("o", F.transform("v", lambda x: x / norm).alias("unit"))
    signed = materialize(units.mapInPandas(_signatures(bands, bits, seed), "o bigint, unit array<double>, keys array<bigint>"), "signatures")
    keyed = signed.select("o", "unit", F.posexplode("keys").alias("band", "key")).withColumn("band", F.col("band") + bands * F.size("unit"))
    counts = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = keyed.join(counts, ["band", "key"]).withColumns({"blk": F.pmod(F.xxhash64("o"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    dealt = dealt.select("band", "key", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "o", "unit")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, o, blk = np.stack(pdf["unit"].to_numpy()), pdf["o"].to_numpy(), pdf["blk"].to_numpy()
        mine, theirs = np.flatnonzero(blk == pdf["lo"].iat[0]), np.flatnonzero(blk == pdf["hi"].iat[0])
        sims = x[mine] @ x[theirs].T
        r, c = np.nonzero(sims >= threshold)
        i, j = o[mine[r]], o[theirs[c]]
        keep = i != j
        out = pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "sim": sims[r, c][keep]})
        return out.drop_duplicates(["i", "j"])

    found = dealt.groupBy("band", "key", "lo", "hi").applyInPandas(compare, "i bigint, j bigint, sim double")
    return found.groupBy("i", "j").agg(F.max("sim").alias("sim"))


def near(docs: DataFrame, threshold: float = 0.95, order: str = "row_index", doc_id: str = "document_id", content: str = "content", embedding: str = "embedding", rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed): in row order, of each near pair the one with the longer content stays, a tie keeps the
    earlier; a row that loses stops looking. removed has (removed, kept, sim).

    A pair takes place unless one of its rows lost in a pair before it. In each round the pairs that no undecided pair before
    them can stop take place, all at once, and the pairs after them of the rows that lost go; a group in which all are near
    each other is decided in few rounds. What is left after `rounds` of them is decided component by component."""
    pairs = near_pairs(docs, threshold, order, embedding)
    sizes = docs.select(F.col(order).alias("o"), F.char_length(F.coalesce(content, F.lit(""))).alias("size"))
    sized = pairs.join(sizes.toDF("i", "si"), "i").join(sizes.toDF("j", "sj"), "j")
    loser, winner = F.when(F.col("si") < F.col("sj"), F.col("i")).otherwise(F.col("j")), F.when(F.col("si") < F.col("sj"), F.col("j")).otherwise(F.col("i"))
    open_pairs = materialize(sized.select(F.struct("i", "j").alias("p"), loser.alias("removed"), winner.alias("kept"), "sim"), "near-pairs")
    parts = []
    for _ in range(rounds):
        if open_pairs.isEmpty():
            break
        first = materialize(open_pairs.groupBy("removed").agg(F.min("p").alias("m")), "first-losses")
        stop = lambda end: first.select(F.col("removed").alias(end), F.col("m").alias(f"m_{end}"))  # noqa: E731, B023
        ready = open_pairs.join(stop("removed"), "removed").join(stop("kept"), "kept", "left").filter((F.col("p") == F.col("m_removed")) & F.coalesce(F.col("p") <= F.col("m_kept"), F.lit(True)))
        ready = materialize(ready.select("p", "removed", "kept", "sim"), "lost")
        parts.append(ready.select("removed", "kept", "sim"))
        gone = lambda end: ready.select(F.col("removed").alias(end), F.col("p").alias(f"g_{end}"))  # noqa: E731, B023
        rest = open_pairs.join(gone("removed"), "removed", "left").join(gone("kept"), "kept", "left")
        rest = rest.filter(F.coalesce(F.col("p") < F.col("g_removed"), F.lit(True)) & F.coalesce(F.col("p") < F.col("g_kept"), F.lit(True)))
        open_pairs = materialize(rest.select("p", "removed", "kept", "sim"), "near-open")
    if not open_pairs.isEmpty():
        parts.append(_lose_in_order(open_pairs))
    lost = open_pairs.select("removed", "kept", "sim").filter("false")
    for more in parts:
        lost = lost.unionByName(more)
    removed = materialize(lost.select("removed", "kept", F.round("sim", 4).alias("sim")), "near-removed")
    return docs.join(removed.select(F.col("removed").alias(order)), order, "left_anti"), removed


def _lose_in_order(pairs: DataFrame) -> DataFrame:
    """(removed, kept, sim) of the pairs (p, removed, kept, sim) that take place, each component on its own."""
    groups = connected_components(pairs.select("removed", "kept"), "removed", "kept")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        gone, out = set(), []
        for r in pdf.sort_values(["i", "j"]).itertuples():
            if r.removed not in gone and r.kept not in gone:
                gone.add(r.removed)
                out.append((r.removed, r.kept, r.sim))
        return pd.DataFrame(out, columns=["removed", "kept", "sim"])

    held = pairs.join(groups.toDF("removed", "component"), "removed").select("component", "p.i", "p.j", "removed", "kept", "sim")
    return held.groupBy("component").applyInPandas(decide, "removed bigint, kept bigint, sim double")
