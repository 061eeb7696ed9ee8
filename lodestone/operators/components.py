"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import discard, materialize

HUB = 10_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach. Nodes without a link to another don't appear.

    Alternates the large-star and small-star steps, which keep the number of links from growing and need a logarithmic
    number of rounds. The minimum of a node's neighbours is aggregated before the shuffle. Hubs, nodes with more than one
    in HUB of all links (and 256 at least), are few by that definition: their minima are joined as a broadcast table of
    2 * HUB rows at most, so a hub's links stay spread over all tasks. Each round is written to the shared folder. Links
    with a null end are ignored.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = materialize(pairs.distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, mark[0]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "large-star")
        small = _with_least(large, mark[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = materialize(small, "small-star")
        discard(large)
        discard(now)
        now, last = after, mark
        mark = _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.toDF("node", "component").unionByName(roots.select("node", F.col("node").alias("component")))


def _with_least(links: DataFrame, n_links: int) -> DataFrame:
    """links (u, v) with m, the least v of each u."""
    hub = F.col("n") > max(256, n_links // HUB)
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(hub).select("u", "m"))
    others = links.join(hubs, "u", "left_anti").join(least.filter(~hub).select("u", "m"), "u")
    return others.unionByName(links.join(hubs, "u"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
