"""Exact percentiles by selection: no task holds or sorts a group.

The values of each group are counted in buckets of equal width between its least and greatest value; the bucket that holds
a wanted rank is the new range, and so on, until a range holds few values or equal ones only. Each round reads the values
once and shuffles counts, a bounded number for each group and rank; as a range ends at values that are there, it loses some
in every round, and mostly all but a thousandth. Only the few values of the last ranges are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import discard, materialize


def _same(a: Sequence[str], b: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b, strict=True)], F.lit(True))


def percentiles(rows: DataFrame, wanted: Mapping[str, tuple[Column, float]], by: Sequence[str] = (), buckets: int = 1024, few: int = 4096, by_rank: bool = False) -> DataFrame:
    """(by..., and a column for each name of wanted): wanted[name] is a value and a share from 0 to 1. As Spark's percentile():
    linear between neighbours, nulls don't count, null where a group has no value. Groups may have null keys. by_rank: the value
    that floor(share * n) of the n values come before."""
    names, keys = list(wanted), [f"_k{i}" for i in range(len(by))]
    values = {str(c): c for c, _ in wanted.values()}  # names that share a value are selected together
    number = {text: i for i, text in enumerate(values)}
    listed = F.array(*[F.struct(F.lit(i).alias("_v"), values[t].cast("double").alias("_x")) for t, i in number.items()])
    each = materialize(rows.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], F.inline(listed)).filter("_x is not null"), "values")
    group = [*keys, "_v"]
    sizes = each.groupBy(*group).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    shares = F.array(*[F.struct(F.lit(j).alias("_w"), F.lit(float(p)).alias("_p")) for j, (_, p) in enumerate(wanted.values())])
    of = F.array(*[F.lit(number[str(c)]) for c, _ in wanted.values()])
    asked = sizes.select(*group, "_n", "_lo", "_hi", F.inline(shares)).filter(F.get(of, F.col("_w")) == F.col("_v"))
    at = F.least(F.floor(F.col("_p") * F.col("_n")), F.col("_n") - 1).cast("double") if by_rank else F.col("_p") * (F.col("_n") - 1)
    asked = asked.withColumn("_at", at).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    state = materialize(asked.select(*group, "_w", "_at", "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_in")), "ranks")
    part = [*[f"_r{k}" for k in group], "_a", "_b"]

    def within(ranges: DataFrame) -> DataFrame:
        """The values of the ranges: part names a range."""
        named = ranges.select(*[F.col(c).alias(p) for c, p in zip([*group, "_lo", "_hi"], part, strict=True)]).distinct()
        return each.join(named, _same(group, part[:-2]) & F.col("_x").between(F.col("_a"), F.col("_b"))).select(*part, "_x")

    wide = (F.col("_in") > few) & (F.col("_lo") < F.col("_hi"))
    while not (open_now := state.filter(wide)).isEmpty():
        cell = F.least(F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * buckets), F.lit(buckets - 1))
        cells = within(open_now).groupBy(*part, cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
        until = F.sum("_c").over(Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("_until", until)
        inside = (F.col("_rank") - F.col("_before") < F.col("_until")) & (F.col("_rank") - F.col("_before") >= F.col("_until") - F.col("_c"))
        met = open_now.join(cells, _same([*group, "_lo", "_hi"], part) & inside)
        met = met.select(*group, "_w", "_at", "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_before") + F.col("_until") - F.col("_c")).alias("_before"), F.col("_c").alias("_in"))
        after = materialize(state.filter(~wide).unionByName(met), "ranks")
        discard(state)
        state = after
    rest = state.filter("_lo < _hi")
    sorted_ = within(rest).withColumn("_no", F.row_number().over(Window.partitionBy(*part).orderBy("_x")) - 1)
    found = rest.join(sorted_, _same([*group, "_lo", "_hi"], part) & (F.col("_rank") - F.col("_before") == F.col("_no")))
    take = [*keys, "_w", "_at", "_rank"]
    one = found.select(*take, "_x").unionByName(state.filter("_lo = _hi").select(*take, F.col("_lo").alias("_x")))
    share = F.when(F.floor("_at") == F.ceil("_at"), 1.0).when(F.col("_rank") == F.floor("_at"), F.ceil("_at") - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    mean = one.groupBy(*keys, "_w").agg(F.sum(F.col("_x") * share).alias("_y"))
    out = mean.groupBy(*keys).agg(*[F.max(F.when(F.col("_w") == j, F.col("_y"))).alias(name) for j, name in enumerate(names)])
    groups = rows.select(*[F.col(b) for b in by]).distinct() if by else rows.sparkSession.range(1).select()
    return groups.join(out, _same(by, keys), "left").select(*by, *names) if by else groups.join(out, how="left").select(*names)


def with_percentiles(rows: DataFrame, aggregates: Sequence[Column], wanted: Mapping[str, tuple[Column, float]], by: Sequence[str] = ()) -> DataFrame:
    """rows.groupBy(by).agg(aggregates) with the percentiles."""
    plain = rows.groupBy(*by).agg(*aggregates)
    if not by:
        return plain.join(percentiles(rows, wanted), how="left")
    right = percentiles(rows, wanted, by).select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], *wanted)
    return plain.join(right, _same(by, [f"_g{i}" for i in range(len(by))])).select(*plain.columns, *wanted)
