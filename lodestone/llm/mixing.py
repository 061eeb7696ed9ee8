"""Mixing sources to target weights by a low-discrepancy schedule, in built-in functions throughout.

Each source's documents are put in a fixed shuffled order, by the MD5 of seed, id and text, and read as one stream of
words that begins anew when it ends; the stream is cut into blocks of equally many words. The mix has as many slots as
the targets have blocks. The k-th golden-ratio point, frac((k + 1) * phi), falls into one of the sources' intervals of
the unit line, whose lengths are the sources' shares of all targets, and so decides which source has slot k; any stretch
of the schedule holds all sources in proportion. The r-th slot of a source takes the r-th block of its stream. A slot
ends where its source's target is reached, so no source goes beyond its target. What the points leave of a source, a few
blocks or all of one smaller than a block, is taken by slots after them, in which each source's are spread evenly again; so
every source reaches its target, in whole words. k is the order of the mix.

Targets: `total` times the sum of all sizes, shared by weight; no target is above `most` times its source's size, and
the excess is reshared by weight among the others until none is above.

Running sums over a source's documents, and the ranks of the schedule, are taken in two steps: sums by ranges of the
order, a window over the ranges' sums, and a window inside each range; so a source with a third of all rows is spread
over all its ranges, whose number follows the number of rows. Equal rows are collapsed, with their number, before that.

Edge cases: a null text has size 0 and takes nothing; null is a source like others, the last; repeated rows are
documents of their own; a null id is kept; an empty table gives an empty result; texts of any length may be cut between
blocks; extra columns are dropped. Rows with equal MD5, id and source are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.words import n_words
from lodestone.runtime import materialize

PHI = 0.6180339887498949


def _before(value: str, *keys: str, order: list[str]) -> Column:
    """The sum of value over the rows before, in order, of the same keys."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_no, source_size, target) of each row (source, source_size) of sizes, one row for each source.

    The sources at their limit are those with the least limits by weight: a prefix of that order. The first place whose
    level, (what the limits before it leave) / (the weights from it on), is under its own limit by weight, sets the level.
    """
    everything = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))))
    s = s.withColumns({"w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1), "limit": most * F.col("source_size")})
    s = s.withColumns({"wanted": total * F.sum("source_size").over(everything), "all_w": F.sum("w").over(everything), "ratio": F.col("limit") / F.col("w")})
    order = ["ratio", "source_no"]
    left = F.col("wanted") - F.coalesce(F.sum("limit").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.col("all_w") - F.coalesce(F.sum("w").over(Window.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", left / free)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)["level"])
    return s.select("source", "source_no", "source_size", F.coalesce(F.least("limit", F.col("level") * F.col("w")), F.col("limit")).cast("double").alias("target"))


def block_size(words: int, slots: int = 1 << 20, least: int = 16, most: int = 4096) -> int:
    """Words of a block, for about so many slots where the bounds allow it."""
    return min(max(words // slots, least), most)


def schedule(sources: DataFrame, block_words: int, phi: float = PHI) -> DataFrame:
    """(k, source_no, slot): the source of each slot k of the mix, and the slot's rank among those of its source, from 0. The
    slots that the points don't give a source come last. sources has source_no and target."""
    plan = wanted = sources.select("source_no", F.floor("target").cast("long").alias("want")).filter("want > 0")
    seen = plan.agg(F.coalesce(F.sum("want"), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    cells = max(1024, 4 * seen["n"])  # of the unit line, for the join of points and intervals
    plan = plan.withColumn("high", F.sum("want").over(Window.partitionBy(F.lit(0)).orderBy("source_no")))
    plan = plan.select("source_no", ((F.col("high") - F.col("want")) / F.lit(float(seen["words"] or 1))).alias("low"), (F.col("high") / F.lit(float(seen["words"] or 1))).alias("high"))
    points = sources.sparkSession.range(-(-seen["words"] // block_words)).select(F.col("id").alias("k"), ((F.col("id") + 1) * F.lit(phi) % F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * cells).cast("long"))
    lines = plan.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells).cast("long"), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)).cast("long"))))
    drawn = points.join(lines, "cell").filter("u >= low and u < high").select("k", "source_no", F.shiftright("k", 12).alias("range"))
    drawn = drawn.withColumn("inside", F.row_number().over(Window.partitionBy("source_no", "range").orderBy("k")) - 1)
    counts = drawn.groupBy("source_no", "range").agg(F.count("*").alias("n"))
    before = counts.select("source_no", "range", _before("n", "source_no", order=["range"]).alias("before"))
    slots = drawn.join(before, ["source_no", "range"]).select("k", "source_no", (F.col("before") + F.col("inside")).cast("long").alias("slot"))
    have = F.coalesce("have", F.lit(0))
    short = wanted.join(counts.groupBy("source_no").agg(F.sum("n").alias("have")), "source_no", "left")
    short = short.select("source_no", have.alias("have"), (F.ceil(F.col("want") / block_words) - have).alias("missing")).filter("missing > 0")
    more = short.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("j") + 0.5) / F.col("missing"), "source_no"))
    more = more.select((place + (-(-seen["words"] // block_words) - 1)).cast("long").alias("k"), "source_no", (F.col("have") + F.col("j")).cast("long").alias("slot"))
    return slots.unionByName(more)


def place(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 7, per_range: int = 50_000
) -> tuple[DataFrame, DataFrame]:
    """The documents, (doc_id, source, source_no, h, size, n, start, source_size, target): n equal rows that follow each
    other from the word `start` of their source's order; and the sources, (source, source_no, source_size, target)."""
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.md5(told).alias("h"), n_words(F.col(text)).alias("size"))
    rows = materialize(each.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("n")), "sizes")
    rows = rows.withColumn("words", F.col("size") * F.col("n"))
    sources = materialize(targets(rows.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total, most), "sources")
    n_rows = rows.count()
    digits = next(d for d in range(2, 16) if 16**d * per_range >= n_rows)
    rows = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("range", F.substring("h", 1, digits))
    rows = rows.withColumn("inside", _before("words", "source_no", "range", order=["h", "doc_id", "size"]))
    ranges = rows.groupBy("source_no", "range").agg(F.sum("words").alias("n_words"))
    ranges = ranges.select("source_no", "range", _before("n_words", "source_no", order=["range"]).alias("before"))
    placed = rows.join(ranges, ["source_no", "range"]).withColumn("start", F.col("before") + F.col("inside"))
    return materialize(placed.select("doc_id", "source", "source_no", "h", "size", "n", "start", "source_size", "target"), "placed"), sources


def _single(placed: DataFrame) -> DataFrame:
    """A row for each document, with its own start and its number among equal rows."""
    step = 4096  # in two steps, so that no array grows with the number of equal rows
    one = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / step).cast("long"))))
    one = one.withColumn("copy", F.explode(F.sequence(F.col("copy") * step, F.least((F.col("copy") + 1) * step, "n") - 1)))
    return one.withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("n")


def blocks(sources: DataFrame, block_words: int, phi: float = PHI) -> DataFrame:
    """(k, source_no, pass, begin, end): the words of its source that slot k takes, a row for each stretch of it."""
    known = sources.filter("source_size > 0").select("source_no", F.floor("target").cast("long").alias("want"), "source_size")
    slots = schedule(sources, block_words, phi).join(known, "source_no").withColumns({"a": F.col("slot") * block_words, "b": F.least((F.col("slot") + 1) * block_words, "want")})
    turns = F.sequence(F.floor(F.col("a") / F.col("source_size")).cast("long"), F.floor((F.col("b") - 1) / F.col("source_size")).cast("long"))
    slots = slots.filter("a < b").withColumn("pass", F.explode(turns)).withColumn("base", F.col("pass") * F.col("source_size"))
    return slots.select("k", "source_no", "pass", (F.greatest("a", "base") - F.col("base")).alias("begin"), (F.least("b", F.col("base") + F.col("source_size")) - F.col("base")).alias("end"))


def _cells(begin: str, end: str, block_words: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(begin) / block_words).cast("long"), F.floor((F.col(end) - 1) / block_words).cast("long")))


def _words(sources: DataFrame) -> int:
    return int(sources.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0])


def mix(docs: DataFrame, block_words: int | None = None, phi: float = PHI, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row: taken counts the document's words in the mix."""
    placed, sources = place(docs, **options)
    block_words = block_words or block_size(_words(sources))
    taken = materialize(blocks(sources, block_words, phi).withColumn("cell", _cells("begin", "end", block_words)), "blocks")
    rows = _single(placed).withColumn("until", F.col("start") + F.col("size"))
    parts = rows.filter("size > 0").withColumn("cell", _cells("start", "until", block_words))
    own = ["doc_id", "source", "source_no", "size", "source_size", "target", "start"]
    low, high = F.greatest("start", "begin", F.col("cell") * block_words), F.least("until", "end", (F.col("cell") + 1) * block_words)
    joined = parts.join(taken.select("source_no", "cell", "begin", "end"), ["source_no", "cell"], "left")
    used = joined.groupBy(*own).agg(F.sum(F.when(F.col("begin").isNotNull(), F.greatest(high - low, F.lit(0))).otherwise(0)).cast("long").alias("taken"))
    out = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return used.select(*out).unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*out))


def mix_documents(docs: DataFrame, block_words: int | None = None, phi: float = PHI, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, part_words: int = 8_000_000, **options) -> DataFrame:
    """The rows of docs in the order of the mix, each as often as its middle word is taken, at the place of the slot that
    takes it; so texts stay whole. Texts without a word go."""
    placed, sources = place(docs, doc_id, text, source, seed=seed, **options)
    block_words = block_words or block_size(_words(sources))
    turns = F.sequence(F.lit(0).cast("long"), F.floor(F.col("target") / F.col("source_size")).cast("long"))
    rows = _single(placed.filter("size > 0")).withColumn("pass", F.explode(turns))
    rows = rows.withColumn("at", F.col("pass") * F.col("source_size") + F.col("start") + F.floor(F.col("size") / 2)).filter("at < floor(target)")
    rows = rows.withColumn("slot", F.floor(F.col("at") / block_words).cast("long"))
    def unique(h: Column, own: Column, of: Column) -> Column:
        return F.md5(F.concat_ws("|", h, F.coalesce(F.concat(F.lit("="), own.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit("="), of), F.lit(""))))

    key = unique(F.col("h"), F.col("doc_id"), F.col("source")).alias("_key")
    order = rows.join(schedule(sources, block_words, phi), ["source_no", "slot"]).groupBy(key, F.col("copy").alias("_copy"))
    order = order.agg(F.collect_list(F.struct("k", "at")).alias("_places"))  # a place for each pass
    told = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    # rows and their places are dealt together and paired by number inside a key, so the texts are shuffled once for it
    both = docs.withColumn("_key", unique(F.md5(told), F.col(doc_id), F.col(source))).unionByName(order, allowMissingColumns=True).repartition("_key")
    both = both.withColumn("_no", F.row_number().over(Window.partitionBy("_key", F.col("_places").isNull()).orderBy("_copy")))
    both = both.withColumn("_at", F.first("_places", ignorenulls=True).over(Window.partitionBy("_key", "_no")))
    found = both.filter("_places is null and _at is not null").withColumn("_place", F.explode("_at"))
    words = _words(sources)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // part_words)
    part = F.least(F.floor(F.col("_place.k") * parts / max(1, -(-words // block_words))), F.lit(parts - 1)).cast("int")
    return found.repartitionById(parts, part).sortWithinPartitions("_place").select(*docs.columns)
