"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Edge cases: a null text counts as empty; an empty text has no words and fails the base rules; repeated rows are judged
one by one; extra columns stay as they are, unless named like a result column, which is replaced. An empty table gives
an empty result.
"""

from __future__ import annotations

import operator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.words import SPACES, let, words

SYMBOLS = "#*$%&|<>"
# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in that it with for as was on be by is a an are this at "
    "le la les de du des un une et en que qui dans pour par au aux sur est "
    "der die das und ein eine zu den von mit ist im nicht auf sich "
    "el los las y se del con por una lo para es al"
).split()

OPS = {"<=": operator.le, ">=": operator.ge}


class Rule(NamedTuple):
    name: str
    feature: str
    op: str
    bound: float


#: A text is kept if all hold. Ratios are per word (symbols, stop words) or per line with a word (the line rules).
RULES = (
    Rule("mean_word_low", "mean_word", ">=", 2.0),
    Rule("mean_word_high", "mean_word", "<=", 20.0),
    Rule("symbols", "symbol_ratio", "<=", 0.25),
    Rule("stop_words", "stop_ratio", ">=", 0.02),
    Rule("dup_lines", "dup_line_ratio", "<=", 0.5),
    Rule("alpha_words", "alpha_ratio", ">=", 0.5),
)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice. Windows are compared by 64-bit hash within one text
    (two different windows of a text of n words agree by chance with probability n^2 / 2^65)."""
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    keyed = F.transform(
        starts,
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def twice(s: Column) -> Column:
        def same(x: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def cover(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + p + 3 - F.greatest(p, acc["end"])).cast("long").alias("n"), (p + 3).cast("int").alias("end"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    return F.aggregate(let(F.sort_array(keyed), twice), start, cover, lambda acc: acc["n"])


def features(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """One struct of counts: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop, n_alpha."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(bare).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*stop_words))).cast("long").alias("n_stop"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha"),
        )

    return let(words(text), of)


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with the counts, base_failed, kept, and failed_rules (names of the thresholds that were missed).

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not base_failed and no rule
    missed. One narrow projection: no shuffle, no user function.
    """
    out = docs.withColumn("_f", features(F.col(text)))
    f = F.col("_f")
    per_word = lambda x: x / F.greatest(f["n_words"], F.lit(1))
    values = {
        "mean_word": per_word(f["word_chars"]),
        "symbol_ratio": per_word(f["n_symbols"]),
        "stop_ratio": per_word(f["n_stop"]),
        "alpha_ratio": per_word(f["n_alpha"]),
        "dup_line_ratio": f["lines"]["dup"] / F.greatest(f["lines"]["n"], F.lit(1)),
    }
    missed = F.array_compact(F.array(*[F.when(~OPS[r.op](values[r.feature], F.lit(r.bound)), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    base = (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])
    passed = reduce(operator.and_, [OPS[r.op](values[r.feature], F.lit(r.bound)) for r in rules], F.lit(True))
    return out.withColumns(
        {
            "n_words": f["n_words"],
            "word_chars": f["word_chars"],
            "n_symbols": f["n_symbols"],
            "n_dup_lines": f["lines"]["dup"],
            "n_repeat_words": f["n_repeat_words"],
            "base_failed": base,
            "kept": ~base & passed,
            "failed_rules": missed,
        }
    ).drop("_f")
